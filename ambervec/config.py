"""Settings of the engine's parts."""

from __future__ import annotations

from dataclasses import dataclass, field

PAGE_SIZE = 4096


@dataclass(frozen=True)
class GraphConfig:
    max_degree: int = 16
    alpha: float = 1.2
    candidates: int = 100
    rule: str = "fill"
    seed: int = 42


@dataclass(frozen=True)
class PqConfig:
    subspaces: int = 8
    codes: int = 256
    iterations: int = 25
    sample: int = 100_000
    seed: int = 42


@dataclass(frozen=True)
class SearchConfig:
    k: int = 10
    ef: int = 50
    beam_width: int = 16
    adc_factor: float = 4.0


@dataclass(frozen=True)
class CacheConfig:
    capacity: int = 100
    hot_ratio: float = 0.3
    hub_percentile: float = 0.75
    hub_threshold: int = 2
    scan: int = 10


@dataclass(frozen=True)
class LogConfig:
    rows_per_segment: int = 10_000
    tables_to_compact: int = 2
    most_tables: int = 4
    level_bytes: int = 1 << 20
    level_factor: int = 10


@dataclass(frozen=True)
class EngineConfig:
    dimension: int = 128
    memory_low: float = 0.10
    memory_high: float = 0.20
    graph: GraphConfig = field(default_factory=GraphConfig)
    pq: PqConfig = field(default_factory=PqConfig)
    search: SearchConfig = field(default_factory=SearchConfig)
    cache: CacheConfig = field(default_factory=CacheConfig)
    log: LogConfig = field(default_factory=LogConfig)


def sift1m() -> EngineConfig:
    """Preset for 128-dimensional data with a memory limit of 20 %."""
    return EngineConfig(dimension=128, memory_high=0.20)
