"""Operator 8: audio features of media columns."""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_slices, documents

RATE_IN, RATE_OUT = 16_000, 8_000
FRAME, HOP, MELS, CLIP = 256, 128, 16, 64  # samples, samples, bands, frames a tensor
LOUD, QUIET = 0.35, 0.15  # hysteresis, in shares of the text's energy range



# ------------------------------------------------------------- media form


def padded(raw: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of 64."""
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def to_wav(payload: bytes, rate: int = RATE_IN) -> bytes:
    """8-bit mono PCM in a RIFF/WAVE file; the samples are the bytes themselves."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    body = b"WAVE" + fmt + struct.pack("<4sI", b"data", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def from_wav(media: bytes) -> tuple[bytes, int]:
    """(samples, rate) of an 8-bit mono PCM file; other media raise ValueError."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, rate = 12, None
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is read")
        elif name == b"data" and rate is not None:
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


# --------------------------------------------------------------- features


@lru_cache(8)
def _filter(up: int, down: int, taps: int = 8) -> np.ndarray:
    """Polyphase branches (up, taps) of a windowed-sinc low pass."""
    n = np.arange(up * taps) - (up * taps - 1) / 2
    cut = 1 / max(up, down)
    h = np.sinc(n * cut) * np.hamming(up * taps) * cut * up
    return (h / h.sum() * up).reshape(taps, up).T[:, ::-1].astype(np.float32).copy()


def resample(x: np.ndarray, rate_in: int, rate_out: int) -> np.ndarray:
    """Polyphase resampling: output k is one branch's product with the samples around it."""
    g = np.gcd(rate_in, rate_out)
    up, down = rate_out // g, rate_in // g
    if up == down:
        return x
    branch = _filter(int(up), int(down))
    taps = branch.shape[1]
    n = -(-len(x) * up // down)
    pad = np.concatenate([np.full(taps // 2, x[0], np.float32), x, np.full(taps, x[-1], np.float32)])
    seen = np.lib.stride_tricks.sliding_window_view(pad, taps)
    out = np.empty(n, np.float32)
    for p in range(up):
        k = np.arange(p, n, up)  # outputs whose phase is the same
        phase = p * down % up
        at = k * down // up
        out[p::up] = seen[at[0] :: down][: len(k)] @ branch[phase]
    return out


@lru_cache(4)
def _mel(rate: int, size: int, bands: int) -> np.ndarray:
    """Triangular filters on the mel scale (size // 2 + 1, bands)."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edge = 700 * (10 ** (np.linspace(0, top, bands + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, size // 2 + 1)[:, None]
    rise, fall = (f - edge[:-2]) / (edge[1:-1] - edge[:-2]), (edge[2:] - f) / (edge[2:] - edge[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


_WINDOW = np.hanning(FRAME + 1)[:-1].astype(np.float32)


def log_mel(x: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """(frames, MELS) log-mel energies of overlapped frames, and log energies of the frames."""
    n = max(1, -(-max(len(x) - FRAME, 0) // HOP) + 1)
    pad = np.zeros((n - 1) * HOP + FRAME, np.float32)
    pad[: len(x)] = x
    mel, loud = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(pad, FRAME)[::HOP]
    for lo in range(0, n, 1024):
        spec = np.fft.rfft(frames[lo : lo + 1024] * _WINDOW)
        power = (spec.real**2 + spec.imag**2).astype(np.float32)
        mel[lo : lo + 1024] = np.log(power @ _mel(rate, FRAME, MELS) + 1e-6)
        loud[lo : lo + 1024] = np.log(power.sum(1) + 1e-6)
    return mel, loud


def segments(loud: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames that rise over the upper and end below the lower threshold."""
    lo, hi = float(loud.min()), float(loud.max())
    if hi - lo < 1e-6:
        return [(0, len(loud))]
    on, off = loud >= lo + LOUD * (hi - lo), loud < lo + QUIET * (hi - lo)
    # state after each frame: the last decision made up to it
    said = np.where(on, 1, np.where(off, -1, 0))
    last = np.maximum.accumulate(np.where(said != 0, np.arange(len(said)), -1))
    state = (last >= 0) & (said[np.maximum(last, 0)] == 1)
    edge = np.flatnonzero(np.diff(state.astype(np.int8), prepend=0, append=0))
    return [(int(a), int(b)) for a, b in edge.reshape(-1, 2)]


def store(docs: DataFrame, column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded with bytes 0 to a
    positive multiple of 64, as the samples of a WAV file. Null texts are empty."""

    def run(batches):
        for batch in batches:
            for part in batch_slices(batch, column, 8 << 20):
                raw = part.column(column).cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array([len(r or b"") for r in raw], pa.int64()), pa.array([to_wav(padded(r or b"")) for r in raw], pa.binary())],
                    ["doc_id", "n_bytes", "media"],
                )

    return docs.select("doc_id", column).mapInArrow(run, "doc_id long, n_bytes long, media binary")


TENSOR_SHAPE = (CLIP, MELS)
TENSORS = pa.schema([("start_s", pa.float64()), ("end_s", pa.float64()), ("log_mel", pa.fixed_shape_tensor(pa.float32(), list(TENSOR_SHAPE)))])
AUDIO = "payload_bytes long, payload binary, rate int, n_tensors int, tensors binary, segments array<struct<start_s:double,end_s:double>>"


def write_tensors(clips: np.ndarray, start_s: np.ndarray, end_s: np.ndarray) -> bytes:
    """An Arrow IPC stream of one batch: time spans and fixed-shape tensors (n, 64, 16)."""
    flat = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(clips, np.float32).ravel()), CLIP * MELS)
    batch = pa.record_batch([pa.array(start_s, pa.float64()), pa.array(end_s, pa.float64()), pa.ExtensionArray.from_storage(TENSORS.field("log_mel").type, flat)], schema=TENSORS)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, TENSORS) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(stored: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tensors (n, 64, 16), start_s, end_s) of a stored stream."""
    table = pa.ipc.open_stream(stored).read_all().combine_chunks()
    tensors = table.column("log_mel").chunk(0).to_numpy_ndarray()
    return tensors, table.column("start_s").to_numpy(), table.column("end_s").to_numpy()


def audio_features(media: DataFrame, column: str = "media", payload: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Features read from stored 8-bit WAV files.

    Adds the samples read back (``payload``), ``tensors``: log-mel tensors of the
    fixed shape (64 frames, 16 bands) with the time span of each (the last one
    filled with its floor value), as an Arrow IPC stream whose log_mel column has
    Arrow's fixed-shape tensor type (`read_tensors` opens it), their number, and the
    spans that hysteresis on the frame energies finds. Resampling is polyphase,
    frames overlap by half. Each file is computed on its own, so equal files give
    equal values wherever they lie. Null media give null features; other broken
    media fail with a ValueError. Columns of the input (or those in ``keep``) are
    kept unless they bear a name of the output. Empty table: no rows.
    """
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(AUDIO)
    names = [c for c in (media.columns if keep is None else keep) if c not in new.names]
    schema = StructType([*media.select(*names).schema.fields, *new.fields])
    arrow = _arrow(AUDIO)

    def one(raw: bytes | None) -> dict | None:
        if raw is None:
            return dict.fromkeys(new.names)
        got, rate = from_wav(raw)
        x = np.frombuffer(got, np.uint8).astype(np.float32)
        y = resample((x - 128) / 128, rate, RATE_OUT)
        mel, loud = log_mel(y, RATE_OUT)
        second = HOP / RATE_OUT
        n = -(-len(mel) // CLIP)
        full = np.full((n * CLIP, MELS), np.float32(np.log(1e-6)))
        full[: len(mel)] = mel
        total, at = len(y) / RATE_OUT, np.arange(n + 1) * CLIP * second
        tensors = write_tensors(full, at[:-1], np.minimum(total, at[1:]))
        spans = [{"start_s": a * second, "end_s": min(total, ((b - 1) * HOP + FRAME) / RATE_OUT)} for a, b in segments(loud)]
        return {"payload_bytes": len(got), "payload": got if payload else None, "rate": rate, "n_tensors": n, "tensors": tensors, "segments": spans}

    def run(batches):
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                rows, size = [], 0
                while at < batch.num_rows and len(rows) < 256 and size < 8 << 20:
                    raw = batch.column(column)[at].as_py()
                    rows.append(one(raw))
                    size += len(raw or b"")
                    at += 1
                part = batch.slice(at - len(rows), len(rows))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), *(pa.array([r[f.name] for r in rows], f.type) for f in arrow)], [*names, *new.names]
                )

    return media.mapInArrow(run, schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def digests(features: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in ``keep`` and ``feature``: number and seconds of the segments,
    number of tensors, and a digest of every log-mel value of every stored tensor in
    hundredths. Null features give a null digest."""
    schema = features.select(*keep).schema.add("feature", "string")

    def one(spans: list | None, stored: bytes | None) -> str | None:
        if stored is None:
            return None
        mel, _, _ = read_tensors(stored)
        loud = sum(x["end_s"] - x["start_s"] for x in spans)
        return f"{len(spans)};{loud:.3f};{len(mel)};{hashlib.sha256(np.round(mel * 100).astype('<i4').tobytes()).hexdigest()}"

    def run(batches):
        for batch in batches:
            got = [one(s.as_py(), t.as_py()) for s, t in zip(batch.column("segments"), batch.column("tensors"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(got, pa.string())], [*keep, "feature"])

    return features.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = audio_features(store(documents(spark, sf_dir)))
    tail = F.expr("substring(payload, greatest(1, length(payload) - 63), 64)")
    got = got.select(
        "doc_id", "n_bytes", "payload_bytes", F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "segments", "tensors",
    )
    return digests(got, [c for c in got.columns if c not in ("segments", "tensors")])
