"""Bloom filters of 1024 bits over ids, as sorted arrays of set bits, and page checksums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..config import PAGE_SIZE
from .vectors import _c

BITS = 1024


def bloom_bits(node_id) -> Column:
    """The three bits of an id: id, 31 id + 7 and 37 id + 13, modulo 1024."""
    x = _c(node_id).cast("long")
    return F.array(F.pmod(x, F.lit(BITS)), F.pmod(x * 31 + 7, F.lit(BITS)), F.pmod(x * 37 + 13, F.lit(BITS)))


def bloom_agg(node_id) -> Column:
    """Aggregate: the filter of a group's ids; at most 1024 bits whatever the group's size."""
    a, b, c = (F.collect_set(F.get(bloom_bits(node_id), F.lit(i))) for i in range(3))
    return F.array_sort(F.array_union(F.array_union(a, b), c))


def might_contain(bloom, node_id) -> Column:
    """Whether all of an id's bits are set; an empty filter says yes."""
    bloom = _c(bloom)
    return (F.coalesce(F.size(bloom), F.lit(0)) <= 0) | F.forall(bloom_bits(node_id), lambda bit: F.array_contains(bloom, bit))


@F.arrow_udf(IntegerType())
def page_checksum(page: pa.Array) -> pa.Array:
    """Fletcher checksum modulo 255 over a page's first 4092 bytes; shorter pages are filled with zeros."""
    n = PAGE_SIZE - 4
    col = page.cast(pa.large_binary())
    if not len(col):
        return pa.array([], pa.int32())
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    size = np.where(col.is_valid().to_numpy(zero_copy_only=False), np.minimum(np.diff(off), n), 0)
    upto = np.cumsum(size)
    place = np.arange(upto[-1]) - np.repeat(upto - size, size)  # in its page
    data = np.frombuffer(col.buffers()[2], np.uint8)[np.repeat(off[:-1], size) + place].astype(np.int64) if upto[-1] else np.zeros(0, np.int64)
    run = np.zeros((2, len(data) + 1), np.int64)
    np.cumsum(data, out=run[0, 1:])
    np.cumsum(data * (n - place), out=run[1, 1:])
    plain, weighted = (run[:, upto] - run[:, upto - size]) % 255
    return pa.array((weighted << 8 | plain).astype(np.int32), mask=~col.is_valid().to_numpy(zero_copy_only=False))


def with_checksum(page) -> Column:
    """The page filled to 4096 bytes, its last four holding the checksum (little-endian)."""
    page = _c(page)
    body = F.expr("unhex(repeat('00', 4092))")
    filled = F.substring(F.concat(page, body), 1, PAGE_SIZE - 4)
    sum_hex = F.lpad(F.hex(page_checksum(page)), 8, "0")
    ends = F.concat(*(F.substring(sum_hex, k, 2) for k in (7, 5, 3, 1)))
    return F.concat(filled, F.unhex(ends))


def checksum_holds(page) -> Column:
    page = _c(page)
    return with_checksum(F.substring(page, 1, PAGE_SIZE - 4)) == page
