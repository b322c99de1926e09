"""Column builders over vectors (ARRAY<FLOAT>). All sums are in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import PAGE_SIZE


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _same_size(a: Column, b: Column, value: Column) -> Column:
    """``zip_with`` would pad the shorter vector with nulls; refuse instead."""
    wrong = F.raise_error(F.concat(F.lit("dimension mismatch: "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string")))
    return F.when(F.size(a) == F.size(b), value).when(a.isNull() | b.isNull(), F.lit(None).cast("double")).otherwise(wrong.cast("double"))


def l2_squared(a, b) -> Column:
    """Sum of squared differences; vectors of different size are an error."""
    a, b = _c(a), _c(b)
    return _same_size(a, b, _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def l2_distance(a, b) -> Column:
    return F.sqrt(l2_squared(a, b))


def dot(a, b) -> Column:
    a, b = _c(a), _c(b)
    return _same_size(a, b, _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))))


def inner_product_distance(a, b) -> Column:
    """Negated inner product: smaller is nearer."""
    return -dot(a, b)


def norm(v) -> Column:
    return F.sqrt(_sum(F.transform(_c(v), lambda x: x.cast("double") * x.cast("double"))))


def cosine_distance(a, b) -> Column:
    """1 - cosine; 1.0 where either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.lit(1.0) - dot(a, b) / n)


METRICS = {"l2": l2_distance, "l2_squared": l2_squared, "ip": inner_product_distance, "cosine": cosine_distance}


def normalize_l2(v) -> Column:
    """Unit length; vectors of norm up to 1e-8 stay as they are."""
    v = _c(v)
    n = norm(v)
    return F.when(n > 1e-8, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def subvector(v, j: int, width: int) -> Column:
    """Elements j*width to (j+1)*width of a vector."""
    return F.slice(_c(v), j * width + 1, width)


def is_valid(v, dimension: int | None = None) -> Column:
    """Not null, not empty, of the dimension if one is given, and finite throughout."""
    v = _c(v)
    ok = v.isNotNull() & (F.size(v) > 0)
    if dimension is not None:
        ok = ok & (F.size(v) == dimension)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(ok & ~bad, F.lit(False))


def record_offset(node_id) -> Column:
    """Byte offset of a record in a file of one page a record; also its page's start."""
    return _c(node_id).cast("long") * PAGE_SIZE


def page_of(node_id) -> Column:
    return F.floor(record_offset(node_id) / PAGE_SIZE).cast("long")


def record_bytes(neighbours, dimension: int = 128, subspaces: int = 8) -> Column:
    """Used bytes of a record: header 32, vector, 4 a neighbour id, and its codes."""
    n = F.coalesce(F.size(_c(neighbours)), F.lit(0))
    return F.lit(32 + 4 * dimension) + n * (4 + subspaces)


def record_utilization(neighbours, dimension: int = 128, subspaces: int = 8) -> Column:
    return record_bytes(neighbours, dimension, subspaces) / F.lit(float(PAGE_SIZE))


def neighbour_code(codes, position: int, subspaces: int = 8) -> Column:
    """The inlined code of the neighbour at a 0-based position."""
    return F.slice(_c(codes), position * subspaces + 1, subspaces)
