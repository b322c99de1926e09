"""Product-quantisation expressions. A codebook is ARRAY<ARRAY<ARRAY<DOUBLE>>>:
subspace, code, element. Codes are ARRAY<SMALLINT>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import _c


def _part(v: Column, j: Column, width: Column) -> Column:
    return F.slice(v, j * width + 1, width)


def _squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def nearest_code(part: Column, centroids: Column) -> Column:
    """Index of the nearest centroid; the first one wins ties."""
    d = F.transform(centroids, lambda c: _squared(part, c))
    return (F.array_position(d, F.array_min(d)) - 1).cast("smallint")


def encode(v, codebook) -> Column:
    v, book = _c(v), _c(codebook)
    width = (F.size(v) / F.size(book)).cast("int")
    return F.transform(book, lambda centroids, j: nearest_code(_part(v, j, width), centroids))


def decode(codes, codebook) -> Column:
    book = _c(codebook)
    return F.flatten(F.transform(_c(codes), lambda c, j: F.get(F.get(book, j), c.cast("int"))))


def distance_table(q, codebook) -> Column:
    """Squared distances of a query's parts to all centroids (subspace, code)."""
    q, book = _c(q), _c(codebook)
    width = (F.size(q) / F.size(book)).cast("int")
    return F.transform(book, lambda centroids, j: F.transform(centroids, lambda c: _squared(_part(q, j, width), c)))


def adc_distance(codes, table) -> Column:
    """Estimated squared distance: sum of the table's entries at the codes."""
    table = _c(table)
    return F.aggregate(F.transform(_c(codes), lambda c, j: F.get(F.get(table, j), c.cast("int"))), F.lit(0.0), lambda s, x: s + x)


def partial_distance(table, j: int, code) -> Column:
    return F.get(F.get(_c(table), F.lit(j)), _c(code).cast("int"))


def memory_bytes(n: int, subspaces: int, codes: int, width: int) -> dict[str, int]:
    """Bytes of the codes, the codebook and one query's distance table."""
    return {"codes": n * subspaces, "codebook": subspaces * codes * width * 4, "table": subspaces * codes * 4}
