"""Operator 9: near-duplicate documents by min-max hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import U64, Words, batch_slices, documents, from48, low48, mix, powers, span_hash, staged, text_buffer, whole_runs, window_hash
from .graph import components

_M48 = U64((1 << 48) - 1)


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, n, dtype=np.uint64) * U64(2) + U64(1)


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): each text's distinct shingles, sorted, as 48-bit hashes.

    Text d's set is hashes[first[d]:first[d+1]]. Texts of fewer words than
    ``width`` have their whole sequence as one shingle, empty ones nothing.
    """
    w = Words(data, off, lower=True)
    h = w.hashes()
    n = np.diff(w.first)
    at = whole_runs(w.first, width)
    keys, doc = [window_hash(h, width)[at] & _M48], [w.doc[at]]
    for few in range(1, width):
        short = np.flatnonzero(n == few)
        if len(short):
            keys.append(window_hash(h, few)[w.first[short]] & _M48)
            doc.append(short)
    k, d = np.concatenate(keys), np.concatenate(doc)
    # 16 bits for the text's number: blocks of that many texts
    if len(n) > 1 << 16:
        raise ValueError("more texts at once than a block holds")
    tag = np.sort((d.astype(np.uint64) << U64(48)) | k)
    tag = tag[np.concatenate(([True], tag[1:] != tag[:-1]))] if len(tag) else tag
    first = np.searchsorted(tag, np.arange(len(n) + 1, dtype=np.uint64) << U64(48)) if len(n) < 1 << 16 else np.append(np.searchsorted(tag, np.arange(len(n), dtype=np.uint64) << U64(48)), len(tag))
    return tag & _M48, first


def _signatures(sets: np.ndarray, first: np.ndarray, perms: int) -> np.ndarray:
    """Minimum and maximum of each non-empty set under each permutation: (texts, 2 * perms)."""
    full = np.flatnonzero(np.diff(first))
    starts = first[full]
    x = mix(sets)
    out = np.zeros((len(first) - 1, 2 * perms), np.uint64)
    if not len(starts):
        return out
    for k, (a, c) in enumerate(zip(_odd(5, perms), _odd(7, perms))):
        y = (x ^ c) * a
        out[full, 2 * k] = np.minimum.reduceat(y, starts)
        out[full, 2 * k + 1] = np.maximum.reduceat(y, starts)
    return out


SIGNED = "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, bands array<long>, sketch binary"


TEXT_HASH = "xxhash64(coalesce(text, '')) AS text_hash"


def _signed(docs: DataFrame, width: int, perms: int, rows: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in batch_slices(batch, "text"):
                data, off = text_buffer(part.column("text"))
                sets, first = shingle_sets(data, off, width)
                sig = _signatures(sets, first, perms)
                bands = sig.shape[1] // rows
                key = np.zeros((len(sig), bands), np.uint64)
                for r in range(rows):
                    key = mix(key * U64(31) + sig[:, r : r + bands * rows : rows] + U64(r + 1))
                key = mix(key + np.arange(bands, dtype=np.uint64))
                # a digest of the set: sums of two scramblings
                n = np.diff(first)
                pre = np.zeros((2, len(sets) + 1), np.uint64)
                np.cumsum(mix(sets + U64(3)), out=pre[0, 1:])
                np.cumsum(mix(sets ^ U64(0x5851F42D4C957F2D)), out=pre[1, 1:])
                digest = mix(pre[:, first[1:]] - pre[:, first[:-1]] + n.astype(np.uint64)).view(np.int64)
                sketch = (sig >> U64(40)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), part.column("text_hash"), pa.array(n, pa.int64()), pa.array(digest[0]), pa.array(digest[1]),
                     pa.ListArray.from_arrays(np.arange(0, len(sig) * bands + 1, bands, dtype=np.int32), pa.array(key.view(np.int64).ravel())),
                     pa.array([s.tobytes() for s in sketch], pa.binary())],
                    ["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "bands", "sketch"],
                )

    return docs.select("doc_id", F.expr(TEXT_HASH), "text").mapInArrow(run, SIGNED)


def _sets_of(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in batch_slices(batch, "text"):
                data, off = text_buffer(part.column("text"))
                sets, first = shingle_sets(data, off, width)
                six = low48(sets)
                yield pa.RecordBatch.from_arrays([part.column("cid"), pa.array([six[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())], ["cid", "shingles"])

    return docs.mapInArrow(run, "cid long, shingles binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            last, left = None, None
            for i, (x, y) in enumerate(zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist())):
                if x != last:
                    left, last = from48(np.frombuffer(x, np.uint8).reshape(-1, 6)), x
                keep[i] = _similar(left, from48(np.frombuffer(y, np.uint8).reshape(-1, 6)), percent)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    a = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(b, "b").join(a, "a").mapInArrow(run, "a long, b long")


def _runs(batches, columns: tuple[str, ...]):
    """Tables that hold whole runs of equal values of the columns, from sorted batches."""
    held = None
    for batch in _then_none(batches):
        if batch is None:
            if held is not None and held.num_rows:
                yield held
            return
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        if not held.num_rows:
            continue
        same = np.ones(held.num_rows, bool)
        for c in columns:
            x = held.column(c).to_numpy()
            same &= x == x[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield held.slice(0, cut)
            held = held.slice(cut)


def _each(table: pa.Table, columns: tuple[str, ...]):
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for c in columns:
        x = table.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    edge = np.append(np.flatnonzero(new), table.num_rows)
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
        yield table.slice(lo, hi - lo)


def _likely(t: pa.Table, percent: int):
    """Pairs of a bucket that may be similar enough, as (i, those j), by label, size
    and sketch; pairs with the bucket's leader were tested before, and a pair
    that shares several buckets belongs to its first one."""
    key, cid, label, n, leader, block = (t.column(c).to_numpy() for c in ("key", "cid", "label", "n_shingles", "leader", "block"))
    sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(cid), -1)
    bands = t.column("bands").combine_chunks().values.to_numpy().reshape(len(cid), -1)
    least = int(sketch.shape[1] * (percent / 100 - 0.22))
    one, two = t.column("bi")[0].as_py(), t.column("bj")[0].as_py()
    place = int(np.flatnonzero(bands[0] == key[0])[0])
    for i in np.flatnonzero((block == one) & (cid != leader)):
        j = np.flatnonzero((block == two) & (label != label[i]) & (cid != leader))
        j = j[j > i] if one == two else j
        j = j[100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])]
        j = j[(sketch[j] == sketch[i]).sum(1) >= least]
        if len(j):
            j = j[~(bands[j, :place] == bands[i, :place]).any(1)]
        if len(j):
            yield int(i), j


BUCKET = ("key", "bi", "bj")


def _in_doubt(members: DataFrame, percent: int) -> DataFrame:
    """(key, cid) of the members that have a likely partner of another label in their bucket."""

    def run(batches):
        for whole in _runs(batches, BUCKET):
            keys, cids = [], []
            for t in _each(whole, BUCKET):
                mine = set()
                for i, j in _likely(t, percent):
                    mine.update((i, *j.tolist()))
                if mine:
                    at = np.array(sorted(mine))
                    keys.append(t.column("key").to_numpy()[at])
                    cids.append(t.column("cid").to_numpy()[at])
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(cids))], ["key", "cid"])

    return _dealt(members).mapInArrow(run, "key long, cid long").distinct()


def _links_in_buckets(members: DataFrame, percent: int) -> DataFrame:
    """Links between labels inside buckets, confirmed on full sets (column shingles).

    Labels that a link joins are one from then on, so a bucket of n members gives
    less than n links and compares only what is still apart.
    """

    def run(batches):
        for whole in _runs(batches, BUCKET):
            a, b = [], []
            for t in _each(whole, BUCKET):
                cid, label = t.column("cid").to_numpy(), t.column("label").to_numpy()
                raw, sets, parent = t.column("shingles").to_pylist(), {}, {}

                def set_of(i, raw=raw, sets=sets):
                    if i not in sets:
                        sets[i] = from48(np.frombuffer(raw[i], np.uint8).reshape(-1, 6))
                    return sets[i]

                def root(x, parent=parent):
                    while (up := parent.get(x, x)) != x:
                        parent[x] = parent.get(up, up)
                        x = up
                    return x

                for i, j in _likely(t, percent):
                    for k in j.tolist():
                        x, y = root(label[i]), root(label[k])
                        if x != y and _similar(set_of(i), set_of(k), percent):
                            parent[max(x, y)] = min(x, y)
                            a.append(cid[i])
                            b.append(cid[k])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _dealt(members).mapInArrow(run, "a long, b long")


def _dealt(members: DataFrame) -> DataFrame:
    return members.repartition(*BUCKET).sortWithinPartitions(*BUCKET, "cid")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    both = int((x[at] == y).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _then_none(batches):
    yield from batches
    yield None


def _grouped(docs: DataFrame, width: int, percent: int, perms: int, rows: int, block: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, rep): every row with the least (doc_id, text_hash)
    of its component; null where it has no shingles or no id. See `near_duplicates`."""
    signed = staged(_signed(docs, width, perms, rows), "signed")
    sets_known = signed.where("n_shingles > 0 and doc_id is not null")
    classes = sets_known.groupBy("set_a", "set_b", "n_shingles").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    # a class is named by its set's digest; classes that share its first half get the next numbers
    number = F.row_number().over(W.partitionBy("set_a").orderBy("set_b", "n_shingles")) - 1
    classes = staged(classes.withColumn("cid", F.col("set_a") + number), "classes")
    banded = classes.select("cid", F.explode("bands").alias("key"))
    hot = banded.groupBy("key").agg(F.min("cid").alias("leader"), F.max("cid").alias("last")).where("leader < last")
    members = staged(banded.join(hot, "key").select("key", "cid", "leader"), "members")
    met = members.select("cid").distinct()
    known = classes.join(met, "cid")
    sized = staged(known.select("cid", "n_shingles", "sketch", "bands"), "sized")
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(TEXT_HASH), "text").join(known.select("cid", "rep.doc_id", "rep.text_hash"), ["doc_id", "text_hash"])
    # a repeated row is read once
    wanted = wanted.groupBy("cid").agg(F.min("text").alias("text"))
    sets = staged(_sets_of(wanted, width), "sets")

    n = sized.select("cid", "n_shingles")
    fits = F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb")
    star = members.where("cid <> leader").select(F.col("leader").alias("a"), F.col("cid").alias("b")).distinct()
    star = star.join(n.select(F.col("cid").alias("b"), F.col("n_shingles").alias("nb")), "b").join(n.select(F.col("cid").alias("a"), F.col("n_shingles").alias("na")), "a").where(fits).select("a", "b")
    links = staged(_confirmed(star, sets, percent), "confirmed")
    labels = components(links)

    named = members.join(labels.withColumnRenamed("id", "cid"), "cid", "left").select("key", "cid", "leader", F.coalesce("label", "cid").alias("label"))
    apart = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi and size > 2")
    blocks = F.ceil(F.col("size") / block).cast("int")
    left = named.join(apart, "key").select("key", "cid", "leader", "label", blocks.alias("blocks"), F.pmod(F.xxhash64("cid"), blocks).cast("int").alias("block"))
    left = left.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    left = left.select("key", "cid", "leader", "label", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    left = left.join(sized, "cid")
    doubt = _in_doubt(left, percent)
    left = left.join(doubt, ["key", "cid"], "left_semi").join(sets, "cid")
    more = staged(_links_in_buckets(left, percent), "confirmed")
    if not more.isEmpty():
        labels = components(labels.select(F.col("id").alias("a"), F.col("label").alias("b")).unionByName(more))

    by_class = classes.select("set_a", "set_b", "n_shingles", "cid", "rep").join(labels.withColumnRenamed("id", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    least = by_class.groupBy("label").agg(F.min("rep").alias("rep"))
    by_class = by_class.drop("rep").join(least, "label").select("set_a", "set_b", "n_shingles", "rep")
    out = signed.select("doc_id", "text_hash", "n_shingles", "set_a", "set_b").join(by_class, ["set_a", "set_b", "n_shingles"], "left")
    return out.select("doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, perms: int = 48, rows: int = 4, block: int = 4096) -> DataFrame:
    """Classes of documents linked by ``100 * intersection >= percent * union``.

    A document's set is its distinct shingles of ``width`` lower-cased words (as
    48-bit hashes). Every permutation gives two signature values, its minimum and
    its maximum; bands of ``rows`` values become bucket keys (48 permutations, 24
    bands: a link at 0.8 is missed with probability 3e-6; up to 2e-5 for sets of
    less than ten shingles, whose minima and maxima depend on each other). Equal
    sets are one class and meet once. In every bucket the least class is compared
    with the others; all links are confirmed on full sets. Buckets that still hold
    several components are searched where they lie, in blocks of at most ``block``
    members: pairs between components that sizes and sketches allow are compared on
    full sets until they are one component, so no bucket is expanded into its pairs
    and no link is lost for a cap.

    Returns doc_id, n_shingles, component_id (least doc_id reachable, itself
    included), kept (doc_id = component_id). Null and empty texts: no shingles,
    linked with nothing. Null ids: linked with nothing, kept. Every row is a
    document of its own text: rows that repeat an id with another text are linked by
    their text alone, rows of equal texts share a component. Empty table: no rows.
    Other columns are left out.
    """
    out = _grouped(docs, width, percent, perms, rows, block)
    out = out.select("doc_id", "n_shingles", F.coalesce("rep.doc_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near copies: that of the least id (of
    several texts of this id, one).

    Rows are told apart by id and text: of rows (1, a), (5, a), (5, b), (7, b) the
    first and third stay. Repeated rows are one document and stay together. Rows of
    null id or without words stay. All columns are kept.
    """
    rep = F.struct("doc_id", "text_hash")
    gone = _grouped(docs, width, percent, 48, 4, 4096).where(F.col("rep").isNotNull() & (F.col("rep") != rep)).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    rows = docs.withColumn("__th", F.expr("xxhash64(coalesce(text, ''))"))
    return rows.join(gone, (F.col("doc_id").cast("long") == F.col("__id")) & (F.col("__th") == F.col("__hash")), "left_anti").select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=4)
