"""Operator 5: substring deduplication with difference-cover anchors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import (
    U64, Words, bucket_runs, documents, from48, in_order, in_parts, low48, pack, text_buffer, unpack, whole_runs, window_hash,
)

_ASK = "bucket int, pid int, ask binary"
_TOLD = "pid int, kind int, bucket int, bits binary"
REMOVED = "doc_id long, n_words long, n_removed long, removed array<struct<from_word:long,to_word:long>>, kept_text string"
_LAST = np.iinfo(np.int64).max


def difference_cover(period: int) -> list[int]:
    """Smallest set of residues in which every difference modulo the period occurs."""
    from itertools import combinations

    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            cover = (0, *rest)
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return list(cover)
    return [0]


class _Part:
    """The words of one part of the documents and what follows from them alone."""

    def __init__(self, table: pa.Table, window: int, period: int):
        self.table = in_order(table)
        data, off = text_buffer(self.table.column("text"))
        self.words = Words(data, off)
        self.ids = self.table.column("doc_id").fill_null(_LAST).to_numpy()
        self.window, self.period = window, period
        self.h = self.words.hashes()
        self.width = window - period + 1
        cover = np.zeros(period, bool)
        cover[difference_cover(period)] = True
        at = whole_runs(self.words.first, self.width)
        place = at - self.words.first[self.words.doc[at]]
        self.at = at[cover[place % period]]
        key = window_hash(self.h, self.width, at=self.at)
        doc = self.ids[self.words.doc[self.at]]
        # each different anchor once, with whether several documents here hold it
        order = np.argsort(key, kind="stable")
        new = np.ones(len(key), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        run = np.cumsum(new) - 1
        self.anchor_of = np.empty(len(key), np.int64)
        self.anchor_of[order] = run
        starts = np.flatnonzero(new)
        self.keys = key[order][starts]
        d = doc[order]
        self.many = np.minimum.reduceat(d, starts) < np.maximum.reduceat(d, starts) if len(starts) else np.zeros(0, bool)

    def candidates(self, shared: np.ndarray) -> None:
        """Windows that hold a shared anchor within their first ``period`` places:
        two equal windows have, at one of these places, a sampled anchor in both."""
        mark = np.zeros(len(self.words) + self.period + 1, np.int32)
        mark[self.at[shared[self.anchor_of]] + 1] = 1
        np.cumsum(mark, out=mark)
        at = whole_runs(self.words.first, self.window)
        self.win = at[mark[at + self.period] > mark[at]]
        a = window_hash(self.h, self.window, at=self.win)
        b = window_hash(self.words.hashes(2), self.window, 2, self.win) if len(self.win) else a
        doc = self.ids[self.words.doc[self.win]]
        order = np.lexsort((doc, b, a))
        a, b, d = a[order], b[order], doc[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        run = np.cumsum(new) - 1
        self.win_of = np.empty(len(a), np.int64)
        self.win_of[order] = run
        self.win_doc = doc
        self.a, self.b, self.least = a[new], b[new], d[new]

    def removed(self, earlier: np.ndarray) -> np.ndarray:
        """Which words are covered by a window that also starts in an earlier document."""
        gone = self.win[(self.least[self.win_of] < self.win_doc) | earlier[self.win_of]]
        edge = np.zeros(len(self.words) + self.window + 1, np.int32)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + self.window, -1)
        return np.cumsum(edge)[: len(self.words)] > 0


def _bits(told: list[tuple[int, bytes]], runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Answers in the order of the questions."""
    out, by = np.zeros(n, bool), dict(told)
    for bucket, lo, hi in runs:
        if bucket in by:
            out[lo:hi] = np.unpackbits(np.frombuffer(by[bucket], np.uint8), count=hi - lo)
    return out


def _answer(table: pa.Table, kind: int, shared) -> pa.Table:
    """shared(pid numbers, blobs) gives one flag a question; send them back to the parts."""
    pid = table.column("pid").to_pylist()
    blobs = table.column("ask").to_pylist()
    sizes = [int(np.frombuffer(b, np.int64, 1)[0]) for b in blobs]
    flags = np.split(shared(np.repeat(np.arange(len(pid)), sizes), blobs), np.cumsum(sizes)[:-1])
    rows = [(p, kind, table.column("bucket")[0].as_py(), np.packbits(f).tobytes()) for p, f in zip(pid, flags) if f.any()]
    cols = list(zip(*rows)) or [(), (), (), ()]
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["pid", "kind", "bucket", "bits"])


def _runs_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorting order and the number of each sorted row's run of equal keys."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    new[:1] = True
    return order, new


def remove_repeats(docs: DataFrame, window: int = 13, period: int = 7, part_bytes: int = 4 << 20) -> DataFrame:
    """Cut out every word covered by a run of ``window`` words that also starts in
    a document with a smaller id.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Anchors of window-period+1
    words are hashed only at places whose residue modulo ``period`` is in a
    difference cover; any two equal windows hold an equal, sampled anchor at the
    same distance. Parts of the documents ask hash buckets which of their
    different anchors other documents hold too (one question a part and anchor,
    however often it occurs, so a passage of a third of all documents is no hot
    key), then extend shared anchors to whole windows and ask for the least
    document of each (128-bit hashes of the words). Answers are bits in the
    order of the questions.

    Returns doc_id, n_words, n_removed, removed (word ranges), kept_text (kept
    words joined by one space). Null and empty texts: no words. A null id counts
    as larger than all others. Rows that repeat an id are one document for the
    comparison and stay separate rows. Empty table: no rows. Other columns are
    left out.
    """
    rows, _, buckets = in_parts(docs, part_bytes)

    def anchors(key, table):
        p = _Part(table, window, period)
        out = [(b, key[0].as_py(), pack(low48(p.keys[lo:hi]).view("V6").ravel(), p.many[lo:hi].view(np.uint8))) for b, lo, hi in bucket_runs(p.keys, buckets)]
        cols = list(zip(*out)) or [(), (), ()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "pid", "ask"])

    def meet_anchors(key, table):
        def shared(who, blobs):
            got = [unpack(b, "V6", np.uint8) for b in blobs]
            k = from48(np.concatenate([g[0] for g in got]).view(np.uint8).reshape(-1, 6))
            many = np.concatenate([g[1] for g in got])
            order, new = _runs_of(k)
            starts = np.flatnonzero(new)
            held = np.diff(np.append(starts, len(k))) + np.maximum.reduceat(many[order], starts) > 1
            out = np.empty(len(k), bool)
            out[order] = held[np.cumsum(new) - 1]
            return out

        return _answer(table, 0, shared)

    def extended(table: pa.Table, told: pa.Table) -> tuple[_Part, list]:
        p = _Part(table, window, period)
        said = list(zip(*(told.column(c).to_pylist() for c in ("kind", "bucket", "bits"))))
        p.candidates(_bits([x[1:] for x in said if x[0] == 0], list(bucket_runs(p.keys, buckets)), len(p.keys)))
        return p, [x[1:] for x in said if x[0] == 1]

    def windows(key, table, told):
        out = []
        if table.num_rows and told.num_rows:
            p, _ = extended(table, told)
            for b, lo, hi in bucket_runs(p.a, buckets):
                out.append((b, key[0].as_py(), pack(p.a[lo:hi], p.b[lo:hi], p.least[lo:hi])))
        cols = list(zip(*out)) or [(), (), ()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "pid", "ask"])

    def meet_windows(key, table):
        def earlier(who, blobs):
            got = [unpack(b, U64, U64, np.int64) for b in blobs]
            a, b, d = (np.concatenate([g[i] for g in got]) for i in range(3))
            order, new = _runs_of(a, b)
            least = np.minimum.reduceat(d[order], np.flatnonzero(new))
            out = np.empty(len(a), bool)
            out[order] = least[np.cumsum(new) - 1] < d[order]
            return out

        return _answer(table, 1, earlier)

    def cut(key, table, told):
        names = [c.partition(" ")[0] for c in ("doc_id", "n_words", "n_removed", "removed", "kept_text")]
        span = pa.list_(pa.struct([("from_word", pa.int64()), ("to_word", pa.int64())]))
        if told.num_rows and table.num_rows:
            p, said = extended(table, told)
            gone = p.removed(_bits(said, list(bucket_runs(p.a, buckets)), len(p.a)))
            table, first = p.table, p.words.first
        else:
            gone = first = None
        data, off = text_buffer(table.column("text"))
        raw, n_words, n_removed, spans, kept = data.tobytes(), [], [], [], []
        for d in range(table.num_rows):
            words, cuts = raw[off[d] : off[d + 1]].split(), []
            n_words.append(len(words))
            if gone is not None and (mine := gone[first[d] : first[d + 1]]).any():
                edge = np.flatnonzero(np.diff(mine.astype(np.int8), prepend=0, append=0))
                cuts = edge.reshape(-1, 2).tolist()
                keep, at = [], 0
                for lo, hi in cuts:
                    keep += words[at:lo]
                    at = hi
                words = keep + words[at:]
            n_removed.append(n_words[-1] - len(words))
            spans.append([{"from_word": lo, "to_word": hi} for lo, hi in cuts])
            kept.append(b" ".join(words))
        return pa.table([table.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary()).cast(pa.string())], names=names)

    shared = rows.groupBy("pid").applyInArrow(anchors, _ASK).groupBy("bucket").applyInArrow(meet_anchors, _TOLD)
    asked = rows.groupBy("pid").cogroup(shared.groupBy("pid")).applyInArrow(windows, _ASK)
    told = shared.unionByName(asked.groupBy("bucket").applyInArrow(meet_windows, _TOLD))
    return rows.groupBy("pid").cogroup(told.groupBy("pid")).applyInArrow(cut, REMOVED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
