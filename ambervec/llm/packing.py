"""Operator 1: best-fit packing of tokenised documents into sequences."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch_slices, documents, staged, text_buffer
from .tokens import word_bpe

_PIECES = "pid int, doc_id long, piece int, start long, length long, ids_crc32 long, rank_in_part long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def tokenise(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces of at most ``capacity`` ids, each with its rank among the pieces
    of the same length in the same input split."""

    def run(batches):
        enc, seen = word_bpe(tokenizer), np.zeros(capacity + 1, np.int64)
        pid = TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in batch_slices(batch, "text", 8 << 20):
                data, off = text_buffer(part.column("text"))
                raw, ids = data.tobytes(), part.column("doc_id").to_pylist()
                rows: list[tuple] = []
                for d, doc_id in enumerate(ids):
                    got = enc.ids(raw[off[d] : off[d + 1]]) + end
                    n = len(got) // 4
                    for k, at in enumerate(range(0, n, capacity)):
                        size = min(capacity, n - at)
                        rows.append((pid, doc_id, k, at, size, zlib.crc32(got[4 * at : 4 * (at + size)]), seen[size]))
                        seen[size] += 1
                cols = list(zip(*rows))
                kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 4]
                names = [c.split()[0] for c in _PIECES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    return docs.select("doc_id", "text").mapInArrow(run, _PIECES)


# ------------------------------------------------------------- the plan


def _configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole numbers of few-size configurations that cover the demand.

    The configuration LP is solved by column generation: the basis prices the
    sizes, an unbounded knapsack finds the best configuration at these prices,
    and it enters the basis. The solution is rounded down; what is left of the
    demand is covered by configurations that are filled from the largest size.
    """
    k = len(sizes)
    size, d = np.array(sizes), np.array(demand, float)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    for _ in range(40 * k):
        prices = np.linalg.solve(basis.T, np.ones(k))
        # best value with at most t items in each room, one layer an item
        best, picks = np.zeros(capacity + 1), []
        for _ in range(capacity // int(size.min())):
            nxt, pick = best.copy(), np.full(capacity + 1, -1)
            for g in range(k):
                value = best[: capacity + 1 - size[g]] + prices[g]
                better = value > nxt[size[g] :] + 1e-12
                nxt[size[g] :][better], pick[size[g] :][better] = value[better], g
            best = nxt
            picks.append(pick)
        if best[capacity] <= 1 + 1e-9:
            break
        column, c = np.zeros(k), capacity
        for pick in reversed(picks):
            if (g := pick[c]) >= 0:
                column[g] += 1
                c -= size[g]
        x, y = np.linalg.solve(basis, d), np.linalg.solve(basis, column)
        up = np.flatnonzero(y > 1e-9)
        if not len(up):
            break
        basis[:, up[(x[up] / y[up]).argmin()]] = column
    x = np.linalg.solve(basis, d)
    left, out = np.array(demand, np.int64), []
    for j in np.argsort(-x):
        column = basis[:, j].astype(np.int64)
        n = int(np.floor(x[j] + 1e-9))
        if n > 0:
            out.append((np.minimum(column, left), n)) if n == 1 else out.append((column, n))
            left = np.maximum(left - out[-1][0] * n, 0)
    while left.any():
        column, room = np.zeros(k, np.int64), capacity
        for g in range(k):
            column[g] = min(left[g], room // size[g])
            room -= column[g] * size[g]
        n = int((left[column > 0] // column[column > 0]).min())
        out.append((column, n))
        left -= column * n
    return out


def plan_packing(hist: dict[int, int], capacity: int, groups: int = 20, large: float = 0.125) -> np.ndarray:
    """Slots for all pieces, from the histogram of their lengths alone.

    Returns rows (length, first rank, end rank, first sequence, pieces a
    sequence, offset): the pieces of that length with these ranks go to
    consecutive sequences, so many in each, from that offset on. The histogram
    has at most ``capacity`` entries, so the plan's size has a bound that does
    not depend on the corpus.

    Lengths over ``large * capacity`` are dealt in falling order to groups of
    equal cardinality and rounded up to their group's largest; a length that fills a
    group alone is one and is not rounded, nor is any of at most ``2 * groups``
    different lengths. Configurations of these few sizes are optimised; then the actual lengths take the places of
    the rounded ones, and all smaller pieces go, largest first, into the
    fullest sequences that still hold them (best fit).
    """
    lengths = sorted(hist, reverse=True)
    big = [n for n in lengths if n > large * capacity]
    slots: list[tuple[int, int, int, int, int, int]] = []
    open_runs: list[tuple[int, int, int, int]] = []  # room, first sequence, sequences, used
    sequence = 0

    if big:
        share = -(-sum(hist[n] for n in big) // groups)
        queue: list[list[list[int]]] = [[]]  # per group: [length, first rank, end rank]
        have = 0
        for n in big:
            rank, alone = 0, hist[n] >= share or len(big) <= 2 * groups
            if alone and have:
                queue.append([])
                have = 0
            while rank < hist[n]:
                if have == share and not alone:
                    queue.append([])
                    have = 0
                take = hist[n] - rank if alone else min(hist[n] - rank, share - have)
                queue[-1].append([n, rank, rank + take])
                rank, have = rank + take, have + take
            if alone:
                queue.append([])
                have = 0
        queue = [q for q in queue if q]
        sizes = [q[0][0] for q in queue]
        # groups that begin at the same length are one size
        merged: dict[int, list[list[int]]] = {}
        for s, q in zip(sizes, queue):
            merged.setdefault(s, []).extend(q)
        sizes, queue = list(merged), list(merged.values())
        demand = [sum(e - b for _, b, e in q) for q in queue]
        for column, n in _configurations(sizes, demand, capacity):
            cuts, takes = {0, n}, []
            for g in np.flatnonzero(column):
                for _ in range(column[g]):
                    need, at = n, 0
                    runs = []
                    while need and queue[g]:
                        head = queue[g][0]
                        take = min(need, head[2] - head[1])
                        runs.append((at, at + take, head[0], head[1]))
                        cuts |= {at, at + take}
                        head[1] += take
                        need, at = need - take, at + take
                        if head[1] == head[2]:
                            queue[g].pop(0)
                    takes.append(runs)
            edge = sorted(cuts)
            for lo, hi in zip(edge, edge[1:]):
                used = 0
                for runs in takes:
                    for b, e, length, rank in runs:
                        if b <= lo and hi <= e:
                            slots.append((length, rank + lo - b, rank + hi - b, sequence + lo, 1, used))
                            used += length
                if used:
                    insort(open_runs, (capacity - used, sequence + lo, hi - lo, used))
            sequence += n

    for length in (n for n in lengths if n <= large * capacity):
        rank, left = 0, hist[length]
        while left:
            i = bisect_left(open_runs, (length,))
            if i == len(open_runs):
                fresh = -(-left // (capacity // length))
                insort(open_runs, (capacity, sequence, fresh, 0))
                sequence += fresh
                continue
            room, first, count, used = open_runs.pop(i)
            each = room // length
            full = min(count, left // each)
            if full:
                slots.append((length, rank, rank + full * each, first, each, used))
                insort(open_runs, (room - each * length, first, full, used + each * length))
                rank, left = rank + full * each, left - full * each
            rest = count - full
            if rest and left:  # fewer than fill one sequence
                slots.append((length, rank, rank + left, first + full, left, used))
                insort(open_runs, (room - left * length, first + full, 1, used + left * length))
                rest, full, left = rest - 1, full + 1, 0
            if rest:
                insort(open_runs, (room, first + full, rest, used))
    return np.array(sorted(slots), np.int64).reshape(-1, 6)


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pack documents (doc_id, text) into as few sequences of ``capacity`` ids as it can.

    Every text is tokenised whole and ends with ``end_id``; only texts of more
    than ``capacity`` ids are cut. The pieces' lengths are counted (at most
    ``capacity`` different ones), the driver plans on these counts, and each
    piece finds its slot by its rank among the pieces of its length; ranks come
    from counts per input split, so no piece meets all others of its length in
    one task. Returns doc_id, piece, start, length, ids_crc32, sequence_id,
    offset per piece.

    Null and empty texts: one piece of ``end_id`` alone. Null ids stay null.
    Repeated rows: each is packed. Empty table: no rows. Other columns of the
    input are left out, whatever their names.
    """
    pieces = staged(tokenise(docs, tokenizer, capacity, end_id), "pieces")
    by_part = pieces.groupBy("pid", "length").agg(F.count(F.lit(1)).alias("n"))
    hist = {int(r.length): int(r.n) for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = docs.sparkSession.sparkContext.broadcast(plan_packing(hist, capacity))
    before = W.partitionBy("length").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)
    base = by_part.select("pid", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def place(batches):
        slot = plan.value
        key = (slot[:, 0] << 48) + slot[:, 1]
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("rank_in_part").to_numpy() + b.column("base").to_numpy()
            s = slot[np.searchsorted(key, (length << 48) + rank, "right") - 1] if len(rank) else slot[:0]
            at = rank - s[:, 1]
            out = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            out += [pa.array(s[:, 3] + at // np.maximum(s[:, 4], 1)), pa.array(s[:, 5] + at % np.maximum(s[:, 4], 1) * length)]
            yield pa.RecordBatch.from_arrays(out, [c.split()[0] for c in PACKED.split(", ")])

    return pieces.join(base, ["pid", "length"]).mapInArrow(place, PACKED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit_packing(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
