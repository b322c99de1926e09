"""Operator 6: language-model scores by a hidden Markov model over words."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Words, batch_slices, bucket_of, bucket_runs, documents, in_parts, pack, text_buffer, unpack

STATES, SYMBOLS = 8, 1 << 15  # the last symbol but one more is the end
_ASK = "bucket int, pid int, ask binary"
SCORED = "doc_id long, n_tokens long, n_known long, log_counts double, score double"


def held_out(doc_id: F.Column) -> F.Column:
    """Rows that nothing is learned from: crc32 of the id's digits is 2 modulo 7."""
    return F.coalesce((F.crc32(doc_id.cast("string").cast("binary")) % 7) == 2, F.lit(False))


def _is_held_out(ids: list) -> np.ndarray:
    return np.array([i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i in ids], bool)


@dataclass
class Hmm:
    """begin (K), move (K, K), emit (SYMBOLS + 1, K)."""

    begin: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    def _steps(self, a: np.ndarray | None, sym: np.ndarray, off: np.ndarray, first_step: bool, keep: bool):
        """Scaled forward recursion over a block of steps, from the state ``a`` before it:
        (scales, last state, and if asked all scaled forward values and the emissions)."""
        e = self.emit[sym]
        scale, alphas = np.empty(len(sym)), np.empty(e.shape) if keep else None
        for t, (lo, hi) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
            a = (self.begin if t == 0 and first_step else a[: hi - lo] @ self.move) * e[lo:hi]
            c = a.sum(1)
            a /= c[:, None]
            scale[lo:hi] = c
            if keep:
                alphas[lo:hi] = a
        return scale, a, alphas, e

    def forward(self, sym: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The scaled forward recursion of many sequences at once, longest first: a
        factor of the likelihood for each token."""
        out, a = np.ones(len(sym)), None
        for place, off, t in _blocks_of_steps(first):
            out[place], a, _, _ = self._steps(a, sym[place], off, t == 0, False)
        return out

    def counts(self, sym: np.ndarray, first: np.ndarray):
        """Expected begins, moves and emissions of whole sequences (the E step).

        Blocks of steps bound the memory: the forward state is kept at the start of
        each, and their forward values are computed again on the way back, so
        nothing is cut at a block's edge.
        """
        k = len(self.begin)
        begin, moves, emit = np.zeros(k), np.zeros((k, k)), np.zeros((SYMBOLS + 1, k))
        blocks, starts = list(_limits(first)), [None]
        for cut in blocks[:-1]:
            place, off, t = _block(first, *cut)
            starts.append(self._steps(starts[-1], sym[place], off, t == 0, False)[1])
        w = np.empty((0, k))  # beta * emission / scale of the step behind
        for cut, start in zip(reversed(blocks), reversed(starts)):
            place, off, t = _block(first, *cut)
            s = sym[place]
            scale, _, alpha, e = self._steps(start, s, off, t == 0, True)
            e /= scale[:, None]
            for lo, hi in zip(off[-2::-1].tolist(), off[:0:-1].tolist()):
                moves += alpha[lo : lo + len(w)].T @ w
                beta = np.ones((hi - lo, k))
                beta[: len(w)] = w @ self.move.T
                alpha[lo:hi] *= beta  # from here on the posterior
                w = beta * e[lo:hi]
            if t == 0:
                begin += alpha[: off[1]].sum(0)
            for j in range(k):
                emit[:, j] += np.bincount(s, alpha[:, j], SYMBOLS + 1)
        return begin, moves * self.move, emit

    @staticmethod
    def of(begin: np.ndarray, moves: np.ndarray, emit: np.ndarray) -> "Hmm":
        """The M step; every symbol keeps a share, half of a count spread by all states' use of it."""
        use = emit.sum(1) + 1e-3
        emit = emit + 20.0 * (use / use.sum())[:, None]
        return Hmm((begin + 0.1) / (begin + 0.1).sum(), (moves + 0.1) / (moves + 0.1).sum(1, keepdims=True), emit / emit.sum(0))


def symbols(h: np.ndarray) -> np.ndarray:
    """A word's symbol, from the high bits of its hash."""
    return bucket_of(h, SYMBOLS)


def _with_end(sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Put the end symbol behind every sequence."""
    out = np.insert(sym, first[1:], SYMBOLS)
    return out, first + np.arange(len(first))


STEP_TOKENS = 1 << 19  # tokens of a block of steps: 100 MB of forward values and emissions


def _limits(first: np.ndarray):
    """(order, live, from, to): blocks of steps of at most STEP_TOKENS tokens, one step
    at least; live[t] sequences, longest first, are longer than t."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    n = n[order]
    live = len(n) - np.searchsorted(n[::-1], np.arange(int(n[0]) if len(n) else 0), "right")
    upto, t = np.cumsum(live), 0
    while t < len(live):
        to = max(t + 1, int(np.searchsorted(upto, (upto[t - 1] if t else 0) + STEP_TOKENS, "right")))
        yield order, live, t, to
        t = to


def _block(first: np.ndarray, order: np.ndarray, live: np.ndarray, t: int, to: int):
    """Places of a block's tokens, step after step, the limits of the steps, the first step."""
    live = live[t:to]
    off = np.concatenate(([0], np.cumsum(live)))
    rank = np.arange(off[-1]) - np.repeat(off[:-1], live)
    return first[:-1][order[rank]] + np.repeat(np.arange(t, to), live), off, t


def _blocks_of_steps(first: np.ndarray):
    for cut in _limits(first):
        yield _block(first, *cut)


def _start() -> Hmm:
    """First parameters: seeded noise on every symbol's emission, the same for every corpus."""
    rng = np.random.Generator(np.random.PCG64(3))
    return Hmm.of(np.ones(STATES), np.eye(STATES) * 9 + 1.0 / STATES, np.exp(rng.normal(0, 1, (SYMBOLS + 1, STATES))))


def _round(texts: DataFrame, model: Hmm) -> tuple[Hmm, int, int]:
    """One Baum-Welch round over training texts: every split's expected counts as rows
    (a symbol, a state's moves, the begins, the numbers of tokens and texts), added
    up by row. Sums are taken where rows arrive, so a task holds its rows' sums
    however many splits there are."""
    held, k = texts.sparkSession.sparkContext.broadcast(model), STATES

    def expect(batches):
        flat = np.zeros((SYMBOLS + 1 + k + 2, k))  # symbols, moves, begins, numbers
        for batch in batches:
            for part in batch_slices(batch, "text", 4 << 20):
                data, off = text_buffer(part.column("text"))
                w = Words(data, off, lower=True)
                sym, first = _with_end(symbols(w.hashes()), w.first)
                begin, moves, emit = held.value.counts(sym, first)
                flat[: SYMBOLS + 1] += emit
                flat[SYMBOLS + 1 : -2] += moves
                flat[-2] += begin
                flat[-1, :2] += len(sym), part.num_rows
        row = np.flatnonzero(flat.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), *(pa.array(flat[row, j]) for j in range(k))], ["row", *names])

    names = [f"s{j}" for j in range(k)]
    rows = texts.mapInArrow(expect, "row int, " + ", ".join(f"{c} double" for c in names)).groupBy("row").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
    flat = np.zeros((SYMBOLS + 1 + k + 2, k))
    flat[rows.column("row").to_numpy()] = np.column_stack([rows.column(c).to_numpy() for c in names])
    if not flat[-1, 1]:
        return model, 0, 0
    return Hmm.of(flat[-2], flat[SYMBOLS + 1 : -2], flat[: SYMBOLS + 1]), round(flat[-1, 0]), round(flat[-1, 1])


def train(docs: DataFrame, share: int = 16, first_rounds: int = 8, rounds: int = 2) -> tuple[Hmm, int, int]:
    """(model, training tokens, training texts): ``first_rounds`` Baum-Welch rounds over
    every ``share``-th training text (by the id's hash), so they grow with the corpus,
    then ``rounds`` over all of them. Every text counts whole, from its begin to its end."""
    texts = docs.where(~held_out(F.col("doc_id"))).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    some = texts.where(F.pmod(F.xxhash64("doc_id", F.lit("share")), F.lit(share)) == 0)
    model, tokens, n = _start(), 0, 0
    for _ in range(first_rounds):
        model = _round(some.select("text"), model)[0]
    for _ in range(rounds):
        model, tokens, n = _round(texts.select("text"), model)
    return model, tokens, n


def hmm_scores(docs: DataFrame, rounds: int = 2, part_bytes: int = 4 << 20) -> DataFrame:
    """Log10 probability of every whole text under a hidden Markov model.

    Tokens are lower-cased words and one end a text. A hidden state emits one of
    32,768 symbols (a hash of the word) or the end, and the symbol emits the
    word in proportion to its training count plus one, with one share for words
    never seen: P(text) sums over all state paths, exactly, by the scaled
    forward recursion. States are trained by `train`, whose last ``rounds`` rounds
    count all training texts, word counts are exact over all of them: parts of the
    documents ask hash buckets for the counts of their different words, so no
    frequent word is a hot key. Words count as equal if their 64-bit hashes are.

    Rows whose id's crc32 is 2 modulo 7 are scored but not learned from.
    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (the
    add-one unigram), score. Null and empty texts: the end alone. Null ids are
    learned from. Nothing to learn from: all words are unknown. Repeated rows
    count as often as they occur. Empty table: no rows. Other columns are left
    out.
    """
    model, n_train, n_texts = train(docs, rounds=rounds)
    return scores_by(docs, model, n_train, n_texts, part_bytes)


def scores_by(docs: DataFrame, model: Hmm, n_train: int, n_texts: int, part_bytes: int = 4 << 20) -> DataFrame:
    """`hmm_scores` with a trained model; ``n_texts`` training texts, ``n_train`` training tokens."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows, _, buckets = in_parts(docs, part_bytes)
    blobs = (pa.int32(), pa.int32(), pa.binary())

    def table_of(out, names):
        cols = list(zip(*out)) or [()] * len(names)
        return pa.table([pa.array(c, t) for c, t in zip(cols, blobs)], names=names)

    def words_of(table: pa.Table):
        data, off = text_buffer(table.column("text"))
        w = Words(data, off, lower=True)
        h = w.hashes()
        keys, of = np.unique(h, return_inverse=True)
        # whole symbols stay in one bucket: deal out by symbol
        return w, h, keys, of

    def ask(key, table):
        w, _, keys, of = words_of(table)
        train = ~_is_held_out(table.column("doc_id").to_pylist())
        counts = np.bincount(of, train[w.doc].astype(float), len(keys)).astype(np.uint32)
        return table_of([(b, key[0].as_py(), pack(keys[lo:hi], counts[lo:hi])) for b, lo, hi in _by_symbol(keys, buckets)], ["bucket", "pid", "ask"])

    def added(table: pa.Table):
        got = [unpack(x, U64, np.uint32) for x in table.column("ask").to_pylist()]
        k, c = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        keys, of = np.unique(k, return_inverse=True)
        return [len(g[0]) for g in got], keys, of, np.bincount(of, c, len(keys))

    def tell(key, table):
        sizes, keys, of, counts = added(table)
        sym = symbols(keys)
        sym -= sym.min() if len(sym) else 0
        seen = counts > 0
        room = np.bincount(sym, counts) + np.bincount(sym[seen], minlength=int(sym.max()) + 1 if len(sym) else 0) + 1
        c, r = counts[of].astype(np.int64), room[sym[of]].astype(np.int64)
        cut = np.cumsum(sizes)[:-1]
        out = [(p, key[0].as_py(), pack(x.astype(np.uint64), y.astype(np.uint64))) for p, x, y in zip(table.column("pid").to_pylist(), np.split(c, cut), np.split(r, cut))]
        return table_of(out, ["pid", "bucket", "told"])

    def distinct(key, table):
        return pa.table({"n": pa.array([int((added(table)[3] > 0).sum())], pa.int64())})

    def score(key, table, told):
        w, h, keys, of = words_of(table)
        by = dict(zip(told.column("bucket").to_pylist(), told.column("told").to_pylist()))
        count, room = np.zeros(len(keys)), np.ones(len(keys))
        for b, lo, hi in _by_symbol(keys, buckets):
            count[lo:hi], room[lo:hi] = unpack(by[b], U64, U64)
        n, log = np.diff(w.first), np.zeros((3, len(w) + 1))
        for x, v in zip(log, (np.log10(count + 1), np.log10((count + 1) / room), count > 0)):
            np.cumsum(v[of], out=x[1:])
        sums = log[:, w.first[1:]] - log[:, w.first[:-1]]
        sym, first = _with_end(symbols(h), w.first)
        scale = np.log10(held.value.forward(sym, first))
        path = np.add.reduceat(scale, first[:-1]) if table.num_rows else np.zeros(0)
        cols = [table.column("doc_id"), pa.array(n + 1), pa.array(sums[2].astype(np.int64) + (n_texts > 0)), pa.array(sums[0] + np.log10(n_texts + 1)), pa.array(path + sums[1])]
        return pa.table(cols, names=[c.split()[0] for c in SCORED.split(", ")])

    asked = rows.groupBy("pid").applyInArrow(ask, _ASK)
    told = asked.groupBy("bucket").applyInArrow(tell, "pid int, bucket int, told binary")
    types = asked.groupBy("bucket").applyInArrow(distinct, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("types"))
    out = rows.groupBy("pid").cogroup(told.groupBy("pid")).applyInArrow(score, SCORED).crossJoin(F.broadcast(types))  # one row
    room = F.lit(n_train) + F.col("types") + F.lit(int(n_texts > 0)) + 1
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("log_counts") - F.col("n_tokens") * F.log10(room)).alias("base_score"), "score",
    )


def _by_symbol(keys: np.ndarray, buckets: int):
    """Runs of sorted keys by bucket; a symbol's words share one bucket."""
    return bucket_runs_of(symbols(keys) * min(buckets, SYMBOLS) // SYMBOLS)


def bucket_runs_of(bucket: np.ndarray):
    cut = np.flatnonzero(np.diff(bucket)) + 1
    edge = np.concatenate(([0], cut, [len(bucket)])) if len(bucket) else np.zeros(1, np.int64)
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
        yield int(bucket[lo]), lo, hi


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_scores(documents(spark, sf_dir))
