"""Operator 4: a byte-level convolutional quality classifier in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch_slices, documents, text_buffer

CHUNK, STEP, TAPS, HOP, FILTERS = 512, 480, 6, 2, 16


def chunks_of(raw: np.ndarray) -> np.ndarray:
    """(chunks, CHUNK) bytes that cover the text with overlap, zeros at the end."""
    n = max(1, -(-max(len(raw) - (CHUNK - STEP), 1) // STEP))
    pad = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
    pad[: len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(pad, CHUNK)[np.arange(n) * STEP]


class ByteCnn:
    """Filters over byte windows, max-pooled over each chunk; the means and the
    maxima of a document's chunks give one probability."""

    def __init__(self, seed: int = 0):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.taps = rng.normal(0, 0.4, (TAPS, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.const = np.zeros(1, np.float32)

    def _pool(self, x: np.ndarray, where: bool = False):
        """Pooled responses of chunks (n, FILTERS) and, if asked, their places."""
        top = np.empty((len(x), FILTERS), np.float32)
        place = np.empty((len(x), FILTERS), np.int64) if where else None
        n = (CHUNK - TAPS) // HOP + 1
        for lo in range(0, len(x), 64):
            part = x[lo : lo + 64]
            acc = np.take(self.taps[0], part[:, 0 : 0 + n * HOP : HOP], axis=0)
            for j in range(1, TAPS):
                acc += np.take(self.taps[j], part[:, j : j + n * HOP : HOP], axis=0)
            if where:
                place[lo : lo + 64] = acc.argmax(1)
                top[lo : lo + 64] = np.take_along_axis(acc, place[lo : lo + 64, None], 1)[:, 0]
            else:
                top[lo : lo + 64] = acc.max(1)
        return (top + self.bias, place) if where else top + self.bias

    @staticmethod
    def _document(pooled: np.ndarray, first: np.ndarray) -> np.ndarray:
        act = np.maximum(pooled, 0)
        mean = np.add.reduceat(act, first[:-1]) / np.diff(first)[:, None]
        return np.concatenate([mean, np.maximum.reduceat(act, first[:-1])], 1)

    def scores(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probability of each document; document d owns chunks first[d]:first[d+1]."""
        z = self._document(self._pool(x), first) @ self.out + self.const
        return 1 / (1 + np.exp(-z.astype(np.float64)))

    def fit(self, docs: list[np.ndarray], labels: np.ndarray, epochs: int = 14, size: int = 32, rate: float = 0.01) -> "ByteCnn":
        rng = np.random.Generator(np.random.PCG64(1))
        params = [self.taps, self.bias, self.out, self.const]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for epoch in range(epochs):
            order = rng.permutation(len(docs))
            for lo in range(0, len(order), size):
                pick = order[lo : lo + size]
                x = np.concatenate([docs[d] for d in pick])
                first = np.concatenate(([0], np.cumsum([len(docs[d]) for d in pick])))
                pooled, place = self._pool(x, True)
                feat = self._document(pooled, first)
                p = 1 / (1 + np.exp(-(feat @ self.out + self.const)))
                dz = ((p - labels[pick]) / len(pick)).astype(np.float32)
                counts = np.diff(first)
                doc = np.repeat(np.arange(len(pick)), counts)
                act = np.maximum(pooled, 0)
                g = dz[doc, None] * self.out[None, :FILTERS] / counts[doc][:, None]
                ties = act == feat[:, FILTERS:][doc]
                share = np.add.reduceat(ties.astype(np.float32), first[:-1])[doc]
                g = (g + dz[doc, None] * self.out[None, FILTERS:] * ties / share) * (pooled > 0)
                d_taps = np.zeros_like(self.taps)
                f = np.broadcast_to(np.arange(FILTERS), place.shape)
                for j in range(TAPS):
                    np.add.at(d_taps[j], (np.take_along_axis(x, place * HOP + j, 1), f), g)
                grads = [d_taps, g.sum(0), feat.T @ dz + 1e-4 * self.out, dz.sum(keepdims=True)]
                step += 1
                lr = rate * (1 - 0.9 * epoch / epochs)
                for q, dq, mm, vv in zip(params, grads, m, v):
                    mm += 0.1 * (dq - mm)
                    vv += 0.01 * (dq * dq - vv)
                    q -= lr * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-7)
        return self


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 3000, sample_bytes: int = 32 << 20) -> ByteCnn | None:
    """Train on at most ``sample`` labelled documents of together at most
    ``sample_bytes`` bytes, taken in the order of their id's hash and shown whole, so
    the driver gets little more than ``sample_bytes``; texts of over a sixteenth of
    that are not in the sample. Of several labels of an id the greatest counts, of
    several texts the least. None if no document is labelled."""
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    picked = known.join(texts.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def cut(batches):
        for batch in batches:
            data, off = text_buffer(batch.column("text"))
            got = [chunks_of(data[a:b]).tobytes() for a, b in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(got, pa.binary())], ["doc_id", "quality", "chunks"])

    # at most `sample` rows of two numbers: a proven bound for the broadcast
    shown = texts.where(F.octet_length("text") <= sample_bytes // 16).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    upto = F.sum(F.octet_length("text")).over(W.orderBy(F.xxhash64("doc_id"), "doc_id"))  # at most `sample` rows
    shown = shown.withColumn("upto", upto).where(F.col("upto") <= sample_bytes).select("doc_id", "text", "quality")
    rows = sorted(shown.mapInArrow(cut, "doc_id long, quality int, chunks binary").collect(), key=lambda r: r.doc_id)
    if not rows:
        return None
    x = [np.frombuffer(r.chunks, np.uint8).reshape(-1, CHUNK) for r in rows]
    return ByteCnn().fit(x, np.array([r.quality for r in rows], np.float32))


def quality_scores(docs: DataFrame, model: ByteCnn | None, score: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the probability that a document's quality label is 1.

    Overlapping chunks cover the whole text. Null and empty texts get the score
    of an empty text; without a model (nothing labelled) every score is 1. All
    columns of the input (or those in ``keep``) are kept; a column named
    ``score`` is replaced. Empty table: no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.drop(score)
    names = base.columns if keep is None else keep
    schema = base.select(*names).schema.add(score, "double")

    def run(batches):
        net = held.value
        for batch in batches:
            for part in batch_slices(batch, "text", 4 << 20):
                if net is None:
                    got = np.ones(part.num_rows)
                else:
                    data, off = text_buffer(part.column("text"))
                    x = [chunks_of(data[a:b]) for a, b in zip(off[:-1], off[1:])]
                    got = net.scores(np.concatenate(x), np.concatenate(([0], np.cumsum([len(c) for c in x]))))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(got)], [*names, score])

    return base.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4) == 2
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out)
    out = quality_scores(docs, fit_quality(docs, labels), keep=["doc_id"])
    return out.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
