"""Operator 7: benchmark decontamination by spaced-seed hashing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

WINDOW, SUBSTITUTIONS = 13, 2
ONE_WRONG = 7  # items of 7 to 12 words may have one word substituted
# Any 13 words with at most 2 substitutions hold all places of this mask
# unchanged somewhere (tested over all pairs of places), so one mask loses nothing.
MASKS = ((0, 1, 3, 6, 7),)
BROADCAST_BYTES, SEED_BYTES = 64 << 20, 64


def short_masks(n: int) -> tuple[tuple[int, ...], ...]:
    """Masks for a whole item of n words: with one word wrong, its even or its odd
    places are unchanged."""
    return (tuple(range(0, n, 2)), tuple(range(1, n, 2))) if n >= ONE_WRONG else (tuple(range(n)),)


def word_hashes(text: Column) -> Column:
    """64-bit hashes of a text's words: lower-cased runs of letters and digits."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(masks: list[tuple[int, ...]]) -> Column:
    """Seeds at all places of ``words``, mask after mask: entry mask * words + place."""
    each = [f"transform(words, (w, i) -> xxhash64({', '.join(f'get(words, i + {o})' if o else 'w' for o in mask)}))" for mask in masks]
    return F.expr(each[0] if len(each) == 1 else f"concat({', '.join(each)})")


# words: the document's words beside the item's, from the first place that both have
_VERIFIED = f"""
exists(array(transform(words, (w, p) -> if(w <=> get(item_words, p + skip), 1, 0))), same -> CASE
  WHEN n < {ONE_WRONG} THEN size(same) = n AND aggregate(same, 0, (a, x) -> a + x) = n
  WHEN n < {WINDOW} THEN size(same) = n AND aggregate(same, 0, (a, x) -> a + x) >= n - 1
  WHEN size(same) < {WINDOW} OR aggregate(same, 0, (a, x) -> a + x) < {WINDOW - SUBSTITUTIONS} THEN false
  ELSE exists(sequence(1, size(same) - {WINDOW} + 1), s -> aggregate(slice(same, s, {WINDOW}), 0, (a, x) -> a + x) >= {WINDOW - SUBSTITUTIONS}) END)
"""


def leaks(docs: DataFrame, benchmark: DataFrame, least_words: int = 1) -> DataFrame:
    """(doc_id, text_hash, items): documents that hold passages of the benchmark.

    A document holds an item if 13 consecutive words of the item lie in it, in
    order and without gaps, with at most 2 words substituted. A shorter item must
    lie in it whole: with at most one word substituted if it has 7 to 12 words,
    unchanged if it has fewer. An item of one common word so marks every document
    that has the word; ``least_words`` leaves out items of fewer words. Items
    without words are in no document.

    Spaced seeds of both sides are joined: a mask of five places that ignores the
    places between them, at every word of every text; for items of up to 12 words
    masks over the whole item, for the lengths that occur. What meets is a document,
    an item and a diagonal, each once; then the aligned words of the documents with
    such hits are compared. The benchmark's seeds and words are broadcast if their
    number, counted before, times 64 bytes is at most 64 MB; else they are joined by
    shuffling.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_hashes(F.col("text")).alias("words")).where(F.size("words") >= max(1, least_words))
    words = F.size("words")
    # at most twelve lengths and a sum
    total, short = items.agg(F.coalesce(F.sum(words), F.lit(0)), F.collect_set(F.when(words < WINDOW, words))).first()
    masks = [(0, m) for m in MASKS] + [(n, m) for n in sorted(short) for m in short_masks(n)]
    side = F.broadcast if total * len(masks) * SEED_BYTES <= BROADCAST_BYTES else (lambda df: df)

    def seeded(rows: DataFrame, *names: str) -> DataFrame:
        """The seeds of texts; only the names go along, not the words."""
        out = rows.where("size(words) > 0").select(*names, F.size("words").alias("n"), F.posexplode(_seeds([m for _, m in masks])).alias("t", "seed"))
        return out.select(*names, "n", F.expr("t % n").alias("at"), F.expr("cast(t div n AS int)").alias("mask"), "seed")

    mine = F.lit(False)
    for k, (n, mask) in enumerate(masks):
        fits = (F.col("n") == n) & (F.col("at") == 0) if n else (F.col("n") >= WINDOW) & (F.col("at") + mask[-1] < F.col("n"))
        mine = mine | ((F.col("mask") == k) & fits)
    seeds = seeded(items, "item_id").where(mine).select("item_id", "seed", F.col("at").alias("j"), "n")

    ids = (F.col("doc_id"), F.xxhash64("text").alias("text_hash"))
    places = seeded(docs.select(*ids, word_hashes(F.col("text")).alias("words")), "doc_id", "text_hash").drop("n")
    met = places.join(side(seeds), "seed").select("doc_id", "text_hash", "item_id", "n", (F.col("at") - F.col("j")).alias("diagonal")).distinct()
    met = met.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.collect_list(F.struct("item_id", "n", "diagonal")).alias("hits"))
    texts = docs.select(*ids, F.coalesce("text", F.lit("")).alias("text"))
    there = texts.join(met.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")))
    # of each hit only the words beside the item go on
    there = there.select("doc_id", "text_hash", "hits", word_hashes(F.col("text")).alias("all")).select("doc_id", "text_hash", "all", F.explode("hits").alias("h"))
    skip = F.greatest(F.lit(0), -F.col("h.diagonal"))
    beside = F.slice("all", F.col("h.diagonal") + skip + 1, F.col("h.n") - skip)
    there = there.select("doc_id", "text_hash", F.col("h.item_id").alias("item_id"), F.col("h.n").alias("n"), skip.alias("skip"), beside.alias("words"))
    there = there.join(side(items.select("item_id", F.col("words").alias("item_words"))), "item_id")
    found = there.where(F.size("item_words") == F.col("n")).where(F.expr(_VERIFIED))
    return found.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def _joined(docs: DataFrame, benchmark: DataFrame, how: str) -> DataFrame:
    base = docs.withColumn("__text_hash", F.xxhash64("text"))
    got = leaks(docs, benchmark).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("items").alias("__items"))
    return base.join(got, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")), how)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold passages of the benchmark.

    Null and empty texts and an empty benchmark leave documents in. Null ids and
    repeated ids are judged by their own text. All columns are kept.
    """
    return _joined(docs, benchmark, "left_anti").drop("__text_hash")


def flagged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, n_items, items) of every document; empty table: no rows."""
    out = _joined(docs.select("doc_id", "text"), benchmark, "left")
    return out.select("doc_id", F.col("__items").isNotNull().alias("contaminated"), F.coalesce(F.size("__items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("__items", F.array().cast("array<long>")).alias("items"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold benchmark passages, each with the items it holds."""
    found = leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.size("items").cast("long").alias("n_items"), F.concat_ws(",", F.col("items").cast("array<string>")).alias("items"))


# A run of four words is unchanged in any 13 words with at most 2 substitutions, and
# a run of three in any 7 to 12 words with one, so such runs find all candidates here.
SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS v FROM benchmark),
dp AS (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 4),
bp AS (SELECT item_id, v, unnest(range(1, len(v) - 2)) AS j FROM b WHERE len(v) >= 13),
dk AS (SELECT doc_id, i, hash(w[i], w[i+1], w[i+2], w[i+3]) AS k FROM dp),
bk AS (SELECT item_id, j, hash(v[j], v[j+1], v[j+2], v[j+3]) AS k FROM bp),
bq AS (SELECT item_id, v, unnest(range(1, len(v) - 1)) AS j FROM b WHERE len(v) BETWEEN 7 AND 12),
bs AS (SELECT item_id, j, [v[j], v[j+1], v[j+2]] AS g FROM bq),
ds AS (SELECT doc_id, i, w[i:i+2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 7 AND (SELECT count(*) FROM bs) > 0)),
diag AS (SELECT DISTINCT doc_id, item_id, i - j AS g FROM dk JOIN bk USING (k) UNION SELECT DISTINCT doc_id, item_id, i - j AS g FROM ds JOIN bs USING (g)),
same AS (SELECT doc_id, item_id, len(v) AS n, list_transform(range(greatest(1, 1 - g), least(len(v), len(w) - g) + 1), lambda p: CASE WHEN w[p + g] = v[p] THEN 1 ELSE 0 END) AS s FROM diag JOIN d USING (doc_id) JOIN b USING (item_id)),
few AS (SELECT DISTINCT len(v) AS n FROM b WHERE len(v) BETWEEN 1 AND 6),
dw AS (SELECT DISTINCT doc_id, w[i:i+n-1] AS v FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, few WHERE len(w) >= n)),
hit AS (
  SELECT DISTINCT doc_id, item_id FROM same
  WHERE (n >= 13 AND len(s) >= 13 AND len(list_filter(range(1, len(s) - 11), lambda o: list_sum(s[o:o+12]) >= 11)) > 0)
     OR (n BETWEEN 7 AND 12 AND len(s) = n AND list_sum(s) >= n - 1)
  UNION SELECT doc_id, item_id FROM dw JOIN b USING (v))
SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items FROM hit GROUP BY doc_id
"""
