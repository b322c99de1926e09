"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages
the rows are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ambervec.llm import decontaminate, lines, near_dedup, packing, quality
from ambervec.llm.common import documents, staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ACCEPT = 0.7


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.7 or more. It learns from
    labelled rows whose id's crc32 is not 2 modulo 4."""
    held_out = F.coalesce((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4) == 2, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out)
    model = quality.fit_quality(docs, labels)
    return quality.quality_scores(docs, model, "__score").where(F.col("__score") >= ACCEPT).drop("__score")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that occur, or nearly occur, earlier. A document
    goes only if lines were taken and nothing but blank ones is left."""
    names = docs.columns
    out = lines.deduplicated_lines(docs)
    out = out.where((F.col("n_removed") == 0) | F.col("kept_text").rlike(r"(?U)\S"))
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    changed = {"text": text}
    if "n_chars" in names:
        changed["n_chars"] = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.char_length("kept_text").cast(docs.schema["n_chars"].dataType))
    return out.withColumns(changed).select(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the least id) of each group of near copies: 0.8 on five-word shingles."""
    return near_dedup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences of 4096."""
    import public_tokenizers

    return packing.best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_filter),
    ("line_dedup", line_dedup),
    ("near_dedup", near_duplicates),
    ("decontaminate", decontamination),
    ("pack", pack),
]

# A trained network and a tokenizer cannot be said in SQL; the stages are tested
# against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
