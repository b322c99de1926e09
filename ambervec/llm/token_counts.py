"""Operator 2: exact token counts of whole texts, huge ones by overlapping chunks."""

from __future__ import annotations

import pyarrow as pa
import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import batch_slices, documents, text_buffer
from .tokens import piece_counts

COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, model: str, limit: int = 4096, chunk: int = 8192, overlap: int = 128) -> DataFrame:
    """Tokens of each text as the sentencepiece file ``model`` counts them.

    Texts of more than twice ``chunk`` characters are encoded in chunks that
    overlap by ``overlap`` characters, spliced where both encodings share a
    boundary that the vocabulary proves stable; the overlap is doubled where
    none is found (see `tokens.PieceCounts`). A narrow scan without a shuffle.

    Null and empty texts count 0. Null ids and repeated rows are kept. Empty
    table: no rows. Other columns of the input are left out.
    """

    def run(batches):
        counter = piece_counts(model, chunk, overlap)
        for batch in batches:
            for part in batch_slices(batch, "text", 8 << 20):
                _, off = text_buffer(part.column("text"))
                n = pa.array(counter.count([t or "" for t in part.column("text").to_pylist()]), pa.int64())
                size = np.diff(off)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(size, pa.int64()), n, pa.array(n.to_numpy() > limit)], [c.split()[0] for c in COUNTS.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, COUNTS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
