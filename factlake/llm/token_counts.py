"""Token counts by heap-and-linked-list byte-pair merging (see tokens.MergeCounter)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.llm import common as c
from factlake.llm import tokens


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """Per row of docs (doc_id, text, ...): doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Nothing is shuffled and whole texts are counted. Null and empty texts have 0 bytes and 0 tokens; equal rows give
    equal rows; a null doc_id stays null; other columns are ignored; an empty table gives no rows. Very long texts are
    counted whole, piece by piece.
    """

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        memory = tokens.counter(vocabulary)
        n = pa.array([tokens.counted(t, memory) for t in b.column("text").to_pylist()], pa.int64())
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), n], ["doc_id", "n_bytes", "n_tokens"])

    texts = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = c.map_rows(texts, count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
