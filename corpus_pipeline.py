"""A corpus of documents to packed training sequences, in five stages.

Each stage gets what its predecessor has kept, as a table read from Parquet, and all but the last return the columns of
documents. ORACLE_SQL is None: SQL can't express language models, sampling and tokenizers; tests/llm compares the
stages with plain versions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm import common as c
from factlake.llm import language
from factlake.llm.decontaminate import decontaminated
from factlake.llm.lines import without_copied_lines
from factlake.llm.near_dedup import deduplicated
from factlake.llm.packing import pack_documents

#: A document whose language is less sure than this is rejected, as is one without letters.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model tells; it learns from two thirds of the labelled ones, as in op7.

    Null, empty and letterless texts go. Where nothing could be learned, all texts with a letter stay. Other columns stay as
    they are; equal rows fare alike; an empty table gives no rows.
    """
    model = language.train(docs.where(~language.is_held_out()))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language.judged(docs, model)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("_row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of maximal repeated line runs; those that were nothing else go. n_chars follows the text.

    Null and empty texts stay; rows equal in doc_id and text are one document; other columns stay as they are; an empty
    table gives no rows.
    """
    out = without_copied_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one of least doc_id (null first).

    Null and empty texts are classes of their own; rows equal in doc_id and text count once; other columns stay as they are;
    an empty table gives no rows.
    """
    return deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Null and empty texts are clean; equal rows fare alike; other columns stay as they are; an empty table gives no rows, and an
    empty benchmark leaves all.
    """
    return decontaminated(docs, c.table(spark, sf_dir, "benchmark"), unnamed=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences, as in op2: null and empty texts are the end id alone, equal rows
    are all packed, other columns are left out, and an empty table gives no rows."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", identify_language), ("line_dedup", dedup_lines), ("near_dedup", dedup_near), ("decontaminate", decontaminate), ("pack", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = c.scratch(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
