"""The queries opN_<name> of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from factlake.llm import common as c


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factlake.llm.near_dedup import near_duplicates

    return near_duplicates(c.table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op2_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factlake.llm.packing import pack_documents

    return pack_documents(c.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factlake.llm.decontaminate import find_contaminated

    found = find_contaminated(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "benchmark"), unnamed=True)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factlake.llm.cleaning import judged

    return judged(c.table(spark, sf_dir, "documents")).drop("text")


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factlake.llm import warc

    path = c.new_path(spark, "warc")
    pages = c.table(spark, sf_dir, "pages")
    warc.write_archives(pages, path)
    c.delete_at_exit(spark, path)
    read = warc.with_originals(warc.read_archives(spark, path, pages.schema["page_id"].dataType.simpleString()))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factlake.llm import token_files as t

    docs, path = c.table(spark, sf_dir, "documents"), c.new_path(spark, "tokens")
    t.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), 2, 50_257)
    c.delete_at_exit(spark, path)
    return t.checksums(t.read_tokens(spark, path, t.keys_of(docs)))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factlake.llm import language as l

    docs = c.table(spark, sf_dir, "documents")
    model = l.train(docs.where(~l.is_held_out()))
    found = l.identify(docs.select("doc_id", "text", l.is_held_out().alias("held_out")), model, ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factlake.llm.lines import deduplicate_lines

    return deduplicate_lines(c.table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factlake.llm.token_counts import token_counts

    return token_counts(c.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factlake.llm.extract import extract

    return extract(c.table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:2] == "op" and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from factlake.llm import oracles

    return dict(oracles.SQL)
