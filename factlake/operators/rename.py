"""Rename plans and the edits that carry them out."""

from __future__ import annotations

import re
import tomllib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.functions import caps


def annotate_plan(fn: DataFrame, masks: DataFrame, crate: str) -> DataFrame:
    """(old_name, new_name) for the crate's functions (def_path, is_test, is_trait_impl) with masks (def_path, mask).

    Prefixed names, names that begin with a capital, the crate's main, tests and trait implementations keep theirs, and
    so does every name that a trait implementation has. Of several new names for one old the greatest is taken.
    """
    short = caps.last_segment("def_path")
    own = fn.where(F.col("def_path").startswith(f"{crate}::")).withColumn("old_name", short)
    own = own.where(~F.col("old_name").startswith("rvs_") & ~F.col("old_name").rlike("^[A-Z]") & (F.col("def_path") != f"{crate}::main"))
    skipped = own.where("is_trait_impl AND NOT is_test").select("old_name").distinct()
    named = own.where("NOT is_test AND NOT is_trait_impl").join(masks.select("def_path", "mask"), "def_path")
    letters = caps.letters("mask")
    new = F.concat(F.lit("rvs_"), F.col("old_name"), F.when(letters == "", "").otherwise(F.concat(F.lit("_"), letters)))
    return named.join(skipped, "old_name", "left_anti").groupBy("old_name").agg(F.max(new).alias("new_name"))


def strip_plan(site: DataFrame) -> DataFrame:
    """(old_name, new_name) of sites (name, ...): prefixed names without prefix and suffix, where that changes them."""
    names = site.select(F.col("name").alias("old_name"), caps.base_name("name").alias("new_name"))
    return names.where("new_name IS NOT NULL AND new_name <> old_name").distinct()


def eligible_sites(site: DataFrame) -> DataFrame:
    """Sites (name, is_in_trait_impl, ...) that annotating may rename."""
    return site.where(caps.parsed_mask("name").isNull() & ~F.col("is_in_trait_impl"))


def local_files(files: DataFrame, root: str) -> DataFrame:
    """Rows of files (file, ...) inside root; the path must go on at a component's border."""
    root = root.rstrip("/")
    return files.where((F.col("file") == root) | F.col("file").startswith(f"{root}/"))


def in_trait_impl(site: DataFrame, impl_range: DataFrame) -> DataFrame:
    """Sites (file, lo, ...) with is_in_trait_impl: inside a range (file, lo, hi, label) whose label has ' for '.

    The equal file makes it a hash join; the range is checked within a file.
    """
    ranges = impl_range.where(F.col("label").contains(" for ")).select(F.col("file").alias("_file"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    placed = site.withColumn("_site", F.monotonically_increasing_id())  # a site may lie in several ranges, and equal sites are two
    met = placed.join(ranges, (F.col("file") == F.col("_file")) & F.col("lo").between(F.col("_lo"), F.col("_hi")), "left")
    row = F.first(F.struct(*site.columns)).alias("_row")
    return met.groupBy("_site").agg(row, F.bool_or(F.col("_file").isNotNull()).alias("is_in_trait_impl")).select("_row.*", "is_in_trait_impl")


def apply_edits(source: DataFrame, edit: DataFrame) -> DataFrame:
    """(file, text) of source (file, text) after edit (file, start, end, insert), in characters.

    Edits are applied from the end of a file to its begin; one that reaches over the end is passed over. One file is one
    group, and a file fits in memory.
    """

    def run(key, texts: pd.DataFrame, edits: pd.DataFrame) -> pd.DataFrame:
        edits = edits.sort_values(["start", "end"], ascending=False)
        rows = list(zip(edits["start"], edits["end"], edits["insert"], strict=True))
        out = []
        for text in texts["text"]:
            after, begin = [], len(text)  # what stands behind the edits made so far, last first; where it begins
            for start, end, insert in rows:
                if end > begin:  # reaches into what an edit has made: join and go on there
                    text = text[:begin] + "".join(reversed(after))
                    after, begin = [], len(text)
                    if end > begin:
                        continue
                after += [text[end:begin], insert]
                begin = start
            out.append(text[:begin] + "".join(reversed(after)))
        return pd.DataFrame({"file": texts["file"], "text": out})

    edits = edit.select("file", "start", "end", "insert").groupBy("file")
    return source.select("file", "text").groupBy("file").cogroup(edits).applyInPandas(run, "file string, text string")


def wanted_lints(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of wanted (name, level) that existing (name, ...) lacks."""
    return wanted.join(existing.select("name").distinct(), "name", "left_anti")


# Lints that a manifest should set, with their level.
WANTED = """
string_slice warn, indexing_slicing warn, unwrap_used warn, panic warn, todo warn, unimplemented warn, unreachable warn,
get_unwrap warn, unwrap_in_result warn, unchecked_time_subtraction warn, panic_in_result_fn warn,
let_underscore_future warn, let_underscore_must_use warn, unused_result_ok warn, map_err_ignore warn,
assertions_on_result_states warn, await_holding_lock warn, await_holding_refcell_ref warn, large_futures warn,
mem_forget warn, undocumented_unsafe_blocks warn, multiple_unsafe_ops_per_block warn, unnecessary_safety_doc warn,
unnecessary_safety_comment warn, float_cmp warn, float_cmp_const warn, lossy_float_literal warn, cast_sign_loss warn,
invalid_upcast_comparisons warn, rc_mutex warn, debug_assert_with_mut_call warn, iter_not_returning_iterator warn,
expl_impl_clone_on_copy warn, infallible_try_from warn, use_debug warn, dbg_macro warn, allow_attributes warn,
allow_attributes_without_reason warn, manual_ok_err allow, manual_unwrap_or_default allow
"""


def wanted_table(spark: SparkSession) -> DataFrame:
    """(name, level) of all wanted lints."""
    return spark.createDataFrame([tuple(x.split()) for x in WANTED.split(",")], "name string, level string")


def inject_lints(manifest: str) -> tuple[str, int]:
    """A manifest with the wanted lints that its table lints.clippy lacks, and how many these are; what is set stays. A text that
    is no manifest, or has another thing in that table's place, is returned as it is."""
    try:
        found = tomllib.loads(manifest)
    except tomllib.TOMLDecodeError:
        return manifest, 0
    table = found.get("lints", {})
    own = table.get("clippy", {}) if isinstance(table, dict) else None
    if not isinstance(own, dict):
        return manifest, 0
    missing = [x.split() for x in WANTED.split(",") if x.split()[0] not in own]
    lines = [f'{name} = "{level}"' for name, level in missing]
    if not missing:
        return manifest, 0
    rows = manifest.split("\n")
    head = next((k for k, x in enumerate(rows) if re.fullmatch(r"\s*\[\s*lints\s*\.\s*clippy\s*\]\s*(#.*)?", x)), None)
    if head is None and "clippy" in table:  # written inline or as dotted keys: only a parser that keeps layout could add there
        return manifest, 0
    if head is None:
        out = manifest.rstrip("\n") + "\n\n[lints.clippy]\n" + "\n".join(lines) + "\n"
    else:
        out = "\n".join([*rows[: head + 1], *lines, *rows[head + 1 :]])
    return out, len(missing)
