"""Fact files in JSON: call graphs (object by function) and function reports (array of objects)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.functions import caps

REQUIRED = ["has_async", "is_unsafe_fn", "has_mut_param", "has_static_ref", "has_static_mut_ref", "has_thread_local_ref"]
OPTIONAL = ["is_trait_impl", "is_test", "is_port_method"]
_BEHAVIOR = "calls ARRAY<STRING>, " + ", ".join(f"{x} BOOLEAN" for x in REQUIRED + OPTIONAL)
_ENTRY = "name STRING, caps STRING, lines BIGINT, is_test BOOLEAN, allows_dead_code BOOLEAN"


def _callgraph(spark: SparkSession, path: str) -> DataFrame:
    """(file, def_path, f, problem) of the functions in the files at path, a file one task each; a file that is no object has one
    row with a problem."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    files = files.select(F.input_file_name().alias("file"), F.from_json("value", f"MAP<STRING, STRUCT<{_BEHAVIOR}>>").alias("m"))
    rows = files.select("file", F.posexplode_outer("m").alias("pos", "def_path", "f"), F.col("m").isNull().alias("broken"))
    rows = rows.where("broken OR def_path IS NOT NULL").groupBy("file", "def_path", "broken").agg(F.max_by("f", "pos").alias("f"))
    lacks = F.col("f.calls").isNull()
    for x in REQUIRED:
        lacks = lacks | F.col(f"f.{x}").isNull()
    problem = F.when(F.col("broken"), F.concat(F.lit("no call graph: "), "file")).when(lacks, F.concat(F.lit("missing field in "), "def_path"))
    return rows.select("file", "def_path", "f", problem.alias("problem"))


def read_callgraph(spark: SparkSession, path: str) -> DataFrame:
    """(file, def_path, calls, flags) of every function in the files at path. A file that is no such object, or a function that
    lacks a required field, stops the query. A key that a file repeats counts once, the last time."""
    rows = _callgraph(spark, path)
    stop = F.raise_error(F.col("problem")).cast("array<string>")
    rows = rows.withColumn("calls", F.when(F.col("problem").isNotNull(), stop).otherwise(F.col("f.calls")))
    optional = (F.coalesce(F.col(f"f.{x}"), F.lit(False)).alias(x) for x in OPTIONAL)
    return rows.select("file", "def_path", "calls", *(F.col(f"f.{x}") for x in REQUIRED), *optional)


def merged(graph: DataFrame) -> tuple[DataFrame, DataFrame]:
    """fn (def_path, flags), any of a key's flags holding, and edge (caller, callee), all of a key's calls."""
    flags = [x for x in REQUIRED + OPTIONAL if x in graph.columns]
    fn = graph.groupBy("def_path").agg(*(F.bool_or(x).alias(x) for x in flags))
    edge = graph.select(F.col("def_path").alias("caller"), F.explode("calls").alias("callee")).distinct()
    return fn, edge


def replaced(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of both graphs; a function that second has comes from there only."""
    return second.unionByName(first.join(second.select("def_path").distinct(), "def_path", "left_anti"))


def read_cached(spark: SparkSession, path: str, std_path: str) -> tuple[DataFrame, DataFrame]:
    """fn and edge of two folders of call graphs, each merged by itself; functions of the second replace those of the first. A
    folder that isn't there, or holds a file that is no call graph, is passed over; without any the graph is empty."""
    kinds = ", ".join(f"{x} boolean" for x in REQUIRED + OPTIONAL)
    fn, edge = spark.createDataFrame([], f"def_path string, {kinds}"), spark.createDataFrame([], "caller string, callee string")
    for folder in (path, std_path):
        if not is_folder(spark, folder) or not _callgraph(spark, folder).where("problem IS NOT NULL").isEmpty():
            continue
        own_fn, own_edge = merged(read_callgraph(spark, folder))
        names = own_fn.select("def_path")
        edge = own_edge.unionByName(edge.join(names, edge["caller"] == names["def_path"], "left_anti"))
        fn = own_fn.unionByName(fn.join(names, "def_path", "left_anti"))
    return fn, edge


def is_folder(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.exists(where) and files.getFileStatus(where).isDirectory()


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """(name, mask, lines, is_test, allows_dead_code) of report files, each an array of objects or an object a line; unknown
    letters are passed over, and a file that is neither stops the query."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.trim("value").alias("value"))
    parts = F.when(F.col("value").startswith("["), F.array("value")).otherwise(F.split("value", "\n"))
    texts = files.select(F.explode(parts).alias("text")).where(F.trim("text") != "")
    rows = texts.select(F.inline(F.from_json("text", f"ARRAY<STRUCT<{_ENTRY}>>", {"mode": "FAILFAST"})))
    return rows.select("name", caps.parse_letters("caps").alias("mask"), "lines", "is_test", "allows_dead_code")


def _framed(rows: DataFrame, group: str, left: str, right: str, path: str) -> None:
    """Write rows (group, line) as text, a folder for each group; the lines of each file stand in a frame, commas between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = []
        for b in batches:
            groups, lines = [], []
            for g, line in zip(b.column(group).to_pylist(), b.column("line").to_pylist(), strict=True):
                if last and last != [g]:
                    groups += last
                    lines.append(right)
                groups.append(g)
                lines.append(("," if last == [g] else left) + line)
                last = [g]
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.string()), pa.array(lines, pa.string())], [group, "line"])
        if last:
            yield pa.RecordBatch.from_arrays([pa.array(last, pa.string()), pa.array([right])], [group, "line"])

    rows = rows.select(F.col(group).cast("string").alias(group), "line").sortWithinPartitions(group)
    rows.mapInArrow(run, f"{group} string, line string").write.mode("overwrite").partitionBy(group).text(path)


def write_report(entries: DataFrame, path: str) -> None:
    """Entries (crate, name, caps, lines, is_test, allows_dead_code) as JSON arrays that read_report reads, a folder for each
    crate, whatever of an earlier run was there is replaced. Each task writes files of its own."""
    line = F.to_json(F.struct("name", "caps", "lines", "is_test", "allows_dead_code"))
    _framed(entries.select("crate", line.alias("line")), "crate", "[", "]", path)


def write_callgraph(fn: DataFrame, edge: DataFrame, path: str) -> None:
    """Functions (def_path, flags, optionally crate) with the callees that edge (caller, callee) gives them, as JSON objects keyed
    by function that read_callgraph reads, a folder for each crate (the first segment of the path, if fn has none)."""
    calls = edge.groupBy(F.col("caller").alias("def_path")).agg(F.sort_array(F.collect_set("callee")).alias("calls"))
    rows = fn.join(calls, "def_path", "left").withColumn("calls", F.coalesce("calls", F.array().cast("array<string>")))
    crate = F.col("crate") if "crate" in fn.columns else F.substring_index("def_path", "::", 1)
    quoted = F.to_json(F.struct(F.col("def_path").alias("k")))
    key = F.substring(quoted, F.lit(6), F.length(quoted) - 6)  # {"k":"..."} without {"k": and }
    behavior = F.to_json(F.struct("calls", *(x for x in REQUIRED + OPTIONAL if x in fn.columns)))
    _framed(rows.select(crate.alias("crate"), F.concat(key, F.lit(":"), behavior).alias("line")), "crate", "{", "}", path)


def crate_name(package: str) -> str:
    if not package:
        raise ValueError("a package needs a name")
    return package.replace("-", "_")
