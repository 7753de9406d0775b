"""Capability dictionaries: text files of lines key=LETTERS # comment, in layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.functions import caps
from factlake.sources.facts_json import is_folder

#: Layers from lowest to highest priority; others follow by name.
LAYERS = ["std", "deps", "seed", "suppress", "ext"]
ENTRY = "layer string, line int, key string, caps_text string"


def _stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def parsed(lines: DataFrame) -> DataFrame:
    """lines (text, ...) with key, caps_text, mask and error: blank and comment lines are left out.

    The first = parts key from value, and a comment is cut from the value only, as keys may hold #. A line without = or
    with an unknown letter has an error and no mask.
    """
    text = _stripped(F.col("text"))
    rows = lines.withColumn("_text", text).where("_text <> '' AND NOT startswith(_text, '#')")
    at = F.instr("_text", "=")
    value = _stripped(F.substring_index(F.substring(F.col("_text"), at + 1, F.length("_text")), "#", 1))
    key = _stripped(F.substring(F.col("_text"), F.lit(1), at - 1))
    rows = rows.withColumn("key", F.when(at > 0, key)).withColumn("caps_text", F.when(at > 0, value))
    no_sign, invalid = F.concat(F.lit("missing = in: "), "_text"), F.concat(F.lit("invalid capability in: "), "caps_text")
    error = F.when(at == 0, no_sign).when(~caps.is_valid("caps_text"), invalid)
    return rows.withColumn("error", error).withColumn("mask", F.when(F.col("error").isNull(), caps.parse_letters("caps_text"))).drop("_text", "text")


def read(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(layer, line, key, caps_text, mask, error) of a dictionary file or of all files in a folder; a path that isn't there gives no
    rows. strict: an error stops the query and names its line."""
    if not _exists(spark, path):
        return spark.createDataFrame([], f"{ENTRY}, mask int, error string")
    # a dictionary is a small file, so that its line numbers are worth reading it whole
    files = spark.read.text(path, wholetext=True).withColumn("layer", F.element_at(F.split(F.input_file_name(), "/"), -1))
    lines = files.select("layer", F.posexplode(F.split("value", "\r?\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    out = parsed(lines)
    if strict:
        stop = F.raise_error(F.concat("layer", F.lit(" line "), F.col("line").cast("string"), F.lit(": "), "error")).cast("int")
        out = out.withColumn("mask", F.when(F.col("error").isNotNull(), stop).otherwise(F.col("mask")))
    return out.select("layer", "line", "key", "caps_text", "mask", "error")


def read_excluding(spark: SparkSession, path: str, layers: list[str]) -> DataFrame:
    """Entries of a folder without those layers; a path that is no folder has none."""
    return excluding(read(spark, path), layers) if is_folder(spark, path) else spark.createDataFrame([], f"{ENTRY}, mask int, error string")


def resolved_path(spark: SparkSession, explicit: str | None, project: str, built_in: str | None) -> str | None:
    """Where the dictionary is: the path asked for if it is there, else the project's folder caps, else the one that comes with
    the tool, else nowhere."""
    if explicit and _exists(spark, explicit):
        return explicit
    own = f"{project.rstrip('/')}/caps"
    if is_folder(spark, own):
        return own
    return built_in if built_in and is_folder(spark, built_in) else None


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _masks(entries: DataFrame) -> DataFrame:
    return entries if "mask" in entries.columns else entries.withColumn("mask", caps.parse_strict("caps_text"))


def _last(entries: DataFrame, priority: Column) -> DataFrame:
    return _masks(entries).groupBy("key").agg(F.max_by("mask", F.struct(priority.alias("p"), F.col("layer"), F.col("line"))).alias("mask"))


def merged(entries: DataFrame) -> DataFrame:
    """(key, mask) of entries (layer, line, key, caps_text): a later layer wins, and within one the later line.

    One aggregation with a partial step before the shuffle.
    """
    priority = F.coalesce(*(F.when(F.col("layer") == x, i) for i, x in enumerate(LAYERS)), F.lit(len(LAYERS)))
    return _last(entries, priority)


def merged_layers(entries: DataFrame, layers: list[str]) -> DataFrame:
    """Like merged, for the layers named, in that order; ones that aren't there are passed over."""
    priority = F.coalesce(*(F.when(F.col("layer") == x, i) for i, x in enumerate(layers)))
    return _last(entries.where(F.col("layer").isin(layers)), priority)


def excluding(entries: DataFrame, layers: list[str]) -> DataFrame:
    return entries.where(~F.col("layer").isin(layers))


def formatted(masks: DataFrame) -> DataFrame:
    """(line) of (key, mask): key=LETTERS # names; sorted by line when written."""
    mask = F.col("mask")
    value = F.when(mask == 0, "").otherwise(F.concat(caps.letters(mask), F.lit(" # "), caps.names(mask)))
    return masks.select(F.concat("key", F.lit("="), value).alias("line"))


def write(masks: DataFrame, path: str) -> None:
    """One text file in order; dictionaries are small by nature. An empty one is a single line end."""
    lines = formatted(masks).orderBy("line")
    if lines.isEmpty():
        lines = masks.sparkSession.createDataFrame([("",)], "line string")
    lines.coalesce(1).write.mode("overwrite").text(path)


def write_result(masks: DataFrame, default_path: str, output: str | None = None) -> DataFrame | None:
    """Write to the default path always, and to output if there is one; without, the lines are returned for printing."""
    write(masks, default_path)
    if output is None:
        return formatted(masks).orderBy("line")
    write(masks, output)
    return None
