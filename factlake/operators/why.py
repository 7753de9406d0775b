"""Why a function has its capabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.functions import caps
from factlake.operators.infer import group_of_callee, impl_index, vote


def shown(mask: Column) -> Column:
    """BI (Blocking IO); (pure); (unknown)"""
    return F.when(mask.isNull(), "(unknown)").when(mask == 0, "(pure)").otherwise(F.concat(caps.letters(mask), F.lit(" ("), caps.names(mask), F.lit(")")))


def callees(function: str, fn: DataFrame, edge: DataFrame, inferred: DataFrame, seed: DataFrame) -> DataFrame:
    """(callee, mask, text) of what a function calls: inferred, else seeded, else voted."""
    own = edge.where(F.col("caller") == function).select("callee").distinct()
    out = own.join(inferred.select(F.col("def_path").alias("callee"), F.col("mask").alias("one")), "callee", "left")
    out = out.join(seed.select(F.col("key").alias("callee"), F.col("mask").alias("two")), "callee", "left")
    out = out.withColumn("group_key", group_of_callee("callee"))
    members = impl_index(fn).join(F.broadcast(out.select("group_key").distinct()), "group_key", "left_semi")  # one function's callees
    votes = vote(members.join(inferred.select("def_path", "mask"), "def_path", "left")).select("group_key", F.col("mask").alias("three"))
    out = out.join(votes, "group_key", "left")
    return out.select("callee", F.coalesce("one", "two", "three").alias("mask")).withColumn("text", shown(F.col("mask")))


def candidates(part: str, fn: DataFrame, inferred: DataFrame, most: int = 10) -> DataFrame:
    """(def_path, text): the first functions in order whose path contains part."""
    found = fn.where(F.col("def_path").contains(part)).select("def_path").distinct().orderBy("def_path").limit(most)
    mask = F.col("mask")
    text = F.when(mask.isNull(), " (unknown)").when(mask == 0, " (pure)").otherwise(F.concat(F.lit(" = "), caps.letters(mask)))
    return found.join(inferred.select("def_path", "mask"), "def_path", "left").select("def_path", F.concat("def_path", text).alias("text"))


def why(function: str, fn: DataFrame, edge: DataFrame, inferred: DataFrame, seed: DataFrame) -> DataFrame:
    """(position, line): the answer as text: the function with its set and its callees in order, or candidates, or an error."""
    own = fn.where(F.col("def_path") == function).select("def_path").distinct().join(inferred, "def_path", "left")
    mask = F.col("mask")
    head = F.concat("def_path", F.when(mask.isNull(), " (not in inferred)").when(mask == 0, " (pure)").otherwise(F.concat(F.lit(" = "), shown(mask))))
    rows = own.select(F.lit(0).alias("position"), head.alias("line"), F.lit("").alias("k"))
    called = callees(function, fn, edge, inferred, seed)
    lines = called.select(F.lit(3), F.concat(F.lit("    "), "callee", F.lit(": "), "text"), "callee")
    if own.isEmpty():
        near = candidates(function, fn, inferred)
        if near.isEmpty():
            raise ValueError(f"function '{function}' not found in callgraph")
        rows = near.select(F.lit(1).alias("position"), F.concat(F.lit("  "), "text").alias("line"), F.col("def_path").alias("k"))
        rows = rows.union(rows.sparkSession.createDataFrame([(0, "Exact match not found. Did you mean:", "")], rows.schema))
    else:
        some = not called.isEmpty()
        fixed = [(1, "", ""), (2, "  callees:" if some else "  (no callees)", "")]
        rows = rows.union(rows.sparkSession.createDataFrame(fixed, rows.schema)).union(lines)
    return rows.orderBy("position", "k").select("position", "line")
