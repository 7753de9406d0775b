"""The capability report: functions and lines by level and by capability, with overlapping groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factlake.functions import caps

WIDTH = 30


def report(entries: DataFrame) -> DataFrame:
    """(label, fn_count, line_count, pct, bar_len, position) of entries (name, mask, lines, is_test, allows_dead_code).

    Tests and functions with dead code allowed are out. A function counts in each of its capabilities, and pure ones are
    good and ok too. One pass sums everything; the rows are a fixed eleven, the levels always, a capability where any
    function has it. pct is in tenths of a percent.
    """
    own = entries.where("NOT is_test AND NOT allows_dead_code")
    levels = [("(ok)", caps.is_subset("mask", caps.OK)), ("(good)", caps.is_subset("mask", caps.GOOD)), ("(pure)", F.col("mask") == 0)]
    rows = [(label, test, True) for label, test in levels] + [(f"{x}({d})", caps.contains("mask", x), False) for x, d in caps.CAPABILITIES]

    def summed(k: int, label: str, test, always: bool):
        lines = F.coalesce(F.sum(F.when(test, F.col("lines"))), F.lit(0)).cast("long")
        columns = {"label": F.lit(label), "fn_count": F.count_if(test), "line_count": lines, "always": F.lit(always), "ord": F.lit(k)}
        return F.struct(*(x.alias(name) for name, x in columns.items()))

    sums = [summed(k, *row) for k, row in enumerate(rows)]
    one = own.agg(F.coalesce(F.sum("lines"), F.lit(0)).cast("long").alias("total"), F.array(*sums).alias("rows"))
    out = one.select("total", F.inline("rows")).where("total > 0 AND (always OR fn_count > 0)")
    share = F.col("line_count") / F.col("total")
    place = F.row_number().over(Window.orderBy(F.desc("line_count"), "ord"))  # eleven rows at most
    bar = F.least(F.greatest(F.round(share * WIDTH), F.lit(0)), F.lit(WIDTH)).cast("int")
    percent = F.round(share * 1000).cast("long")
    return out.select("label", "fn_count", "line_count", percent.alias("pct"), bar.alias("bar_len"), place.alias("position"))


def totals(entries: DataFrame) -> DataFrame:
    """(fn_count, line_count) of what the report covers."""
    lines = F.coalesce(F.sum("lines"), F.lit(0)).cast("long")
    return entries.where("NOT is_test AND NOT allows_dead_code").agg(F.count("*").alias("fn_count"), lines.alias("line_count"))


def report_text(entries: DataFrame) -> DataFrame:
    """(position, line): the report as text."""
    rule = F.repeat(F.lit("-"), 60)
    total = F.format_string("Total: %d functions, %d lines", "fn_count", "line_count")
    nothing = F.when(F.col("line_count") == 0, F.lit("(no rvs_ functions found)"))
    head = totals(entries).select(F.posexplode(F.array(F.lit("Capability Report"), rule, total, rule, nothing)).alias("position", "line"))
    bar = F.concat(F.repeat(F.lit("█"), F.col("bar_len")), F.repeat(F.lit("░"), WIDTH - F.col("bar_len")))
    percent = F.format_string("%d.%d", (F.col("pct") / 10).cast("long"), F.col("pct") % 10)
    line = F.concat(F.format_string("  %-12s %5d fns %6d lines %6s", "label", "fn_count", "line_count", percent), F.lit("% |"), bar, F.lit("|"))
    return head.where("line IS NOT NULL").union(report(entries).select(F.col("position") + 4, line.alias("line")))


def fn_entries(fn: DataFrame) -> DataFrame:
    """Report entries of facts (name, body_snippet, is_test, allows, ...): prefixed functions only."""
    dead = F.coalesce(F.arrays_overlap(F.split("allows", ","), F.array(F.lit("dead_code"), F.lit("unused"))), F.lit(False))
    own = fn.withColumn("mask", caps.parsed_mask("name")).where("mask IS NOT NULL")
    letters, lines = caps.letters("mask").alias("caps"), caps.effective_lines("body_snippet").alias("lines")
    return own.select("name", "mask", letters, lines, "is_test", dead.alias("allows_dead_code"))
