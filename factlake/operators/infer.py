"""Inference of capabilities over call graphs, cycles and interface votes included.

fn: def_path and the flags of functions.caps.signature_mask; edge: caller, callee; seed: key, mask.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.functions import caps
from factlake.plans.lineage import discard, settled

#: Rounds after which their tables are merged.
MERGE = 8
#: Path prefixes of the standard library's crates.
STD = ("std::", "core::", "alloc::", "compiler_builtins::")


def signature_caps(fn: DataFrame) -> DataFrame:
    """(def_path, mask) from facts alone."""
    return fn.select("def_path", caps.signature_mask().alias("mask"))


def group_of_key(path: Column | str) -> Column:
    """Vote group m@T of an implementation's key p::m@T; NULL for other paths. The first @ parts them."""
    path = F.col(path) if isinstance(path, str) else path
    at = F.instr(path, "@")
    return F.when(at > 0, F.concat(caps.last_segment(F.substring(path, F.lit(1), at - 1)), F.substring(path, at, F.length(path))))


def group_of_callee(path: Column | str) -> Column:
    """Vote group m@T that a callee T::m asks; NULL for paths with @ or without ::."""
    path = F.col(path) if isinstance(path, str) else path
    last = caps.last_segment(path)
    scope = F.substring(path, F.lit(1), F.length(path) - F.length(last) - 2)
    return F.when(~path.contains("@") & path.contains("::"), F.concat(last, F.lit("@"), scope))


def alias_of_key(path: Column | str) -> Column:
    """T::m of an implementation's key p::m@T."""
    path = F.col(path) if isinstance(path, str) else path
    at = F.instr(path, "@")
    return F.when(at > 0, F.concat(F.substring(path, at + 1, F.length(path)), F.lit("::"), caps.last_segment(F.substring(path, F.lit(1), at - 1))))


def impl_index(fn: DataFrame) -> DataFrame:
    """(group_key, def_path, is_port_method) of every implementation."""
    return fn.select(group_of_key("def_path").alias("group_key"), "def_path", "is_port_method").where("group_key IS NOT NULL")


def vote(members: DataFrame) -> DataFrame:
    """(group_key, mask) of members (group_key, mask, is_port_method): P if any member is a port method, else each capability
    but A and U that at least half of the members with a known set have."""
    known = F.count("mask")
    bits = [F.when(2 * F.count_if(F.col("mask").bitwiseAND(b) != 0) >= known, b).otherwise(0) for x, b in caps.BIT.items() if b & caps.VOTED]
    mask = F.when(F.bool_or("is_port_method"), caps.BIT["P"]).when(known > 0, reduce(lambda a, b: a.bitwiseOR(b), bits))
    return members.groupBy("group_key").agg(mask.alias("mask")).where("mask IS NOT NULL")


def impl_votes(fn: DataFrame, known: DataFrame) -> DataFrame:
    """(group_key, mask) over the masks of known (def_path, mask)."""
    return vote(impl_index(fn).join(known.select("def_path", "mask"), "def_path", "left"))


def trait_aliases(fn: DataFrame, known: DataFrame) -> DataFrame:
    """(key, mask): T::m with the voted set, for every implementation key p::m@T of known (def_path, mask)."""
    votes = impl_votes(fn, known)
    alias = known.select(alias_of_key("def_path").alias("key"), group_of_key("def_path").alias("group_key")).where("key IS NOT NULL").distinct()
    return alias.join(votes, "group_key").select("key", "mask")


def infer(fn: DataFrame, edge: DataFrame, seed: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(def_path, mask): the least fixpoint of signature capabilities, seeds and what callees pass on.

    Functions in seed and port methods keep their sets. A callee is looked up among the functions, then in seed, then,
    without @, as a vote of its implementations; that choice never changes, so edges are resolved once. Each round
    joins only what changed in the round before, and groups with a changed member vote again. Sets only grow and have
    eight letters, so it ends; max_rounds stops it sooner. A round writes what has changed; after MERGE rounds these tables
    become one, and the older ones go.
    """
    fn = fn.join(seed.select(F.col("key").alias("def_path"), F.col("mask").alias("seeded")), "def_path", "left")
    frozen = F.col("seeded").isNotNull() | F.col("is_port_method")
    own = fn.select("def_path", F.coalesce("seeded", caps.signature_mask()).alias("mask"), frozen.alias("frozen"))
    edge = edge.select("caller", "callee").distinct()
    outside = edge.select(F.col("callee").alias("def_path")).distinct().join(own, "def_path", "left_anti")
    outside = outside.join(seed.select(F.col("key").alias("def_path"), "mask"), "def_path").withColumn("frozen", F.lit(True))
    state = settled(own.unionByName(outside), "state")

    active = state.where("NOT frozen").select(F.col("def_path").alias("caller"))
    edge = edge.join(active, "caller", "left_semi")
    keys = state.select(F.col("def_path").alias("callee"), F.lit(True).alias("known"))
    known = F.coalesce("known", F.lit(False)).alias("known")
    resolved = edge.join(keys, "callee", "left").select("caller", "callee", known, group_of_callee("callee").alias("group_key"))
    resolved = settled(resolved, "edges")
    direct = resolved.where("known").select("caller", F.col("callee").alias("def_path"))
    members = impl_index(fn)
    asked = resolved.where("NOT known AND group_key IS NOT NULL").select("caller", "group_key")
    voting = settled(asked.join(members.select("group_key").distinct(), "group_key", "left_semi"), "votes")
    members = settled(members.join(voting.select("group_key").distinct(), "group_key", "left_semi"), "members")

    state = state.drop("frozen")
    deltas: list[DataFrame] = []

    def masks() -> DataFrame:
        """(def_path, mask), a row for each time a function's set has grown."""
        return reduce(DataFrame.union, deltas, state)

    def latest(rows: DataFrame, *more: Column) -> DataFrame:
        return rows.groupBy("def_path").agg(F.bit_or("mask").alias("mask"), *more)

    changed, rounds = state, 0
    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        again = members.join(changed.select("def_path"), "def_path", "left_semi").select("group_key").distinct()
        asked = members.join(again, "group_key", "left_semi")
        votes = vote(asked.join(latest(masks().join(asked.select("def_path"), "def_path", "left_semi")), "def_path"))
        passed = direct.join(changed, "def_path").select("caller", "mask").union(voting.join(votes, "group_key").select("caller", "mask"))
        gained = passed.groupBy(F.col("caller").alias("def_path")).agg(F.bit_or(F.col("mask").bitwiseAND(caps.PASSED)).alias("gained"))
        known = latest(masks().join(gained, "def_path"), F.first("gained").alias("gained"))
        new = F.col("mask").bitwiseOR(F.col("gained"))
        changed = settled(known.where(new != F.col("mask")).select("def_path", new.alias("mask")), "delta")  # what a round writes
        if changed.isEmpty():
            break
        deltas.append(changed)
        if len(deltas) == MERGE:
            merged = settled(latest(masks()), "state")
            for old in (state, *deltas[:-1]):
                discard(old)
            state, deltas = merged, []
    return latest(masks())


def direct_external(fn: DataFrame, edge: DataFrame, seed: DataFrame, inferred: DataFrame, crate: str) -> DataFrame:
    """(callee, caller, mask) of edges that leave the crate and are not in seed; mask NULL: nothing is known of the callee."""
    out = edge.where(F.col("caller").startswith(f"{crate}::") & ~F.col("callee").startswith(f"{crate}::")).select("caller", "callee").distinct()
    out = out.join(seed.select(F.col("key").alias("callee")), "callee", "left_anti")
    own = inferred.select(F.col("def_path").alias("callee"), F.col("mask").alias("own"))
    votes = impl_votes(fn, inferred).select("group_key", F.col("mask").alias("voted"))
    out = out.join(own, "callee", "left").withColumn("group_key", group_of_callee("callee")).join(votes, "group_key", "left")
    return out.select("callee", "caller", F.coalesce("own", "voted").alias("mask"))


def direct_deps(external: DataFrame) -> DataFrame:
    """(key, mask) of the known ones of direct_external."""
    return external.where("mask IS NOT NULL").select(F.col("callee").alias("key"), "mask").distinct()


def unknown_callees(external: DataFrame, shown: int = 3) -> DataFrame:
    """(callee, callers, n_callers, text) of the unknown ones: the first callers in order, and how many there are more.

    Callers are ranked before they are gathered, so that a callee of any number of callers costs one short list.
    """
    unknown = external.where("mask IS NULL").select("callee", "caller").distinct()
    rank = F.row_number().over(Window.partitionBy("callee").orderBy("caller"))
    first = unknown.withColumn("rank", rank).where(F.col("rank") <= shown)
    lists = first.groupBy("callee").agg(F.sort_array(F.collect_list("caller")).alias("list"))
    counts = unknown.groupBy("callee").agg(F.count("*").alias("n_callers"))
    more = F.when(F.col("n_callers") > shown, F.concat(F.lit("    ... and "), (F.col("n_callers") - shown).cast("string"), F.lit(" more\n"))).otherwise("")
    lines = F.array_join(F.transform("list", lambda x: F.concat(F.lit("    called by: "), x, F.lit("\n"))), "")
    text = F.concat(F.lit("  "), F.col("callee"), F.lit("=\n"), lines, more)
    return lists.join(counts, "callee").select("callee", F.array_join("list", ", ").alias("callers"), "n_callers", text.alias("text"))


def _is_std(path: str) -> Column:
    return reduce(lambda a, b: a | b, (F.col(path).startswith(p) for p in STD))


def infer_std(fn: DataFrame, edge: DataFrame, seed: DataFrame, crate: str) -> tuple[DataFrame, DataFrame]:
    """(key, mask) of the standard library, and its unknown callees (callee, caller).

    Aliases from signatures of std functions override seed before the fixpoint, and aliases from its result override
    what was inferred.
    """
    std = fn.where(_is_std("def_path"))
    first = trait_aliases(std, signature_caps(std))
    start = settled(first.union(seed.select("key", "mask").join(first, "key", "left_anti")), "seed")
    inferred = infer(fn, edge, start)
    last = trait_aliases(std, inferred.where(_is_std("def_path")))
    whole = last.union(inferred.select(F.col("def_path").alias("key"), "mask").join(last, "key", "left_anti"))
    whole = settled(whole, "inferred")
    out = whole.where(_is_std("key") & ~F.col("key").startswith(f"{crate}::"))
    calls = edge.where(_is_std("caller")).select("callee", "caller").distinct()
    unknown = calls
    for table, key in ((whole, "key"), (start, "key"), (fn, "def_path")):
        unknown = unknown.join(table.select(F.col(key).alias("callee")), "callee", "left_anti")
    return out, unknown
