"""Packing token sequences by minimum bin slack.

What fits together depends on lengths alone, so the search runs on the histogram of piece lengths: at most `capacity`
numbers, however many documents there are. Each bin takes the greatest length left and then the fullest combination
that a bitset subset-sum finds among the lengths that remain. A combination is used as often as the histogram allows,
so the combinations found grow with the number of distinct lengths and not with the data.

Pieces get a rank among those of their length, and a rank's place follows from the table of combinations, whose size is
bounded by the capacity as well. A length is dealt to as many groups as its pieces need (GROUP), by a number of the row, so
that a frequent length, or rows that are all equal, are not one task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factlake.llm import common as c
from factlake.llm import tokens

#: Least groups of a length, and pieces of a group where all have one length.
SALTS, GROUP = 64, 200_000


def fullest(room: int, lengths: list[int], counts: dict[int, int]) -> list[int]:
    """The lengths, repeated, of a combination that fills as much of room as any does; lengths descend.

    reach is a bitset of the sums that lengths so far can make. Each length is added in groups of 1, 2, 4, ... copies;
    the bitsets before each group lead back to the combination.
    """
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for x in lengths:
        if x > room:
            continue
        left, group = min(counts[x], room // x), 1
        while left > 0:
            k = min(group, left)
            new = reach | (reach << (k * x)) & full
            if new != reach:
                steps.append((reach, x, k))
                reach = new
            left -= k
            group *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    for was, x, k in reversed(steps):
        if not was >> total & 1:
            chosen += [x] * k
            total -= k * x
    return chosen


def combinations(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(copies by length, number of bins) so that every piece of the histogram is in one bin."""
    counts = {x: n for x, n in histogram.items() if n and x}
    order, out = sorted(counts, reverse=True), []
    while order:
        x = order[0]
        counts[x] -= 1
        bin_ = [x, *fullest(capacity - x, order, counts)]
        counts[x] += 1
        copies = {y: bin_.count(y) for y in set(bin_)}
        times = min(counts[y] // k for y, k in copies.items())
        for y, k in copies.items():
            counts[y] -= k * times
        out.append((copies, times))
        order = [y for y in order if counts[y]]
    return out


def pieces_of(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32. A document over capacity is cut into full pieces and a rest."""

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        end = np.array([end_id], "<u4").tobytes()
        rows, step = [], 4 * capacity
        for row, ids in enumerate(tokens.encoder(vocabulary).encoded(b.column("text").to_pylist())):
            ids += end
            for k, at in enumerate(range(0, len(ids), step)):
                part = ids[at : at + step]
                rows.append((row, k, at // 4, len(part) // 4, zlib.crc32(part)))
        row, piece, start, length, crc = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
            ["doc_id", "piece", "start", "length", "ids_crc32"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return c.map_rows(docs.select("doc_id", "text"), cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def packed(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces (length from 1 to capacity, ...) with sequence_id and offset: their place in sequences of that capacity."""
    spark, names = pieces.sparkSession, pieces.columns
    numbered, n = c.counted(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    groups = max(SALTS, -(-n // GROUP))
    salted = numbered.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    sizes = c.scratch(sizes, "lengths")
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most capacity rows
    slots, sequence = [], 0  # length, first rank, copies in a bin, first sequence, offset
    ranks = dict.fromkeys(histogram, 0)
    for copies, times in combinations(histogram, capacity):
        offset = 0
        for x in sorted(copies, reverse=True):
            slots.append((x, ranks[x], copies[x], sequence, offset))
            ranks[x] += copies[x] * times
            offset += x * copies[x]
        sequence += times
    slots.sort()
    shared = spark.sparkContext.broadcast(np.array(slots, np.int64).reshape(-1, 5))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).drop("_n")
    order = Window.partitionBy("length", "_salt").orderBy("_row")
    ranked = salted.withColumn("_own", F.row_number().over(order)).join(before.hint("merge"), ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_own") - 1 + F.col("_before")).select(*names, "_rank")

    def place(b: pa.RecordBatch) -> pa.RecordBatch:
        t = shared.value
        length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
        big = int(max(t[:, 1].max(), rank.max())) + 1
        # (length, rank) as one number where that is safe, else length by length
        if big < (1 << 62) // (capacity + 1):
            at = np.searchsorted(t[:, 0] * big + t[:, 1], length * big + rank, side="right") - 1
        else:
            at = np.empty(len(length), np.int64)
            for x in np.unique(length):
                lo, hi = np.searchsorted(t[:, 0], [x, x + 1])
                own = length == x
                at[own] = lo + np.searchsorted(t[lo:hi, 1], rank[own], side="right") - 1
        inside = rank - t[at, 1]
        sequence_id, offset = t[at, 3] + inside // t[at, 2], t[at, 4] + inside % t[at, 2] * length
        return pa.RecordBatch.from_arrays([*(b.column(k) for k in names), pa.array(sequence_id), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return c.map_rows(ranked, place, schema)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """Every row of docs (doc_id, text, ...) in sequences of at most capacity ids: one row per piece with its place.

    Null and empty texts are the end id alone. Equal rows are packed as often as they stand there. Other columns are
    ignored; an empty table gives no rows. Very long texts are encoded whole and cut into pieces.
    """
    return packed(pieces_of(docs, vocabulary, end_id, capacity), capacity)
