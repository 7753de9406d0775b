"""Line dedup: a suffix array over line-id sequences by distributed prefix doubling, and the intervals of its common prefixes.

Each document is a sequence of line ids. Suffixes are ranked by their first line, then by pairs of ranks (first half,
second half) for 2, 4, 8, ... lines; ranks keep the order of the sequences, so each level is a suffix array to that
depth, and its ties are the intervals of suffixes with at least that many lines in common. Doubling goes on until nothing
ties. Lines that stand only once cannot begin a repeated run and leave after the first level; a suffix leaves as soon as
its rank is its own.

Then the levels are gone down again, and each step tries to lengthen the intervals by its number of lines: the members of an
interval that go on alike become a longer interval, and their first one also stays in the shorter, for the others to be
compared with. So at the end every suffix stands in the interval of the longest prefix that it shares with any suffix
before it: the maximal repeated run that begins there, and its length. An interval is named by its first member and its
length; it is counted and split by aggregates and joins, never gathered.

A later copy of a maximal repeated run with at least min_words words goes whole; the first one stays. What two copies have
in common beyond a run, and shorter runs, stay as well.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.llm import common as c

#: Least words of a run that is removed.
MIN_WORDS = 5


def _place():
    return F.struct("doc_id", "doc", "pos")


def lines_of(docs: DataFrame) -> DataFrame:
    """Per line with a word: doc_id, doc (key of the row), pos (among such lines), line (id)."""

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        row, pos, ids = [], [], []
        for i, text in enumerate(b.column("text").to_pylist()):
            own = [x.strip() for x in text.split("\n") if x and not x.isspace()]
            ids += [hashlib.blake2b(x.encode(), digest_size=16).digest() for x in own]
            row += [i] * len(own)
            pos += range(len(own))
        take = pa.array(row, pa.int64())
        columns = [b.column("doc_id").take(take), b.column("doc").take(take), pa.array(pos, pa.int32()), pa.array(ids, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "doc", "pos", "line"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return c.map_rows(docs.select("doc_id", "text", row_key().alias("doc")).where("text IS NOT NULL"), cut, f"doc_id {kind}, doc binary, pos int, line binary")


def row_key():
    """128 bits for doc_id and text: rows equal in both are one document."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce(F.col("text"), F.lit("")))))


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rank, first) of the keys that stand more than once: rank keeps their order over the whole table, first is the
    least place (doc_id, doc, pos) that has them."""
    groups = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(_place()).alias("first")).where("_n > 1").drop("_n")
    dealt = groups.repartitionByRange(c.partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    return c.scratch(dealt.withColumn("rank", F.monotonically_increasing_id()), "ranks")  # ascends by task, and within one


def suffix_levels(lines: DataFrame) -> list[DataFrame]:
    """Suffixes of lines (doc_id, doc, pos, line) that share 1, 2, 4, ... first lines with another, up to the last such number:
    a table (doc_id, doc, pos, rank, first) for each, ordered by rank like the suffix array to that depth."""
    levels, shift = [], 1
    tied, n = c.counted(lines.join(ranked(lines, ["line"]).hint("merge"), "line").drop("line"), "suffixes")
    while n:
        levels.append(tied)
        first = tied.drop("first").withColumnRenamed("rank", "rank_1")
        second = tied.select("doc", (F.col("pos") - shift).alias("pos"), F.col("rank").alias("rank_2"))
        pairs = c.scratch(first.join(second, ["doc", "pos"]), "pairs")
        tied, n = c.counted(pairs.join(ranked(pairs, ["rank_1", "rank_2"]).hint("merge"), ["rank_1", "rank_2"]).drop("rank_1", "rank_2"), "suffixes")
        shift *= 2
    return levels


def repeated_runs(lines: DataFrame) -> DataFrame:
    """(doc_id, doc, pos, n) of each line of lines (doc_id, doc, pos, line) that begins a run standing before: n is the greatest
    number of lines that the run from there on has in common with a run that begins at any place before."""
    levels = suffix_levels(lines)
    kind = lines.schema["doc_id"].dataType.simpleString()
    spark, columns = lines.sparkSession, ["doc_id", "doc", "pos", "n", "first", "asks"]
    state = spark.createDataFrame([], f"doc_id {kind}, doc binary, pos int, n int, first struct<doc_id: {kind}, doc: binary, pos: int>, asks boolean")
    found, moved = [], None
    for k in range(len(levels) - 1, -1, -1):
        width = 1 << k
        if moved is not None:
            at = levels[k].select(F.col("doc").alias("_doc"), F.col("pos").alias("_at"), "rank")
            rows = state.join(at, (F.col("doc") == F.col("_doc")) & (F.col("pos") + F.col("n") == F.col("_at")), "left").drop("_doc", "_at")
            name = ["first", "n", "rank"]
            longer = rows.where("rank IS NOT NULL").groupBy(*name).agg(F.min(_place()).alias("head"), F.max(F.when(F.col("asks"), _place())).alias("last")).where("last > head").drop("last")
            # written first, so that the join reads two plain shuffles and Spark may split a run that stands very often
            rows = rows.join(c.scratch(longer, "intervals").hint("merge"), name, "left")
            own = F.struct("n", "first", "asks")
            is_head = F.col("head") == _place()
            grown = F.struct((F.col("n") + width).alias("n"), F.col("head").alias("first"), (F.col("asks") & ~is_head).alias("asks"))
            rows = rows.withColumn("_to", F.when(F.col("head").isNull(), F.array(own)).when(is_head, F.array(own, grown)).otherwise(F.array(grown)))
            state = rows.select("doc_id", "doc", "pos", F.inline("_to")).select(columns)
        later = levels[k].where(F.col("first") != _place()).select("doc_id", "doc", "pos", "first")
        new = later if moved is None else later.join(moved, ["doc", "pos"], "left_anti").select("doc_id", "doc", "pos", "first")
        moved = later.select("doc", "pos")
        if k == 0:
            found.append(new.select("doc_id", "doc", "pos", F.lit(1).alias("n")))
        else:
            asked = new.select("doc_id", "doc", "pos", F.lit(width).alias("n"), "first", F.lit(True).alias("asks"))
            heads = new.select("first.*", F.lit(width).alias("n"), "first", F.lit(False).alias("asks")).distinct()
            state = c.scratch(state.union(asked).union(heads), "state")
    found.append(state.where("asks").select("doc_id", "doc", "pos", "n"))
    return found[0].union(found[1]) if len(found) > 1 else found[0]


def _without_copies(docs: DataFrame, min_words: int) -> DataFrame:
    """(_row, n_lines, n_removed): each row of docs as a struct, its text without later copies of repeated runs."""
    lines = c.scratch(lines_of(docs).dropDuplicates(["doc", "pos"]), "lines")
    runs = repeated_runs(lines).groupBy("doc").agg(F.collect_list(F.struct("pos", "n")).alias("_runs"))
    runs = runs.select(F.col("doc").alias("_gone"), "_runs")
    rows = docs.select(F.struct(*(F.col(f"`{k}`") for k in docs.columns)).alias("_row"), F.col("text").alias("_text"), row_key().alias("_doc"))
    rows = rows.join(runs, F.col("_doc") == F.col("_gone"), "left").select("_row", "_text", F.col("_runs.pos").alias("_pos"), F.col("_runs.n").alias("_n"))

    def rest(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, n_lines, n_removed = [], [], []
        for text, pos, n in zip(*(b.column(k).to_pylist() for k in ("_text", "_pos", "_n")), strict=True):
            own = text.split("\n") if text else []
            full = [i for i, x in enumerate(own) if x and not x.isspace()]
            gone = {full[k] for k in _covered([len(own[i].split()) for i in full], pos, n, min_words)} if pos else ()
            n_lines.append(len(full))
            n_removed.append(len(gone))
            texts.append(text if not gone else "" if len(gone) == len(full) else "\n".join(x for i, x in enumerate(own) if i not in gone))
        columns = [b.column("_row"), pa.array(texts, b.column("_text").type), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["_row", "_text", "n_lines", "n_removed"])

    schema = T.StructType([rows.schema["_row"], rows.schema["_text"]]).add("n_lines", T.LongType()).add("n_removed", T.LongType())
    out = c.map_rows(rows, rest, schema)
    return out.select(F.col("_row").withField("text", F.col("_text")).alias("_row"), "n_lines", "n_removed")


def _covered(words: list[int], pos: list[int], n: list[int], min_words: int) -> np.ndarray:
    """Lines that runs (from pos on, n lines) of min_words words cover; words: of each line."""
    total = np.concatenate([[0], np.cumsum(words)])
    begin, end = np.array(pos), np.array(pos) + np.array(n)
    enough = total[end] - total[begin] >= min_words
    depth = np.zeros(len(total), np.int64)
    np.add.at(depth, begin[enough], 1)
    np.add.at(depth, end[enough], -1)
    return np.flatnonzero(np.cumsum(depth))


def deduplicate_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs (doc_id, text, ...) without the later copies of maximal repeated line runs of at least min_words words, and the
    columns n_lines, n_removed (in place of any that docs has by these names; see without_copied_lines).

    "Later" goes by doc_id (null first) and place. Lines are equal when they are after trimming; lines without words are
    kept and don't part a run. A text that loses all its lines is "". Null texts stay null; very long ones are read whole,
    in one task each. Rows equal in doc_id and text are one document and all keep what it keeps. An empty table gives no
    rows.
    """
    names = [f"_row.`{k}`" for k in docs.columns if k not in ("n_lines", "n_removed")]
    return _without_copies(docs, min_words).select(*names, "n_lines", "n_removed")


def without_copied_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Like deduplicate_lines, with the columns of docs, all of them and no others; documents that were nothing but copies go."""
    out = _without_copies(docs, min_words).where("n_removed = 0 OR _row.text <> ''")
    return out.select(*(f"_row.`{k}`" for k in docs.columns))
