"""Benchmark decontamination by Wu-Manber search over words.

The patterns are the windows of the benchmark items: 10 consecutive words, or all words of a shorter item. Patterns of
one length are searched together. The shift table is indexed by the hash of a block of two words (one, where patterns
are one word long): a block that no pattern holds lets the search skip all positions in which it could stand, another
block the distance from its last place in any pattern to the end. Where the shift is 0, the hash of the last words
selects the patterns to compare, and the words themselves decide.

Benchmarks of any size are searched: patterns go out in broadcasts of at most BLOCK_WORDS words, one pass each, and the
hit words of a document are united over the passes. One pass is the rule.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.llm import common as c

WINDOW = 10
#: Words of patterns in one broadcast; a pattern of ten takes about 400 bytes with the tables, in the driver and in each task.
BLOCK_WORDS = 2_000_000
_TABLE = 1 << 20
_FOUND = T.StructType().add("n_words", T.LongType()).add("spans", T.ArrayType(T.ArrayType(T.LongType()))).add("items", T.ArrayType(T.StringType()))


class Search:
    """Wu-Manber tables of patterns (tuples of words) of one length; find() gives the places where any ends."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]]):
        self.m = len(next(iter(patterns)))
        self.block = min(2, self.m)
        flat = b"\0".join(b" ".join(p) for p in patterns)
        _, _, _, hashes, _ = c.words_of([flat])
        hashes = hashes.reshape(-1, self.m)
        self.shift = np.full(_TABLE, min(255, self.m - self.block + 1), np.uint8)
        for k in range(self.m - self.block + 1):  # places nearer to the end come later and are nearer, so they stay
            at = self._blocks(hashes[:, k : k + self.block].ravel())[:: self.block]
            self.shift[at] = np.minimum(self.shift[at], min(255, self.m - self.block - k))
        self.buckets: dict[int, list[tuple[tuple[bytes, ...], list[str]]]] = defaultdict(list)
        for h, (p, items) in zip(hashes, patterns.items(), strict=True):
            self.buckets[self._suffix(h)].append((p, items))

    def _blocks(self, hashes: np.ndarray) -> np.ndarray:
        """Table place of the block that begins at each word."""
        x = hashes if self.block == 1 else c.mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ hashes[1:]) if len(hashes) > 1 else hashes[:0]
        return (x & np.uint64(_TABLE - 1)).astype(np.int64)

    def _suffix(self, hashes) -> int:
        h = 0
        for x in hashes[-min(4, self.m) :]:
            h = (h * 0x100000001B3 ^ int(x)) & (1 << 64) - 1
        return h

    def find(self, hashes: np.ndarray, word) -> list[tuple[int, list[str]]]:
        """(first word, items) of each occurrence in a text; word(i) is its i-th word."""
        m, n = self.m, len(hashes)
        if n < m:
            return []
        shift = self.shift[self._blocks(hashes)].tobytes()
        out, i, last = [], m - self.block, n - self.block
        while i <= last:
            if s := shift[i]:
                i += s
                continue
            begin = i + self.block - m
            for pattern, items in self.buckets.get(self._suffix(hashes[begin : begin + m]), ()):
                if all(word(begin + k) == w for k, w in enumerate(pattern)):
                    out.append((begin, items))
            i += 1
        return out


def windows(benchmark: DataFrame, unnamed: bool = False) -> Iterator[dict[tuple[bytes, ...], list[str]]]:
    """Patterns and the ids of their items, in blocks of bounded size, at least one; the driver holds one at a time. With
    unnamed, items without an id give patterns that name no item."""
    block, size, any_ = {}, 0, False
    for row in benchmark.select("item_id", "text").toLocalIterator():
        if row.item_id is None and not unnamed or not row.text:
            continue
        buf, starts, ends, _, _ = c.words_of([row.text.encode()])
        words = [buf[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
        if not words:
            continue
        item = None if row.item_id is None else str(row.item_id)
        for k in range(max(1, len(words) - WINDOW + 1)):
            p = tuple(words[k : k + WINDOW])
            if item is None:
                size += 0 if p in block else len(p)
                block.setdefault(p, [])
            elif item not in (own := block.setdefault(p, [])):
                own.append(item)
                size += len(p)
            if size >= BLOCK_WORDS:
                yield block
                block, size, any_ = {}, 0, True
    if block or not any_:
        yield block


def _search(source: DataFrame, block: dict, keep: list[str]) -> DataFrame:
    """The columns keep of source (text, ...) with n_words, spans and items of one block of patterns."""
    shared = source.sparkSession.sparkContext.broadcast(block)
    made: list[Search] = []

    def search(b: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            by_length = defaultdict(dict)
            for p, items in shared.value.items():
                by_length[len(p)][p] = items
            made.extend(Search(p) for p in by_length.values())
        counts, spans, found = [], [], []
        for _, part in c.chunks(b.column("_text").cast(pa.large_binary()).to_pylist()):
            buf, starts, ends, hashes, first = c.words_of(part)
            for d in range(len(part)):
                lo, hi = first[d], first[d + 1]
                hits, items = [], set()
                for s in made:
                    for at, own in s.find(hashes[lo:hi], lambda i, lo=lo: buf[starts[lo + i] : ends[lo + i]].tobytes()):
                        hits.append((at, at + s.m))
                        items.update(own)
                counts.append(int(hi - lo))
                spans.append(united(hits))
                found.append(sorted(items))
        columns = [*(b.column(k) for k in keep), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(found, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, [*keep, *_FOUND.names])

    schema = T.StructType([source.schema[k] for k in keep] + _FOUND.fields)
    return c.map_rows(source.select(*keep, F.col("text").alias("_text")), search, schema)


def find_contaminated(docs: DataFrame, benchmark: DataFrame, unnamed: bool = False) -> DataFrame:
    """Per row of docs (doc_id, text, ...): doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans.

    spans: [first, end) of the runs of hit words; items: the item ids that occur, sorted as strings. Null and empty texts
    have no words and are clean; items without words are passed over; items without an id are too, or with unnamed
    count as hits but not in n_items and items; items of equal text all count; equal rows of docs give equal rows; without
    a benchmark every document is clean. Very long texts are searched whole; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = windows(benchmark, unnamed)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        out = _search(docs, first, ["doc_id"])
    else:  # rows that are equal in doc_id and text get the same result, as often as they stand there
        source = docs.select("doc_id", "text", c.text_key().alias("_key"))
        passes = [_search(source.dropDuplicates(["doc_id", "_key"]), block, ["doc_id", "_key"]) for block in chain((first, second), blocks)]
        all_ = passes[0]
        for p in passes[1:]:
            all_ = all_.union(p)
        merge = F.pandas_udf(lambda s: s.map(lambda x: united([tuple(y) for y in x])), "array<array<bigint>>")
        all_ = all_.groupBy("doc_id", "_key").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        all_ = all_.withColumn("spans", merge("_spans")).select(F.col("doc_id").alias("_id"), F.col("_key").alias("_own"), "n_words", "spans", "items")
        source = source.select("doc_id", "_key")
        out = source.join(all_, source["doc_id"].eqNullSafe(all_["_id"]) & (source["_key"] == all_["_own"]))

    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    out = out.select(F.col("doc_id").cast(kind).alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "items", "spans")
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def united(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Union of [first, end) spans, sorted."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, unnamed: bool = False) -> DataFrame:
    """docs without the contaminated documents; same columns. Nothing is shuffled."""
    kept = docs.columns
    for block in windows(benchmark, unnamed):
        hidden = docs.select(F.struct(*(F.col(f"`{k}`") for k in kept)).alias("_row"), "text")
        docs = _search(hidden, block, ["_row"]).where(F.size("spans") == 0).select("_row.*")
    return docs
