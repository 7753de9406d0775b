"""Near-duplicates: improved consistent weighted sampling over TF-IDF word shingles, banded, verified.

Texts are cut into word shingles (five words). A shingle weighs tf * (FLOOR + (1 - FLOOR) * idf), where idf is
ln(N / df), at most ln(1 / RARE), as a share of that most: idf saturates once a shingle stands in under RARE of all
documents. So only the frequent shingles need a table, and there are at most (mean shingles of a document) / RARE of
them whatever N is. Tables over TABLE_BYTES are never broadcast whole: passes over the texts note, a block of the table
each, what weights a text's own shingles have.

A sketch has SAMPLES samples. In each, every shingle of the text competes with its weight: the sample is the shingle (and
quantum of its weight) that comes first under Ioffe's scheme, so two texts agree in a sample as often as their weighted
Jaccard says. ROWS samples make a band; texts that agree in a band share a bucket.

Buckets never become all pairs. First each member is compared with its bucket's least member. Then rounds follow: the
members of a bucket whose classes still differ are ordered by further samples, so that the more samples two texts share the
nearer they stand, and a member is compared with its neighbour where the two are of different classes. A round has at most
one pair for each member of a bucket, of buckets of any size, and orders are sorted over all tasks, so that a bucket of
any size is split. There are ROUNDS rounds, each with orders of its own; they only leave less to the last step.

That step compares all pairs which the rounds have left: two members of a bucket, neither of them its least, whose classes
still differ. Buckets are cut into blocks, and a task gets two blocks and the overlaps of all their texts as products
of matrices, so that pairs never are rows; two blocks of one same class are left out. So no two texts of a bucket whose
similarity reaches the threshold end in two classes, whatever ROUNDS, DEPTH and BLOCK are. Time here grows with the
square of the members of those buckets whose texts are near and yet under the threshold.

Samples may miss a pair, so a last pass takes the rest exactly, by prefixes: shingles have one order, rare ones first, and
the keys of a text are its first shingles, until what is left weighs less than the threshold's share of the text. Two
similar texts have a key in common. Where texts of two classes have one, the weight of all their common keys and of what
is left bounds what they may share, and pairs that may reach the threshold are verified. A key of more than GROUP texts
is compared like a bucket. So no two similar texts end in two classes.

Only texts that are compared are shuffled: a Bloom filter drops the other rows where they are read, and an exact join drops
those that it lets through, so FILTER_BYTES bounds the filter and never what is found.

Every link was verified on the whole texts. Copies are collapsed first and never expanded. Null, empty and wordless texts
are alone in their class. Very long texts are read whole, a batch of them at a time. Equal rows are one class like any
copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.llm import common as c

#: Samples of a sketch, and those of a band: a pair at 0.8 shares a band with a probability of 0.9993.
BANDS, ROWS = 24, 6
SAMPLES = BANDS * ROWS
#: Further samples by which the members of a bucket are ordered, and rounds of comparing neighbours.
DEPTH, ROUNDS = 16, 2
#: Most texts and bytes of a block of a bucket (a longer text is a block), and columns of its matrices.
BLOCK, BLOCK_BYTES, COLUMNS = 1024, 1 << 21, 1024
#: Most texts of a key whose pairs are rows; the texts of other keys are compared in blocks.
GROUP = 64
#: log2 of the number of hashed counters that preselect frequent shingles, and their parts in the merge.
COUNTERS, PARTS = 20, 16
FLOOR, RARE = 0.75, 1 / 256
#: Most bytes of a broadcast table of frequent shingles.
TABLE_BYTES = 64 << 20
#: Bits for each row of a filter, and most bytes of it; a filter of more rows than these serve lets more other rows through.
FILTER_BITS, FILTER_BYTES = 16, 16 << 20

_SHIFT = np.uint64(16)
_ROW = np.dtype([("shingle", "<u8"), ("idf", "<f8")])


def _scheme() -> tuple[np.ndarray, ...]:
    """Random r, ln c and beta (Gamma(2, 1), Gamma(2, 1) and uniform) for each of 65536 places."""
    u = ((c.mix(np.arange(5 << 16, dtype=np.uint64) + np.uint64(0xA5A5)) >> np.uint64(11)) + np.uint64(1)) * 2.0**-53
    u = u.reshape(5, -1)
    return tuple(x.astype(np.float32) for x in (-np.log(u[0] * u[1]), np.log(-np.log(u[2] * u[3])), u[4] * (1 - 2.0**-20)))


_R, _LOG_C, _BETA = _scheme()
_MULTIPLIERS = c.mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _raced(place: np.ndarray, log_weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a shingle of that weight reaches at a place of the scheme (as a number that orders alike, in the upper half of 64
    bits), and the quantum of its weight."""
    r, beta = _R[place], _BETA[place]
    t = np.floor(log_weight / r + beta)
    reached = (_LOG_C[place] - r * (t - beta) - r).astype(np.float32)
    bits = reached.view(np.uint32)
    bits ^= np.where(bits >> np.uint32(31), np.uint32(0xFFFFFFFF), np.uint32(1 << 31))
    return bits.astype(np.uint64) << np.uint64(32), t


#: The same for all places and the weight 1, which most shingles have.
_ONE = _raced(np.arange(1 << 16), np.zeros(1 << 16, np.float32))[0]


class Weights:
    """Weights of shingles: sorted frequent shingles with their share of the most idf, and that of all others."""

    def __init__(self, keys: np.ndarray, idf: np.ndarray, rest: float):
        self.keys, self.idf, self.rest = keys, idf, rest

    @staticmethod
    def noted(notes: list[bytes | None], rest: float) -> Weights:
        """Of texts that carry what their own shingles weigh."""
        rows = np.frombuffer(b"".join(x or b"" for x in notes), _ROW)
        keys, at = np.unique(rows["shingle"], return_index=True)
        return Weights(keys, rows["idf"][at], rest)

    def of(self, shingles: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Weights, as multiples of the weight that a shingle of no table has where it stands once."""
        weight = np.ones(len(shingles))
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, shingles), len(self.keys) - 1)
            found = self.keys[at] == shingles
            weight[found] = (FLOOR + (1 - FLOOR) * self.idf[at[found]]) / (FLOOR + (1 - FLOOR) * self.rest)
        return tf * weight


def document_shingles(part: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, 48-bit shingle and count of each distinct shingle of each text, sorted by both."""
    _, _, _, hashes, first = c.words_of(part)
    s, at = c.shingles_of(hashes, first, n)
    packed = np.sort(at.astype(np.uint64) << np.uint64(48) | s >> _SHIFT)
    if not len(packed):
        return np.empty(0, np.int64), packed, np.empty(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
    tf = np.diff(np.concatenate([new, [len(packed)]]))
    packed = packed[new]
    return (packed >> np.uint64(48)).astype(np.int64), packed & np.uint64((1 << 48) - 1), tf


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.large_binary()).to_pylist()


def shingle_frequencies(docs: DataFrame, n: int) -> tuple[DataFrame, int, int, np.ndarray]:
    """(shingle, df) of all frequent shingles, exact, from two passes over all documents; how many they are, and how many these;
    and a number for each hashed counter that grows with it, about 8 times its binary logarithm."""
    spark = docs.sparkSession
    text = docs.select("text")
    size = 1 << COUNTERS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, n_rows = np.zeros(size, np.uint32), 0
        for b in c.slices(batches):
            n_rows += b.num_rows
            for _, part in c.chunks(_texts(b)):
                _, _, _, hashes, first = c.words_of(part)
                s, _ = c.shingles_of(hashes, first, n)
                counters += np.bincount((s >> _SHIFT & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint32)
        if n_rows:
            parts = counters.reshape(PARTS, -1).astype(np.uint64)
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(PARTS), pa.int32()), "task": pa.array([task] * PARTS, pa.int64()), "n": pa.array([n_rows] * PARTS, pa.int64()), "counts": [x.tobytes() for x in parts]})

    def add(t: pa.Table) -> pa.Table:
        out = np.zeros(size // PARTS, np.uint64)
        for b in t.column("counts").to_pylist():
            out += np.frombuffer(b, np.uint64)
        return pa.table({"part": t.column("part")[:1], "task": t.column("task")[:1], "n": pa.array([sum(t.column("n").to_pylist())], pa.int64()), "counts": [out.tobytes()]})

    merged = c.merged(text.mapInArrow(count, "part int, task long, n long, counts binary"), "part", add)
    counters, total = np.zeros((PARTS, size // PARTS), np.uint64), 0
    for row in merged.collect():  # PARTS rows
        counters[row.part], total = np.frombuffer(row.counts, np.uint64), row.n
    least = max(1.0, RARE * total)
    shared = spark.sparkContext.broadcast(counters.ravel() >= least)

    def frequent(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for _, part in c.chunks(_texts(b)):
            _, _, _, hashes, first = c.words_of(part)
            s, at = c.shingles_of(hashes, first, n)
            s >>= _SHIFT
            keep = shared.value[(s & np.uint64(size - 1)).astype(np.int64)]
            packed = np.unique(at[keep].astype(np.uint64) << np.uint64(48) | s[keep])
            out.append(packed & np.uint64((1 << 48) - 1))
        out, df = np.unique(np.concatenate(out), return_counts=True)
        return pa.RecordBatch.from_pydict({"shingle": out.astype(np.int64), "df": df})

    df = c.map_rows(text, frequent, "shingle long, df long").groupBy("shingle").agg(F.sum("df").alias("df")).where(F.col("df") >= least)
    df, n = c.counted(df, "shingle-df")
    return df, n, total, np.minimum(255, 8 * np.log2(1.0 + counters.ravel())).astype(np.uint8)


class Weigher:
    """Weights for the rows of a table: one broadcast table, or notes that the rows carry where that would be too large."""

    def __init__(self, docs: DataFrame, n: int):
        spark = docs.sparkSession
        df, rows, total, levels = shingle_frequencies(docs, n)
        self.levels = spark.sparkContext.broadcast(levels)
        most = math.log(1 / RARE)
        self.n, self.rest = n, min(1.0, math.log(max(total, 1)) / most)

        def table(rows: DataFrame):
            t = rows.toArrow().sort_by("shingle")
            idf = np.clip(np.log(total / t.column("df").to_numpy()) / most, 0, 1) if len(t) else np.empty(0)
            return spark.sparkContext.broadcast(Weights(t.column("shingle").to_numpy().astype(np.uint64), idf, self.rest))

        blocks = -(-rows * _ROW.itemsize // TABLE_BYTES)
        self.shared = table(df) if blocks < 2 else None
        self.tables = [] if blocks < 2 else [table(df.where(F.pmod(F.xxhash64("shingle"), F.lit(blocks)) == k)) for k in range(blocks)]
        self.columns = ["notes"] if self.tables else []

    def ready(self, docs: DataFrame) -> DataFrame:
        """docs (text, ...) with what weights() reads."""
        n = self.n
        for k, shared in enumerate(self.tables):
            rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text"), F.lit(b"").alias("notes") if not k else F.col("notes"))

            def note(b: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
                own = shared.value
                out = []
                for _, part in c.chunks(_texts(b)):
                    doc, shingle, _ = document_shingles(part, n)
                    known = np.isin(shingle, own.keys)
                    at = np.searchsorted(own.keys, shingle[known])
                    rows = np.empty(len(at), _ROW)
                    rows["shingle"], rows["idf"] = shingle[known], own.idf[at]
                    cuts = np.searchsorted(doc[known], np.arange(len(part) + 1))
                    out += [rows[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                out = [x + y for x, y in zip(b.column("notes").to_pylist(), out, strict=True)]
                return pa.RecordBatch.from_arrays([b.column("_row"), pa.array(out, pa.binary())], ["_row", "notes"])

            names = [x for x in docs.columns if x != "notes"]
            schema = T.StructType([rows.schema["_row"], T.StructField("notes", T.BinaryType())])
            docs = c.map_rows(rows, note, schema).select(*(F.col(f"_row.{x}") for x in names), "notes")
        return docs

    def reader(self):
        """A function from a batch of ready() to Weights, for a task."""
        shared, rest = self.shared, self.rest
        return lambda batch, *columns: shared.value if shared is not None else Weights.noted([x for k in columns or ("notes",) for x in batch.column(k).to_pylist()], rest)


def sketches(part: list[bytes], weights: Weights, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Samples of each text (texts x SAMPLES) and whether it has words."""
    doc, shingle, tf = document_shingles(part, n)
    return samples(len(part), doc, shingle, weights.of(shingle, tf))


def samples(n_texts: int, doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of texts whose shingles have these weights."""
    out, some = np.zeros((n_texts, SAMPLES), np.uint64), np.zeros(n_texts, bool)
    if not len(doc):
        return out, some
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    own = doc[first]
    some[own] = True
    s = c.mix(shingle + np.uint64(0x51ED270B))
    low = s & np.uint64(0xFFFFFFFF)
    other = np.flatnonzero(weight != 1)
    log_weight, s_other, low_other = np.log(weight[other]).astype(np.float32), s[other], low[other]
    for k, m in enumerate(_MULTIPLIERS):
        reached = _ONE[(s * m >> np.uint64(48)).view(np.int64)]
        reached |= low
        if len(other):
            value, t = _raced((s_other * m >> np.uint64(48)).view(np.int64), log_weight)
            reached[other] = value | (low_other + t.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF))
        out[own, k] = np.minimum.reduceat(reached, first)
    return c.mix(out), some


def prefixes(n_texts: int, doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, levels: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """Keys of all texts, their weights, how many each text has, what a text weighs, and its shingles that are no keys.

    Shingles of low levels come first, and the rest by a hash; a text's keys are those before which at most 1 - threshold
    of its weight stands, so the others weigh less than any similar text has in common with it.
    """
    key = levels[(shingle & np.uint64(len(levels) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(40)
    key |= c.mix(shingle + np.uint64(0x2545F491)) >> np.uint64(24)
    order = np.argsort(doc.astype(np.uint64) << np.uint64(48) | key)
    key, weight = key[order], weight[order]  # texts stay where they were
    total = np.bincount(doc, weight, n_texts)
    before = np.cumsum(weight) - weight
    before -= np.append(before, 0)[np.searchsorted(doc, np.arange(n_texts))][doc]
    keep = before <= (1 - threshold + 1e-9) * total[doc]
    key, weight, doc = key[keep].astype(np.int64), weight[keep], doc[keep]
    return key, weight, np.bincount(doc, minlength=n_texts), total, np.maximum(total - np.bincount(doc, weight, n_texts), 0)


def weighted_jaccard(a: bytes, b: bytes, weights: Weights, n: int) -> float:
    doc, shingle, tf = document_shingles([a, b], n)
    w = weights.of(shingle, tf)
    cut = np.searchsorted(doc, 1)
    _, i, j = np.intersect1d(shingle[:cut], shingle[cut:], assume_unique=True, return_indices=True)
    both = np.minimum(w[:cut][i], w[cut:][j]).sum()
    total = w.sum() - both
    return float(both / total) if total else 0.0


def _verified(pairs: DataFrame, texts: DataFrame, weigher: Weigher, threshold: float) -> DataFrame:
    """The pairs (a, b, ...) whose texts are similar."""
    names, read, n = pairs.columns, weigher.reader(), weigher.n

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = (batch.column(f"_text_{k}").cast(pa.large_binary()).to_pylist() for k in "ab")
        weights = read(batch, "_notes_a", "_notes_b")
        good = [i for i in range(batch.num_rows) if weighted_jaccard(x[i], y[i], weights, n) >= threshold]
        return pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(good, pa.int64())) for k in names], names)

    both = pairs
    for k in "ab":
        own = texts.select(F.col("node").alias(k), *(F.col(x).alias(f"_{x}_{k}") for x in ["text", *weigher.columns]))
        both = both.join(own.hint("merge"), k)
    extra = [x for x in both.columns if x not in names]
    return c.map_rows(both.select(*names, *extra), verify, pairs.schema)


def _hashes(*columns: str) -> list["F.Column"]:
    return [F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)]


def _slots(hashes: list["F.Column"], mask: int) -> list["F.Column"]:
    """The bits of a row in a filter of mask + 1 bits."""
    return [F.shiftrightunsigned(h, by).bitwiseAND(F.lit(mask)) for h in hashes for by in (0, 32)]


def among(rows: DataFrame, columns: list[str], chosen: DataFrame, of: list[str], n: int) -> DataFrame:
    """rows without most of those whose columns are those (of) of no row of chosen, which has n rows: a Bloom filter."""
    bits = min(8 * FILTER_BYTES, 1 << max(16, (FILTER_BITS * n - 1).bit_length()))
    slot = chosen.select(F.explode(F.array(*_slots(_hashes(*of), bits - 1))).alias("slot"))
    slot = slot.select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, CAST(slot & 63 AS INT))").alias("bit"))
    words = slot.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    held = np.zeros(bits >> 6, np.int64)
    held[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(held.view(np.uint64))

    @F.arrow_udf("boolean")
    def may_be(*slots: pa.Array) -> pa.Array:
        words, found = shared.value, True
        for x in slots:
            x = x.to_numpy().view(np.uint64)
            found = (words[(x >> np.uint64(6)).view(np.int64)] >> (x & np.uint64(63)) & np.uint64(1)).astype(bool) & found
        return pa.array(found)

    # else it is asked of both sides of a join, and before the columns are made, which would be made twice
    return rows.where(may_be.asNondeterministic()(*_slots(_hashes(*columns), bits - 1)))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of each node of edges (a, b): comp is the least node it is connected with.

    Each round a node takes the least label around it and then that label's own label, so that the rounds grow with
    the logarithm of a chain's length. Labels stay in the shared folder; only a count comes to the driver.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("comp"))
    labels = c.scratch(labels, "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", F.least("comp", "near").alias("low"), F.col("comp").alias("was"))
        up = labels.select(F.col("node").alias("low"), F.col("comp").alias("up"))
        new = step.join(up, "low").select("node", F.least("low", "up").alias("comp"), (F.least("low", "up") != F.col("was")).alias("moved"))
        new, moved = c.counted(new, "labels", F.count_if("moved"))
        labels = new.select("node", "comp")
        if not moved:
            return labels


def neighbours(rows: DataFrame) -> DataFrame:
    """Pairs (a, b, comp_a, comp_b) of rows (band, place, node, comp) that stand next to one another in the order of band, place
    and node, with one band and two comps.

    The order is dealt by ranges of all its columns, so that a band of any size is split; the first and last row of each
    task meet in a join.
    """
    order = ["band", "place", "node"]
    dealt = rows.repartitionByRange(c.partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    ends = ["part", "end", "band", "node", "comp"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, end = TaskContext.get().partitionId(), None, None
        for b in c.slices(batches, 1 << 16):
            band, node, comp = b.column("band").to_pylist(), b.column("node").to_pylist(), b.column("comp").to_pylist()
            out = [] if last else [(None, None, None, None, part, 0, band[0], node[0], comp[0])]
            for row in zip(band, node, comp, strict=True):
                if last and row[0] == last[0] and row[2] != last[2]:
                    out.append((last[1], row[1], last[2], row[2], None, None, None, None, None))
                last = row
            end = b.schema
            yield batch(out)
        if end is not None:
            yield batch([(None, None, None, None, part, 1, *last)])

    types = [pa.binary()] * 4 + [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    names = ["a", "b", "comp_a", "comp_b", *ends]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out, strict=True)) or [()] * 9, types, strict=True)], names)

    schema = "a binary, b binary, comp_a binary, comp_b binary, part long, end int, band long, node binary, comp binary"
    found = c.scratch(dealt.mapInArrow(scan, schema), "neighbours")
    before = found.where("end = 1").select((F.col("part") + 1).alias("part"), "band", F.col("node").alias("a"), F.col("comp").alias("comp_a"))
    after = found.where("end = 0").select("part", "band", F.col("node").alias("b"), F.col("comp").alias("comp_b"))
    met = before.join(after, ["part", "band"]).where("comp_a <> comp_b").select("a", "b", "comp_a", "comp_b")
    return found.where("a IS NOT NULL").select("a", "b", "comp_a", "comp_b").union(met)


def _places(members: DataFrame, turn: int) -> DataFrame:
    """(band, place, node, comp) of members (node, bands, sketch, comp): place is a choice of other samples for each band and turn."""
    orders = c.mix(np.arange(BANDS * SAMPLES, dtype=np.uint64) + np.uint64((turn + 1) << 32)).reshape(BANDS, SAMPLES)
    for k in range(BANDS):
        orders[k, k * ROWS : (k + 1) * ROWS] = (1 << 64) - 1  # its own come last: a bucket's members have them all
    chosen = np.argsort(orders, axis=1)[:, :DEPTH]

    def place(b: pa.RecordBatch) -> pa.RecordBatch:
        n = b.num_rows
        sketch = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint8).reshape(n, SAMPLES)
        places = np.ascontiguousarray(sketch[:, chosen]).reshape(n * BANDS, DEPTH)
        take = pa.array(np.repeat(np.arange(n), BANDS))
        columns = [b.column("bands").flatten(), pa.array([x.tobytes() for x in places], pa.binary()), b.column("node").take(take), b.column("comp").take(take)]
        return pa.RecordBatch.from_arrays(columns, ["band", "place", "node", "comp"])

    return c.map_rows(members.select("node", "bands", "sketch", "comp"), place, "band long, place binary, node binary, comp binary")


def overlaps(texts: list[bytes], left: np.ndarray, right: np.ndarray, weights: Weights, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Weight that texts left and texts right have in common (left x right; not that of a text with itself), and the weight of each text.

    The weight of a shingle is its count times a factor, so a shingle that stands k times is k columns of that factor, and the
    common weight a product of matrices of zeros and ones. Columns of many texts are multiplied, the others counted.
    """
    cells = [(start, *document_shingles(part, n)) for start, part in c.chunks(texts)]
    doc = np.concatenate([start + d for start, d, _, _ in cells])
    shingle, tf = (np.concatenate([x[k] for x in cells]) for k in (2, 3))
    weight = weights.of(shingle, np.ones(len(shingle)))
    total = np.bincount(doc, weight * tf, len(texts))
    common = np.zeros((len(left), len(right)))
    _, column, seen = np.unique(shingle, return_inverse=True, return_counts=True)
    keep = np.flatnonzero(seen[column] > 1)
    doc, column, tf, weight = doc[keep], column[keep], tf[keep], weight[keep]
    if not len(doc):
        return common, total
    time = np.arange(tf.sum()) - np.repeat(np.cumsum(tf) - tf, tf)
    doc, weight = np.repeat(doc, tf), np.repeat(weight, tf)
    _, column = np.unique(np.repeat(column, tf) * tf.max() + time, return_inverse=True)
    sides = []
    for side in (left, right):
        place = np.full(len(texts), -1)
        place[side] = np.arange(len(side))
        own = np.flatnonzero(place[doc] >= 0)
        own = own[np.argsort(column[own], kind="stable")]
        sides.append((place[doc[own]], column[own], weight[own]))
    n_columns = column.max() + 1
    counts = [np.bincount(x[1], minlength=n_columns) for x in sides]
    many = counts[0] * counts[1] * 64 >= common.size
    (row_a, column_a, _), (row_b, column_b, weight_b) = sides
    number = np.cumsum(many) - 1
    dense = [np.flatnonzero(many[x[1]]) for x in sides]
    for at in range(0, int(many.sum()), COLUMNS):
        width = min(COLUMNS, int(many.sum()) - at)
        a, b = np.zeros((len(left), width)), np.zeros((len(right), width))
        for x, row, col, own, value in ((a, row_a, column_a, dense[0], 1.0), (b, row_b, column_b, dense[1], weight_b)):
            i, j = np.searchsorted(number[col[own]], [at, at + width])
            own = own[i:j]
            x[row[own], number[col[own]] - at] = value if np.isscalar(value) else value[own]
        common += a @ b.T
    few = np.flatnonzero(~many[column_a] & (counts[1][column_a] > 0))
    first = np.cumsum(counts[1]) - counts[1]
    size = counts[1][column_a[few]]
    ends = np.cumsum(size)
    start = 0
    while start < len(few):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + (1 << 20), "right")))
        own, k = few[start:stop], size[start:stop]
        other = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first[column_a[own]], k)
        np.add.at(common.reshape(-1), np.repeat(row_a[own], k) * len(right) + row_b[other], weight_b[other])
        start = stop
    return common, total


def cell_links(texts: list[bytes], comps: list[bytes], second: np.ndarray, weights: Weights, n: int, threshold: float) -> list[tuple[bytes, bytes]]:
    """Links that join all classes (comps) with a similar pair: of all texts, or where some are of a second block, of one of each."""
    left, right = np.flatnonzero(~second), np.flatnonzero(second)
    whole = not len(right)
    right = left if whole else right
    _, own = np.unique(np.array([x.hex() for x in comps]), return_inverse=True)
    common, total = overlaps(texts, left, right, weights, n)
    near = common >= (threshold - 1e-9) * (total[left][:, None] + total[right][None, :] - common)
    near &= own[left][:, None] != own[right][None, :]
    out, label = [], own.copy()
    for i, j in zip(*np.nonzero(np.triu(near, 1) if whole else near), strict=True):
        a, b = left[i], right[j]
        if label[a] != label[b] and weighted_jaccard(texts[a], texts[b], weights, n) >= threshold:
            out.append((comps[a], comps[b]))
            label[label == label[b]] = label[a]
    return out


def blocks(rows: DataFrame) -> DataFrame:
    """rows (band, comp, node, bytes) with a block for each: BLOCK rows or BLOCK_BYTES of a band at most, in the order of comps.

    The order is dealt by ranges of all its columns, so that a band of any size is split.
    """
    order = ["band", "comp", "node"]
    dealt = rows.repartitionByRange(c.partitions(rows.sparkSession), *order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, last, n, size = TaskContext.get().partitionId() << 36, None, 0, 0
        for b in batches:
            out = []
            for band, more in zip(b.column("band").to_pylist(), b.column("bytes").to_pylist(), strict=True):
                if band != last or n == BLOCK or size + more > BLOCK_BYTES:
                    block, last, n, size = block + 1, band, 0, 0
                n, size = n + 1, size + more
                out.append(block)
            yield pa.RecordBatch.from_arrays([b.column("band"), b.column("comp"), b.column("node"), pa.array(out, pa.int64())], ["band", "comp", "node", "block"])

    return c.scratch(dealt.mapInArrow(cut, "band long, comp binary, node binary, block long"), "blocks")


def rest_links(shared_rows: DataFrame, labels: DataFrame, tried: DataFrame, texts: DataFrame, weigher: Weigher, threshold: float) -> DataFrame:
    """Links (comp_a, comp_b) that join all classes of labels with a similar pair in a bucket of shared_rows (band, node, lead).

    All pairs with a lead (which may be null) were tried, and so was the pair of a bucket with two others if it is in tried. Buckets with the same
    members are compared once.
    """
    read, n, notes = weigher.reader(), weigher.n, weigher.columns
    members = shared_rows.where("NOT node <=> lead").select("band", "node").join(labels.hint("merge"), "node")
    kept = [F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("b")]
    sets = [F.bit_xor(F.xxhash64("node")).alias("h"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("g")]
    mixed = members.groupBy("band").agg(*kept, *sets).where("lo <> hi").groupBy("n", "h", "g", "a", "b").agg(F.min("band").alias("band"))
    pairs = mixed.where("n = 2").join(tried.hint("merge"), ["a", "b"], "left_anti").select("band")
    mixed = mixed.where("n > 2").select("band").union(pairs)
    members = members.join(mixed.hint("merge"), "band").join(texts.select("node", F.octet_length("text").alias("bytes")).hint("merge"), "node")
    dealt = blocks(members)
    seen = c.scratch(dealt.groupBy("band", "block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")), "ends")
    x, y = (seen.select("band", F.col("block").alias(k), F.col("lo").alias(f"lo_{k}"), F.col("hi").alias(f"hi_{k}")) for k in "xy")
    cells = x.join(y, "band").where("x <= y AND NOT (lo_x = hi_x AND lo_y = hi_y AND lo_x = lo_y)").select("x", "y")
    cells = c.scratch(cells, "cells")
    sides = cells.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    rows = sides.join(dealt.select("block", "comp", "node").hint("merge"), "block")
    rows = rows.join(texts.select("node", "text", *notes).hint("merge"), "node").select("x", "y", "block", "comp", "text", *notes)
    rows = rows.repartition(c.partitions(rows.sparkSession), "x", "y").sortWithinPartitions("x", "y")

    def linked(own: list[pa.RecordBatch]) -> pa.RecordBatch:
        cell = pa.Table.from_batches(own).combine_chunks().to_batches()[0]
        second = cell.column("block").to_numpy() != cell.column("x")[0].as_py()
        out = cell_links([t or b"" for t in _texts(cell)], cell.column("comp").to_pylist(), second, read(cell), n, threshold)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], ["comp_a", "comp_b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = [], None
        for b in batches:
            x, y = (b.column(k).to_numpy() for k in "xy")
            cuts = [0, *(np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if j > i and last not in (None, (x[i], y[i])):
                    yield linked(own)
                    own = []
                if j > i:
                    own.append(b.slice(i, j - i))
                    last = (x[i], y[i])
        if own:
            yield linked(own)

    c.bound_batches(rows.sparkSession)
    return rows.mapInArrow(compare, "comp_a binary, comp_b binary")


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, comp) after links (comp_a, comp_b)."""
    new = components(links.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))).select(F.col("node").alias("comp"), F.col("comp").alias("new"))
    return c.scratch(labels.join(new.hint("merge"), "comp", "left").select("node", F.coalesce("new", "comp").alias("comp")), "labels")


def common_keys(base: DataFrame, who: DataFrame) -> DataFrame:
    """(key, share, uid, class, n) of keys that texts of several classes have: base (uid, keys, shares), who (uid, comp), and n, the
    key's texts."""
    classes = who.groupBy("comp").agg(F.min("uid").alias("class"))
    own = who.select("uid", "comp").join(classes.hint("merge"), "comp").select("uid", "class")
    rows = base.select("uid", "keys", "shares").join(own.hint("merge"), "uid")
    rows = rows.select("uid", "class", F.explode(F.arrays_zip("keys", "shares")).alias("x")).select(F.col("x.keys").alias("key"), F.col("x.shares").alias("share"), "uid", "class")
    key = Window.partitionBy("key")
    seen = rows.withColumns({"n": F.count("*").over(key), "lo": F.min("class").over(key), "hi": F.max("class").over(key)})
    return c.scratch(seen.where("lo <> hi").drop("lo", "hi"), "keys")


def possible_pairs(keys: DataFrame, who: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, comp_a, comp_b) of two classes that may reach the threshold, by all their common keys.

    keys are those of common_keys, who has (uid, node, comp, weight, rest). A shingle that two texts share is a key of both or
    stands behind the keys of one, so they share their common keys and no more than the larger rest.
    """
    x, y = (keys.select("key", F.col("uid").alias(k), F.col("class").alias(f"class_{k}"), F.col("share").alias(f"share_{k}")) for k in "ab")
    both = x.join(y.hint("merge"), "key").where("a < b AND class_a <> class_b").groupBy("a", "b").agg(F.sum(F.least("share_a", "share_b")).alias("both"))
    for k in "ab":
        both = both.join(who.select(F.col("uid").alias(k), *(F.col(x).alias(f"{x}_{k}") for x in ["node", "comp", "weight", "rest"])).hint("merge"), k)
    needed = (F.col("weight_a") + F.col("weight_b")) * (threshold / (1 + threshold) * (1 - 1e-6))
    both = both.where((F.col("both") + F.greatest("rest_a", "rest_b") >= needed) & (F.least("weight_a", "weight_b") >= F.greatest("weight_a", "weight_b") * (threshold * (1 - 1e-6))))
    swap = F.col("node_a") > F.col("node_b")
    a, b = (F.struct(F.col(f"node_{k}").alias("node"), F.col(f"comp_{k}").alias("comp")) for k in "ab")
    both = both.select(F.when(swap, b).otherwise(a).alias("x"), F.when(swap, a).otherwise(b).alias("y"))
    return both.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.comp").alias("comp_a"), F.col("y.comp").alias("comp_b"))


def near_duplicates(docs: DataFrame, shingle_words: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, node, class_id, kept) for each row of docs (doc_id, text, ...).

    node: 128 bits for the text; class_id: least doc_id of the class; kept: true for one row of each class. Other columns
    are ignored; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    weigher = Weigher(docs, shingle_words)
    docs, read, levels = weigher.ready(docs), weigher.reader(), weigher.levels

    def sketch(b: pa.RecordBatch) -> pa.RecordBatch:
        bands, bytes_, firsts = [], [], []
        weights = read(b)
        for _, part in c.chunks(_texts(b)):
            doc, shingle, tf = document_shingles(part, shingle_words)
            weight = weights.of(shingle, tf)
            firsts.append(prefixes(len(part), doc, shingle, weight, levels.value, threshold))
            x, some = samples(len(part), doc, shingle, weight)
            h = x.reshape(len(part), BANDS, ROWS)
            key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), h.shape[:2]).copy()
            for k in range(ROWS):
                key = c.mix(key * np.uint64(0x9E3779B97F4A7C15) ^ h[:, :, k])
            key, x = key.view(np.int64), x.astype(np.uint8)
            bands += [key[i] if some[i] else None for i in range(len(part))]
            bytes_ += [x[i].tobytes() if some[i] else None for i in range(len(part))]
        key, share, n, weight, rest = (np.concatenate(x) for x in zip(*firsts, strict=True))
        cuts = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
        keys, shares = (pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (key, share.astype(np.float32)))
        columns = [b.column("doc_id"), b.column("node"), pa.array(bands, pa.list_(pa.int64())), pa.array(bytes_, pa.binary()), keys, shares, pa.array(weight, pa.float64()), pa.array(rest, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "bands", "sketch", "keys", "shares", "weight", "rest"])

    types = "node binary, bands array<long>, sketch binary, keys array<long>, shares array<float>, weight double, rest double"
    base = c.map_rows(docs.withColumn("node", c.text_key()), sketch, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {types}")
    base = c.scratch(base.withColumn("uid", F.monotonically_increasing_id()), "sketches")
    nodes = c.scratch(base.where("bands IS NOT NULL").select("node", "bands", "sketch", "uid", "weight", "rest").dropDuplicates(["node"]), "nodes")
    rows = nodes.select("node", F.explode("bands").alias("band"))
    stats = rows.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("lead")).where("n > 1").drop("n")
    shared_rows = c.scratch(rows.join(stats.hint("merge"), "band"), "buckets")
    labels = shared_rows.select("node", F.col("node").alias("comp")).distinct()

    def texts_of(need: DataFrame, *hint: str) -> DataFrame:
        # one row of each text, named by its doc_id as well, so that the copies of a text are not one task
        one = base.groupBy("node").agg(F.min("doc_id").alias("_id")).join(need.hint("merge"), "node")
        one, n = c.counted(one.withColumnRenamed("node", "_node"), "chosen")
        own = among(docs.withColumn("node", c.text_key()), ["node", "doc_id"], one, ["_node", "_id"], n)
        one = one.hint(*hint) if hint else one
        found = own.join(one, (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_id")))
        return c.scratch(found.select("node", "text", *weigher.columns).dropDuplicates(["node"]), "texts")

    texts = texts_of(labels.select("node"), "shuffle_hash")
    tried = c.scratch(shared_rows.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    pairs = tried.withColumns({"comp_a": F.col("a"), "comp_b": F.col("b")})
    for turn in range(ROUNDS + 1):
        links, n = c.counted(_verified(pairs, texts, weigher, threshold).select("comp_a", "comp_b"), "links")
        if n:
            labels = _relabelled(labels, links)
        if turn == ROUNDS:
            break
        members = shared_rows.select("band", "node").join(labels.hint("merge"), "node")
        mixed = members.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band")
        members = members.join(mixed.hint("merge"), "band").select("node", "comp").distinct()
        next_ = neighbours(_places(nodes.join(members.hint("merge"), "node"), turn))
        swap = F.col("a") > F.col("b")
        a, b = (F.struct(F.col(x).alias("node"), F.col(f"comp_{x}").alias("comp")) for x in "ab")
        next_ = next_.select(F.when(swap, b).otherwise(a).alias("x"), F.when(swap, a).otherwise(b).alias("y"))
        next_ = next_.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.comp").alias("comp_a"), F.col("y.comp").alias("comp_b"))
        pairs = next_.distinct().join(tried, ["a", "b"], "left_anti")
        tried = tried.union(next_.select("a", "b"))
    links, n = c.counted(rest_links(shared_rows, labels, tried, texts, weigher, threshold), "links")
    if n:
        labels = _relabelled(labels, links)

    who = nodes.select("node", "uid", "weight", "rest").join(labels.hint("merge"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    who = c.scratch(who, "components")  # so that Spark may split a text that very many rows have
    known = who.select("node", "comp")
    keys = common_keys(base, who)
    pairs, n = c.counted(possible_pairs(keys.where(F.col("n") <= GROUP), who, threshold), "pairs")
    groups = keys.where(F.col("n") > GROUP).join(who.select("uid", "node").hint("merge"), "uid")
    groups, m = c.counted(groups.select(F.col("key").alias("band"), "node", F.lit(None).cast("binary").alias("lead")), "groups")
    if n or m:
        texts = texts_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(groups.select("node")).distinct())
        links, n = c.counted(_verified(pairs, texts, weigher, threshold).select("comp_a", "comp_b"), "links")
        known = _relabelled(known, links) if n else known
    if m:
        links, n = c.counted(rest_links(groups, known, pairs.select("a", "b"), texts, weigher, threshold), "links")
        known = _relabelled(known, links) if n else known
    out = base.select("doc_id", "node", "uid").join(known.hint("merge"), "node", "left")
    first = out.where("comp IS NOT NULL").groupBy("comp").agg(F.min(F.struct("doc_id", "uid")).alias("least"))
    # written first, so that the join reads two plain shuffles and Spark may split a large class
    out = out.join(c.scratch(first, "firsts").hint("merge"), "comp", "left")
    return out.select("doc_id", "node", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("class_id"), F.coalesce(F.col("uid") == F.col("least.uid"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, **parameters) -> DataFrame:
    """docs with one document of each class, the one with the least doc_id; same columns, whatever their names.

    Rows that are equal in doc_id and text count as one row. A null doc_id sorts first.
    """
    keep = near_duplicates(docs, **parameters).where("kept").select(F.col("doc_id").alias("_id"), F.col("node").alias("_node")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{k}`") for k in docs.columns)).alias("_row"), F.col("doc_id").alias("_own_id"), c.text_key().alias("_own"))
    joined = rows.join(keep.hint("merge"), F.col("_own").eqNullSafe(F.col("_node")) & F.col("_own_id").eqNullSafe(F.col("_id")))
    return joined.dropDuplicates(["_id", "_node"]).select("_row.*")
