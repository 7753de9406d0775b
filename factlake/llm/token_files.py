"""Token ids in binary shards with a minimal perfect hash index.

Under the folder: `shards/*.ids` hold the ids in ascending doc_id order, `manifest` (Parquet) one row per shard, and
`index` (Parquet) one row per bucket of keys.

A shard is: 8 bytes magic, the ids, one 64-bit number per record and one more (ids before it in the shard), width of an id
in bytes and number of records (two 64-bit numbers). All numbers are little-endian. So a shard is written as the ids
come, and no task holds one in memory.

A bucket of the index is a minimal perfect hash ("hash and displace"): keys fall into cells of about two, a cell has
the seed that sends its keys to free slots, and a cell of one key names its slot. A slot holds a fingerprint of its
key, the shard and the record, so a look-up takes constant time and tells keys that were never written.

Rows are ordered by doc_id and their place in the input and dealt by ranges of both, so that a doc_id of any number of rows
is split over tasks; a row's number among those of its doc_id follows from counts by task.

Shards are written under names of their own attempt and only those that the manifest names count, so tasks may be run
again at any time.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlake.llm import common as c
from factlake.llm import tokens

MAGIC = b"FLTOKEN1"
#: Ids and records after which a shard is closed (what is open, a task holds as one number a record), and keys of a bucket
#: of the index on average.
SHARD_IDS, SHARD_RECORDS, BUCKET_KEYS = 32 << 20, 1 << 18, 50_000
#: A key: doc_id and the number of this row among rows of the same doc_id.
KEY = ["doc_id", "copy"]
_SLOT = np.dtype([("print", "<u4"), ("shard", "<u8"), ("record", "<u4")])


def _hash(key: tuple, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=8, key=seed.to_bytes(4, "little")).digest(), "little")


def _place(h: int, seed: int, n: int) -> int:
    h = (h + seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    return ((h ^ h >> 29) * 0xBF58476D1CE4E5B9 >> 32 & 0xFFFFFFFF) % n


def perfect_hash(keys: list[tuple]) -> tuple[int, np.ndarray, list[int], list[int]]:
    """Seed of the key hash, number of each cell (seed >= 0, or slot as -1 - slot), slot and hash of each key. Keys differ.

    Where the keys of a cell can't be parted, all start again with the next seed of the key hash.
    """
    n, seed = len(keys), 0
    while True:
        hashes = [_hash(k, seed) for k in keys]
        if len(set(hashes)) == n and (found := _placed(hashes, n)):
            return seed, *found, hashes
        seed += 1


def _placed(hashes: list[int], n: int) -> tuple[np.ndarray, list[int]] | None:
    cells: list[list[int]] = [[] for _ in range(n // 2 + 1)]
    for i, h in enumerate(hashes):
        cells[h % len(cells)].append(i)
    taken, slots, numbers = bytearray(n), [0] * n, np.zeros(len(cells), "<i4")
    for k in sorted((k for k in range(len(cells)) if len(cells[k]) > 1), key=lambda k: -len(cells[k])):
        own = [hashes[i] for i in cells[k]]
        for s in range(64 * n + 64):
            at = []
            for h in own:
                x = _place(h, s, n)
                if taken[x] or x in at:
                    break
                at.append(x)
            else:
                break
        else:
            return None
        numbers[k] = s
        for i, x in zip(cells[k], at, strict=True):
            taken[x], slots[i] = 1, x
    free = (x for x in range(n) if not taken[x])
    for k, cell in enumerate(cells):
        if len(cell) == 1:
            slots[cell[0]] = x = next(free)
            numbers[k] = -1 - x
    return numbers, slots


def find(key: tuple, seed: int, numbers: np.ndarray, slots: np.ndarray) -> tuple[int, int] | None:
    """Shard and record of a key, or None."""
    h = _hash(key, seed)
    number = int(numbers[h % len(numbers)])
    slot = slots[-1 - number if number < 0 else _place(h, number, len(slots))] if len(slots) else None
    return None if slot is None or int(slot["print"]) != h >> 32 else (int(slot["shard"]), int(slot["record"]))


def _bucket(n: int):
    return F.pmod(F.xxhash64(*KEY), F.lit(n)).cast("int")


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, ids: int | None = None) -> None:
    """Encode every row of docs (doc_id, text, ...) and write the folder. ids: size of the vocabulary, for the width.

    Null and empty texts are the end id alone; a null doc_id comes first; rows with equal doc_id are all kept, one after
    the other. Very long texts are encoded whole. Other columns are ignored; an empty table gives no shards.
    """
    spark = docs.sparkSession
    width = 2 if ids is not None and ids <= 1 << 16 else 4
    kind = docs.schema["doc_id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(f"{base}/shards", recursive=True)
        part, shard, copy, last = TaskContext.get().partitionId(), 0, 0, object()
        names = ["doc_id", "copy", "part", "shard", "record", "n", "file"]
        keys, copies, lengths, size, f, name = [], [], [], 0, None, ""

        def close(kind: pa.DataType) -> pa.RecordBatch:
            at = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
            f.write(at.tobytes() + np.array([width, len(lengths)], "<u8").tobytes())
            f.close()
            n = len(keys)
            types = [kind, pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
            columns = [keys, copies, [part] * n, [part << 24 | shard] * n, range(n), lengths, [name] * n]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names)

        for b in c.slices(batches, min(c.SLICE, SHARD_IDS, SHARD_RECORDS)):
            kind = b.schema.field("doc_id").type
            if f is None:
                name = f"{part:08d}-{shard:06d}-{uuid.uuid4().hex}.ids"
                f = store.open_output_stream(f"{base}/shards/{name}")
                f.write(MAGIC)
            ids = tokens.encoder(vocabulary).encoded(b.column("text").to_pylist())
            for key, x in zip(b.column("doc_id").to_pylist(), ids, strict=True):
                copy, last = (copy + 1 if key == last else 0), key
                keys.append(key)
                copies.append(copy)
                lengths.append(len(x) // 4 + 1)
                size += lengths[-1]
            f.write(np.frombuffer(b"".join(x + end for x in ids), "<u4").astype(f"<u{width}").tobytes())
            if size >= SHARD_IDS or len(keys) >= SHARD_RECORDS:
                yield close(kind)
                keys, copies, lengths, size, f, shard = [], [], [], 0, None, shard + 1
        if f is not None:
            yield close(kind)

    c.bound_batches(spark)
    placed = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_place"))
    dealt = placed.repartitionByRange(c.partitions(spark), "doc_id", "_place").sortWithinPartitions("doc_id", "_place").drop("_place")
    entries, n_entries = c.counted(dealt.mapInArrow(write, f"doc_id {kind}, copy long, part long, shard long, record int, n long, file string"), "entries")
    # doc_ids that go on in another task: two for each task at most
    ends = entries.groupBy("part").agg(F.min(F.struct("doc_id")).alias("lo"), F.max(F.struct("doc_id")).alias("hi"))
    ends = ends.select(F.explode(F.array("lo", "hi")).alias("id"), "part").distinct()
    again = ends.groupBy("id").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("id.doc_id").alias("_id"))
    parts = entries.join(F.broadcast(again), F.col("doc_id").eqNullSafe(F.col("_id"))).groupBy("_id", "part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_id").orderBy("part")) - F.col("_n")
    parts = c.scratch(parts.select("_id", F.col("part").alias("_part"), before.alias("_before")), "repeated")
    entries = entries.join(F.broadcast(parts), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("part") == F.col("_part")), "left")
    entries = entries.withColumn("copy", F.col("copy") + F.coalesce("_before", F.lit(0))).drop("_id", "_part", "_before", "part")
    shards = entries.groupBy("shard", "file").agg(F.sum("n").alias("n_ids"), F.count("*").alias("n_records")).withColumn("part", F.expr("shiftright(shard, 24)"))
    shards = c.scratch(shards, "shards")
    total, starts = 0, []
    for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():  # a row for each task that wrote
        starts.append((r["part"], total))
        total += r["n"]
    starts = spark.createDataFrame(starts, "part long, part_start long")
    before = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")
    manifest = shards.withColumn("_before", before).join(starts, "part").select("shard", "file", "n_records", "n_ids", (F.col("part_start") + F.col("_before")).alias("start"))
    manifest.write.parquet(f"{path}/manifest")
    buckets = max(1, -(-n_entries // BUCKET_KEYS))

    def build(t: pa.Table) -> pa.Table:
        keys = list(zip(t.column("doc_id").to_pylist(), t.column("copy").to_pylist(), strict=True))
        seed, numbers, slots, hashes = perfect_hash(keys)
        out = np.zeros(len(keys), _SLOT)
        out["print"][slots] = np.array(hashes, np.uint64) >> np.uint64(32)
        out["shard"][slots], out["record"][slots] = t.column("shard").to_numpy(), t.column("record").to_numpy()
        return pa.table({"bucket": t.column("bucket")[:1], "buckets": pa.array([buckets], pa.int32()), "seed": pa.array([seed], pa.int32()), "numbers": [numbers.tobytes()], "slots": [out.tobytes()]})

    index = entries.select(*KEY, "shard", "record", _bucket(buckets).alias("bucket")).groupBy("bucket").applyInArrow(build, "bucket int, buckets int, seed int, numbers binary, slots binary")
    index.write.parquet(f"{path}/index")


def look_up(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """(doc_id, copy, shard, record) of those keys (doc_id, copy) that the folder holds."""
    index = spark.read.parquet(f"{path}/index")
    found = index.select("buckets").limit(1).collect()
    buckets = found[0]["buckets"] if found else 1
    kind = keys.schema["doc_id"].dataType.simpleString()

    def look(own: pa.Table, bucket: pa.Table) -> pa.Table:
        rows = []
        if bucket.num_rows:
            numbers, slots = np.frombuffer(bucket.column("numbers")[0].as_py(), "<i4"), np.frombuffer(bucket.column("slots")[0].as_py(), _SLOT)
            seed = bucket.column("seed")[0].as_py()
            for i, key in enumerate(zip(own.column("doc_id").to_pylist(), own.column("copy").to_pylist(), strict=True)):
                if at := find(key, seed, numbers, slots):
                    rows.append((i, *at))
        take, shard, record = (pa.array([r[k] for r in rows], pa.int64()) for k in range(3))
        return pa.table({"doc_id": own.column("doc_id").take(take), "copy": own.column("copy").take(take), "shard": shard, "record": record.cast(pa.int32())})

    asked = keys.select(*KEY).withColumn("bucket", _bucket(buckets))
    return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(look, f"doc_id {kind}, copy long, shard long, record int")


def read_tokens(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """(doc_id, copy, start, n_tokens, ids) of the keys, from the index and the shards; ids: little-endian 32-bit numbers."""
    at = look_up(spark, path, keys).join(spark.read.parquet(f"{path}/manifest").select("shard", "file", F.col("start").alias("shard_start")).hint("merge"), "shard")
    at = at.repartition(c.partitions(spark), "file").sortWithinPartitions("file", "record")
    kind = keys.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path)
        name, f = None, None
        for b in c.slices(batches):
            starts, ids = [], []
            for file, record in zip(b.column("file").to_pylist(), b.column("record").to_pylist(), strict=True):
                if file != name:
                    if f is not None:
                        f.close()
                    name, f = file, store.open_input_file(f"{base}/shards/{file}")
                    foot = f.read_at(16, f.size() - 16)
                    width, n = np.frombuffer(foot, "<u8").tolist()
                    if f.read_at(8, 0) != MAGIC:
                        raise ValueError(f"{file} is no shard")
                    begin = np.frombuffer(f.read_at(8 * (n + 1), f.size() - 16 - 8 * (n + 1)), "<u8").astype(np.int64)
                lo, hi = int(begin[record]), int(begin[record + 1])
                starts.append(lo)
                ids.append(np.frombuffer(f.read_at((hi - lo) * width, 8 + lo * width), f"<u{width}").astype("<u4").tobytes())
            start = pa.array(b.column("shard_start").to_numpy() + np.array(starts, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("copy"), start, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "copy", "start", "n_tokens", "ids"])
        if f is not None:
            f.close()

    return at.select("doc_id", "copy", "file", "record", "shard_start").mapInArrow(read, f"doc_id {kind}, copy long, start long, n_tokens long, ids binary")


def keys_of(docs: DataFrame) -> DataFrame:
    """The keys under which write_tokens has stored docs. A doc_id's numbers are made in blocks, never as one list."""
    counts = docs.groupBy("doc_id").agg((F.count("*") - 1).alias("_last"))
    blocks = counts.select("doc_id", "_last", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("_last div 10000"))).alias("_block"))
    return blocks.select("doc_id", F.explode(F.sequence(F.col("_block") * 10_000, F.least("_last", F.col("_block") * 10_000 + 9_999))).alias("copy"))


def checksums(found: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what read_tokens found."""

    def crc(b: pa.RecordBatch) -> pa.RecordBatch:
        sums = pa.array([zlib.crc32(x) for x in b.column("ids").to_pylist()], pa.int64())
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), sums], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return c.map_rows(found, crc, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, start long, n_tokens long, ids_crc32 long")
