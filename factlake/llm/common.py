"""What the operators of this subpackage share: scratch tables, Arrow helpers and the word kernel."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from factlake.plans.lineage import delete_at_exit, new_path

# Fixed class of a word byte in lower-cased text: 0-9, a-z and every byte of a non-ASCII character.
_WORD = np.zeros(256, np.uint8)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def bound_batches(spark: SparkSession) -> None:
    """Let Spark hand at most BATCH rows at once to Python, on either side: texts and pages may be long."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH:
        spark.conf.set(_BATCH, str(BATCH))


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, so that lineage ends there and each row is made once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    bound_batches(spark)
    was = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")  # nothing reads this query's shuffle files again
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, was)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, what=None) -> tuple[DataFrame, int]:
    """scratch(df), and the number of its rows (or another aggregate), which writing them has counted."""
    seen = Observation()
    out = scratch(df.observe(seen, (F.count(F.lit(1)) if what is None else what).alias("n")), name)
    return out, seen.get.get("n") or 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Rows of a batch from Spark, and rows that Python works on at once.
BATCH, SLICE = 1024, 512


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of batches in parts of so many."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
    """fn over slices of Arrow batches."""

    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(fn, slices(batches))

    return df.mapInArrow(run, schema)


#: Most rows that one merge of counts reads.
FAN_IN = 64


def merged(rows: DataFrame, key: str, add: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """One row per key of rows (key, task, ...), where task numbers the tasks that made them: add makes one row of a table of
    rows of a key, at most FAN_IN tasks' of them, until there is one of each."""
    while True:
        rows = rows.withColumn("task", F.expr(f"task div {FAN_IN}")).groupBy(key, "task").applyInArrow(add, rows.schema)
        rows, last = counted(rows, "counts", F.max("task"))
        if not last:
            return rows


def text_key() -> "F.Column":
    """128 bits that stand for a text."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, b in enumerate((_BASE, _BASE_INV)):
            f = np.full(size, b)
            f[0] = 1
            _powers[i] = np.cumprod(f)
    return _powers


def chunks(texts: list[bytes | None], limit: int = 1 << 19) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in groups of about limit bytes and under 60,000 texts, each with the place of its first text."""
    start, size, part = 0, 0, []
    for i, t in enumerate(texts):
        part.append(t or b"")
        size += len(part[-1])
        if size >= limit or len(part) >= 60_000:
            yield start, part
            start, size, part = i + 1, 0, []
    if part:
        yield start, part


def words_of(part: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of the joined texts; start, end and 64-bit hash of each word; first word of each text, and the end."""
    buf = _LOWER[np.frombuffer(b"\0".join(part) + b"\0", np.uint8)]
    is_word = _WORD[buf]
    edge = np.diff(is_word.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    powers, inverses = _power_tables(len(buf) + 1)
    sums = np.empty(len(buf) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[buf] * powers[: len(buf)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverses[starts] ^ (ends - starts).astype(np.uint64))
    texts_at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in part])])
    return buf, starts, ends, hashes, np.searchsorted(starts, texts_at)


def shingles_of(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each n-word shingle; a text of fewer words, but not none, has one of all its words."""
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts)), counts)
    m = len(hashes) - n + 1
    if m > 0:
        s = hashes[:m].copy()
        for k in range(1, n):
            s = s * _BASE + hashes[k : k + m]
        whole = doc[:m] == doc[n - 1 :]
        s, at = mix(s[whole]), doc[:m][whole]
    else:
        s, at = np.empty(0, np.uint64), np.empty(0, np.int64)
    few = np.flatnonzero((counts > 0) & (counts < n))
    if len(few):
        own = []
        for d in few:
            x = np.zeros(1, np.uint64) + np.uint64(counts[d])
            for h in hashes[first[d] : first[d + 1]]:
                x = x * _BASE + h
            own.append(x)
        s, at = np.concatenate([s, mix(np.concatenate(own))]), np.concatenate([at, few])
    return s, at
