"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, every run of other characters than letters becomes one space, and the n-grams of 1 to GRAMS
characters of the whole text are hashed into BUCKETS. Counts of all labelled rows are summed by language in Spark; the
matrix of log probabilities (languages x BUCKETS) is what is broadcast, in blocks of LANGUAGES rows at most. A batch is
scored by adding up the rows of the matrix that its n-grams name. Any number of languages is told apart: each block is one
pass over the texts, and the best language and the sum of all probabilities go from one to the next.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.llm import common as c

GRAMS, BUCKETS, LANGUAGES = 3, 1 << 14, 512
#: Added to each count.
SMOOTHING = 0.5
#: What a text without letters is.
UNKNOWN = "und"

_OTHER = re.compile(r"[\W\d_]+")


def normalized(text: str | None) -> str:
    """Letters in lower case, one space between runs and at both ends; "" if there is no letter."""
    t = _OTHER.sub(" ", text.lower()).strip() if text else ""
    return f" {t} " if any(map(str.isalpha, t)) else ""  # letter-like numbers alone are no letters


def gram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of each n-gram of normalized texts."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    space = points == 32
    buckets, docs = [], []
    h = np.zeros(len(points), np.uint64)
    for n in range(1, GRAMS + 1):
        m = len(points) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x100000001B3) + points[n - 1 :]
        own = doc[:m] == doc[n - 1 :]
        if n == 1:
            own &= ~space
        elif n > 2:  # no n-gram across a word's end and the next word's begin
            own &= ~space[1 : 1 + m]
        buckets.append((c.mix(h[own] + np.uint64(n << 40)) & np.uint64(BUCKETS - 1)).astype(np.int64))
        docs.append(doc[:m][own])
    return (np.concatenate(buckets), np.concatenate(docs)) if buckets else (np.empty(0, np.int64), doc)


class Block:
    """Some languages of a model, with the logarithms of their share of the rows and of their n-grams."""

    def __init__(self, languages: list[str], log_prior: np.ndarray, log_prob: np.ndarray):
        self.languages, self.log_prior, self.log_prob = languages, log_prior, log_prob

    def joint(self, texts: list[str]) -> np.ndarray:
        """Log of the joint probability of each text (normalized) and each language."""
        bucket, doc = gram_buckets(texts)
        sums = [np.bincount(doc, row[bucket], len(texts)) if len(bucket) else np.zeros(len(texts)) for row in self.log_prob]
        return np.stack(sums, axis=1) + self.log_prior


class Model:
    """Languages with the number of their rows, and the table (lang, rows, counts) of what was counted."""

    def __init__(self, languages: list[str], rows: list[int], counts: DataFrame):
        self.languages, self.rows, self.counts = languages, rows, counts

    def blocks(self) -> Iterator[Block]:
        """The model in blocks of at most LANGUAGES languages, of which the driver holds one at a time."""
        for at in range(0, len(self.languages), LANGUAGES):
            names = self.languages[at : at + LANGUAGES]
            found = {r.lang: r.counts for r in self.counts.where(F.col("lang").between(names[0], names[-1])).select("lang", "counts").collect()}
            counts = np.array([np.frombuffer(found[k], np.int64) for k in names], float) + SMOOTHING
            prior = np.array(self.rows[at : at + LANGUAGES], float)
            yield Block(names, np.log(prior / sum(self.rows)), np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))


def train(labelled: DataFrame) -> Model:
    """Model of rows (text, lang); rows of null lang or without letters teach nothing. All rows are counted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        task = TaskContext.get().partitionId()

        def out() -> pa.RecordBatch:
            columns = {"lang": list(counts), "task": pa.array([task] * len(counts), pa.int64()), "rows": pa.array(rows.values(), pa.int64()), "counts": pa.array([x.astype(np.int64).tobytes() for x in counts.values()], pa.binary())}
            return pa.RecordBatch.from_pydict(columns)

        for b in c.slices(batches):
            texts, langs = b.column("text").to_pylist(), b.column("lang").to_pylist()
            for start, part in _groups(texts):
                names, own = np.unique(np.array(langs[start : start + len(part)], object), return_inverse=True)
                bucket, doc = gram_buckets([normalized(x) for x in part])
                seen = np.bincount(doc, minlength=len(part)) > 0
                for k, name in enumerate(names):
                    found = np.bincount(bucket[own[doc] == k], minlength=BUCKETS)
                    counts[name] = counts.get(name, 0) + found
                    rows[name] = rows.get(name, 0) + int(seen[own == k].sum())
                if len(counts) >= LANGUAGES:
                    yield out()
                    counts.clear()
                    rows.clear()
        if counts:
            yield out()

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in t.column("counts"))
        return pa.table({"lang": t.column("lang")[:1], "task": t.column("task")[:1], "rows": pa.array([sum(t.column("rows").to_pylist())], pa.int64()), "counts": [total.tobytes()]})

    texts = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    merged = c.merged(texts.mapInArrow(count, "lang string, task long, rows long, counts binary"), "lang", add).where("rows > 0")
    found = sorted(merged.select("lang", "rows").collect())  # a name and a number for each language
    return Model([r.lang for r in found], [r.rows for r in found], merged)


def _groups(texts: list[str | None], limit: int = 1 << 19) -> Iterator[tuple[int, list[str | None]]]:
    start, size, part = 0, 0, []
    for i, t in enumerate(texts):
        part.append(t)
        size += len(t or "")
        if size >= limit:
            yield start, part
            start, size, part = i + 1, 0, []
    if part:
        yield start, part


def judged(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """(_row, lang_pred, score) of each row of docs (text, ...): _row is a struct of its columns `keep` (default: all)."""
    spark, names = docs.sparkSession, ["_row", "_text", "_best", "_log", "_sum"]
    row = F.struct(*(F.col(f"`{k}`") for k in keep or docs.columns))
    rows = docs.select(row.alias("_row"), F.col("text").alias("_text"), F.lit(UNKNOWN).alias("_best"), F.lit(float("-inf")).alias("_log"), F.lit(float("-inf")).alias("_sum"))
    for block in model.blocks():
        shared = spark.sparkContext.broadcast(block)

        def score(b: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            texts = [normalized(x) for x in b.column("_text").to_pylist()]
            best, log, total = b.column("_best").to_pylist(), b.column("_log").to_numpy().copy(), b.column("_sum").to_numpy().copy()
            for start, part in _groups(texts):
                joint = shared.value.joint(part)
                k, own = joint.argmax(axis=1), slice(start, start + len(part))
                most = joint[np.arange(len(part)), k]
                total[own] = np.logaddexp(total[own], most + np.log(np.exp(joint - most[:, None]).sum(axis=1)))
                for i in np.flatnonzero((most > log[own]) & [bool(x) for x in part]):
                    best[start + i], log[start + i] = shared.value.languages[k[i]], most[i]
            return pa.RecordBatch.from_arrays([b.column("_row"), b.column("_text"), pa.array(best, pa.string()), pa.array(log), pa.array(total)], names)

        rows = c.map_rows(rows, score, rows.schema)
    known = F.col("_best") != UNKNOWN
    return rows.select("_row", F.col("_best").alias("lang_pred"), F.when(known & (F.col("_log") > float("-inf")), F.least(F.exp(F.col("_log") - F.col("_sum")), F.lit(1.0))).otherwise(0.0).alias("score"))


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """docs (text, ...) as its columns `keep` (default: doc_id) with lang_pred and score (0 to 1, the posterior).

    Null, empty and letterless texts are "und" with score 0, as is everything if nothing was learned. Only text is used, all
    of it. Of equally probable languages the first by name is taken. Equal rows give equal rows; columns to keep may not
    be named lang_pred or score (see judged).
    """
    keep = keep or ["doc_id"]
    return judged(docs, model, keep).select(*(f"_row.`{k}`" for k in keep), "lang_pred", "score")


def is_held_out():
    """Whether a row of documents is kept from training: crc32 of doc_id as text, modulo 3, is 1; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
