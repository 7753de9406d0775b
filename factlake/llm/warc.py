"""WARC archives: writing, reading and revisit resolution.

Headers (not payloads) are shuffled by payload digest; of records with equal payloads the one with the largest page id is
the response, and the others become revisits that name its record. Archives are then written with fresh headers, payloads
standing once, and read back; a revisit's payload length comes from the response it refers to. Payloads are shuffled only
where the list of revisits is too large to broadcast (LIST_BYTES).

Archives are gzip members, one per record (WARC/1.1), in `archives/`; the table `manifest` (Parquet) names the files that
count, so a task may be run again at any time.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm import common as c

#: Bytes after which an archive is closed. Level of compression.
ARCHIVE_BYTES, LEVEL = 64 << 20, 6
#: Most bytes of a broadcast list of revisits.
LIST_BYTES = 16 << 20
_STEP = 1 << 14
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, url: str | None, digest: str) -> str:
    """Id of a response. Rows that are equal in all three are one record, written as often as they stand."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id} {digest} {url}')}>"


def _line(value: str) -> str:
    """A header's value: line ends, which no URI has, would break the block and are percent-encoded."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to: tuple | None, date: str) -> bytes:
    """One WARC record; refers_to: page id and url of the response that a revisit stands for, or None."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    own = f"<urn:uuid:{uuid.uuid4()}>" if refers_to else record_id(page_id, url, digest)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {own}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(*refers_to, digest)}", f"WARC-Refers-To-Date: {date}"]
        if refers_to[1] is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_line(refers_to[1])}")
    if page_id is not None:
        head.append(f"WARC-Page: {_line(str(page_id))}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of each record of an archive of gzip members; a revisit's payload is empty."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, whole = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(view):
                raise ValueError("the archive ends inside a record")
            part = view[at : at + _STEP]
            whole.append(z.decompress(part))
            at += len(part) - len(z.unused_data)
        head, _, rest = b"".join(whole).partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        block = rest[: int(headers["Content-Length"])]
        yield headers, block.partition(b"\r\n\r\n")[2]


def resolved(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """headers (page_id, url, payload_digest, payload_bytes, ...) with refers_to and refers_to_url: page id and url of the
    record a record revisits, or null.

    Records are responses if their payload is under least_bytes or theirs is the largest page_id of the digest. Rows
    that share that largest page_id are all responses, and revisits name the one of the greatest url; null page ids count
    as the least.
    """
    top = F.max(F.struct("page_id", "url")).alias("_top")
    original = headers.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(top, F.count("*").alias("_n")).where("_n > 1").drop("_n")
    joined = headers.join(original, "payload_digest", "left")
    again = (F.col("payload_bytes") >= least_bytes) & F.col("_top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_top.page_id"))
    return joined.select(*headers.columns, F.when(again, F.col("_top.page_id")).alias("refers_to"), F.when(again, F.col("_top.url")).alias("refers_to_url"))


def headers_of(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest as hex) of pages (page_id, url, html, ...)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("page_id", "url", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write a record per row of pages (page_id, url, html, ...): null html is an empty payload, null url has no target.

    Equal rows each get a record. Very long pages are held whole, one at a time. Other columns are ignored; an empty table
    gives an empty manifest.
    """
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    again = resolved(headers_of(pages), least_bytes).where("refers_to IS NOT NULL")
    again = again.select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), "refers_to", "refers_to_url").distinct()
    again, measured = c.counted(again, "revisits", F.sum(F.coalesce(F.octet_length("refers_to_url"), F.lit(0)) + 100))
    again = F.broadcast(again) if measured <= LIST_BYTES else again.hint("merge")
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("html")).withColumn("_sha", F.sha1("html"))
    rows = rows.join(again, (F.col("_sha") == F.col("_digest")) & F.col("page_id").eqNullSafe(F.col("_page")), "left")
    rows = rows.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "_sha", "refers_to", "refers_to_url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(f"{base}/archives", recursive=True)
        out, n = io.BytesIO(), 0

        def close() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.gz"
            with store.open_output_stream(f"{base}/archives/{name}", compression=None) as f:
                f.write(out.getbuffer())
            return pa.RecordBatch.from_pydict({"file": [name], "n_records": pa.array([n], pa.int64())})

        for b in c.slices(batches):
            for page, url, html, sha, *refers_to in zip(*(b.column(k).to_pylist() for k in ("page_id", "url", "html", "_sha", "refers_to", "refers_to_url")), strict=True):
                z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                revisits = None if refers_to[0] is None else tuple(refers_to)
                out.write(z.compress(record(page, url, html or b"", base64.b32encode(bytes.fromhex(sha)).decode(), revisits, date)) + z.flush())
                n += 1
                if out.tell() >= ARCHIVE_BYTES:
                    yield close()
                    out, n = io.BytesIO(), 0
        if n:
            yield close()

    rows.mapInArrow(write, "file string, n_records long").write.parquet(f"{path}/manifest")


def read_archives(spark: SparkSession, path: str, page_type: str = "long") -> DataFrame:
    """(record_id, page_id, url, record_type, payload_digest, refers_to_record, payload_bytes, payload) of every record in the
    archives; page_type: what page ids are cast to.

    payload and its length are null for revisits. A response whose payload has another digest than its header says stops
    the query.
    """
    files = spark.read.parquet(f"{path}/manifest").select("file").repartition(c.partitions(spark), "file")
    names = ["record_id", "page_id", "url", "record_type", "payload_digest", "refers_to_record", "payload"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path)
        for b in batches:
            for name in b.column("file").to_pylist():
                with store.open_input_file(f"{base}/archives/{name}") as f:
                    data = f.read()
                rows, size = [], 0
                for head, payload in records(data):
                    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and digest_of(payload) != digest:
                        raise ValueError(f"{name}: the payload of {head['WARC-Record-ID']} is not what its digest says")
                    rows.append((head["WARC-Record-ID"], head.get("WARC-Page"), head.get("WARC-Target-URI"), kind, digest, head.get("WARC-Refers-To"), payload if kind == "response" else None))
                    size += len(payload)
                    if size >= 8 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(x, pa.binary() if k == "payload" else pa.string()) for k, x in zip(names, zip(*rows, strict=True), strict=True)]
        return pa.RecordBatch.from_arrays(columns, names)

    out = files.mapInArrow(read, ", ".join(f"{k} {'binary' if k == 'payload' else 'string'}" for k in names))
    return out.withColumn("page_id", F.col("page_id").cast(page_type)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))


def with_originals(read: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of what read_archives gives: a revisit has the
    payload length of the response that its header names, and refers_to is that response's page id. Payloads are left out
    before anything is shuffled."""
    headers = c.scratch(read.drop("payload"), "headers")
    responses = headers.where("record_type = 'response'").select(F.col("record_id").alias("_id"), F.col("page_id").alias("_page"), F.col("payload_bytes").alias("_bytes")).dropDuplicates(["_id"])
    joined = headers.join(responses, headers["refers_to_record"] == responses["_id"], "left")
    return joined.select("page_id", "url", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("_page").alias("refers_to"))
