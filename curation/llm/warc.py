"""WARC archives with an index: records are written once with their offset, length, URL and digest, then read back
by coalesced byte ranges.

Each writing task appends gzip members to an archive of its own in shared storage and returns the index rows; a file
is named after the task attempt, so what a lost attempt left is never indexed. Readers sort the selected index rows
by archive and offset and fetch neighbouring records with one ranged read. Storage is reached through Arrow's file
systems by URI.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curation.llm.common import KeyFilter, shared_dir, small_batches, table, written

#: Payloads from this size on are stored once.
REVISIT_BYTES = 1000
#: A read is extended over a gap of at most GAP bytes, and up to MOST bytes.
GAP, MOST = 64 << 10, 8 << 20
#: Archive bytes that one reading task fetches: index rows are small, so their own size would make too few tasks.
TASK_BYTES = 64 << 20
CAPTURED = "1970-01-01T00:00:00Z"

INDEX = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, path string, offset long, length long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload (null html: empty), record_type, refers_to, refers_url.

    Of equal payloads of ``least`` bytes or more the largest page_id is the response (rows repeating that id too),
    the others revisit it. Only rows whose payload may have a double go through the join, so most bodies are never
    shuffled; the groups are written before it and nothing stands on top, so Spark may split a hot payload.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("_key", F.when(F.octet_length("payload") >= least, F.sha2("payload", 256)))
    newest = F.max(F.struct("page_id", "url"))
    groups = rows.where("_key is not null").groupBy("_key").agg(newest.alias("_top"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    groups = written(groups.select("_key", "_n", F.col("_top.page_id").alias("_keep"), F.col("_top.url").alias("_keep_url")))
    flagged = KeyFilter(groups, ["_key"], pages.count()).marked(rows, ["_key"], "_maybe")
    maybe = F.col("_maybe") & F.col("_key").isNotNull()
    lone = flagged.where(~maybe).select("page_id", "url", "payload", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("refers_url"))
    revisit = F.col("_n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_keep"))
    doubled = flagged.where(maybe).join(groups, "_key", "left")
    doubled = doubled.select(
        "page_id", "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_keep")).alias("refers_to"),
        F.when(revisit, F.col("_keep_url")).alias("refers_url"),
    )
    return lone.unionByName(doubled)


def target(url: str) -> str:
    return quote(url, safe="".join(map(chr, range(33, 127))))


def record(name: str, page_id: int | None, url: str | None, kind: str, refers_to: int | None, refers_url: str | None, payload: bytes, digest: str) -> bytes:
    """One WARC/1.1 record, whose id is drawn from ``name``; a revisit has no payload but the digest and size of the one
    it refers to, and that one's URL."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {CAPTURED}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {target(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}", f"X-Payload-Length: {len(payload)}", f"WARC-Refers-To-Date: {CAPTURED}"]
        if refers_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {target(refers_url)}")
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers in lower case, and the payload after the HTTP head."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}
    return headers, rest[: int(headers["content-length"])].partition(b"\r\n\r\n")[2]


def write_archives(pages: DataFrame, root: str) -> DataFrame:
    """Write ``with_revisits(pages)`` below ``root`` and return the index, which is itself stored there.

    Null html is an empty payload; a null page_id or url is left out of its record. An empty table writes nothing.
    Extra columns are not read.
    """
    spark = pages.sparkSession
    schema = pa.schema([(f.split()[0], pa.int64() if f.endswith("long") else pa.string()) for f in INDEX.split(", ")])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(f"{root}/archives")
        context, out, offset = TaskContext.get(), None, 0
        name = f"{base}/{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        try:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    if out is None:
                        store.create_dir(base, recursive=True)
                        out = store.open_output_stream(name, compression=None)
                    payload = r["payload"].encode()
                    digest = hashlib.sha1(payload).hexdigest()
                    member = gzip.compress(record(f"{name}:{offset}", r["page_id"], r["url"], r["record_type"], r["refers_to"], r["refers_url"], payload, digest), 1, mtime=0)
                    out.write(member)
                    rows.append((r["page_id"], r["url"], r["record_type"], r["refers_to"], len(payload), digest, name, offset, len(member)))
                    offset += len(member)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
        finally:
            if out is not None:
                out.close()

    with_revisits(pages).mapInArrow(task, INDEX).write.parquet(f"{root}/index")
    return spark.read.schema(INDEX).parquet(f"{root}/index")


def read_records(index: DataFrame, root: str) -> DataFrame:
    """The records that the rows of ``index`` point at: their own headers, and size, digest and bytes of the payload."""
    schema = pa.schema([(f.split()[0], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.split()[1]]) for f in RECORDS.split(", ")])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, int, int]]]:
        """Neighbours in sorted order that one read shall fetch."""
        held: list[tuple[str, int, int]] = []
        for batch in batches:
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (path != held[0][0] or offset - held[-1][1] - held[-1][2] > GAP or offset + length - held[0][1] > MOST):
                    yield held
                    held = []
                held.append((path, offset, length))
        if held:
            yield held

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(root)
        path = file = None
        for held in spans(batches):
            if held[0][0] != path:
                path, file = held[0][0], store.open_input_file(held[0][0])
            first = held[0][1]
            data = file.read_at(held[-1][1] + held[-1][2] - first, first)
            rows = []
            for _, offset, length in held:
                h, payload = parsed(gzip.decompress(data[offset - first : offset - first + length]))
                kind, page, refers = h["warc-type"], h.get("x-page-id"), h.get("x-refers-to-page-id")
                full = kind == "response"
                size, digest = (len(payload), hashlib.sha1(payload).hexdigest()) if full else (int(h["x-payload-length"]), h["warc-payload-digest"].removeprefix("sha1:"))
                rows.append((page and int(page), h.get("warc-target-uri"), kind, None if refers in (None, "None") else int(refers), size, digest, payload if full else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-total // TASK_BYTES))
    chosen = index.select("path", "offset", "length").repartitionByRange(tasks, "path", "offset").sortWithinPartitions("path", "offset")
    return chosen.mapInArrow(task, RECORDS)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    root = shared_dir(spark)
    index = write_archives(table(spark, sf_dir, "pages"), root)
    return read_records(index, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
SELECT page_id, octet_length(encode(t)) AS payload_bytes, sha1(t) AS payload_digest,
       CASE WHEN octet_length(encode(t)) >= 1000 AND page_id < max(page_id) OVER g THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(t)) >= 1000 AND page_id < max(page_id) OVER g THEN max(page_id) OVER g END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS t FROM pages)
WINDOW g AS (PARTITION BY t)
"""
