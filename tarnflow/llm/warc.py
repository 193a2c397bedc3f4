"""WARC archives with revisit resolution.

Headers alone (page_id, length, SHA-1) are shuffled by payload digest; in every group of equal payloads of
at least 1000 bytes the largest page_id owns the response and the others become revisit records. The
decisions go back to the pages by page_id, so payloads of one hot digest never meet in a task, and each task
writes one .warc.gz file (a gzip member a record) with fresh headers. Reading parses the archives and joins
each revisit record to the response that it refers to.

Defined cases: null html is an empty payload; null or odd urls are percent-encoded or left out; rows that
repeat the owner's page_id are responses each; a null page_id is always a response. A payload is read whole
however long it is, by one task. Extra columns are ignored; an empty table writes no files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_id, materialize, settled, tidy, working_folder

LEAST_BYTES = 1000
#: Fixed values of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6f1d9c1e-52c8-4c0e-9b7d-0f4f5a6f7a10")
_URL_SAFE = ":/?#[]@!$&'()*+,;=%-._~"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}')}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, owner: int | None) -> bytes:
    """One record: a response, or a revisit of the owner's response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if owner is not None else http + payload
    head = [VERSION, f"WARC-Type: {'revisit' if owner is not None else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_URL_SAFE)}")
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if owner is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(owner, digest)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an open archive."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode().partition(":")
            head[name.strip().lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        stream.read(4)
        yield head, block


def resolve_revisits(pages: DataFrame) -> DataFrame:
    """Of pages whose payload another page owns: page_id, digest, owner."""
    heads = pages.select("page_id", F.octet_length(F.coalesce("html", F.lit(""))).alias("size"), F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")).alias("digest"))
    heads = heads.where((F.col("size") >= LEAST_BYTES) & F.col("page_id").isNotNull())
    owners = heads.groupBy("digest", "size").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return heads.join(owners, ["digest", "size"]).where("page_id <> owner").select("page_id", "digest", "owner").distinct()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages (page_id, url, html, ...) under folder; returns (file, records), a row a file."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, base = pafs.FileSystem.from_uri(folder)
        final = f"{base}/part-of-{task.partitionId():06d}.warc.gz"
        trial, out, n = f"{final}.{task.taskAttemptId()}", None, 0
        for batch in batches:
            for page, url, html, digest, owner in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "owner")), strict=True):
                out = out or fs.open_output_stream(trial)
                out.write(gzip.compress(warc_record(page, url, (html or "").encode(), digest, owner), 3, mtime=0))
                n += 1
        if out is not None:
            out.close()
            fs.move(trial, final)
            yield pa.RecordBatch.from_pydict({"file": [final], "records": [n]})

    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    decided = materialize(resolve_revisits(pages), "revisits")
    whole = pages.select("page_id", "url", "html", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")).alias("digest"))
    rows = by_id(whole, decided, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "owner")
    return rows.mapInArrow(tidy(write, 1000), "file string, records long")


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """Parses the archives: page_id, record_id, record_type, payload_bytes, payload_digest, refers_record."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        names = ["page_id", "record_id", "record_type", "payload_bytes", "payload_digest", "refers_record"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for path in batch.column("file").to_pylist():
                rows = []
                with fs.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for head, block in read_records(stream):
                        page = head.get("warc-page-id")
                        told = base64.b32decode(head["warc-payload-digest"].partition(":")[2]).hex()
                        size = None
                        if head["warc-type"] == "response":
                            payload = block[block.index(b"\r\n\r\n") + 4 :]
                            size, found = len(payload), hashlib.sha1(payload).hexdigest()
                            if found != told:
                                raise ValueError(f"payload digest differs in {head['warc-record-id']}")
                        rows.append((None if page is None else int(page), head["warc-record-id"], head["warc-type"], size, told, head.get("warc-refers-to")))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.mapInArrow(tidy(read), "page_id long, record_id string, record_type string, payload_bytes long, payload_digest string, refers_record string")


@settled("archive-digests")
def archive_digests(pages: DataFrame) -> DataFrame:
    """Writes the archives, reads them back and resolves revisits to their responses.

    The archives go once they are read; write_archives() leaves them to its caller."""
    spark = pages.sparkSession
    folder = working_folder(spark, "warc")
    files = materialize(write_archives(pages, folder), "warc-files")
    # a file is read by one task; the list is a row a file
    records = materialize(read_archives(files.repartition(max(1, spark.sparkContext.defaultParallelism * 4)), folder), "warc-heads")
    answers = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_record"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("size"), F.col("payload_digest").alias("told"))
    answers = answers.where("refers_to is not null").dropDuplicates(["refers_record"])
    # only revisits are joined
    back = records.where("record_type = 'revisit'").join(answers, "refers_record", "left")
    back = back.select("page_id", F.when(F.col("told") == F.col("payload_digest"), F.col("size")).alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    own = records.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return own.unionAll(back)


#: Fixed by the contract; DuckDB has no SHA-1 of a text that Spark's sha1 of UTF-8 would not equal.
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, strlen(t) AS payload_bytes, sha1(t) AS payload_digest FROM p),
g AS (SELECT payload_digest, payload_bytes, max(page_id) AS owner FROM h WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT h.page_id, h.payload_bytes, h.payload_digest,
  CASE WHEN g.owner <> h.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN g.owner <> h.page_id THEN g.owner END AS refers_to
FROM h LEFT JOIN g ON h.payload_digest = g.payload_digest AND h.payload_bytes = g.payload_bytes
"""
