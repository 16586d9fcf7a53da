"""WARC archives: written with an index first, read back by coalesced byte ranges.

``write_archives`` packs records, each a gzip member of its own, into one file for each task in the shared folder, and returns
the index: path, offset, length, URL and digest of each record. A file's name holds its task attempt, and only index rows of
attempts that succeeded exist, so a task that is lost and run again leaves no record twice. ``read_records`` takes rows of an
index (all or a selection), cuts each file into stretches, sorts the wanted ranges of a stretch, joins ranges that lie close,
and reads each run with one request.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, saved, scratch

#: Payloads of at least this many bytes may be stored once.
REVISIT_BYTES = 1000
#: Bytes of a file that one task reads in order, the gap up to which two ranges are read together, and the longest run.
STRETCH, GAP, RUN = 32 << 20, 64 << 10, 4 << 20

INDEX = "path string, offset long, length long, url string, payload_digest string, page_id long, record_type string, refers_to long, payload_bytes long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _record_id(page: int | None, digest: str) -> str:
    h = hashlib.sha1(f"{page}:{digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-a{h[17:20]}-{h[20:32]}>"


def encode_record(page: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers: int | None) -> bytes:
    """One gzip member: a response with its payload, or (payload None) a revisit that refers to another page's record."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: {_record_id(page, digest)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if page is not None:
        lines.append(f"X-Page-Id: {page}")
    if payload is None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers, digest)}", f"X-Refers-To-Page-Id: {refers}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


def decode_record(member: bytes) -> dict:
    """Headers (lower case names), and ``payload``: bytes of a response, None of a revisit; ``http_length``: of the full payload."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    out: dict = {}
    for line in head.decode().split("\r\n")[1:]:
        name, _, value = line.partition(": ")
        out[name.lower()] = value
    block = rest[: int(out["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    out["http_length"] = int(re.search(rb"Content-Length: (\d+)", http)[1])
    out["payload"] = payload if out["warc-type"] == "response" else None
    return out


def _write(folder: str):
    def run(batches):
        where, out = TaskContext.get(), None
        name = f"{folder}/part-{where.partitionId():06d}-{where.taskAttemptId()}.warc.gz"
        offset = 0
        try:
            for b in batches:
                rows = []
                for page, url, html, size, digest, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    member = encode_record(page, url, None if refers is not None else (html or "").encode(), size, digest, refers)
                    if out is None:
                        system, path = _filesystem(name)
                        system.create_dir(path.rpartition("/")[0], recursive=True)
                        out = system.open_output_stream(path, compression=None)
                    out.write(member)
                    rows.append((name, offset, len(member), url, digest, page, "response" if refers is None else "revisit", refers, size))
                    offset += len(member)
                columns = list(zip(*rows, strict=True)) or [()] * 9
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return run


def described(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, refers_to) of pages; native functions, and one join on digests.

    Digests that occur once never reach the join's small side, and those that occur often meet in a pre-aggregated maximum.
    """
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html).alias("payload_digest"))
    keys = rows.where(f"payload_bytes >= {least}").groupBy("payload_digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    refers = F.when((F.col("page_id") != F.col("last")) | (F.col("page_id").isNull() & F.col("last").isNotNull()), F.col("last")).alias("refers_to")
    fields = ["page_id", "url", "html", "payload_bytes", "payload_digest"]
    large = rows.where(f"payload_bytes >= {least}").join(keys, "payload_digest", "left").select(*fields, refers)
    # small payloads are never compared, so they do not take part in the join
    return large.union(rows.where(f"payload_bytes < {least}").select(*fields, F.lit(None).cast("long")))


def write_archives(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) and returns the saved index.

    Null html is an empty payload, null url leaves the target out. Of equal payloads of at least ``least`` bytes the largest
    page_id is the response; rows that share that page_id and payload are all responses. Rows without page_id are revisits where
    an equal payload has an id, else responses. An empty table writes no file and gives an empty index.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    rows = described(pages, least).select("page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to")
    rows = rows.withColumn("html", F.when(F.col("refers_to").isNull(), F.col("html")))
    return saved(rows.mapInArrow(_write(scratch(spark, "warc")), INDEX), "warc-index")


def _read(batches):
    source, name = None, None
    for b in batches:
        rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
        out = []
        i = 0
        while i < len(rows):
            j, path, start, end = i + 1, rows[i][0], rows[i][1], rows[i][1] + rows[i][2]
            while j < len(rows) and rows[j][0] == path and start <= rows[j][1] <= end + GAP and max(end, rows[j][1] + rows[j][2]) - start <= RUN:
                end = max(end, rows[j][1] + rows[j][2])
                j += 1
            if name != path:
                if source is not None:
                    source.close()
                system, at = _filesystem(path)
                source, name = system.open_input_file(at), path
            source.seek(start)
            run = io.BytesIO(source.read(end - start)).getbuffer()
            for _, offset, length in (r[:3] for r in rows[i:j]):
                x = decode_record(bytes(run[offset - start : offset - start + length]))
                payload = x["payload"]
                digest = hashlib.sha1(payload).hexdigest() if payload is not None else base64.b32decode(x["warc-payload-digest"].removeprefix("sha1:")).hex()
                ids = [int(x[k]) if k in x else None for k in ("x-page-id", "x-refers-to-page-id")]
                out.append((ids[0], len(payload) if payload is not None else x["http_length"], digest, x["warc-type"], ids[1], x.get("warc-target-uri"), payload))
            i = j
        columns = list(zip(*out, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()], strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])


def read_records(index: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload) of the index rows given.

    Digest and size of a response come from its payload, those of a revisit from its headers; its payload is null and is that of
    the response it refers to. Rows are dealt by file and stretch, so a hot file is read by many tasks.
    """
    bounded_batches(index.sparkSession)
    rows = index.select("path", "offset", "length", F.floor(F.col("offset") / STRETCH).alias("stretch"))
    rows = rows.repartition("path", "stretch").sortWithinPartitions("path", "offset").select("path", "offset", "length")
    return rows.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def op1_warc(spark, sf_dir: str) -> DataFrame:
    """Every page, written to archives and read back."""
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
     l as (select *, max(page_id) over (partition by payload_digest) as last from p)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 1000 and page_id <> last then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id <> last then last end as refers_to
from l
"""
