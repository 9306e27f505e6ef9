"""WARC archives: written one gzip member a record, read back sequentially.

Writing: records with equal payloads of at least ``least`` bytes keep one response (largest
page_id); the others become revisit records that name it and carry no payload. Spark finds the
groups by digest (partial aggregation, then a salted join), and each task streams its rows into
one file in the shared folder.

Reading: a file is inflated piece by piece with zlib; each member ends where its gzip stream
ends, its block is framed by Content-Length, and the SHA-1 digests in the header are verified
(block digest for every record, payload digest for responses).

Defined cases: a null html is an empty payload; a null url is left out of the header; a null
page_id is written without an id and read back as null, is response if its group has no id at
all, else revisits the group's largest; rows that repeat the largest page_id are all response;
an empty table writes no file; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.session import scratch_path

from .common import file_system, publishing, text_bytes, written

LEAST, SALTS, LEVEL, READ = 1000, 64, 6, 1 << 16
_EPOCH = "1970-01-01T00:00:00Z"       # records carry no crawl time of their own


def decided(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html and, for revisits, the page_id of the response they refer to."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("digest", F.sha1("html"))
    large = F.octet_length("html") >= least
    groups = (rows.filter(large).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("first"))
              .filter((F.col("n") > 1) & F.col("first").isNotNull())
              .select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    # a hot payload's rows spread over the salts; small payloads have a salt of their own and match nothing
    salt = F.when(large, F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    return (rows.withColumn("salt", salt).join(groups, ["digest", "salt"], "left")
            .select("page_id", "url", "html", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to")))


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page_id: int) -> str:
    return f"<urn:page:{page_id}>"


def _line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record, uncompressed."""
    block = payload if refers_to is None else b""
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Date", _EPOCH)]
    if page_id is not None:
        fields.append(("WARC-Record-ID", _name(page_id)))
    if url:
        fields.append(("WARC-Target-URI", _line(url)))
    if refers_to is not None:
        fields += [("WARC-Refers-To", _name(refers_to)),
                   ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("WARC-Payload-Digest", _sha1(payload)), ("WARC-Block-Digest", _sha1(block)),
               ("X-Payload-Length", str(len(payload))), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """One archive a task; returns path, bytes and records of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/part-of-crawl-{TaskContext.get().partitionId():06d}.warc.gz"
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        size = records = 0
        with publishing(name) as out:
            while first is not None:
                for page_id, url, payload, refers in zip(first.column(0).to_pylist(), first.column(1).to_pylist(),
                                                         text_bytes(first.column(2)), first.column(3).to_pylist()):
                    data = member(record(page_id, url, payload, refers))
                    out.write(data)
                    size, records = size + len(data), records + 1
                first = next(batches, None)
        yield pa.RecordBatch.from_pydict({"path": [name], "bytes": [size], "records": [records]})

    return written(decided(pages, least).mapInArrow(run, "path string, bytes long, records long"), "archives")


def members(stream) -> Iterator[bytes]:
    """The records of a stream of gzip members, inflated one after the other."""
    z, parts, rest = zlib.decompressobj(31), [], stream.read(READ)
    while rest:
        parts.append(z.decompress(rest))
        rest = z.unused_data
        if z.eof:
            yield b"".join(parts)
            z, parts = zlib.decompressobj(31), []
            rest = rest or stream.read(READ)
        else:
            rest = stream.read(READ)
    if parts:
        raise ValueError("the archive ends within a member")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of a record; wrong framing or digests raise."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not frame the block")
    if _sha1(block) != fields["warc-block-digest"]:
        raise ValueError("wrong block digest")
    if fields["warc-type"] == "response" and _sha1(block) != fields["warc-payload-digest"]:
        raise ValueError("wrong payload digest")
    return fields, block


def _page(urn: str | None) -> int | None:
    return int(urn.strip("<>").rpartition(":")[2]) if urn else None


ROWS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
                  ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read(archives: DataFrame) -> DataFrame:
    """A row for each record: page_id, url, payload (null for revisits), payload_bytes,
    payload_digest (hex), record_type, refers_to. One task reads a file from start to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, name = file_system(path)
                rows, held = [], 0
                with fs.open_input_stream(name, compression=None) as stream:
                    for data in members(stream):
                        h, block = parse(data)
                        kind = h["warc-type"]
                        digest = base64.b32decode(h["warc-payload-digest"].partition(":")[2]).hex()
                        rows.append((_page(h.get("warc-record-id")), h.get("warc-target-uri"),
                                     block if kind == "response" else None, int(h["x-payload-length"]), digest, kind,
                                     _page(h.get("warc-refers-to"))))
                        held += len(block)
                        if held > 1 << 24 or len(rows) >= 10_000:
                            yield _rows(rows)
                            rows, held = [], 0
                if rows:
                    yield _rows(rows)

    files = max(1, min(archives.count(), 4 * archives.sparkSession.sparkContext.defaultParallelism))
    return archives.select("path").repartition(files, "path").mapInArrow(
        run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, "
             "record_type string, refers_to long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ROWS.types)], schema=ROWS)


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write all pages to the shared folder and read the archives back."""
    return read(write(pages, scratch_path(pages.sparkSession, "warc"), least))
