"""WARC archives: a writer that stores equal payloads once, and a sequential reader.

Each record is one gzip member. The reader feeds blocks of a file to an incremental zlib decoder,
starts the next member where one ends, frames records by Content-Length, and verifies the block
digest of each record and the payload digest of each response.

To write, every page becomes a packed response member in the task that reads it, so that a page is
compressed before it moves. Digests of at least `least` bytes that occur again are found with partial
sums over (digest, page_id); the few rows they name are joined back by digest and salt, so that a
digest with many copies is spread over tasks. The packed pages move once, by page_id, which no group
of copies skews, and a page that revisits another loses its payload there.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import new_folder
from pagewright.llm.files import open_read, write_whole

LEAST = 100
SALTS = 16
LEVEL = 1
FILE_BYTES = 256 << 20
READ_BYTES = 1 << 18
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


class WarcError(ValueError):
    """A record that breaks the format or its own digest."""


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def record_id(page_id) -> str:
    return f"<urn:page:{page_id}>"


def page_of(record: str) -> int | None:
    name = record.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "None" else int(name)


def one_line(text: str) -> str:
    return "".join(c if c.isprintable() else "%{:02X}".format(ord(c)) for c in text)


def pack(kind: str, page_id, url: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One record as one gzip member. A revisit holds the response's head without its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return pack_block(kind, page_id, url, http if kind == "revisit" else http + payload, digest, refers_to)


def pack_block(kind: str, page_id, url: str | None, block: bytes, digest: str, refers_to=None) -> bytes:
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", one_line(url or "about:blank")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{sha256(block)}"),
    ]
    if kind == "revisit":
        headers += [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", PROFILE)]
    headers += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def split_record(data: bytes) -> Record:
    """A member's only record, framed by its Content-Length and its digests verified."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise WarcError("no record head")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    length = int(headers.get("content-length", -1))
    if length < 0 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"{headers.get('warc-record-id')}: Content-Length does not frame the record")
    record = Record(headers, rest[:length])
    if (said := headers.get("warc-block-digest")) and said != f"sha256:{sha256(record.block)}":
        raise WarcError(f"{headers.get('warc-record-id')}: its block has another digest")
    if headers.get("warc-type") == "response" and (said := headers.get("warc-payload-digest")) and said != f"sha256:{sha256(http_payload(record)[1])}":
        raise WarcError(f"{headers.get('warc-record-id')}: its payload has another digest")
    return record


def http_payload(record: Record) -> tuple[int, bytes]:
    """The payload's length as the HTTP head states it, and the payload (empty in a revisit)."""
    head, found, payload = record.block.partition(b"\r\n\r\n")
    if not found:
        raise WarcError(f"{record.headers.get('warc-record-id')}: no HTTP head")
    length = next((int(v) for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:]) if k.strip().lower() == b"content-length"), len(payload))
    if record.headers.get("warc-type") == "response" and length != len(payload):
        raise WarcError(f"{record.headers.get('warc-record-id')}: its payload has another length")
    return length, payload


def read_records(file: BinaryIO) -> Iterator[Record]:
    """The records of an archive, in order, with one member in memory at a time."""
    decoder, parts, data = zlib.decompressobj(31), [], file.read(READ_BYTES)
    started = False
    while data:
        started = True
        parts.append(decoder.decompress(data))
        if decoder.eof:
            yield split_record(b"".join(parts))
            data, parts, decoder, started = decoder.unused_data, [], zlib.decompressobj(31), False
        else:
            data = b""
        data = data or file.read(READ_BYTES)
    if started:
        raise WarcError("the file ends inside a member")


def pack_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, members = [], []
        ids = batch.column("page_id").to_pylist()
        for page_id, url, html in zip(ids, batch.column("url").to_pylist(), batch.column("html").cast(pa.large_binary()).to_pylist()):
            digests.append(sha256(html or b""))
            members.append(pack("response", page_id, url, html or b"", digests[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), batch.column("url"), pa.array([len(x or b"") for x in batch.column("html").cast(pa.large_binary()).to_pylist()], pa.int64()), pa.array(digests), pa.array(members, pa.binary())], ["page_id", "url", "payload_bytes", "digest", "member"])


def write_members(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """This task's archives: whole members one after the other, up to FILE_BYTES a file."""
    rows = ((r["member"], r) for batch in batches for r in batch.to_pylist())
    part, number = TaskContext.get().partitionId(), 0
    row = next(rows, None)
    while row is not None:
        uri, n, size = f"{folder}/part-{part:06d}-{number:04d}.warc.gz", 0, 0
        with write_whole(uri) as f:
            while row is not None and (not n or size < FILE_BYTES):
                member, r = row
                if r["refers_to"] is not None:
                    revisit = split_record(zlib.decompress(member, 31))
                    head = revisit.block.partition(b"\r\n\r\n")[0] + b"\r\n\r\n"
                    member = pack_block("revisit", r["page_id"], r["url"], head, r["digest"], r["refers_to"])
                size += f.write(member)
                n += 1
                row = next(rows, None)
        yield pa.RecordBatch.from_pydict({"file": [uri], "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})
        number += 1


def write_archives(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Write the pages (page_id, url, html, any others) as archives; per file: file, records, bytes.

    Of equal payloads of at least `least` bytes the record with the smallest page_id is a response and
    the others revisit it; rows that repeat that page_id are responses too. Null html is an empty
    payload. A null page_id revisits if a page with an id has its payload and is a response otherwise.
    """
    keyed = pages.select("page_id", F.sha2(F.coalesce(F.col("html"), F.lit("")), 256).alias("digest"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("size")).where(F.col("size") >= least)
    firsts = keyed.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL").select("digest", "refers_to")
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    spread = firsts.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    revisits = (
        keyed.withColumn("salt", salt).join(spread, ["digest", "salt"])
        .where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
        .select(F.col("page_id").alias("of_page"), F.col("digest").alias("of_digest"), "refers_to").distinct()
    )
    packed = pages.select("page_id", "url", "html").mapInArrow(pack_pages, "page_id long, url string, payload_bytes long, digest string, member binary")
    joined = packed.join(revisits, F.col("page_id").eqNullSafe(F.col("of_page")) & (F.col("digest") == F.col("of_digest")), "left")
    return joined.select("page_id", "url", "digest", "member", "refers_to").mapInArrow(lambda b: write_members(b, folder), "file string, records long, bytes long")


def read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    for batch in batches:
        for uri in batch.column("file").to_pylist():
            rows = []
            with open_read(uri) as f:
                for record in read_records(f):
                    h = record.headers
                    kind = h["warc-type"]
                    refers = page_of(h["warc-refers-to"]) if kind == "revisit" else None
                    rows.append((page_of(h["warc-record-id"]), h["warc-target-uri"], http_payload(record)[0], h["warc-payload-digest"].removeprefix("sha256:"), kind, refers))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def read_archives(files: DataFrame) -> DataFrame:
    """The records of archives (file: their URIs), one task reading a file from its start to its end."""
    return files.select("file").mapInArrow(read_files, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the pages' archives to the shared folder, then read them back from there."""
    written = write_archives(pages, folder or new_folder(spark, "warc"))
    files = [r.file for r in written.select("file").collect()]
    spread = spark.createDataFrame([(f,) for f in sorted(files)], "file string") if files else spark.createDataFrame([], "file string")
    return read_archives(spread.repartition(max(1, len(files)), "file") if files else spread)
