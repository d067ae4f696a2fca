"""Digest of a tree of files, folded one directory level at a time from the deepest up."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.functions.blake3 import CHUNK, digests, hex_digest, joined
from pagewright.operators.resolve import directory, last_segment
from pagewright.sources import scratch

PREFIX, BASE_PREFIX = "b3:", "bf:"
#: Directories with more entries than MANY are hashed in parts of PART bytes; a power of two of chunks.
MANY, PART = 10_000, 64 * CHUNK


def varint(n: int) -> bytes:
    """LEB128, unsigned."""
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def encoded(children: list[tuple[bytes, bool, bytes]]) -> bytes:
    """Name length, name, type and digest of each child, in the order of their names."""
    return b"".join(varint(len(name)) + name + bytes([is_dir]) + digest for name, is_dir, digest in sorted(children))


def fold_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [encoded([(c["name"].encode(), c["is_dir"], bytes.fromhex(c["digest"])) for c in kids]) for kids in batch.column("kids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([d.hex() for d in digests(rows)])], ["path", "digest"])


def part_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The value of each part of a directory's bytes; of a part that is all of it, its digest."""
    for batch in batches:
        cut, whole, first = [], batch.column("whole").to_pylist(), [n * PART // CHUNK for n in batch.column("part").to_pylist()]
        for kids, chunk in zip(batch.column("kids"), first):
            rows = sorted(kids.as_py(), key=lambda c: c["start"])
            text = b"".join(encoded([(c["name"].encode(), c["is_dir"], c["digest"])]) for c in rows)
            skipped = max(0, chunk * CHUNK - rows[0]["start"])
            cut.append(text[skipped : chunk * CHUNK + PART - rows[0]["start"]])
        values: list[bytes] = [b""] * len(cut)
        for alone in (True, False):
            at = [i for i, w in enumerate(whole) if w == alone]
            for i, value in zip(at, digests([cut[i] for i in at], None if alone else [first[i] for i in at])):
                values[i] = value
        yield pa.RecordBatch.from_arrays([batch.column("dir"), batch.column("part"), pa.array(values, pa.binary())], ["dir", "part", "value"])


def joined_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [[p["value"] for p in sorted(row, key=lambda p: p["part"])] for row in batch.column("parts").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([(joined(p) if len(p) > 1 else p[0]).hex() for p in parts])], ["path", "digest"])


def varint_size(n: Column) -> Column:
    return F.when(n < 1 << 7, 1).when(n < 1 << 14, 2).when(n < 1 << 21, 3).when(n < 1 << 28, 4).otherwise(5)


def wide(entries: DataFrame) -> DataFrame:
    """(path, digest) of directories with any number of entries (dir, name, is_dir, digest).

    Entries are dealt by range of their names, so that a directory spreads over many tasks. Sums of their sizes
    place each in its directory's bytes, and those are hashed in aligned parts, which are subtrees of BLAKE3.
    """
    order = ("name", "is_dir", "digest")
    size = varint_size(F.octet_length("name")) + F.octet_length("name") + 33
    dealt = entries.withColumn("digest", F.unhex("digest")).withColumn("size", size.cast("long")).repartitionByRange("dir", "name").withColumn("task", F.spark_partition_id())
    dealt = scratch.written(dealt, "merkle-wide")
    sums = dealt.groupBy("dir", "task").agg(F.sum("size").alias("sum"))
    by_task = W.partitionBy("dir").orderBy("task")
    sums = sums.select("dir", "task", (F.sum("sum").over(by_task) - F.col("sum")).alias("before"), F.sum("sum").over(W.partitionBy("dir")).alias("total"))
    inside = W.partitionBy("dir", "task").orderBy(*order)
    placed = dealt.join(F.broadcast(sums), ["dir", "task"]).withColumn("start", F.col("before") + F.sum("size").over(inside) - F.col("size"))
    touched = F.sequence(F.floor(F.col("start") / PART), F.floor((F.col("start") + F.col("size") - 1) / PART))
    kids = placed.select("dir", F.explode(touched).alias("part"), (F.col("total") <= PART).alias("whole"), F.struct("start", *order).alias("kid"))
    values = kids.groupBy("dir", "part", "whole").agg(F.collect_list("kid").alias("kids")).mapInArrow(part_batches, "dir string, part long, value binary")
    return values.groupBy(F.col("dir").alias("path")).agg(F.collect_list(F.struct("part", "value")).alias("parts")).mapInArrow(joined_batches, "path string, digest string")


def directories(files: DataFrame, many: int = MANY, stored: bool = False) -> DataFrame:
    """(path, digest) of every directory; files: (path, digest as hex). The top one has the empty path.

    A directory of up to `many` entries is hashed in one piece, a wider one in parts. `stored` says that
    `files` is read from a table, so that it needs no copy.
    """
    depth = F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/")))
    nodes = files.select("path", "digest", F.lit(False).alias("is_dir"), depth.alias("depth"))
    nodes = nodes if stored else scratch.written(nodes, "merkle-files")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    waiting, done = None, []
    for level in range(deepest, 0, -1):
        here = nodes.where(F.col("depth") == level).drop("depth")
        here = here if waiting is None else here.unionByName(waiting)
        entries = here.select(directory(F.col("path")).alias("dir"), last_segment(F.col("path")).alias("name"), "is_dir", "digest")
        widest = scratch.written(entries.groupBy("dir").agg(F.count("*").alias("n")).where(F.col("n") > many).select("dir"), "merkle-widest")
        rest = entries.join(F.broadcast(widest), "dir", "left_anti")
        kids = rest.groupBy("dir").agg(F.collect_list(F.struct("name", "is_dir", "digest")).alias("kids"))
        found = kids.withColumnRenamed("dir", "path").mapInArrow(fold_batches, "path string, digest string")
        if not widest.isEmpty():
            found = found.unionByName(wide(entries.join(F.broadcast(widest), "dir", "left_semi")))
        folded = scratch.written(found, "merkle-level")
        done.append(folded)
        waiting = folded.withColumn("is_dir", F.lit(True))
    out = files.select("path", "digest").limit(0)
    for level in done:
        out = out.unionByName(level)
    return out


def root(files: DataFrame, stored: bool = False) -> str:
    """The whole tree's fingerprint."""
    top = directories(files, stored=stored).where("path = ''").first()
    return PREFIX + (top.digest if top else hex_digest(b""))


def base_fold(members: list[tuple[str, str | None]]) -> str:
    """Witness of a small member set of (path, digest as hex, or None where unreadable)."""
    out = b""
    for path, digest in sorted(members, key=lambda m: m[0].encode()):
        name = path.encode()
        out += varint(len(name)) + name + bytes([digest is None]) + (bytes.fromhex(digest) if digest else bytes(32))
    return BASE_PREFIX + hex_digest(out)
