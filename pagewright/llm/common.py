"""What the operators share: word splitting on bytes, the shared folder, bounded broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: The six characters that separate words; bytes.split() separates at exactly these.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"

#: A joined side of at most so many rows of a few numbers each is broadcast (some 100 KB); so small that measured plans are those of large inputs.
BROADCAST_ROWS = 10_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; a temporary one only where none is set."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pagewright-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, hashes: bool = False) -> DataFrame:
    """Cut the lineage: write `df` to the shared folder and read it back.

    hashes: it holds numbers that neither repeat nor shrink, for which dictionaries and a thorough codec are lost labour.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    options = {"compression": "lz4_raw", "parquet.enable.dictionary": "false"} if hashes else {"compression": "zstd"}
    df.write.options(**options).parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._written_to = path
    return kept


def materialise_counted(df: DataFrame, name: str, condition: Column) -> tuple[DataFrame, int]:
    """materialise(), and the rows that meet the condition, counted as they are written."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    kept = materialise(df.observe(seen, F.count_if(condition).alias("n")), name)
    return kept, seen.get.get("n") or 0


def release(*tables: DataFrame) -> None:
    """Delete tables that materialise() wrote and that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._written_to)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def unused_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to differ from the columns'."""
    taken = {c.lower() for c in df.columns}
    longest = max(map(len, taken), default=0)
    return [n if n not in taken else n.ljust(longest + 1, "_") for n in names]


@contextlib.contextmanager
def frugal(spark: SparkSession) -> Iterator[None]:
    """Meanwhile a query's shuffle files go as it ends, and a joined side whose partitions are small isn't sorted."""
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def small_side(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, to be broadcast if it has at most `most` rows; else Spark picks a shuffled join."""
    return F.broadcast(df) if rows <= most else df


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes; null is empty."""
    return [b"" if x is None else x for x in batch.column(name).cast(pa.large_binary()).to_pylist()]


def small(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `most` bytes of a text column, so that a worker holds little at a
    time; what the worker has freed goes back to the system at the end of its task."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(sizes.astype(np.int64) + 1) // most
        edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def sample_texts(docs: DataFrame, most: int, most_bytes: int = 20_000) -> list[str]:
    """At most `most` texts of at most `most_bytes` bytes each: those of the least hashes of their doc_ids, so
    that the sample is the same however rows are laid out."""
    n = docs.count()
    place = F.xxhash64("doc_id")
    few = docs.select("text", place.alias("place")).where((F.pmod(place, F.lit(max(1, n // (4 * most)))) == 0) & (F.octet_length("text") <= most_bytes))
    return [r.text for r in few.orderBy("place", F.xxhash64("text")).limit(most).collect()]
