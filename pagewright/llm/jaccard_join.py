"""N-gram Jaccard join: which documents link, and the components of the links.

Documents with equal shingle sets are one item. For the others, sizes lie in bands, and two sets of
sizes a <= b that link differ in at most a / 9 shingles (at 90 %). A band deals the shingles, by hash,
over more parts than that, so that two linked sets agree in SPARE + 1 parts at least; the hash of
(band, part, the shingles there) is the bucket. A set joins the buckets of its own band, and those of
each band below in which a set can link with it. That is one small row per nine shingles, and a bucket
holds only sets that agree in some nine shingles and in the absence of others there, so a line that
many texts share makes no large bucket. links.py takes the buckets apart: tiles, hashed bitmaps, bit
counts, exact intersections. A linked pair can only miss where all parts that agree are empty; bands
of SMALL shingles or less deal them ROUNDS times, each time by another hash, so that the chance is
under 1e-9 a pair at any size (for 4 and 5 shingles at 80 %: (1 / 6) ** 12).

Items are named by 128 bits: 64 as the item, and 64 more that tell sets of the same item apart. Sets are
kept nowhere; those of items that met are made again from one text of each, found by its hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import as_bytes, frugal, materialise, materialise_counted, release, small, small_side, unused_names
from pagewright.llm.links import Bound, link_components
from pagewright.llm.shingles import mixed, set_names, shingle_sets
from pagewright.llm.verbatim import steps

WIDTH = 3
PERCENT = 90
SPARE = 4
SMALL, ROUNDS = 64, 3
_PART, _SUM = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0x2545F4914F6CDD1D)


def bands(limit: int) -> list[int]:
    """Smallest sizes of the bands up to a size: each half as large again as the one before."""
    starts = [1]
    while starts[-1] <= limit:
        starts.append(max(starts[-1] + 1, -(-starts[-1] * 3 // 2)))
    return starts


def most_different(size: int, percent: int) -> int:
    """The most shingles in which a linked pair whose smaller set has this size can differ."""
    larger = size * 100 // percent
    return max(size + b - 2 * -(-percent * (size + b) // (100 + percent)) for b in {size, max(size, larger - 1), larger})


def levels(size: int, percent: int) -> list[tuple[int, int, int]]:
    """(band, number of parts, rounds) in which a set of this size looks for links."""
    starts = bands(size)
    found = []
    for band in range(len(starts) - 2, -1, -1):
        top = starts[band + 1] - 1
        if percent * size > 100 * top:
            break
        differ = max(most_different(top, percent), most_different(top - 1, percent) if top > 1 else 0)
        if differ:
            found.append((band, differ + 1 + SPARE + differ // 100, ROUNDS if top <= SMALL else 1))
    return found


def bucket_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """The buckets of a set, as signed 64-bit numbers."""
    keys = []
    for band, parts, rounds in levels(len(shingles), percent):
        for salt in range(rounds):
            part = ((mixed((shingles + np.uint64(salt)) * _PART) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            sums = np.zeros(parts, np.uint64)
            np.add.at(sums, part, mixed(shingles ^ _SUM))
            filled = np.flatnonzero(np.bincount(part, minlength=parts))
            keys.append(mixed(sums[filled] + mixed(filled.astype(np.uint64) + np.uint64(band << 40 | salt << 32))))
    return np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)


SIGNED = "doc_id long, n_shingles long, text_hash long, item long, check long, keys array<long>"
#: Names of so many items or rows (24 bytes each) are broadcast to find their texts; beyond it, texts go to them by a shuffle.
BROADCAST_ITEMS = 500_000


def sign(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        for first, texts in steps(as_bytes(batch, "text")):
            sets = shingle_sets(texts, width)
            names = [set_names(s) if len(s) else (None, None) for s in sets]
            keys = [bucket_keys(s, percent) for s in sets]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]).astype(np.int32)), pa.array(np.concatenate(keys)))
            own = batch.slice(first, len(texts))
            columns = [own.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), own.column("text_hash"), *(pa.array(x, pa.int64()) for x in zip(*names)), lists]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SIGNED.split(", ")])


def sets_of_texts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(item, set) of texts whose set has the item's check."""
    for batch in small(batches):
        for first, texts in steps(as_bytes(batch, "text")):
            own, sets = batch.slice(first, len(texts)), shingle_sets(texts, width)
            same = [len(s) > 0 and set_names(s)[1] == check for s, check in zip(sets, own.column("check").to_pylist())]
            yield pa.RecordBatch.from_arrays([own.column("item"), pa.array([s.tobytes() for s in sets], pa.binary())], ["item", "set"]).filter(pa.array(same, pa.bool_()))


def named_apart(marked: DataFrame) -> DataFrame:
    """`marked`, with another item for sets that share theirs with another set."""
    clashes = marked.where("item is not null").groupBy("item").agg(F.min("check").alias("first_check"), F.max("check").alias("last_check")).where("first_check < last_check").drop("last_check")
    clashes, n = materialise_counted(clashes, "jaccard-clashes", F.lit(True))
    if not n:
        return marked
    other = F.when(F.col("check") != F.col("first_check"), F.xxhash64("item", "check")).otherwise(F.col("item"))
    return marked.join(small_side(clashes, n), "item", "left").withColumn("item", F.coalesce(other, "item")).drop("first_check")


def labelled(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, text_hash, group (a name of its component) and component_id."""
    with frugal(docs.sparkSession):
        return _labelled(docs, width, percent)


def _labelled(docs: DataFrame, width: int, percent: int) -> DataFrame:
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    written = materialise(hashed.mapInArrow(lambda b: sign(b, width, percent), SIGNED), "jaccard-marked", hashes=True)
    marked = named_apart(written)
    signed = materialise(marked.drop("keys"), "jaccard-signed", hashes=True)
    classes = materialise(signed.where("item IS NOT NULL").groupBy("item").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"), F.min("text_hash").alias("its_hash"), F.min("check").alias("check")), "jaccard-items")

    def sets_of(items: DataFrame) -> DataFrame:
        release(written)
        wanted = materialise(classes.join(items, "item", "left_semi").select("item", "check", "its_hash"), "jaccard-wanted")
        texts = hashed.join(small_side(wanted, wanted.count(), BROADCAST_ITEMS), F.col("text_hash") == F.col("its_hash"))
        return texts.select("item", "check", "text").mapInArrow(lambda b: sets_of_texts(b, width), "item long, set binary").dropDuplicates(["item"])

    linked = link_components(marked.select("item", F.explode("keys").alias("key")), sets_of, Bound(percent), "jaccard")
    named = linked.join(classes.select("item", "least_id"), "item")
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    grouped = linked.join(least, "component").select("item", "component", "component_id")
    several = classes.select("item", "least_id", "copies").join(grouped, "item", "left").where("copies > 1 OR component IS NOT NULL")
    labels = materialise(several.select("item", F.coalesce("component", "item").alias("group"), F.coalesce("component_id", "least_id").alias("component_id")), "jaccard-named")
    return signed.join(small_side(labels, labels.count()), "item", "left").select("doc_id", "n_shingles", "text_hash", "group", F.coalesce("component_id", "doc_id").alias("component_id"))


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row of `docs` (doc_id, text, any others): doc_id, n_shingles, component_id (the smallest
    doc_id that links reach, its own included).

    A text of fewer than `width` words has its whole sequence as one shingle. Null texts and texts
    without words have no shingles, link with nothing and keep their own id. Rows that repeat a doc_id
    are items of their own; a null doc_id takes its component's id, if any.
    """
    return labelled(docs, width, percent).select("doc_id", "n_shingles", "component_id")


def drop_near_copies(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs`, with all their columns, less all but one of each component: that with the
    smallest doc_id stays, a null one only where there is no other. Texts without words all stay.

    Rows are told apart by doc_id and a hash of the text, so one that shares only its doc_id with a copy
    stays; of rows that repeat both, one stays.
    """
    rows = materialise(labelled(docs, width, percent).where("group IS NOT NULL"), "jaccard-labels")
    its_id, its_hash = unused_names(docs, "its_id", "its_hash")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    kept = rows.groupBy("group").agg(F.min(order).alias("kept"))
    marked = rows.join(kept, "group").select(F.col("doc_id").alias(its_id), F.col("text_hash").alias(its_hash), (order == F.col("kept")).alias("stays"))
    marked = materialise(marked.groupBy(its_id, its_hash, "stays").agg(F.count("*").alias("times")), "jaccard-marked")
    release(rows)
    gone, again = (marked.where(x).select(its_id, its_hash) for x in ("NOT stays", "stays AND times > 1"))
    n_gone, n_again = (x.count() for x in (gone, again))
    same = F.col("doc_id").eqNullSafe(F.col(its_id)) & F.xxhash64("text").eqNullSafe(F.col(its_hash))
    left = docs.join(small_side(gone, n_gone, BROADCAST_ITEMS), same, "left_anti")
    if not n_again:
        return left
    twice = small_side(again, n_again, BROADCAST_ITEMS)
    once = left.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(twice, same, "left_anti").unionByName(once)
