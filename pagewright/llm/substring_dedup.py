"""Substring dedup: passages that repeat across documents, by paragraph.

A paragraph is a line; a line of more than LONG_LINE words is cut further, where a word pair's hash is
the least of those within REACH words on either side. Such cuts depend on the words around them
alone, so a passage within two long lines is cut alike. Paragraphs of fewer than `width` words are
passed over. The shingles of a paragraph (runs of `width` words) give a MinHash signature, banded so
that a pair at the least similarity shares a bucket with probability RECALL at least. Paragraphs that
meet are compared exactly (links.py), and the components of the links are the groups of equal
passages. In a document, grouped paragraphs that follow one another, and do so in another document, are one
passage; a passage of fewer than `least_words` words is left alone. Equal paragraphs are one item from the
start, found with partial sums; no group of copies is expanded into pairs, and no text is shuffled.

Beside them, runs of `least_words` words that two documents share are found wherever they begin and
end (verbatim.py), and reported as passages without a paragraph.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.llm.common import as_bytes, frugal, materialise, release, small, small_side
from pagewright.llm.links import Bound, link_components
from pagewright.llm.shingles import mixed, sums_of, windows, words_of
from pagewright.llm.verbatim import least_around, packed, shared_runs, steps

WIDTH = 5
PERCENT = 80
RECALL = 0.99
MOST_BANDS = 6
LEAST_WORDS = 25
LONG_LINE = 64
REACH = 8

_SALT = np.uint64(0xD1B54A32D192ED03)


def tuned_bands(similarity: float, recall: float, most: int) -> tuple[int, int]:
    """(bands, rows of each): the most rows, for few chance meetings, with which at most `most` bands reach the recall."""
    for rows in range(8, 0, -1):
        for bands in range(1, most + 1):
            if 1 - (1 - similarity**rows) ** bands >= recall:
                return bands, rows
    raise ValueError(f"{most} bands can't reach a recall of {recall} at a similarity of {similarity}")


class Paragraphs(NamedTuple):
    """Paragraphs of several texts: whose they are, where they lie, their words, names and shingles."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    n_words: np.ndarray
    item: np.ndarray
    shingles: np.ndarray
    begins: np.ndarray


def cuts(hashes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words before which long lines (from begins to ends) are cut: where a word pair's hash is the least around."""
    pairs = mixed(hashes[:-1] * _SALT + hashes[1:])
    if not len(begins):
        return np.empty(0, np.int64)
    places = spread(begins + REACH, ends - begins - 1 - 2 * REACH)
    least = least_around(pairs, REACH)
    return places[(pairs[places] < least[places - REACH]) & (pairs[places] <= least[places + 1])] + 1


def spread(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each begin on, `length` of them, one run after the other."""
    return np.repeat(begins - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def paragraphs_of(texts: list[bytes], width: int) -> Paragraphs:
    """The paragraphs of `width` words or more; offsets are code points of their text."""
    words = words_of(texts)
    lines = np.flatnonzero(np.diff(words.line, prepend=-1))
    line_ends = np.r_[lines[1:], len(words.line)]
    long_lines = line_ends - lines > LONG_LINE
    first = np.sort(np.r_[lines, cuts(words.hashes, lines[long_lines], line_ends[long_lines])]).astype(np.int64)
    n_words = np.diff(np.r_[first, len(words.line)])
    first, n_words = first[n_words >= width], n_words[n_words >= width]
    if not len(first):
        return Paragraphs(*[np.empty(0, np.int64)] * 5, np.empty(0, np.uint64), np.empty(0, np.int64))
    sums, factors = sums_of(words.hashes)
    item = mixed((sums[first + n_words] - sums[first]) * factors[first] + n_words.astype(np.uint64)).view(np.int64)
    sizes = n_words - width + 1
    shingles = windows(words.hashes, width)[spread(first, sizes)]
    return Paragraphs(words.owner[first], words.start[first], words.end[first + n_words - 1], n_words, item, shingles, np.cumsum(sizes) - sizes)


def paragraphs(text: bytes, width: int) -> list[tuple[int, int, np.ndarray]]:
    """(start, end, the shingles' hashes in order) of a text's paragraphs."""
    found = paragraphs_of([text], width)
    shingles = np.split(found.shingles, found.begins[1:]) if len(found.begins) else []
    return list(zip(found.start.tolist(), found.end.tolist(), map(np.unique, shingles)))


class Minhash:
    """Bucket keys of many sets at once."""

    def __init__(self, bands: int, rows: int, seed: int = 1):
        numbers = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.factors = numbers.integers(0, 1 << 64, bands * rows, np.uint64) | np.uint64(1)
        self.terms = numbers.integers(0, 1 << 64, bands * rows, np.uint64)

    def keys(self, shingles: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """One row of keys for each set; the sets lie one after the other from `begins` on."""
        keys = np.zeros((len(begins), self.bands), np.uint64)
        for i, (factor, term) in enumerate(zip(self.factors, self.terms)):
            hashed = shingles * factor + term
            least = np.minimum.reduceat(hashed ^ (hashed >> np.uint64(32)), begins)
            keys[:, i // self.rows] = mixed(keys[:, i // self.rows] * _SALT + least + np.uint64(i // self.rows))
        return keys.view(np.int64)


SIGNED = "doc_id long, text_hash long, paragraph int, start int, end int, n_words int, item long, keys array<long>, shingles binary"


def fewest_to_differ(percent: int) -> int:
    """The fewest shingles of a set that links with a set that isn't equal to it."""
    return next(n for n in range(1, 101) if 100 * n >= percent * (n + 1)) if percent < 100 else 1 << 30


def sign(batches: Iterator[pa.RecordBatch], width: int, percent: int, hashing: Minhash) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        ids, text_hashes = batch.column("doc_id"), batch.column("text_hash")
        for first, texts in steps(as_bytes(batch, "text")):
            found = paragraphs_of(texts, width)
            if not len(found.text):
                continue
            keys = hashing.keys(found.shingles, found.begins)
            used = np.ones(keys.shape, bool)
            used[found.n_words - width + 1 < fewest_to_differ(percent), 1:] = False  # links with equal sets alone, which share all keys
            number = np.arange(len(found.text)) - np.searchsorted(found.text, found.text)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *used.sum(1)]).astype(np.int32)), pa.array(keys[used]))
            sets = packed((found.shingles >> np.uint64(32)).astype(np.uint32), np.r_[found.begins, len(found.shingles)])
            rows = pa.array(found.text + first)
            columns = [ids.take(rows), text_hashes.take(rows), *(pa.array(x.astype(np.int32)) for x in (number, found.start, found.end, found.n_words)), pa.array(found.item), lists, sets]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SIGNED.split(", ")])


def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.unique(np.frombuffer(x, np.uint32)).astype(np.uint64).tobytes() for x in batch.column("shingles").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(sets, pa.binary())], ["item", "set"])


def chained(found: DataFrame) -> DataFrame:
    """`found` (doc_id, text_hash, paragraph, n_words, group_id) with passage_words: of the neighbouring
    paragraphs that follow one another in two doc_ids, group by group."""
    of_text = W.partitionBy("doc_id", "text_hash").orderBy("paragraph")
    after = F.when(F.lead("paragraph").over(of_text) == F.col("paragraph") + 1, F.lead("group_id").over(of_text))
    placed = materialise(found.withColumn("next_group", after), "paragraphs-placed")
    held = placed.where("next_group is not null").groupBy("group_id", "next_group").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    pairs = materialise(held.where("low < high").select("group_id", "next_group", F.lit(True).alias("follows")), "paragraph-pairs")
    both = placed.join(small_side(pairs, pairs.count()), ["group_id", "next_group"], "left").withColumn("follows", F.coalesce("follows", F.lit(False)))
    first = F.when(F.coalesce(F.lag("follows").over(of_text), F.lit(False)), 0).otherwise(1)
    numbered = both.withColumn("first_of_run", first).withColumn("run", F.sum("first_of_run").over(of_text))
    return numbered.withColumn("passage_words", F.sum("n_words").over(W.partitionBy("doc_id", "text_hash", "run"))).drop("next_group", "follows", "first_of_run", "run")


def repeated_passages(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per paragraph of a passage that repeats across documents: doc_id, text_hash (xxhash64 of
    its text), paragraph (its number among those of `width` words), start and end (code points, end
    exclusive), n_words, passage_words (of the passage it belongs to), group_id, kept_doc_id (the group's
    smallest doc_id), removed. Besides, one row per verbatim run of `least_words` words or more, of null
    paragraph; it may overlap others.

    A passage is a run of paragraphs, or one, of `least_words` words in all; neighbours count together only
    where their groups are neighbours in another doc_id too. The group's first paragraph, by doc_id, text
    and number, is kept and all others are removed. Repeats within one document alone are no group. Null,
    empty and short texts have no paragraphs. Paragraphs of null doc_ids belong to groups, but don't make
    one span documents. Rows that repeat doc_id and text count once; texts that share their doc_id alone
    are apart, and no repeat across documents.
    """
    with frugal(docs.sparkSession):
        hashing = Minhash(*tuned_bands(percent / 100, RECALL, MOST_BANDS))
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
        verbatim = shared_runs(texts, least_words)
        marked = materialise(texts.mapInArrow(lambda b: sign(b, width, percent, hashing), SIGNED), "paragraphs-marked", hashes=True)
        signed = materialise(marked.drop("keys", "shingles"), "paragraphs", hashes=True)
        classes = materialise(signed.groupBy("item").agg(F.min("doc_id").alias("kept_doc_id"), F.max("doc_id").alias("most_id")), "paragraph-items")

        def sets_of(items: DataFrame) -> DataFrame:
            wanted = materialise(items, "paragraphs-wanted")
            held = marked.select("item", "shingles").join(small_side(wanted, wanted.count()), "item", "left_semi").dropDuplicates(["item"])
            return held.mapInArrow(as_sets, "item long, set binary")

        linked = materialise(link_components(marked.select("item", F.explode("keys").alias("key")), sets_of, Bound(percent), "paragraphs"), "paragraphs-linked")
        release(marked)
        every = classes.join(small_side(linked, linked.count()), "item", "left").where("component is not null or kept_doc_id < most_id")
        every = materialise(every.select("item", "kept_doc_id", "most_id", F.coalesce("component", "item").alias("group_id")), "paragraphs-grouped")
        spread_out = every.groupBy("group_id").agg(F.min("kept_doc_id").alias("kept_doc_id"), F.max("most_id").alias("most_id")).where("kept_doc_id < most_id").drop("most_id")
        n = every.count()
        grouped = materialise(every.select("item", "group_id").join(small_side(spread_out, n), "group_id"), "paragraph-groups")
        found = signed.join(small_side(grouped, n), "item").drop("item").dropDuplicates(["doc_id", "text_hash", "paragraph"])
        sized = materialise(chained(found), "paragraphs-sized")
        release(signed, classes, linked, every, grouped)
        of_kept = sized.where("doc_id = kept_doc_id").groupBy("group_id").agg(F.min(F.struct("text_hash", "paragraph")).alias("first"))
        own = sized.where("doc_id = kept_doc_id").join(of_kept, "group_id").withColumn("removed", F.struct("text_hash", "paragraph") != F.col("first")).drop("first")
        near = own.unionByName(sized.where("not doc_id <=> kept_doc_id").withColumn("removed", F.lit(True))).where(F.col("passage_words") >= least_words)
        columns = ["doc_id", "text_hash", "paragraph", "start", "end", "n_words", "passage_words", "group_id", "kept_doc_id", "removed"]
        return near.select(columns).unionByName(verbatim.withColumn("paragraph", F.lit(None).cast("int")).select(columns))


def remove_passages(docs: DataFrame, **options) -> DataFrame:
    """`docs`, with all their columns, less the removed stretches of their texts."""
    spans = repeated_passages(docs, **options).where("removed").select("doc_id", "text_hash", F.struct("start", "end").alias("span")).distinct()
    gone = spans.groupBy(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).agg(F.sort_array(F.collect_list("span")).alias("gone"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("row_id"), F.col("text").alias("whole"))
    begin = F.struct(F.lit("").alias("kept"), F.lit(0).alias("at"))
    step = lambda out, s: F.struct(F.concat(out["kept"], F.substring(F.col("whole"), out["at"] + 1, F.greatest(s["start"] - out["at"], F.lit(0)))).alias("kept"), F.greatest(out["at"], s["end"]).alias("at"))
    cut = F.aggregate("gone", begin, step, lambda out: F.concat(out["kept"], F.substring(F.col("whole"), out["at"] + 1, F.length("whole"))))
    same = F.col("row_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("whole") == F.col("gone_hash"))
    joined = rows.join(gone, same, "left")
    return joined.select(F.col("row").withField("text", F.when(F.col("gone").isNull(), F.col("whole")).otherwise(cut)).alias("row")).select("row.*")
