"""Runs of words that two documents share, wherever they begin and end.

Every run of `least` words is named by the least hash among its shorter runs of words, its seed. Equal
runs have equal seeds, and neighbouring runs mostly have the same one: they make a block, one row for
some `least` / 4 words that also holds its runs' hashes and places. Seeds of one document alone are
dropped first. Where all blocks of a seed are equal, their runs are shared as they stand; only of the
others are single runs compared, each distinct block once. What is left are exactly the runs that two
documents have (but for a chance collision: 64 bits of the seed and 32 of the run). Lines play no part.
Texts are read twice, once for the seeds and once for the blocks of shared seeds, and not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import as_bytes, materialise, release, small, small_side
from pagewright.llm.shingles import mixed, sums_of, words_of

STEP_BYTES = 1 << 18


def run_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of `width` words, from one running sum."""
    if len(words) < width:
        return np.empty(0, np.uint64)
    sums, down = sums_of(words)
    return mixed((sums[width:] - sums[:-width]) * down[: len(words) - width + 1] ^ np.uint64(width))


def least_around(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    if len(x) < width:
        return np.empty(0, x.dtype)
    reach = 1
    while 2 * reach <= width:
        x, reach = np.minimum(x[: len(x) - reach], x[reach:]), 2 * reach
    return np.minimum(x[: len(x) - (width - reach)], x[width - reach :])


def steps(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in runs of some hundred kilobytes, each with the number of its first."""
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and held < STEP_BYTES:
            held += len(texts[end]) + 1
            end += 1
        yield at, texts[at:end]
        at = end


#: runs: a 32-bit number each; steps: how far start and end move from run to run, in 8 bits each, or in 32 where that is too few.
BLOCKS = "doc_id long, text_hash long, seed long, name long, at int, start int, end int, runs binary, steps binary"


def packed(numbers: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Rows of numbers as one binary value from each edge to the next."""
    rows = np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), -1)
    return pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * rows.shape[1]).astype(np.int32)), pa.py_buffer(rows)])


def unpacked(column: pa.Array, kind=np.uint32) -> np.ndarray:
    """All numbers of a column of packed() values."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


NAMED = "doc_id long, seed long, name long"


def blocks_of(batches: Iterator[pa.RecordBatch], least: int, fields: str = BLOCKS) -> Iterator[pa.RecordBatch]:
    """The texts' blocks, as rows of BLOCKS or of NAMED."""
    wanted = [c.split()[0] for c in fields.split(", ")]
    inner = max(1, least // 3)
    most = least - inner + 1
    for batch in small(batches):
        ids, text_hashes = batch.column("doc_id"), batch.column("text_hash")
        for first, texts in steps(as_bytes(batch, "text")):
            words = words_of(texts)
            seeds = least_around(run_hashes(words.hashes, inner), most)
            at = np.flatnonzero(words.owner[: len(seeds)] == words.owner[least - 1 :]) if len(seeds) else np.empty(0, np.int64)
            if not len(at):
                continue
            seeds, text = seeds[at], words.owner[at]
            new = np.r_[True, (seeds[1:] != seeds[:-1]) | (text[1:] != text[:-1])]
            begins = np.flatnonzero(new)
            within = np.arange(len(at)) - begins[np.cumsum(new) - 1]
            begins = np.flatnonzero(within % most == 0)  # a text that repeats itself has long stretches of one seed
            n = np.diff(np.r_[begins, len(at)])
            a = at[begins]
            sums, down = sums_of(words.hashes)
            names = mixed((sums[a + n + least - 1] - sums[a]) * down[a] + n.astype(np.uint64))
            rows = pa.array(text[begins] + first)
            columns = {"doc_id": ids.take(rows), "seed": pa.array(seeds[begins].view(np.int64)), "name": pa.array(names.view(np.int64))}
            if fields == BLOCKS:
                runs = (run_hashes(words.hashes, least)[at] >> np.uint64(32)).astype(np.uint32)
                places = np.stack([words.start[at], words.end[at + least - 1]], 1)
                moves = np.diff(places, axis=0, prepend=places[:1])
                moves[begins] = 0
                moves = moves.astype(np.uint8 if moves.max() < 256 else np.uint32)
                edges, place = np.r_[begins, len(at)], a - np.searchsorted(words.owner, text[begins])
                columns |= {"text_hash": text_hashes.take(rows), "runs": packed(runs, edges), "steps": packed(moves, edges)}
                columns |= {c: pa.array(x.astype(np.int32)) for c, x in (("at", place), ("start", places[begins, 0]), ("end", places[begins, 1]))}
            yield pa.RecordBatch.from_arrays([columns[c] for c in wanted], wanted)


RUNS = "name long, seed long, kept_doc_id long, most_id long, place int, run int"


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of blocks (name, seed, kept_doc_id, most_id, runs), one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column("runs")).to_numpy() // 4
        number = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
        place = np.arange(len(number)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        columns = [batch.column(c).take(number) for c in ("name", "seed", "kept_doc_id", "most_id")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(place.astype(np.int32)), pa.array(unpacked(batch.column("runs")).view(np.int32))], [c.split()[0] for c in RUNS.split(", ")])


def opened(t: pa.Table) -> tuple[np.ndarray, ...]:
    """(doc, text, run, at, start, end, kept) of the shared runs of blocks (BLOCKS, with kept_doc_id for all their runs, or kept for some)."""
    sizes = pa.compute.binary_length(t.column("runs")).to_numpy().astype(np.int64) // 4
    firsts = np.cumsum(sizes) - sizes
    number = np.repeat(np.arange(t.num_rows), sizes)
    place = np.arange(len(number)) - firsts[number]
    chosen = t.column("kept_doc_id").is_valid().to_numpy()[number]
    kept = t.column("kept_doc_id").fill_null(0).to_numpy()[number]
    some = t.column("kept").combine_chunks()
    which = np.repeat(np.arange(t.num_rows), some.value_lengths().fill_null(0).to_numpy())
    flat = some.flatten()
    if len(flat):
        spot = firsts[which] + flat.field("place").to_numpy()
        kept[spot], chosen[spot] = flat.field("kept_doc_id").to_numpy(), True
    moves = np.empty((len(number), 2), np.int64)
    lengths = pa.compute.binary_length(t.column("steps")).to_numpy() // sizes
    for length, kind in ((2, np.uint8), (8, np.uint32)):
        moves[(lengths == length)[number]] = unpacked(t.column("steps").filter(pa.array(lengths == length)), kind).reshape(-1, 2)
    moves[firsts, 0], moves[firsts, 1] = t.column("start").to_numpy(), t.column("end").to_numpy()
    places = np.cumsum(moves, axis=0)
    places -= (places[firsts] - moves[firsts])[number]
    wide = lambda name: t.column(name).to_numpy()[number[chosen]]
    run = mixed(wide("seed").view(np.uint64) + unpacked(t.column("runs"))[chosen].astype(np.uint64)).view(np.int64)
    return wide("doc_id"), wide("text_hash"), run, wide("at") + place[chosen], *places[chosen].astype(np.int32).T, kept[chosen]


def joined_runs(t: pa.Table, least: int) -> pa.RecordBatch:
    """Runs that overlap or touch are one passage, with one row per stretch that is kept, or removed for one document."""
    doc, text, run, at, start, end, kept = opened(t)
    order = np.lexsort((at, text, doc))
    doc, text, run, at, start, end, kept = (x[order] for x in (doc, text, run, at, start, end, kept))
    own = lambda a, b: (doc[a] == doc[b]) & (text[a] == text[b])
    once = np.r_[True, ~own(np.s_[1:], np.s_[:-1]) | (at[1:] != at[:-1])]
    doc, text, run, at, start, end, kept = (x[once] for x in (doc, text, run, at, start, end, kept))
    removed = doc != kept
    order = np.lexsort((at, run, text, doc))
    again = np.r_[False, own(order[1:], order[:-1]) & (run[order][1:] == run[order][:-1])]
    removed[order[again]] = True
    near = own(np.s_[1:], np.s_[:-1]) & (at[1:] - at[:-1] <= least)
    passage = np.cumsum(np.r_[True, ~near]) - 1
    begins = np.flatnonzero(np.r_[True, ~near])
    lasts = np.r_[begins[1:], len(at)] - 1
    words = (at[lasts] - at[begins] + least)[passage]
    same = near & (at[1:] == at[:-1] + 1) & (kept[1:] == kept[:-1]) & (removed[1:] == removed[:-1])
    a = np.flatnonzero(np.r_[True, ~same])
    z = np.r_[a[1:], len(at)] - 1
    columns = [doc[a], text[a], start[a], end[z], (at[z] - at[a] + least).astype(np.int32), words[a].astype(np.int64), run[a], kept[a], removed[a]]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], [c.split()[0] for c in PASSAGES.split(", ")])


def passages(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows come by doc_id; a document's last rows wait for the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        doc = batch.column("doc_id").to_numpy()
        cut = int(np.searchsorted(doc, doc[-1]))
        if held and (cut or held[-1].column("doc_id")[0].as_py() != doc[0]):
            yield joined_runs(pa.Table.from_batches([*held, batch.slice(0, cut)]), least)
            held = []
        elif cut:
            yield joined_runs(pa.Table.from_batches([batch.slice(0, cut)]), least)
        held.append(batch.slice(cut))
    if held:
        yield joined_runs(pa.Table.from_batches(held), least)


PASSAGES = "doc_id long, text_hash long, start int, end int, n_words int, passage_words long, group_id long, kept_doc_id long, removed boolean"


def shared_runs(docs: DataFrame, least: int) -> DataFrame:
    """One row per stretch of `least` words or more that another doc_id has too: doc_id, text_hash, start
    and end (code points, end exclusive), n_words, passage_words (of the overlapping stretches it belongs
    to), group_id (names its first `least` words), kept_doc_id (the smallest that has them), removed.

    docs: (doc_id long, text, text_hash). A run is kept where it first stands in the texts of its smallest
    doc_id. Rows of null doc_id are passed over, rows that repeat both doc_id and text count once.
    """
    texts = docs.where("doc_id is not null").select("doc_id", "text", "text_hash")
    named, blocks = (texts.mapInArrow(lambda b, fields=fields: blocks_of(b, least, fields), fields) for fields in (NAMED, BLOCKS))
    ends = [F.min("doc_id").alias("kept_doc_id"), F.max("doc_id").alias("most_id")]
    by_seed = named.groupBy("seed").agg(*ends, F.min("name").alias("name"), F.max("name").alias("other")).where("kept_doc_id < most_id")
    seeds = materialise(by_seed.select("seed", F.when(F.col("name") == F.col("other"), F.col("kept_doc_id")).alias("kept_doc_id")), "seeds-shared", hashes=True)
    held = materialise(blocks.join(small_side(seeds, seeds.count()), "seed"), "blocks-held", hashes=True)
    release(seeds)
    mixed_up = held.where("kept_doc_id is null").drop("kept_doc_id")
    names = materialise(mixed_up.groupBy("name").agg(*ends), "blocks-named")
    one_each = mixed_up.withColumnRenamed("doc_id", "kept_doc_id").join(small_side(names, names.count()), ["name", "kept_doc_id"])
    single = materialise(one_each.select("name", "seed", "kept_doc_id", "most_id", "runs").mapInArrow(runs_of, RUNS), "runs", hashes=True)
    two = single.groupBy("seed", "run").agg(F.min("kept_doc_id").alias("kept_doc_id"), F.max("most_id").alias("most_id")).where("kept_doc_id < most_id").drop("most_id")
    both = materialise(two, "runs-shared")
    chosen = single.drop("kept_doc_id", "most_id").join(small_side(both, both.count()), ["seed", "run"])
    some = materialise(chosen.groupBy("name").agg(F.collect_list(F.struct("place", "kept_doc_id")).alias("kept")), "blocks-shared")
    parted = mixed_up.withColumn("kept_doc_id", F.lit(None).cast("long")).join(small_side(some, some.count()), "name")
    whole = held.where("kept_doc_id is not null").withColumn("kept", F.lit(None).cast(parted.schema["kept"].dataType))
    wanted = ["doc_id", "text_hash", "seed", "at", "start", "end", "runs", "steps", "kept_doc_id", "kept"]
    placed = whole.select(wanted).unionByName(parted.select(wanted)).repartition("doc_id").sortWithinPartitions("doc_id")
    found = materialise(placed.mapInArrow(lambda b: passages(b, least), PASSAGES), "runs-found")
    release(held, names, single, both, some)
    return found
