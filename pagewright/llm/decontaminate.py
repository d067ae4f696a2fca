"""Benchmark decontamination with suffix arrays of the training text.

The benchmark's suffixes of `width` words or more (and shorter items as a whole) are a stated query set:
they are numbered over the benchmark's own vocabulary and sent to every task in blocks of at most
`block_words` words, so what is broadcast at once has a fixed bound; a larger benchmark has more
blocks, which a task loads one after the other for each shard. A task gathers its documents into shards
of SHARD_WORDS words. A shard keeps the runs of benchmark words that are long enough to hold a window
(no other place can match), sorts all suffixes of those runs into an array, and finds the range of every
test suffix in it by binary search, for all suffixes at once; suffixes with the same first `width` words
have one range, and share its search. Matches that go on from one suffix of an item to the next are one
verbatim match; the longest of each item and document is kept with its places. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame

from pagewright.llm.common import as_bytes, small

WIDTH = 10
BLOCK_WORDS = 2_000_000
SHARD_WORDS = 2_000_000

_WORD_BYTES = bytes(x + 32 if 0x41 <= x <= 0x5A else x if 0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A or x >= 0x80 else 0x20 for x in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits and of anything beyond ASCII."""
    return text.translate(_WORD_BYTES).split()


class Suffixes:
    """The suffixes of a block of items by their first `width` words, as rows of word numbers, 0 beyond a short item's end.

    Items with the same words are one, of several ids. A null id is no name.
    """

    def __init__(self, items: list[tuple[object, bytes]], width: int = WIDTH):
        self.width = width
        numbers: dict[bytes, int] = {}
        distinct: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            words = tuple(numbers.setdefault(w, len(numbers) + 1) for w in words_of(text))
            if words:
                distinct.setdefault(words, set()).update([] if item_id is None else [str(item_id)])
        holders: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for number, words in enumerate(distinct):
            for start in range(max(1, len(words) - width + 1)):
                holders.setdefault(words[start : start + width], []).append((number, start))
        self.numbers = numbers
        self.item_ids = [sorted(ids) for ids in distinct.values()]
        ordered = sorted(holders)
        self.lengths = np.array([len(w) for w in ordered], np.int64)
        self.rows = np.zeros((len(ordered), width), np.int32)
        for i, w in enumerate(ordered):
            self.rows[i, : len(w)] = w
        held = [np.array(holders[w], np.int64) for w in ordered]
        self.n_held = np.array([len(h) for h in held], np.int64)
        self.item, self.place = np.concatenate(held).T if held else np.empty((2, 0), np.int64)
        self.shortest = int(self.lengths.min()) if len(ordered) else 0


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of `text` in their order, by doubling."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    known, order = 1, np.argsort(rank, kind="stable")
    while known < len(text):
        after = np.full(len(text), -1, np.int64)
        after[:-known] = rank[known:]
        pair = rank * (len(text) + 2) + after + 1
        order = np.argsort(pair, kind="stable")
        step = np.diff(pair[order]) != 0
        rank[order] = np.r_[0, np.cumsum(step)]
        known *= 2
        if step.all():
            break
    return order


def bounds(text: np.ndarray, suffixes: np.ndarray, windows: Suffixes, after: bool) -> np.ndarray:
    """For each row the first suffix that isn't before it, or with `after` the first beyond all it begins."""
    offsets = np.arange(windows.width)
    used = offsets < windows.lengths[:, None]
    low, high = np.zeros(len(windows.rows), np.int64), np.full(len(windows.rows), len(suffixes), np.int64)
    while (open_ := low < high).any():
        middle = (low + high) // 2
        places = suffixes[np.minimum(middle, len(suffixes) - 1)][:, None] + offsets
        found = text[np.minimum(places, len(text) - 1)]
        differs = (found != windows.rows) & used
        at = differs.argmax(1)
        rows = np.arange(len(at))
        is_equal = ~differs[rows, at]
        before = np.where(is_equal, after, found[rows, at] < windows.rows[rows, at])
        low = np.where(open_ & before, middle + 1, low)
        high = np.where(open_ & ~before, middle, high)
    return low


def occurrences(ids: np.ndarray, windows: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """(row, start) of each place in `ids` where a row of `windows` occurs; 0 in `ids` is a word no item has."""
    known = ids > 0
    edges = np.flatnonzero(np.diff(np.r_[False, known, False]))
    starts, ends = edges[::2], edges[1::2]
    long_enough = ends - starts >= windows.shortest
    starts, lengths = starts[long_enough], (ends - starts)[long_enough]
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # the runs one after the other, each with a 0 behind it and enough of them at the end
    begins = np.cumsum(np.r_[0, lengths[:-1] + 1])
    text = np.zeros(int(begins[-1] + lengths[-1] + 1 + windows.width), np.int32)
    place = np.full(len(text), -1, np.int64)
    within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    to, source = np.repeat(begins, lengths) + within, np.repeat(starts, lengths) + within
    text[to], place[to] = ids[source], source
    suffixes = suffix_array(text)
    first, last = bounds(text, suffixes, windows, False), bounds(text, suffixes, windows, True)
    n = last - first
    window = np.repeat(np.arange(len(n)), n)
    at = np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return window, place[suffixes[at]]


class Found(NamedTuple):
    """What a shard's documents have in common with a block."""

    hit: np.ndarray  # for each word of the shard, whether it lies in an occurrence
    matches: list[tuple[int, int, int, int, int]]  # document, item, item's word, document's word, length: the longest of each document and item


def numbered(words: list[bytes], windows: Suffixes) -> np.ndarray:
    return np.fromiter(map(windows.numbers.get, words, repeat(0)), np.int32, len(words))


def search_shard(ids: np.ndarray, begins: np.ndarray, windows: Suffixes) -> Found:
    """ids: the documents' words by their numbers, with a 0 behind each document and one more at the end."""
    if not len(windows.rows):
        return Found(np.zeros(len(ids), bool), [])
    row, start = occurrences(ids, windows)
    if not len(row):
        return Found(np.zeros(len(ids), bool), [])
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + windows.lengths[row], -1)
    first = (np.cumsum(windows.n_held) - windows.n_held)[row]
    n = windows.n_held[row]
    held = np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    item, place, at, length = windows.item[held], windows.place[held], np.repeat(start, n), np.repeat(windows.lengths[row], n)
    order = np.lexsort((at, at - place, item))
    item, place, at, length = (x[order] for x in (item, place, at, length))
    goes_on = (item[1:] == item[:-1]) & (at[1:] - place[1:] == at[:-1] - place[:-1]) & (at[1:] == at[:-1] + 1)
    head = np.flatnonzero(np.r_[True, ~goes_on])
    tail = np.r_[head[1:], len(item)] - 1
    item, place, at, length = item[head], place[head], at[head], at[tail] + length[tail] - at[head]
    doc = np.searchsorted(begins, at, "right") - 1
    order = np.lexsort((place, at, -length, item, doc))
    doc, item, place, at, length = (x[order] for x in (doc, item, place, at, length))
    longest = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]
    return Found(np.cumsum(cover[:-1]) > 0, list(zip(*(x[longest].tolist() for x in (doc, item, place, at - begins[doc], length)))))


SCHEMA = "doc_id long, n_words long, n_hit long, spans array<struct<start:long,end:long>>, items array<string>, matches array<struct<item_id:string,item_start:long,start:long,length:long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_MATCHES = pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int64()), ("start", pa.int64()), ("length", pa.int64())]))


def search_texts(texts: list[np.ndarray], windows: Suffixes) -> tuple[Found, np.ndarray]:
    sizes = np.array([len(w) for w in texts], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    ids = np.zeros(int((sizes + 1).sum()) + 1, np.int32)
    for begin, numbers in zip(begins.tolist(), texts):
        ids[begin : begin + len(numbers)] = numbers
    return search_shard(ids, begins, windows), begins


def shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Runs of batches with some `most` words, six bytes each, in all."""
    held, size = [], 0
    for batch in small(batches):
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
        if size >= 6 * most:
            yield held
            held, size = [], 0
    if held:
        yield held


def searched(shard: list[pa.RecordBatch], blocks: list[Broadcast]) -> tuple[list[int], list[np.ndarray], list[list[tuple[str, int, int, int]]]]:
    """For each document of a shard: its words, which of them are hit, and its longest matches by item id."""
    hits: list[np.ndarray] = []
    for windows in one_by_one(blocks):
        texts = [numbered(words_of(text), windows) for batch in shard for text in as_bytes(batch, "text")]
        if not hits:
            hits, matches = [np.zeros(len(w), bool) for w in texts], [[] for _ in texts]
        found, begins = search_texts(texts, windows)
        for doc in {m[0] for m in found.matches}:
            hits[doc] |= found.hit[begins[doc] : begins[doc] + len(texts[doc])]
        for doc, item, place, at, length in found.matches:
            matches[doc] += [(name, place, at, length) for name in windows.item_ids[item]]
    return [len(h) for h in hits], hits, matches


def longest_by_id(matches: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int, int]]:
    """One match an id, the longest and then the first, by id."""
    out: dict[str, tuple[str, int, int, int]] = {}
    for m in sorted(matches, key=lambda m: (-m[3], m[2], m[1])):
        out.setdefault(m[0], m)
    return [out[k] for k in sorted(out)]


def report(shard: list[pa.RecordBatch], blocks: list[Broadcast]) -> pa.RecordBatch:
    n_words, hits, matches = searched(shard, blocks)
    spans = [np.flatnonzero(np.diff(np.r_[False, h, False])).reshape(-1, 2).tolist() if m or h.any() else [] for h, m in zip(hits, matches)]
    matches = [longest_by_id(m) for m in matches]
    columns = [
        pa.chunked_array([b.column("doc_id") for b in shard]).cast(pa.int64()).combine_chunks(),
        pa.array(n_words, pa.int64()),
        pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()),
        pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], _SPANS),
        pa.array([[m[0] for m in found] for found in matches], pa.list_(pa.string())),
        pa.array([[dict(zip(("item_id", "item_start", "start", "length"), m)) for m in found] for found in matches], _MATCHES),
    ]
    return pa.RecordBatch.from_arrays(columns, [f.name for f in _ROWS])


_ROWS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", _SPANS), ("items", pa.list_(pa.string())), ("matches", _MATCHES)])


def item_blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[object, bytes]]]:
    """The items in blocks, read from the cluster one partition at a time."""
    block, n = [], 0
    for row in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        block.append((row.item_id, row.text.encode()))
        n += len(row.text) // 4 + 1
        if n >= block_words:
            yield block
            block, n = [], 0
    if block:
        yield block


def send_blocks(benchmark: DataFrame, width: int, block_words: int) -> list[Broadcast]:
    context = benchmark.sparkSession.sparkContext
    return [context.broadcast(Suffixes(block, width)) for block in item_blocks(benchmark, block_words)] or [context.broadcast(Suffixes([], width))]


def one_by_one(blocks: list[Broadcast]) -> Iterator[Suffixes]:
    """The blocks; of several, a worker holds one at a time."""
    for block in blocks:
        yield block.value
        if len(blocks) > 1:
            del block._value


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Per row of `docs` (doc_id, text, any others): SCHEMA. spans are runs of hit words; items the ids of
    items with an occurring window, each once, sorted as strings; matches the longest verbatim match of
    each of these (where it begins in the item and in the document, and its length, in words).

    Null and empty texts have no words; items without words match nothing. Items with equal words are all
    named, an id that occurs in several rows once; the windows of items of null id are hit, but nothing
    names them. Without items nothing is hit. A null doc_id stays null, a repeated row is searched each time.
    """
    blocks = send_blocks(benchmark, width, block_words)
    return docs.select("doc_id", "text").mapInArrow(lambda batches: (report(shard, blocks) for shard in shards(batches, shard_words)), SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The rows of `docs` in which no window of the benchmark occurs, with all their columns."""
    blocks = send_blocks(benchmark, width, block_words)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, shard_words):
            clean, at = [not h.any() for h in searched(shard, blocks)[1]], 0
            for batch in shard:
                yield batch.filter(pa.array(clean[at : at + batch.num_rows]))
                at += batch.num_rows

    return docs.mapInArrow(keep, docs.schema)


def items_digest(items) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
