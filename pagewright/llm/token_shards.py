"""Training-order token shards.

Texts become token ids, each text followed by one end-of-text id; the stream of all ids is cut into
sequences of `length` ids, the last one padded. A keyed Feistel network over the smallest even number of
bits that holds the number of sequences, walked along its cycle until it lands below that number,
gives each sequence its slot: a permutation that needs no table. Slots are dealt by range to tasks, and a
task writes its shards from the first slot to the last, each sequence at slot * stride. A shard
appears under its name only when complete, so a lost task leaves nothing behind; a reader can start at
any slot, and inverse() names the sequence that lies there.

Texts are encoded once; the ids are kept by the executors, compressed and spilled as needed, between
the job that counts them by partition and the job that places them, and are computed again where an
executor is lost. Only the ids move, once, to the tasks that write them; the driver gets one
number per partition.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from contextlib import ExitStack
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import materialise, new_folder, small
from pagewright.llm.files import open_read, write_whole

RANKS = "byte_bpe_50k.tiktoken"
END_OF_TEXT = 50_256
LENGTH = 2_048
SHARD_SEQUENCES = 4_096
MOST_TASKS = 20_000
KEY = "order-1"
ROUNDS = 6
ID = np.dtype("<u2")

STEP = 1 << 20
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")

_encoders: dict = {}


class Feistel:
    """A keyed permutation of range(n)."""

    def __init__(self, n: int, key: str):
        self.n = n
        self.half = np.uint64(max(1, -(-max(1, (n - 1).bit_length()) // 2)))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        seed = hashlib.sha256(f"{key}:{n}".encode()).digest()
        self.keys = np.frombuffer(seed + hashlib.sha256(seed).digest(), np.uint64)[:ROUNDS]

    def _mixed(self, half: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (half ^ key) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) & self.mask

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        x = step(np.asarray(x, np.uint64))
        while (out := x >= self.n).any():
            x[out] = step(x[out])
        return x.astype(np.int64)

    def _forth(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys:
            left, right = right, left ^ self._mixed(right, key)
        return (left << self.half) | right

    def _back(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys[::-1]:
            left, right = right ^ self._mixed(left, key), left
        return (left << self.half) | right

    def slots(self, sequences) -> np.ndarray:
        return self._walk(sequences, self._forth)

    def inverse(self, slots) -> np.ndarray:
        return self._walk(slots, self._back)


class Encoder:
    """Ids of texts as bytes, two a piece, as the library gives them.

    Words aren't kept to be looked up: finding one costs as much as encoding it, and most are rare. Long
    texts are encoded in pieces, so that few ids are Python numbers at a time. No pre-token of the
    vocabulary's pattern holds a space after another character, so a text may be cut before a space that
    has no white space beside it.
    """

    def __init__(self, name: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max(ranks.values()) >= END_OF_TEXT:
            raise ValueError(f"{name} has no free id for the end of a text")
        self.encode = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> bytes:
        return np.array(self.encode(text), ID).tobytes()

    def texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text and its end; an empty text has neither."""
        end = np.array([END_OF_TEXT], ID).tobytes()
        return [b"".join([*map(self.ids, pieces(t)), end]) if t else b"" for t in texts]


def pieces(text: str) -> Iterator[str]:
    """A text in pieces of STEP characters or somewhat more, of which each but the first begins at a lone space."""
    at = 0
    while len(text) - at > STEP and (cut := LONE_SPACE.search(text, at + STEP)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encoder(name: str) -> Encoder:
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def encode_batches(batches: Iterator[pa.RecordBatch], ranks: str) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=1)
    for batch in small(batches, most=STEP):
        found = encoder(ranks).texts([t or "" for t in batch.column("text").to_pylist()])
        sizes = pa.array([len(x) // ID.itemsize for x in found], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), sizes, pa.array([packer.compress(x) for x in found], pa.binary())], ["doc_id", "n_tokens", "ids"])


class Layout(NamedTuple):
    """Where everything lies: bases are the ids before each partition."""

    bases: list[int]
    sequences: int
    length: int
    shard_sequences: int
    shards_a_task: int
    key: str


def place_batches(batches: Iterator[pa.RecordBatch], layout: Layout) -> Iterator[pa.RecordBatch]:
    """Each text's ids in pieces: the slot they belong to and where they begin there."""
    part, order = TaskContext.get().partitionId(), Feistel(layout.sequences, layout.key)
    at = layout.bases[part] if part < len(layout.bases) else 0
    packer, unpacker = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    for batch in batches:
        docs, sequences, begins, pieces = [], [], [], []
        for doc_id, packed in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
            ids = unpacker.decompress(packed)
            done, size = 0, len(ids) // ID.itemsize
            while done < size:
                begin = at % layout.length
                n = min(size - done, layout.length - begin)
                docs.append(doc_id)
                sequences.append(at // layout.length)
                begins.append(begin)
                pieces.append(packer.compress(ids[done * ID.itemsize : (done + n) * ID.itemsize]))
                done, at = done + n, at + n
        slots = order.slots(np.array(sequences, np.uint64))
        task = slots // layout.shard_sequences // layout.shards_a_task
        yield pa.RecordBatch.from_arrays(
            [pa.array(task.astype(np.int32)), pa.array(slots), pa.array(sequences, pa.int64()), pa.array(begins, pa.int32()), pa.array(docs, pa.int64()), pa.array(pieces, pa.binary())],
            ["task", "slot", "sequence", "begin", "doc_id", "ids"],
        )


def shard_uri(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:08d}.bin"


WRITTEN = "slot long, sequence long, shard long, offset long, n_tokens long, doc_ids array<long>, payload_sha256 string"


def write_batches(batches: Iterator[pa.RecordBatch], layout: Layout, folder: str) -> Iterator[pa.RecordBatch]:
    """The shards of one task from its pieces in order; one row for each sequence written."""
    unpacker, stride = zstandard.ZstdDecompressor(), layout.length * ID.itemsize
    empty = np.full(layout.length, END_OF_TEXT, ID).tobytes()
    pieces = (row for batch in batches for row in zip(*(batch.column(x).to_pylist() for x in ("slot", "sequence", "begin", "doc_id", "ids"))))
    piece = next(pieces, None)
    while piece is not None:
        shard, rows = piece[0] // layout.shard_sequences, []
        with write_whole(shard_uri(folder, shard)) as f:
            while piece is not None and piece[0] // layout.shard_sequences == shard:
                slot, sequence, used, doc_ids, payload = piece[0], piece[1], 0, [], bytearray(empty)
                while piece is not None and piece[0] == slot:
                    ids = unpacker.decompress(piece[4])
                    payload[piece[2] * ID.itemsize : piece[2] * ID.itemsize + len(ids)] = ids
                    used += len(ids) // ID.itemsize
                    if not doc_ids or doc_ids[-1] != piece[3]:
                        doc_ids.append(piece[3])
                    piece = next(pieces, None)
                f.write(payload)
                rows.append((slot, sequence, shard, slot % layout.shard_sequences * stride, used, doc_ids, hashlib.sha256(payload).hexdigest()))
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in WRITTEN.split(", ")])


def write_shards(docs: DataFrame, folder: str | None = None, ranks: str = RANKS, length: int = LENGTH, shard_sequences: int = SHARD_SEQUENCES, key: str = KEY) -> DataFrame:
    """Write the ids of `docs` (doc_id, text, any others) as shards; one row per sequence: WRITTEN.

    offset is the sequence's place in its shard in bytes, n_tokens is its ids without padding, doc_ids
    the documents it holds in order, payload_sha256 covers the stride as written. Null and empty texts
    add no ids; a row that occurs again is written again; texts of any length run on over sequences;
    no rows give no shards. The order of the stream is that of the rows of `docs`; where a shuffle
    makes them, they are written to the shared folder first, so that their order is fixed.
    """
    spark: SparkSession = docs.sparkSession
    folder = folder or new_folder(spark, "token-shards")
    docs = docs.select("doc_id", "text")
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = materialise(docs, "token-texts")
    tokens = docs.mapInArrow(lambda b: encode_batches(b, ranks), "doc_id long, n_tokens long, ids binary").persist(StorageLevel.MEMORY_AND_DISK)
    sums = {r.part: r.n for r in tokens.groupBy(F.spark_partition_id().alias("part")).agg(F.sum("n_tokens").alias("n")).collect()}
    bases, total = [], 0
    for part in range(max(sums, default=-1) + 1):
        bases.append(total)
        total += sums.get(part, 0)
    sequences = -(-total // length)
    if not sequences:
        tokens.unpersist()
        return spark.createDataFrame([], WRITTEN)
    shards = -(-sequences // shard_sequences)
    layout = Layout(bases, sequences, length, shard_sequences, -(-shards // MOST_TASKS), key)
    placed = tokens.mapInArrow(lambda b: place_batches(b, layout), "task int, slot long, sequence long, begin int, doc_id long, ids binary")
    dealt = placed.repartitionById(-(-shards // layout.shards_a_task), F.col("task")).sortWithinPartitions("slot", "begin")
    written = materialise(dealt.mapInArrow(lambda b: write_batches(b, layout, folder), WRITTEN), "token-sequences")
    tokens.unpersist()
    return written


def read_slots(folder: str, start: int = 0, length: int = LENGTH, shard_sequences: int = SHARD_SEQUENCES) -> Iterator[np.ndarray]:
    """The sequences from slot `start` on, shard after shard, until the shards end."""
    slot, stride = start, length * ID.itemsize
    while True:
        with ExitStack() as stack:
            try:
                f = stack.enter_context(open_read(shard_uri(folder, slot // shard_sequences)))
            except FileNotFoundError:
                return
            f.seek(slot % shard_sequences * stride)
            while len(data := f.read(stride)) == stride:
                yield np.frombuffer(data, ID)
                slot += 1
            if slot % shard_sequences:
                return
