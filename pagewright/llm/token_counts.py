"""Token counts of whole texts, as a SentencePiece BPE model gives them.

A text is cut before each run of spaces. No piece of the model holds a space after another
character, so no merge crosses a cut and the counts of the parts add up; a model with such a piece is
refused. Lookup has two tiers. The lengths of frequent parts, from a sample of at most `sample_docs`
documents, are encoded once on the driver and broadcast in packed form (at most `table_size` parts
of at most MAX_PART bytes). What is missing there is encoded where it is met and kept in a bounded
cache of the Python worker, which outlives the task. Nothing is shuffled, and the
sample decides speed only: every part of every text is counted.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import sample_texts, small

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
SAMPLE_DOCS = 2_000
TABLE_SIZE = 32_768
MAX_PART = 48
CACHE_PARTS = 250_000
STEP_CHARS = 1 << 20

SPACE = "▁"
RUN = re.compile(" +[^ ]*")

_models: dict = {}
_caches: dict = {}


def model_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(name: str):
    """The library's processor for a model, checked for the property that the cuts rest on."""
    if name not in _models:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path(name))
        inner = re.compile(f"[^{SPACE}]{SPACE}")
        if any(inner.search(sp.id_to_piece(i)) for i in range(sp.get_piece_size())):
            raise ValueError(f"{name} has pieces that cross a space; its texts can't be cut there")
        _models[name] = sp
    return _models[name]


def parts_of(text: str) -> list[str]:
    """The text's parts, each without the first space of its run (the model adds that one itself)."""
    if SPACE in text:
        text = text.replace(SPACE, " ")
    if "  " in text or text[:1] == " " or text[-1:] == " ":
        return [x[1:] for x in RUN.findall(f" {text}")] if text else []
    return text.split(" ") if text else []


def part_lengths(sp, parts: list[str]) -> list[int]:
    return [len(x) if part else 1 for part, x in zip(parts, sp.encode(parts, num_threads=1))]


def pack(lengths: dict[str, int]) -> tuple[bytes, bytes]:
    return "\0".join(lengths).encode(), bytes(lengths.values())


def unpack(table: tuple[bytes, bytes]) -> dict[str, int]:
    return dict(zip(table[0].decode().split("\0"), table[1])) if table[1] else {}


def frequent_parts(docs: DataFrame, model: str, sample_docs: int, table_size: int) -> dict[str, int]:
    """Lengths of the parts that are most frequent in a bounded sample."""
    counted = Counter(p for text in sample_texts(docs, sample_docs) for p in parts_of(text) if p and "\0" not in p and len(p.encode()) <= MAX_PART)
    parts = [p for p, _ in counted.most_common(table_size)]
    lengths = part_lengths(load(model), parts) if parts else []
    return {p: n for p, n in zip(parts, lengths) if n < 256}


def count_batches(batches: Iterator[pa.RecordBatch], model: str, table) -> Iterator[pa.RecordBatch]:
    sp = load(model)
    key = (model, id(table))
    if key not in _caches:
        _caches.clear()
        _caches[key] = (frequent := unpack(table.value), dict(frequent))
    frequent, cache = _caches[key]
    for batch in small(batches):
        texts = batch.column("text").to_pylist()
        counts: list[int] = []
        at = 0
        while at < len(texts):
            cut, held = [], 0
            while at < len(texts) and held < STEP_CHARS:
                text = texts[at] or ""
                cut.append(parts_of(text))
                held += len(text) + 1
                at += 1
            new = list(set().union(*cut).difference(cache))
            if new:
                if len(cache) > CACHE_PARTS:
                    cache.clear()
                    cache.update(frequent)
                    new = list(set().union(*cut).difference(cache))
                cache.update(zip(new, part_lengths(sp, new)))
            counts += [sum(map(cache.__getitem__, parts)) for parts in cut]
            for part in new:
                if len(part) > MAX_PART:
                    del cache[part]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, model: str = MODEL, sample_docs: int = SAMPLE_DOCS, table_size: int = TABLE_SIZE) -> DataFrame:
    """Per row of `docs` (doc_id, text, any others): doc_id, n_bytes (UTF-8), n_tokens.

    No begin, end or added special tokens; special strings in a text are ordinary text. Null and
    empty texts have 0 of both. Repeated rows are counted each; texts of any length are counted
    whole; a null doc_id stays null.
    """
    context: SparkContext = docs.sparkSession.sparkContext
    table = context.broadcast(pack(frequent_parts(docs, model, sample_docs, table_size)))
    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(lambda batches: count_batches(batches, model, table), "doc_id long, n_bytes long, n_tokens long")
