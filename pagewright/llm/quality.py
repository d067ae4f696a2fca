"""Quality rules as a short-circuit cascade.

A rule rejects a text or passes it on; a text is kept if every rule passes it. Each rule is
timed alone on a sample of at most `sample_docs` texts, and what it rejects there is counted; the
rules then run in order of rejections per second, and the first that rejects a text ends its turn. The order
changes the time, never the verdict. What rules measure is computed when first asked for and kept
for the text at hand. There is no shuffle; every text is read whole.

Words are runs without the six ASCII spaces. Capitals and letters are judged on ASCII letters, with
every character beyond ASCII taken as a letter.
"""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagewright.llm.common import SPACES, as_bytes, sample_texts, small

SYMBOLS = b"#*$%&|<>"
SAMPLE_DOCS = 1_000

_CONTINUATION = bytes(range(0x80, 0xC0))
_LETTERS = bytes(x for x in range(256) if x >= 0x80 or chr(x).isalpha())
_NO_LETTERS = bytes(x for x in range(256) if x not in _LETTERS and x not in SPACES)
_VOCABULARY = 1 << 18

_word_ids: defaultdict = defaultdict(count().__next__)


def ids_of(words: list[bytes]) -> np.ndarray:
    """A number under 2**21 for each word, equal for equal words of this call."""
    global _word_ids
    if len(_word_ids) + len(words) > _VOCABULARY and _word_ids:
        _word_ids = defaultdict(count().__next__)
    return np.fromiter(map(_word_ids.__getitem__, words), np.int64, len(words))


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text holds twice or more."""
    if len(words) < 4:
        return 0
    ids = ids_of(words)
    if len(_word_ids) > 1 << 21:  # one text with millions of distinct words: its windows by rank
        pairs = np.unique(ids[:-1] * (int(ids.max()) + 1) + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * (int(ids.max()) + 1) + ids[2:]
    else:
        windows = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    order = np.argsort(windows, kind="stable")
    ordered = windows[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    often = np.zeros(len(windows), bool)
    often[1:] |= same
    often[:-1] |= same
    starts = order[often]
    inside = np.zeros(len(words), bool)
    inside[starts] = inside[starts + 1] = inside[starts + 2] = True
    return int(inside.sum())


class Measures:
    """What the rules ask of one text."""

    def __init__(self, text: bytes):
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text.translate(None, SPACES + _CONTINUATION))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text) - len(self.text.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.text.split(b"\n") if x.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)

    @cached_property
    def n_capital_words(self) -> int:
        return sum(map(bytes.isupper, self.words))

    @cached_property
    def n_letter_words(self) -> int:
        return len(self.text.translate(None, _NO_LETTERS).split())


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Measures], bool]


BASE_RULES = (
    Rule("few_words", lambda m: m.n_words < 50),
    Rule("repeats", lambda m: 100 * m.n_repeat_words > 50 * m.n_words),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", lambda m: 10 * m.n_symbols > m.n_words),
    Rule("same_lines", lambda m: 2 * m.n_dup_lines > len(m.lines)),
    Rule("word_length", lambda m: not 2 * m.n_words <= m.word_chars <= 15 * m.n_words),
    Rule("capitals", lambda m: 2 * m.n_capital_words > m.n_words),
    Rule("letters", lambda m: 10 * m.n_letter_words < 6 * m.n_words),
)


def cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_docs: int = SAMPLE_DOCS) -> list[Rule]:
    """`rules` in order of rejections per second on a sample; as given where there are no rows."""
    texts = [t.encode() for t in sample_texts(docs, sample_docs)]
    worth = {}
    for rule in rules:
        began = time.perf_counter()
        rejected = sum(bool(rule.rejects(Measures(t))) for t in texts)
        worth[rule.name] = (rejected + 0.5) / max(time.perf_counter() - began, 1e-9)
    return sorted(rules, key=lambda r: -worth[r.name]) if texts else list(rules)


def passes(measures: Measures, ordered: Sequence[Rule]) -> bool:
    return not any(rule.rejects(measures) for rule in ordered)


def quality_filter(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The rows of `docs` whose text passes every rule, with all their columns.

    Null and empty texts have no words and are rejected by few_words. Equal rows share a verdict.
    """
    ordered = cascade(docs, rules, sample_docs)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield batch.filter(pa.array([passes(Measures(t), ordered) for t in as_bytes(batch, "text")], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


MEASURED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_report(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Per row of `docs` (doc_id, text, any others): doc_id, the measures, base_failed, kept.

    kept is the cascade's verdict; base_failed is that of the base rules alone and implies not kept.
    Null texts count as empty.
    """
    ordered = cascade(docs, rules, sample_docs)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = []
            for text in as_bytes(batch, "text"):
                m = Measures(text)
                failed = not passes(m, BASE_RULES)
                rows.append((*(getattr(m, x) for x in MEASURED), failed, not failed and passes(m, ordered)))
            columns = list(zip(*rows)) or [()] * (len(MEASURED) + 2)
            kinds = [pa.int64()] * len(MEASURED) + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", *MEASURED, "base_failed", "kept"])

    schema = "doc_id long, " + ", ".join(f"{x} long" for x in MEASURED) + ", base_failed boolean, kept boolean"
    return docs.select("doc_id", "text").mapInArrow(judge, schema)
