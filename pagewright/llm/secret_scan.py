"""Secrets in texts: three fixed patterns, and strings that look random to a Markov model.

Two first-order character models, of random strings and of ordinary identifiers, are fitted on
labelled samples: random ones are drawn from the alphabets that keys use, ordinary ones are words of
at most `sample_docs` documents, alone and joined as identifiers are. A long token, or what a base span
leaves of one, is reported when its log-likelihood ratio per character is above the threshold that best
parts held-out samples, whose ordinary strings are of words that the model was not fitted on; of other
tokens, the parts between separators that are above it together are. The model is a table of 66 x 66 numbers in the task's closure. Nothing is shuffled; each
text is scanned whole, as UTF-8 bytes, and offsets are turned into code points for what is found.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagewright.llm.common import as_bytes, sample_texts, small

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
#: What one of ASSIGN's keywords always holds, in lower case.
ASSIGN_HINTS = (b"passw", b"secret", b"token", b"api")

TOKEN_LENGTH = 20
TOKEN = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % TOKEN_LENGTH)
SEPARATORS = b"/_=-"
PART = re.compile(rb"[A-Za-z0-9+]+")
SAMPLE_DOCS = 1_000
SAMPLE_STRINGS = 20_000
#: The share of ordinary strings that repeat one character.
RULES = 0.1
SEED = 7

_ALPHABET = (string.ascii_letters + string.digits + "+/_=-").encode()
_START, _STATES = len(_ALPHABET), len(_ALPHABET) + 1
_CODE = np.full(256, -1, np.int64)
_CODE[np.frombuffer(_ALPHABET, np.uint8)] = np.arange(len(_ALPHABET))


def _mark(wanted: bytes) -> bytes:
    return bytes(ord("x") if x in wanted else ord(" ") for x in range(256))


_HEX_MARK, _TOKEN_MARK = _mark(b"0123456789abcdef"), _mark(_ALPHABET)


class Model(NamedTuple):
    ratio: np.ndarray
    threshold: float


def transitions(strings: list[bytes]) -> np.ndarray:
    """Log probabilities of each character after each other one, with one added to each count."""
    counts = np.ones((_STATES, _STATES))
    for s in strings:
        codes = _CODE[np.frombuffer(s, np.uint8)]
        np.add.at(counts, (np.r_[_START, codes[:-1]], codes), 1)
    return np.log(counts / counts.sum(1, keepdims=True))


def score(ratio: np.ndarray, token: bytes) -> float:
    codes = _CODE[np.frombuffer(token, np.uint8)]
    return float(ratio[np.r_[_START, codes[:-1]], codes].mean())


def random_strings(n: int, rng: random.Random) -> list[bytes]:
    """Labelled 1: hexadecimal, base-32, base-62 and base-64 keys of usual lengths."""
    kinds = ("0123456789abcdef", string.ascii_uppercase + "234567", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_")
    return ["".join(rng.choices(rng.choice(kinds), k=rng.randint(TOKEN_LENGTH, 64))).encode() for _ in range(n)]


def identifiers(words: list[str], n: int, rng: random.Random) -> list[bytes]:
    """Labelled 0: words one after the other, as in names, paths and run-together writing, and rules of one character."""
    found = []
    while len(found) < n and words:
        picked, style = [rng.choice(words) for _ in range(rng.randint(2, 6))], rng.randrange(6)
        if style == 0:
            text = "_".join(picked).lower()
        elif style == 1:
            text = "-".join(picked)
        elif style == 2:
            text = picked[0].lower() + "".join(w.capitalize() for w in picked[1:])
        elif style == 3:
            text = "/".join(picked)
        elif style == 4:
            text = "_".join(picked).upper()
        else:
            text = "".join(picked).lower()
        if rng.random() < 0.15:
            text += f"_{rng.randint(1, 2030)}"
        if rng.random() < RULES:
            text = chr(rng.choice(_ALPHABET)) * rng.randint(TOKEN_LENGTH, 80)
        found.append(text.encode())
    return found


#: Fixed words of program text, so that the ordinary model knows names even where no document has any.
PROGRAM_WORDS = "get set user name value config client server request response index count page list item string number error default option handle create update delete file path data table column result message event type time date version build test main class object method return import model layer train".split()


def fit(texts: list[str], n: int = SAMPLE_STRINGS, seed: int = SEED) -> Model:
    """The model from labelled samples; `texts` give ordinary words."""
    rng = random.Random(seed)
    words = [w for t in texts for w in re.findall(r"[A-Za-z]{2,}", t)]
    known = sorted({*words, *PROGRAM_WORDS})
    held = set(rng.sample(known, len(known) // 5))
    fitted, unseen = ([w for w in (words or known) if (w in held) == kept] + [w for w in PROGRAM_WORDS if (w in held) == kept] * 20 for kept in (False, True))
    cut = n * 4 // 5
    keys, names, others = random_strings(n, rng), identifiers(fitted, cut, rng), identifiers(unseen, n - cut, rng)
    ratio = transitions(keys[:cut]) - transitions(names)
    labelled = sorted([(score(ratio, s), 1) for s in keys[cut:]] + [(score(ratio, s), 0) for s in others])
    wrong = best = sum(1 for _, y in labelled if not y) * 20  # an ordinary string reported costs as much as 20 missed
    threshold = labelled[0][0] - 1
    for (value, y), (following, _) in zip(labelled, [*labelled[1:], (labelled[-1][0] + 1, 1)]):
        wrong += 1 if y else -20
        if wrong < best:
            best, threshold = wrong, (value + following) / 2
    return Model(ratio, threshold)


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of what the fixed patterns find, each kind without overlaps."""
    found = []
    lower = text.lower()
    if any(hint in lower for hint in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if b"x" * 32 in text.translate(_HEX_MARK):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def random_stretches(model: Model, token: bytes) -> list[tuple[int, int]]:
    """Where a token looks random: all of it, or else the runs of its parts (between separators) whose sum
    of ratios less the threshold is the most, so that a path in front of a key doesn't hide it."""
    codes = _CODE[np.frombuffer(token, np.uint8)]
    excess = model.ratio[np.r_[_START, codes[:-1]], codes] - model.threshold
    if excess.mean() > 0:
        return [(0, len(token))]
    total = np.r_[0.0, np.cumsum(excess)]
    found, best, held, begin, last = [], None, -np.inf, 0, 0
    for a, b in (m.span() for m in PART.finditer(token)):
        longer = held + total[b] - total[last]
        alone = model.ratio[_START, codes[a]] - model.threshold + total[b] - total[a + 1]
        if longer < alone:
            found += [best] if best else []
            best, begin = None, a
        held, last = max(longer, alone), b
        if held > 0 and b - begin >= TOKEN_LENGTH and (best is None or held > best[2]):
            best = (begin, b, held)
    return [x[:2] for x in [*found, *([best] if best else [])]]


def outside(start: int, end: int, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """What base spans (by start) leave of a token."""
    for s, _, e in base:
        if s < end and start < e:
            yield start, s
            start = max(start, e)
    yield start, end


def markov_spans(text: bytes, model: Model, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Stretches of long tokens that the model takes for random, where no base span lies."""
    if b"x" * TOKEN_LENGTH not in text.translate(_TOKEN_MARK):
        return []
    found = []
    for m in TOKEN.finditer(text):
        for a, b in outside(m.start(), m.end(), base):
            if a > m.start():
                a = b - len(text[a:b].lstrip(SEPARATORS))
            if b - a >= TOKEN_LENGTH:
                found += [(a + x, 3, a + y) for x, y in random_stretches(model, text[a:b])]
    return found


def written(spans: list[tuple[int, int, int]], text: bytes) -> str:
    if not spans:
        return ""
    if not text.isascii():
        spans = [(len(text[:a].decode()), kind, len(text[:b].decode())) for a, kind, b in spans]
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_spans string, spans string"


def scan_batches(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        rows = []
        for text in as_bytes(batch, "text"):
            base = base_spans(text)
            every = sorted(base + markov_spans(text, model, base))
            n = [sum(k == kind for _, k, _ in every) for kind in range(len(KINDS))] if every else [0] * len(KINDS)
            rows.append((*n, written(base, text), written(every, text)))
        columns = list(zip(*rows)) or [()] * 6
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds))], [x.split()[0] for x in SCHEMA.split(", ")])


def secret_scan(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, model: Model | None = None) -> DataFrame:
    """Per row of `docs` (doc_id, text, any others): SCHEMA. Spans are kind:start:end in code points,
    end exclusive, by start and then in the order of KINDS, joined by commas.

    Null and empty texts have no spans. Repeated rows are scanned each. Without documents the
    ordinary model rests on PROGRAM_WORDS alone.
    """
    if model is None:
        model = fit(sample_texts(docs, sample_docs))
    return docs.select("doc_id", "text").mapInArrow(lambda batches: scan_batches(batches, model), SCHEMA)


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
