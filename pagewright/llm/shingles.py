"""Shingle sets as sorted arrays of 64-bit hashes, and their hashed bitmaps."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import xxhash

from pagewright.llm.common import SPACES

_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    """Words of several texts, one after the other."""

    hashes: np.ndarray
    owner: np.ndarray  # the number of its text
    line: np.ndarray  # rises with every line and text
    start: np.ndarray  # code points of its text
    end: np.ndarray


_BASE = 0xB5AD4ECEDA1CE2A9
_SEGMENT = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
#: A random number for each byte; A-Z have those of a-z.
_BYTES = np.random.default_rng(11).integers(1, 1 << 64, 256, np.uint64)
_BYTES[0x41:0x5B] = _BYTES[0x61:0x7B]


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2 ** 64, as many as were asked for so far."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.empty(0, np.uint64), np.empty(0, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            factors = np.ones((2, max(n, _SEGMENT)), np.uint64)
            factors[0, 1:], factors[1, 1:] = self.base, pow(self.base, -1, 1 << 64)
            up, down = np.multiply.accumulate(factors, axis=1)
            if n > 4 * _SEGMENT:
                return up, down  # a giant word's aren't kept
            self.up, self.down = up, down
        return self.up[:n], self.down[:n]


_powers = _Powers(_BASE)


def sums_of(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums and factors: (sums[b] - sums[a]) * factors[a] tells what numbers stand from a to b, in order."""
    up, down = _powers(len(numbers) + 1)
    sums = np.zeros(len(numbers) + 1, np.uint64)
    np.cumsum(numbers * up[:-1], out=sums[1:])
    return sums, down


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each stretch of bytes, A-Z taken as a-z; stretches don't overlap."""
    out, at = np.empty(len(start), np.uint64), 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + _SEGMENT, "right")))
        first = int(start[at])
        sums, down = sums_of(_BYTES[data[first : int(end[to - 1])]])
        a, b = start[at:to] - first, end[at:to] - first
        out[at:to] = (sums[b] - sums[a]) * down[a]
        at = to
    return mixed(out)


def words_of(texts: list[bytes]) -> Words:
    """The words of the texts by their hashes, equal but for the case of A-Z."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    edges = np.flatnonzero(np.diff(np.r_[True, _SPACE[data]])).astype(np.int64)
    start, end = edges[0::2], edges[1::2]
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    owner = np.searchsorted(begins, start, "right") - 1
    line = np.cumsum(data == 10)[start] if len(start) else start
    hashes = byte_hashes(data, start, end)
    if (data >= 0x80).any():
        before = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
        start, end, begins = before[start], before[end], before[begins]
    at = begins[owner] if len(owner) else owner
    return Words(hashes, owner, line, start - at, end - at)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The hashes of words that hold no space."""
    sizes = np.array([len(w) for w in words], np.int64)
    end = np.cumsum(sizes)
    return byte_hashes(np.frombuffer(b"".join(words), np.uint8), end - sizes, end)


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of `width` words, of the whole where there are fewer."""
    width = min(width, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        out += words[i : i + len(out)] * _FACTORS[i]
    return mixed(out ^ np.uint64(width))


def shingle_set(words: list[bytes], width: int) -> np.ndarray:
    """The distinct shingles of a text in order of their hashes; none without words."""
    return np.unique(windows(word_hashes(words), width)) if words else np.empty(0, np.uint64)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """shingle_set() of the words of each text."""
    words = words_of(texts)
    edges = np.searchsorted(words.owner, np.arange(len(texts) + 1))
    return [np.unique(windows(words.hashes[a:b], width)) if a < b else np.empty(0, np.uint64) for a, b in zip(edges, edges[1:])]


def set_names(shingles: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit names of the set."""
    name = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return tuple(np.array([name >> 64, name & (1 << 64) - 1], np.uint64).view(np.int64).tolist())


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Bits at hashed places: a power of two of at least two bits a shingle, 64 at least."""
    width = max(64, 1 << int(2 * len(shingles) - 1).bit_length())
    flags = np.zeros(width, np.uint8)
    flags[shingles & np.uint64(width - 1)] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap that the same set has at a smaller width."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())
