"""BLAKE3 over many messages at once, one numpy lane per chunk (from the published specification)."""

from __future__ import annotations

import numpy as np

# Fixed values of the specification.
IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK, BLOCK = 1024, 64
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8

_QUARTERS = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))
_LANES = 16_384


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _compress(values: np.ndarray, words: np.ndarray, counters: np.ndarray, lengths: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The next chaining values; every argument has one row per lane."""
    v = [values[:, i].copy() for i in range(8)] + [np.full(len(values), x, np.uint32) for x in IV[:4]]
    v += [(counters & 0xFFFFFFFF).astype(np.uint32), (counters >> 32).astype(np.uint32), lengths.astype(np.uint32), flags.astype(np.uint32)]
    order = list(range(16))
    for turn in range(7):
        for i, (a, b, c, d) in enumerate(_QUARTERS):
            for word, (first, second) in ((order[2 * i], (16, 12)), (order[2 * i + 1], (8, 7))):
                v[a] = v[a] + v[b] + words[:, word]
                v[d] = _rotated(v[d] ^ v[a], first)
                v[c] = v[c] + v[d]
                v[b] = _rotated(v[b] ^ v[c], second)
        order = [order[i] for i in PERMUTATION]
    return np.stack([v[i] ^ v[i + 8] for i in range(8)], 1)


def _chunk_values(messages: list[bytes], first: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Chaining values of all chunks, and the chunks of each message; a lone chunk is its message's root.

    With `first`, messages are parts of longer ones: each begins at that chunk, and none is a root.
    """
    sizes = np.array([len(m) for m in messages], np.int64)
    counts = np.maximum(1, -(-sizes // CHUNK))
    data = np.frombuffer(b"".join(m.ljust(int(n) * CHUNK, b"\0") for m, n in zip(messages, counts)), np.uint8)
    words = data.view("<u4").reshape(-1, CHUNK // BLOCK, BLOCK // 4)
    number = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    held = np.clip(np.repeat(sizes, counts) - number * CHUNK, 0, CHUNK)
    blocks = np.maximum(1, -(-held // BLOCK))
    alone = np.repeat((counts == 1) & (first is None), counts)
    counters = number if first is None else number + np.repeat(np.array(first, np.int64), counts)
    values = np.tile(IV, (len(words), 1))
    for block in range(int(blocks.max())):
        lanes = np.flatnonzero(blocks > block)
        last = blocks[lanes] == block + 1
        flags = (CHUNK_START if block == 0 else 0) | np.where(last, CHUNK_END, 0) | np.where(last & alone[lanes], ROOT, 0)
        lengths = np.minimum(BLOCK, held[lanes] - block * BLOCK)
        values[lanes] = _compress(values[lanes], words[lanes, block], counters[lanes], lengths, flags)
    return values, counts


def _folded(values: np.ndarray, counts: np.ndarray, roots: bool = True) -> list[bytes]:
    """Neighbours merged until each message has one value."""
    while (counts > 1).any():
        starts = np.cumsum(counts) - counts
        place = np.arange(len(values)) - np.repeat(starts, counts)
        size = np.repeat(counts, counts)
        left = np.flatnonzero((place % 2 == 0) & (place + 1 < size))
        flags = PARENT | np.where((size[left] == 2) & roots, ROOT, 0)
        merged = _compress(np.tile(IV, (len(left), 1)), np.concatenate([values[left], values[left + 1]], 1), np.zeros(len(left), np.int64), np.full(len(left), BLOCK), flags)
        values = values.copy()
        values[left] = merged
        values = values[place % 2 == 0]
        counts = (counts + 1) // 2
    return [row.tobytes() for row in values.astype("<u4")]


def digests(messages: list[bytes], first: list[int] | None = None) -> list[bytes]:
    """The 32-byte digest of each message.

    With `first`, the value of each part of a longer message instead; a part begins at that chunk, a multiple
    of the power of two that its length in chunks stays within.
    """
    out: list[bytes] = []
    at = 0
    while at < len(messages):
        end, lanes = at, 0
        while end < len(messages) and (end == at or lanes < _LANES):
            lanes += len(messages[end]) // CHUNK + 1
            end += 1
        out += _folded(*_chunk_values(messages[at:end], first and first[at:end]), first is None)
        at = end
    return out


def joined(parts: list[bytes]) -> bytes:
    """The digest of a message from the values of its parts, of which there are several."""
    return _folded(np.frombuffer(b"".join(parts), "<u4").reshape(-1, 8).astype(np.uint32), np.array([len(parts)]))[0]


def hex_digest(message: bytes) -> str:
    return digests([message])[0].hex()


def revs(spans: list[bytes]) -> list[str]:
    """Revisions of spans: the first 16 hex digits of their digests."""
    return [d.hex()[:16] for d in digests(spans)]
