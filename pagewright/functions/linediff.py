"""Regions of lines that differ between two texts, by patience: unique common lines anchor the rest."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from difflib import unified_diff


def _anchors(a: list[str], b: list[str], lo_a: int, hi_a: int, lo_b: int, hi_b: int) -> list[tuple[int, int]]:
    """Pairs of lines that occur once on either side, the longest run of them in order."""
    once_a, once_b = Counter(a[lo_a:hi_a]), Counter(b[lo_b:hi_b])
    at = {line: j for j, line in enumerate(b[lo_b:hi_b], lo_b) if once_b[line] == 1}
    pairs = [(i, at[a[i]]) for i in range(lo_a, hi_a) if once_a[a[i]] == 1 and a[i] in at]
    tails: list[int] = []
    ends: list[int] = []
    previous: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tails, j)
        tails[k : k + 1] = [j]
        ends[k : k + 1] = [n]
        previous.append(ends[k - 1] if k else -1)
    run, n = [], ends[-1] if ends else -1
    while n >= 0:
        run.append(pairs[n])
        n = previous[n]
    return run[::-1]


def regions(before: list[str], after: list[str]) -> list[tuple[int, int, int, int]]:
    """(start, end, start, end): what of `before` was replaced by what of `after`."""
    out: list[tuple[int, int, int, int]] = []
    work = [(0, len(before), 0, len(after))]
    while work:
        lo_a, hi_a, lo_b, hi_b = work.pop()
        while lo_a < hi_a and lo_b < hi_b and before[lo_a] == after[lo_b]:
            lo_a, lo_b = lo_a + 1, lo_b + 1
        while lo_a < hi_a and lo_b < hi_b and before[hi_a - 1] == after[hi_b - 1]:
            hi_a, hi_b = hi_a - 1, hi_b - 1
        if lo_a == hi_a and lo_b == hi_b:
            continue
        run = _anchors(before, after, lo_a, hi_a, lo_b, hi_b) if lo_a < hi_a and lo_b < hi_b else []
        if not run:
            out.append((lo_a, hi_a, lo_b, hi_b))
            continue
        edges = [(lo_a - 1, lo_b - 1), *run, (hi_a, hi_b)]
        work += [(x + 1, i, y + 1, j) for (x, y), (i, j) in zip(edges, edges[1:])]
    return sorted(out)


def hunks(before: str, after: str) -> str:
    """A unified diff of two texts."""
    return "\n".join(unified_diff(before.splitlines(), after.splitlines(), "before", "after", lineterm=""))
