"""Links among items that share buckets, and their connected components, without all pairs of a group.

Every item is a set of shingles. Items that may link meet in a bucket. First, each item is compared
with one representative: of the smallest members of its buckets, the one it shares most buckets with.
Components of those links then leave unresolved only the buckets that hold several components. There,
bit counts of hashed bitmaps bound every overlap between two components from above; where the bound
allows a link, the components join one group. A group's sets come together once, and the sorted arrays
of items of different components are compared, again behind the bit counts.

Both steps deal their buckets or groups over tiles: items of the largest component and the others go
to blocks of some TILE items or TILE_SHINGLES shingles, whichever is less, and each two blocks that can
hold a pair of different components make a tile. A task so holds two blocks of a tile, no pair is left
out, and a group of copies that link with their representative costs rows in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.llm.common import materialise, materialise_counted, release, small_side
from pagewright.llm.shingles import bitmap, common, folded

TILE, TILE_SHINGLES = 2_048, 8_000_000
HOT_ROWS = 1_000_000
SAMPLE = 64


class Bound(NamedTuple):
    """Two sets link when 100 * intersection >= percent * union."""

    percent: int

    def least_common(self, a, b):
        """The smallest intersection with which sets of these sizes link."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def links(self, a: int, b: int, shared: int) -> bool:
        return 100 * shared >= self.percent * (a + b - shared)


def may_link(a: np.ndarray, b: np.ndarray, bits_a: np.ndarray, bits_b: np.ndarray, bound: Bound) -> bool:
    """False if the bit counts rule the link out: a bit that only one set has is a shingle that only it has."""
    words = min(len(bits_a), len(bits_b))
    x, y = folded(bits_a, words), folded(bits_b, words)
    most = min(len(a) - int(np.bitwise_count(x & ~y).sum()), len(b) - int(np.bitwise_count(y & ~x).sum()))
    return most >= bound.least_common(len(a), len(b))


def arrays(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def verify_pairs(batches: Iterator[pa.RecordBatch], bound: Bound) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first, second = arrays(batch.column("set_a")), arrays(batch.column("set_b"))
        linked = [may_link(a, b, bitmap(a), bitmap(b), bound) and bound.links(len(a), len(b), common(a, b)) for a, b in zip(first, second)]
        yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))


def compare_tile(table: pa.Table, bound: Bound) -> list[tuple[int, int, int, int]]:
    """(item, item, component, component) of pairs that join components of the tile's items.

    Pairs link exactly where the tile has sets, and may link by their bit counts where it has bits only.
    """
    items, components, blocks, sizes = (table.column(x).to_numpy() for x in ("item", "component", "block", "size"))
    exact = "set" in table.column_names
    sets = arrays(table.column("set")) if exact else []
    bits = [bitmap(s) for s in sets] if exact else arrays(table.column("bits"))
    order = np.argsort(sizes, kind="stable")
    widths = np.array([len(x) for x in bits])
    place_at, maps_at = {}, {}  # by width: the sets that have it or more, folded to it
    for words in np.unique(widths).tolist():
        wide = np.flatnonzero(widths >= words)
        place_at[words] = np.zeros(len(bits), np.int64)
        place_at[words][wide] = np.arange(len(wide))
        maps_at[words] = np.stack([folded(bits[k], words) for k in wide.tolist()])
    split = blocks.min() != blocks.max()
    parent = {c: c for c in components.tolist()}
    apart = len(parent) - 1

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    found: list[tuple[int, int, int, int]] = []
    for place, i in enumerate(order[:-1]):
        later = order[place + 1 :]
        later = later[: np.searchsorted(sizes[later], sizes[i] * 100 // bound.percent, "right")]
        later = later[(components[later] != components[i]) & ((blocks[later] != blocks[i]) if split else True)]
        if not len(later):
            continue
        words = int(widths[i])
        own, others = maps_at[words][place_at[words][i]], maps_at[words][place_at[words][later]]
        most = np.minimum(sizes[later] - np.bitwise_count(others & ~own).sum(1, dtype=np.int64), sizes[i] - np.bitwise_count(own & ~others).sum(1, dtype=np.int64))
        for j in later[most >= bound.least_common(sizes[i], sizes[later])].tolist():
            x, y = root(int(components[i])), root(int(components[j]))
            if x != y and (not exact or bound.links(int(sizes[i]), int(sizes[j]), common(sets[i], sets[j]))):
                parent[max(x, y)] = min(x, y)
                found.append((int(items[i]), int(items[j]), int(components[i]), int(components[j])))
                apart -= 1
                if not apart:
                    return found
    return found


FOUND = "a long, b long, component_a long, component_b long"


def compare_tiles(batches: Iterator[pa.RecordBatch], bound: Bound) -> Iterator[pa.RecordBatch]:
    """compare_tile() for each run of rows of one tile."""
    held: list[pa.RecordBatch] = []

    def compared(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = compare_tile(pa.Table.from_batches(parts).combine_chunks(), bound) if sum(p.num_rows for p in parts) > 1 else []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], [x.split()[0] for x in FOUND.split(", ")])

    for batch in batches:
        tiles = batch.column("tile").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(tiles)) + 1).tolist(), len(tiles)] if len(tiles) else []
        for a, b in zip(edges, edges[1:]):
            if held and held[0].column("tile")[0].as_py() != tiles[a]:
                yield from compared(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield from compared(held)


def members(keyed: DataFrame, name: str) -> DataFrame:
    """Of (item, key) rows, once each, those of buckets with two items or more, with first, the bucket's smallest item.

    One shuffle brings a bucket's rows together. Buckets of some HOT_ROWS rows, found on one item in
    SAMPLE, don't take part: their smallest items come from partial sums and go to the rows instead.
    """
    sampled = keyed.where(F.pmod(F.xxhash64("item"), F.lit(SAMPLE)) == 0).groupBy("key").agg(F.count("*").alias("n"))
    hot = materialise(sampled.where(F.col("n") >= HOT_ROWS // SAMPLE).select("key"), f"{name}-hot")
    n_hot = hot.count()
    ends = (F.min("item").alias("first"), F.max("item").alias("last"))
    rest = keyed if not n_hot else keyed.join(small_side(hot, n_hot), "key", "left_anti")
    dealt_rows = rest.repartition("key")
    shared = dealt_rows.groupBy("key").agg(*ends).where("first < last").select("key", "first")
    met = dealt_rows.join(shared.hint("shuffle_hash"), "key").groupBy("key", "item", "first").agg(F.count("*").alias("n")).drop("n")
    if not n_hot:
        return met
    own = keyed.join(small_side(hot, n_hot), "key", "left_semi")
    firsts = materialise(own.groupBy("key").agg(*ends).where("first < last").select("key", "first"), f"{name}-firsts")
    return met.unionByName(keyed.join(small_side(firsts, n_hot), "key").select("key", "item", "first").distinct())


def components(edges: DataFrame, name: str) -> DataFrame:
    """(item, component) for the ends of `edges` (a, b); a component is named by its smallest item.

    Every item points at its smallest neighbour or itself; the pointers are followed to their ends, the
    edges are drawn between those ends, and so on until none is left between two of them.
    """
    edges, n = materialise_counted(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), f"{name}-edges", F.lit(True))
    labels = edges.select(F.col("a").alias("item")).union(edges.select("b")).distinct().withColumn("component", F.col("item"))
    while n:
        both = edges.select("a", "b").union(edges.select("b", "a"))
        pointers = materialise(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("item"), F.least("a", "b").alias("to")), f"{name}-pointers")
        moved = 1
        while moved:
            ahead = pointers.select(F.col("item").alias("to"), F.col("to").alias("beyond"))
            followed, moved = materialise_counted(pointers.join(ahead, "to").select("item", "to", "beyond"), f"{name}-followed", F.col("to") != F.col("beyond"))
            pointers = followed.select("item", F.col("beyond").alias("to"))
        labels = materialise(relabelled(labels, pointers), f"{name}-labels")
        at_a, at_b = (pointers.select(F.col("item").alias(x), F.col("to").alias(f"to_{x}")) for x in "ab")
        drawn = edges.join(at_a, "a").join(at_b, "b").where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        edges, n = materialise_counted(drawn, f"{name}-edges", F.lit(True))
    return labels


def relabelled(labels: DataFrame, named: DataFrame) -> DataFrame:
    """(item, component) with the components that named (item, to) knows renamed."""
    return labels.join(named.select(F.col("item").alias("component"), "to"), "component", "left").select("item", F.coalesce("to", "component").alias("component"))


def once_each(unresolved: DataFrame) -> DataFrame:
    """Of buckets (key, item, component) with the same items, one."""
    held = unresolved.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("item").cast("decimal(38,0)")).alias("sum"))
    return unresolved.join(held.groupBy("n", "sum").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")


def dealt(rows: DataFrame) -> DataFrame:
    """(tile, block, item, component, size) from (key, item, component, size): blocks of the largest component come last."""
    share = F.sum(F.greatest(F.lit(1 / TILE), F.col("size") / TILE_SHINGLES))
    parts = rows.groupBy("key", "component").agg(F.round(share, 6).alias("n"))
    sizes = parts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("n"))
    blocks = sizes.select("key", F.col("main.component").alias("main"), F.ceil("main.n").cast("int").alias("mains"), F.ceil(F.col("n") - F.col("main.n")).cast("int").alias("rests"))
    is_main, place = F.col("component") == F.col("main"), F.xxhash64("item", F.lit(1))
    block = F.when(is_main, F.col("rests") + F.pmod(place, F.col("mains"))).otherwise(F.pmod(place, F.col("rests"))).cast("int")
    last = F.when(is_main, F.col("rests")).otherwise(F.col("rests") + F.col("mains")) - 1
    placed = rows.join(blocks, "key").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    tile = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    return placed.select(tile.alias("tile"), "block", "item", "component", "size")


def compared(rows: DataFrame, bound: Bound) -> DataFrame:
    """FOUND of the tiles of `rows` (tile, block, item, component, size, and bits or set)."""
    return rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(lambda batches: compare_tiles(batches, bound), FOUND)


def add_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = arrays(batch.column("set"))
        yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array([bitmap(s).tobytes() for s in sets], pa.binary())], ["item", "bits"])


def link_components(keyed: DataFrame, sets_of, bound: Bound, name: str) -> DataFrame:
    """(item, component) of the items that link with another one; keyed: (item, key), whose rows may repeat.

    sets_of(items) gives (item, set: its sorted shingle hashes as bytes) of a frame of items, once each.
    """
    met = materialise(members(keyed, name).select("key", "item", "first"), f"{name}-met")
    sets = materialise(sets_of(met.select("item").distinct()), f"{name}-sets")
    best = W.partitionBy("a").orderBy(F.desc("n"), "b")
    stars = (
        met.where("item <> first").groupBy(F.col("item").alias("a"), F.col("first").alias("b")).agg(F.count("*").alias("n"))
        .withColumn("place", F.row_number().over(best)).where("place = 1").select("a", "b")
    )
    set_a, set_b = (sets.select(F.col("item").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
    verified = stars.join(set_a, "a").join(set_b, "b").mapInArrow(lambda batches: verify_pairs(batches, bound), "a long, b long")
    links = materialise(verified, f"{name}-stars")
    labels = components(links, name)
    labelled = materialise(met.select("key", "item").join(labels, "item", "left").select("key", "item", F.coalesce("component", "item").alias("component")), f"{name}-labelled")
    release(met)
    several = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    unresolved, n = materialise_counted(once_each(labelled.join(several, "key", "left_semi")), f"{name}-unresolved", F.lit(True))
    if not n:
        return labels
    sizes = materialise(sets.select("item", (F.octet_length("set") / 8).cast("long").alias("size")), f"{name}-sizes")
    unresolved = unresolved.join(small_side(sizes, sizes.count()), "item")
    bits = sets.mapInArrow(add_bits, "item long, bits binary")
    allowed = compared(dealt(unresolved).join(bits, "item"), bound).select(F.col("component_a").alias("a"), F.col("component_b").alias("b"))
    groups = components(allowed, f"{name}-groups").select(F.col("item").alias("component"), F.col("component").alias("key"))
    grouped = materialise(unresolved.select("item", "component", "size").distinct().join(groups, "component").select("key", "item", "component", "size"), f"{name}-grouped")
    more = compared(dealt(grouped).join(sets.select("item", "set"), "item"), bound).select(F.col("component_a").alias("a"), F.col("component_b").alias("b"))
    joined = components(more, name)
    alone = joined.join(labels.select(F.col("component").alias("item")).distinct(), "item", "left_anti").select("item", F.col("item").alias("component"))
    return relabelled(labels.unionByName(alone), joined.select("item", F.col("component").alias("to")))
