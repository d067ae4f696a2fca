"""What changed between two states of the corpus, by file and by section."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.functions import linediff, markdown

FRAME_FILES = 128


def file_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change, rev_before, rev_after) of two (path, file_rev) states: created, modified, deleted."""
    a, b = before.select("path", F.col("file_rev").alias("rev_before")), after.select("path", F.col("file_rev").alias("rev_after"))
    change = F.when(F.col("rev_before").isNull(), "created").when(F.col("rev_after").isNull(), "deleted").when(F.col("rev_before") != F.col("rev_after"), "modified")
    return a.join(b, "path", "full_outer").withColumn("change", change).where("change IS NOT NULL").select("path", "change", "rev_before", "rev_after")


def ruled_delta(delta: DataFrame, still_on_disk: DataFrame | None = None) -> DataFrame:
    """file_delta() with renames and re-scoped files named.

    One page gone, one page come and equal bytes are a rename, only where nothing else came or went. A page
    that left the corpus but is still on disk (path) is unattested instead of deleted.
    """
    if still_on_disk is not None:
        there = still_on_disk.select("path", F.lit(True).alias("there")).distinct()
        delta = delta.join(there, "path", "left").withColumn("change", F.when((F.col("change") == "deleted") & F.col("there"), "unattested").otherwise(F.col("change"))).drop("there")
    come, gone = F.col("change") == "created", F.col("change") == "deleted"
    whole = delta.agg(
        F.count_if(come).alias("n_come"), F.count_if(gone).alias("n_gone"), F.count_if(F.col("change") == "unattested").alias("n_left"),
        F.max(F.when(come, F.col("path"))).alias("to_path"), F.max(F.when(gone, F.col("path"))).alias("from_path"), F.max(F.when(come, F.col("rev_after"))).alias("to_rev"), F.max(F.when(gone, F.col("rev_before"))).alias("from_rev"),
    ).where("n_come = 1 AND n_gone = 1 AND n_left = 0 AND to_rev = from_rev")
    both = delta.join(F.broadcast(whole), F.lit(True), "left")
    return both.where("from_path IS NULL OR path <> from_path").select("path", F.when(F.col("path") == F.col("to_path"), "renamed").otherwise(F.col("change")).alias("change"), F.when(F.col("path") == F.col("to_path"), F.col("from_path")).alias("from_path"), F.coalesce(F.when(F.col("path") == F.col("to_path"), F.col("from_rev")), "rev_before").alias("rev_before"), "rev_after")


def framed(delta: DataFrame, seq: int, root_before: str, root_after: str, most: int = FRAME_FILES) -> DataFrame:
    """One frame: its first `most` files by path, and how many it leaves out."""
    files = delta.orderBy("path").limit(most).agg(F.sort_array(F.collect_list(F.struct("path", "change"))).alias("files"))
    counted = delta.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("dropped"))
    return files.join(F.broadcast(counted)).select(F.lit(seq).cast("long").alias("seq"), F.lit(root_before).alias("root_before"), F.lit(root_after).alias("root_after"), "files", "dropped")


def node_changes(before: bytes, after: bytes) -> list[tuple[str, str, str]]:
    """(change, kind, hpath) of the deepest section around each changed run of lines: added, edited, anchored, removed."""
    old, new = before.decode("utf-8", "replace").splitlines(True), after.decode("utf-8", "replace").splitlines(True)
    old_nodes, new_nodes = markdown.parse(before), markdown.parse(after)
    old_sections, new_sections = markdown.sections(before, old_nodes), markdown.sections(after, new_nodes)
    had, has = {s.hpath for s in old_sections}, {s.hpath for s in new_sections}
    found: dict[tuple[str, str], str] = {}
    for a, b, c, d in linediff.regions(old, new):
        start, end = sum(len(x.encode()) for x in new[:c]), sum(len(x.encode()) for x in new[:d])
        left, right = sum(len(x.encode()) for x in old[:a]), sum(len(x.encode()) for x in old[:b])
        marked = markdown.kept_bytes(after, start, end, markdown.without_anchors(after, new_nodes)) == markdown.kept_bytes(before, left, right, markdown.without_anchors(before, old_nodes))
        removed = [s.hpath for s in old_sections if left <= s.start < right and s.hpath not in has]
        added = [s.hpath for s in new_sections if start <= s.start < end and s.hpath not in had]
        for hpath in removed:
            found["section", hpath] = "removed"
        for hpath in added:
            found["section", hpath] = "added"
        if not removed and not added:
            held = markdown.governing(new_sections, min(start, max(0, len(after) - 1)))
            key = ("section", held.hpath) if held else ("frontmatter", "") if start < markdown.head_end(after) else ("document", "")
            found[key] = "anchored" if marked and found.get(key, "anchored") == "anchored" else "edited"
    return sorted((change, kind, hpath) for (kind, hpath), change in found.items())


def node_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change, kind, hpath) of pages (path, raw) that both states have with different bytes."""
    pairs = before.select("path", F.col("raw").cast("binary").alias("before")).join(after.select("path", F.col("raw").cast("binary").alias("after")), "path").where("before <> after")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *c) for p, a, b in zip(*(batch.column(i).to_pylist() for i in range(3))) for c in node_changes(a, b)]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["path", "change", "kind", "hpath"])

    return pairs.mapInArrow(compare, "path string, change string, kind string, hpath string")


def property_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, key, value_before, value_after) of two property tables, where they differ."""
    a, b = before.select("path", "key", F.col("value").alias("value_before")), after.select("path", "key", F.col("value").alias("value_after"))
    return a.join(b, ["path", "key"], "full_outer").where("NOT (value_before <=> value_after)")


def section_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, hpath, change) of two section tables, by their revisions."""
    a, b = before.select("path", "hpath", F.col("node_rev").alias("a")), after.select("path", "hpath", F.col("node_rev").alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "edited")
    return a.join(b, ["path", "hpath"], "full_outer").select("path", "hpath", change.alias("change")).where("change IS NOT NULL")


def replayed(log: DataFrame, root_from: str, root_to: str) -> DataFrame:
    """Frames (seq, root_before, root_after, ...) that lead from one root to the other; none where the chain breaks."""
    first = log.where(F.col("root_before") == root_from).agg(F.max("seq")).first()[0]
    last = log.where(F.col("root_after") == root_to).agg(F.max("seq")).first()[0]
    if root_from == root_to or first is None or last is None or first > last:
        return log.where(F.lit(False))
    held = log.where(F.col("seq").between(first, last))
    joined = held.withColumn("linked", F.coalesce(F.lag("root_after").over(W.orderBy("seq")) == F.col("root_before"), F.lit(True)))
    return held if joined.where("NOT linked").isEmpty() else held.where(F.lit(False))
