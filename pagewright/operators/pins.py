"""Pins: what each one names on its page as it is now, and the colour that follows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import frontmatter as fm
from pagewright.functions import lock, markdown
from pagewright.operators import graph


def spans(raw: bytes, nodes: list[markdown.Node], selector: list[str]) -> list[tuple[int, int]]:
    """What a path selector names: the page without one, a block (^id), else a chain of headings."""
    if not selector:
        return [(0, len(raw))]
    if selector[0].startswith("^"):
        from pagewright.operators.project import anchor_host

        return [anchor_host(raw, nodes, n, markdown.head_end(raw)) for n in nodes if n.kind == "anchor" and n.text == selector[0][1:]]
    found = markdown.sections(raw, nodes)
    held: list[int | None] = [None]
    for heading in selector:
        held = [s.seq for s in found if s.heading == heading and s.parent in held]
    return [(found[i].start, found[i].end) for i in held]


def current(raw: bytes, arm: str, selector: list[str]) -> tuple[int, str | None]:
    """How many spans a pin's selector names, and the fingerprint of the only one."""
    if arm == "properties":
        _, _, entries = markdown.page_head(raw)
        return 1, lock.property_fingerprint({e.key: e.value for e in entries}, selector)
    nodes = markdown.parse(raw)
    found = spans(raw, nodes, selector)
    if len(found) != 1:
        return len(found), None
    data = markdown.kept_bytes(raw, *found[0], markdown.without_anchors(raw, nodes))
    return 1, lock.span_fingerprint(data) if data else "empty"


def measured(pins: DataFrame, pages: DataFrame) -> DataFrame:
    """pins (src_path, seq, dest_path, arm, selector, fingerprint, …) with token, found and current.

    A page's text is joined to its pins by path; a page that many pins name goes to several tasks where
    AQE splits it.
    """
    target = pages.select(F.col("path").alias("dest_path"), F.col("raw").cast("binary").alias("target"))
    joined = pins.join(target, "dest_path", "left")
    schema = joined.drop("target").schema.add("token", "string").add("found", "long").add("current", "string")
    names = [f.name for f in schema.fields[:-3]]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("target", "arm", "selector", "fingerprint")))
            found = [(lock.token_class(token or ""), *(current(raw, arm, json.loads(selector or "[]")) if raw is not None else (0, None))) for raw, arm, selector, token in rows]
            added = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + added, [*names, "token", "found", "current"])

    return joined.mapInArrow(measure, schema)


def coloured(pins: DataFrame, faults: DataFrame, pages: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """(src_path, seq, object, dest_path, tone, reason) of all pins, and of pages whose block was refused.

    pins: resolved, with dest_root; faults: (path, error); listing: (path, reason) of files outside the corpus.
    """
    outside = listing.select(F.col("path").alias("object_path"), F.lit(True).alias("on_disk")) if listing is not None else None
    whole = measured(pins, pages).withColumn("refused", F.lit(None).cast("string")).withColumn("object_path", F.substring_index("object", "|", 1))
    whole = whole.join(outside, "object_path", "left") if outside is not None else whole.withColumn("on_disk", F.lit(None).cast("boolean"))
    whole = whole.withColumn("on_disk", F.coalesce("on_disk", F.lit(False)) | F.col("dest_path").isNotNull()).withColumn("in_domain", F.col("dest_path").isNotNull())
    keep = ["src_path", "seq", "object", "dest_path", "tone", "reason"]
    refused = faults.select(F.col("path").alias("src_path"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("object"), F.lit(None).cast("string").alias("dest_path"), F.lit("grey").alias("tone"), F.lit(graph.TONES[0]).alias("reason"))
    return graph.coloured(whole).select(*keep).unionByName(refused)


def minted(asked: DataFrame, sections: DataFrame, anchors: DataFrame, frontmatter: DataFrame) -> DataFrame:
    """asked (path, kind, address) with n, span_start and span_end: an hpath, an anchor or a property key, byte for byte.

    n is how many answer; the span is that of the only one. An hpath with no occurrence numbers names
    every section whose headings are the same.
    """
    bare = lambda c: F.regexp_replace(c, r',"n":\d+', "")
    by_path = sections.select("path", F.lit("hpath").alias("kind"), F.explode(F.array_distinct(F.array("hpath", bare(F.col("hpath"))))).alias("address"), "span_start", "span_end")
    by_anchor = anchors.select("path", F.lit("anchor").alias("kind"), F.col("id").alias("address"), "span_start", "span_end")
    by_key = frontmatter.select("path", F.lit("fm_key").alias("kind"), F.col("key").alias("address"), "span_start", "span_end")
    names = by_path.unionByName(by_anchor).unionByName(by_key)
    found = asked.join(names, ["path", "kind", "address"], "left").groupBy("path", "kind", "address").agg(F.count("span_start").alias("n"), F.min("span_start").alias("span_start"), F.min("span_end").alias("span_end"))
    return found.select("path", "kind", "address", "n", *[F.when(F.col("n") == 1, F.col(c)).alias(c) for c in ("span_start", "span_end")])


def sanitised(heading: Column) -> Column:
    """A heading as an address segment."""
    text = F.translate(F.regexp_replace(heading, r"(?U)^\s+|\s+$", ""), "/ ", "--")
    return F.when(text == "", "untitled").otherwise(text)
