"""The pin graph: walks along edges, cycles, and the colour of each pin."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.sources import scratch

#: Tone and reason of a pin, the first that applies.
TONES = ("lock-refused", "unmounted", "file-not-found", "outside-domain", "malformed-fingerprint", "unverifiable-fingerprint", "ambiguous", "selector-unresolved", "drifted", "green")


def walk(edges: DataFrame, start: DataFrame, depth: int | None, up: bool = False) -> DataFrame:
    """(node, depth): what is reached from `start` (node) in at most `depth` steps (any number if None), each at its least depth.

    One join per step against the frontier; a node that was seen is never expanded again.
    """
    here, there = ("dst", "src") if up else ("src", "dst")
    steps = edges.select(F.col(here).alias("node"), F.col(there).alias("next")).distinct()
    frontier = scratch.written(start.select("node", F.lit(0).alias("depth")).distinct(), "walk")
    seen = frontier
    for level in count(1) if depth is None else range(1, depth + 1):
        reached = steps.join(frontier.select("node"), "node").select(F.col("next").alias("node")).distinct()
        frontier = scratch.written(reached.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(level)), "walk")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def trimmed(edges: DataFrame) -> DataFrame:
    """The edges (src, dst) that are left when nodes without one in or one out are taken off until none is."""
    left = scratch.written(edges.select("src", "dst").distinct(), "cycle")
    while True:
        kept = left.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        kept = scratch.written(kept.select("src", "dst"), "cycle")
        if kept.count() == left.count():
            return kept
        left = kept


def loops(edges: DataFrame) -> DataFrame:
    """(node, loop): nodes that lie on a cycle, and the largest node that they and each other reach.

    Nodes pass the largest name that reaches them along until none changes; a name's own node and what
    reaches it under that name are a strongly connected component. Those come off, and the rest goes round
    again. Nodes between cycles are components of their own and are left out, as they have no edge inside.
    """
    left, found = trimmed(edges), []
    while not left.isEmpty():
        names = scratch.written(left.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("loop", F.col("node")).withColumn("moved", F.lit(True)), "loop-names")
        while not (sending := names.where("moved")).isEmpty():
            sent = left.join(sending.select(F.col("node").alias("src"), "loop"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("loop").alias("sent"))
            further = F.coalesce(F.col("sent") > F.col("loop"), F.lit(False))
            names = scratch.written(names.join(sent, "node", "left").select("node", F.greatest("loop", "sent").alias("loop"), further.alias("moved")), "loop-names")
        names = names.drop("moved")
        ends = names.select(F.col("node").alias("src"), "loop"), names.select(F.col("node").alias("dst"), F.col("loop").alias("other"))
        inside = scratch.written(left.join(ends[0], "src").join(ends[1], "dst").where("loop = other").select("src", "dst", "loop"), "loop-edges")
        members = scratch.written(walk(inside, names.where("node = loop"), None, up=True).select("node"), "loop-members")
        ins, outs = members.withColumnRenamed("node", "dst"), members.withColumnRenamed("node", "src")
        found.append(inside.join(ins, "dst", "left_semi").join(outs, "src", "left_semi").select(F.col("src").alias("node"), "loop").distinct())
        left = trimmed(left.join(ins, "dst", "left_anti").join(outs, "src", "left_anti"))
    return reduce(DataFrame.unionByName, found, edges.select(F.col("src").alias("node"), F.col("src").alias("loop")).limit(0))


def cyclic(edges: DataFrame) -> DataFrame:
    """(node): nodes that lie on a cycle.

    Nodes that link themselves or each other do. Any other needs a way in from and a way out to such nodes or
    others like it; only where some are left, loops() has to tell.
    """
    edges = scratch.written(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL"), "cycle-edges")
    pairs = edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.bool_or(F.col("src") <= F.col("dst")).alias("there"), F.bool_or(F.col("src") >= F.col("dst")).alias("back"))
    sure = scratch.written(pairs.where("there AND back").select(F.explode(F.array("a", "b")).alias("node")).distinct(), "cycle-sure")
    ends = {end: F.col(end).alias("node") for end in ("src", "dst")}
    left = edges.select(ends["src"]).distinct().join(sure, "node", "left_anti")
    left = scratch.written(left.join(edges.select(ends["dst"]), "node", "left_semi"), "cycle-left")
    near = {end: scratch.written(edges.withColumn("node", F.col(end)).join(left, "node", "left_semi").drop("node"), "cycle-near") for end in ends}
    while not left.isEmpty():
        good = sure.unionByName(left)
        out = near["src"].join(good.withColumnRenamed("node", "dst"), "dst", "left_semi").select(ends["src"])
        into = near["dst"].join(good.withColumnRenamed("node", "src"), "src", "left_semi").select(ends["dst"])
        kept = scratch.written(left.join(out, "node", "left_semi").join(into, "node", "left_semi"), "cycle-left")
        if kept.count() == left.count():
            return loops(edges).select("node")
        left = kept
    return sure


def coloured(pins: DataFrame) -> DataFrame:
    """pins with tone and reason.

    pins: refused (text or null), dest_root, dest_path, on_disk, in_domain, token (class of the
    fingerprint), found (spans that the selector names), fingerprint, current (of the span as it is).
    """
    reason = (
        F.when(F.col("refused").isNotNull(), TONES[0])
        .when(F.col("dest_root").isNotNull(), TONES[1])
        .when(F.col("dest_path").isNull() & ~F.col("on_disk"), TONES[2])
        .when(F.col("dest_path").isNull() | ~F.col("in_domain"), TONES[3])
        .when(F.col("token") == "malformed", TONES[4])
        .when(F.col("token") == "unverifiable", TONES[5])
        .when(F.col("found") > 1, TONES[6])
        .when(F.col("found") == 0, TONES[7])
        .when(F.col("fingerprint") != F.col("current"), TONES[8])
        .otherwise(TONES[9])
    )
    tone = F.when(F.col("reason").isin(TONES[2], TONES[7], TONES[8]), "red").when(F.col("reason") == TONES[9], "green").otherwise("grey")
    return pins.withColumn("reason", reason).withColumn("tone", tone)


def rollup(coloured_pins: DataFrame) -> DataFrame:
    """Pins by tone, and the worst tone, in one row."""
    counts = coloured_pins.agg(*[F.count_if(F.col("tone") == t).alias(t) for t in ("red", "grey", "green")])
    return counts.withColumn("worst", F.when(F.col("red") > 0, "red").when(F.col("grey") > 0, "grey").otherwise("green"))


def orphaned_runs(anchors: DataFrame) -> DataFrame:
    """(run): anchors p-run-X without an anchor r-run-X; anchors: (id)."""
    begun = anchors.where(F.col("id").startswith("p-run-")).select(F.substring_index("id", "p-run-", -1).alias("run")).distinct()
    ended = anchors.where(F.col("id").startswith("r-run-")).select(F.substring_index("id", "r-run-", -1).alias("run"))
    return begun.join(ended, "run", "left_anti")


def nearest(asked: DataFrame, offered: DataFrame, most: int = 3) -> DataFrame:
    """(path, text, near): for a heading that isn't there, the page's headings that share most letter pairs."""
    pairs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(F.lower(c), i, F.lit(2))))
    both = asked.select("path", "text", pairs(F.col("text")).alias("a")).join(offered.select("path", "heading", pairs(F.col("heading")).alias("b")), "path")
    scored = both.withColumn("score", 2 * F.size(F.array_intersect("a", "b")) / (F.size("a") + F.size("b"))).where("score > 0")
    ranked = scored.groupBy("path", "text").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("score"), "heading"))), 1, most).alias("near"))
    return ranked.select("path", "text", F.transform("near", lambda x: x["heading"]).alias("near"))
