"""The relations that are derived from others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators import project, resolve

PROPERTIES = ("type", "status", "owner", "session")
RESOLVED = ("link", "frontmatter_link", "lock")


def spelled(parsed: DataFrame, name: str) -> DataFrame:
    """A relation of RESOLVED with the page it stands on (src_path) and what it names (target_raw)."""
    rows = project.relation(parsed, name).withColumnRenamed("path", "src_path")
    if name == "link":
        return rows
    return rows.withColumn("target_raw", F.substring_index("target_raw", "#", 1) if name == "frontmatter_link" else F.substring_index("object", "|", 1))


class Workspace:
    """The relations of parsed pages. Those with destinations are read from `resolved` where it holds them
    (the projection stores them at its build); else each is a plan, computed when used."""

    def __init__(self, parsed: DataFrame, resolved: dict[str, DataFrame] | None = None):
        self.parsed, self.resolved = parsed, resolved or {}
        self.paths = parsed.select("path")
        self.aliases = parsed.select("path", F.explode("alias").alias("alias"))

    def destinations(self) -> dict[str, DataFrame]:
        """The relations that hold destinations, from one list of pages and aliases."""
        return {name: getattr(self, f"_{name}")() for name in RESOLVED}

    def __getattr__(self, name: str) -> DataFrame:
        if name in RESOLVED:
            return self.resolved[name] if name in self.resolved else getattr(self, f"_{name}")()
        if name in project.RELATIONS:
            return project.relation(self.parsed, name)
        raise AttributeError(name)

    @property
    def doc(self) -> DataFrame:
        return project.doc(self.parsed)

    def _link(self) -> DataFrame:
        return resolve.resolve(spelled(self.parsed, "link"), self.paths, self.aliases).withColumn("resolved", F.col("dest_path").isNotNull())

    def _frontmatter_link(self) -> DataFrame:
        return resolve.resolve(spelled(self.parsed, "frontmatter_link"), self.paths, self.aliases)

    def _lock(self) -> DataFrame:
        return resolve.resolve(spelled(self.parsed, "lock"), self.paths, self.aliases).drop("target_raw")


def backlink(link: DataFrame, frontmatter_link: DataFrame) -> DataFrame:
    """(path, src_path, kind, alias, key): who links to a page, from its text or its head."""
    body = link.where("dest_path IS NOT NULL").select(F.col("dest_path").alias("path"), "src_path", "kind", "alias", F.lit(None).cast("string").alias("key"))
    head = frontmatter_link.where("dest_path IS NOT NULL").select(F.col("dest_path").alias("path"), "src_path", F.lit("frontmatter").alias("kind"), F.lit(None).cast("string").alias("alias"), "key")
    return body.unionByName(head)


def dangling(link: DataFrame) -> DataFrame:
    """Links to pages that aren't there, other roots apart."""
    return link.where("kind IN ('wikilink', 'embed') AND dest_path IS NULL AND dest_root IS NULL").select("src_path", "target_raw")


def referrers(lock: DataFrame) -> DataFrame:
    """(path, src_path, seq, arm, selector): the pins that name a page."""
    return lock.where("dest_path IS NOT NULL").select(F.col("dest_path").alias("path"), "src_path", "seq", "arm", "selector")


def base_embeds(excluded: DataFrame, base: DataFrame) -> DataFrame:
    """(path, src_path, seq): links that were left out because they name a base file; excluded as resolve.exclusions gives it."""
    return excluded.join(base.select(F.col("path").alias("exclusion_path")), "exclusion_path").select(F.col("exclusion_path").alias("path"), "src_path", "seq")


def record(doc: DataFrame, frontmatter: DataFrame) -> DataFrame:
    """One row per page: the usual properties as columns."""
    wide = frontmatter.where(F.col("key").isin(*PROPERTIES)).groupBy("path").agg(*[F.max(F.when(F.col("key") == p, F.col("value"))).alias(p) for p in PROPERTIES])
    return doc.select("path").join(wide, "path", "left")


def tag_all(tag: DataFrame | None, frontmatter_tag: DataFrame) -> DataFrame:
    """Tags of text and head, with where they stand."""
    head = frontmatter_tag.select("path", "tag", F.lit("frontmatter").alias("source"), "span_start", "span_end", "node_rev")
    return head if tag is None else tag.select("path", "tag", F.lit("inline").alias("source"), "span_start", "span_end", "node_rev").unionByName(head)


def board(pins: DataFrame) -> DataFrame:
    """Coloured pins; pins is (src_path, seq, tone, reason, ...)."""
    return pins.where("tone IS NOT NULL").withColumn("reason", F.coalesce("reason", F.lit("")))


def board_red(pins: DataFrame) -> DataFrame:
    return pins.where("tone = 'red'")


def board_residue(pins: DataFrame) -> DataFrame:
    return pins.where("tone IS NULL")


def stale_paths(projected: DataFrame, live: DataFrame) -> DataFrame:
    """Paths whose revision differs between two (path, file_rev) tables, or that only one has."""
    a, b = projected.select("path", F.col("file_rev").alias("rev_a")), live.select("path", F.col("file_rev").alias("rev_b"))
    return a.join(b, "path", "full_outer").where("NOT (rev_a <=> rev_b)").select("path")
