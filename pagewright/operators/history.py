"""The projection over time: an append-only log by generation, its latest state, and upkeep by what changed.

Every table has a folder per generation. A generation counts once its pin is written, which is last,
so a failed or retried append is never seen and a reader that holds a generation number keeps its view.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.blake3 import digests
from pagewright.operators import merkle, project, resolve, views
from pagewright.sources import scratch, workspace

CHILDREN = ("frontmatter", "section", "frontmatter_tag", "frontmatter_fault", "task", "lock_fault", "anchor")
BASES = ("base_view", "base_formula")


def revisions(pages: DataFrame) -> DataFrame:
    """(path, file_rev, digest) of pages (path, raw): all that tells whether a page changed."""

    def hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [d.hex() for d in digests([x or b"" for x in batch.column("raw").cast(pa.large_binary()).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([d[:16] for d in found]), pa.array(found)], ["path", "file_rev", "digest"])

    return pages.select("path", "raw").mapInArrow(hash_batches, "path string, file_rev string, digest string")


def latest(log: DataFrame, key: str = "path") -> DataFrame:
    """The newest row of each key in a log with gen; one aggregate, no window."""
    rest = [c for c in log.columns if c not in (key, "gen")]
    newest = log.groupBy(key).agg(F.max_by(F.struct(*rest), "gen").alias("row"), F.max("gen").alias("gen"))
    return newest.select(key, "gen", "row.*")


def live(log: DataFrame, key: str = "path") -> DataFrame:
    """latest() without tombstones."""
    return latest(log, key).where("NOT tombstone").drop("tombstone")


def of_live(child: DataFrame, live_docs: DataFrame) -> DataFrame:
    """The child rows that belong to live versions."""
    return child.join(live_docs.select("path", "gen"), ["path", "gen"], "left_semi")


def changes(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change): added, changed, removed of two (path, file_rev) tables."""
    a, b = manifest.select("path", F.col("file_rev").alias("old")), current.select("path", F.col("file_rev").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where("change IS NOT NULL")


def base_changes(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change) as changes() has it; a file that can't be read has no file_rev, and one without equals nothing."""
    a = manifest.select("path", F.col("file_rev").alias("old"), F.lit(True).alias("was"))
    b = current.select("path", F.col("file_rev").alias("new"), F.lit(True).alias("is"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(~F.coalesce(F.col("old") == F.col("new"), F.lit(False)), "changed")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where("change IS NOT NULL")


def moved_names(diff: DataFrame, old_aliases: DataFrame, new_aliases: DataFrame) -> DataFrame:
    """(name): every spelling whose meaning an append can change."""
    moved = diff.where("change <> 'changed'").select(resolve.spelling(F.col("path")).alias("name"))
    bases = moved.select(resolve.last_segment(F.col("name")).alias("name"))
    aliases = old_aliases.unionByName(new_aliases).join(diff, "path", "left_semi").select(F.col("alias").alias("name"))
    return moved.union(bases).union(aliases).distinct()


def affected(links: DataFrame, names: DataFrame, diff: DataFrame) -> DataFrame:
    """(path): unchanged pages with a link (src_path, target_raw) whose spelling or its last part is a moved name."""
    key = resolve.spelling(F.col("target_raw"))
    spelled = links.select(F.col("src_path").alias("path"), F.explode(F.array_distinct(F.array(key, resolve.last_segment(key)))).alias("name"))
    return spelled.join(names, "name", "left_semi").select("path").distinct().join(diff, "path", "left_anti")


class History:
    """The log in one folder.

    With `names_only` it keeps pages, aliases and links (seq, target_raw and destination), and pages are parsed for these alone.
    A row of `doc` has two generations: `parsed`, in which the page was read and its rows appended, and gen, which is
    later where only the destinations of its links were found anew.
    """

    def __init__(self, spark: SparkSession, folder: str, names_only: bool = False):
        self.spark, self.folder, self.names_only = spark, folder, names_only
        self.children, self.resolved = ((), ("link",)) if names_only else (CHILDREN, views.RESOLVED)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _exists(self, name: str) -> bool:
        path = self._path(name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def pins(self) -> list[dict]:
        """The committed generations, oldest first."""
        if not self._exists("pin"):
            return []
        rows = self.spark.read.schema("gen long, fingerprint string, added long, changed long, removed long").parquet(f"{self.folder}/pin").collect()
        return sorted((r.asDict() for r in rows), key=lambda r: r["gen"])

    def generation(self) -> int:
        return max((p["gen"] for p in self.pins()), default=0)

    def table(self, name: str, gen: int | None = None) -> DataFrame | None:
        """A table's rows up to a generation, the latest committed one by default."""
        at = self.generation() if gen is None else gen
        if not at or not self._exists(name):
            return None
        return self.spark.read.option("basePath", f"{self.folder}/{name}").parquet(f"{self.folder}/{name}").where(F.col("gen") <= at).withColumn("gen", F.col("gen").cast("long"))

    def docs(self, gen: int | None = None) -> DataFrame | None:
        log = self.table("doc", gen)
        return None if log is None else live(log)

    def base(self, gen: int | None = None) -> DataFrame | None:
        log = self.table("base", gen)
        return None if log is None else live(log)

    def stamp(self, gen: int | None = None) -> DataFrame | None:
        """(gen, as_of_fingerprint, doc_count) of a generation, in one row."""
        pins = [p for p in self.pins() if gen is None or p["gen"] <= gen]
        if not pins:
            return None
        return self.docs(gen).agg(F.lit(pins[-1]["gen"]).alias("gen"), F.lit(pins[-1]["fingerprint"]).alias("as_of_fingerprint"), F.count("*").alias("doc_count"))

    def relation(self, name: str, gen: int | None = None) -> DataFrame | None:
        """The live rows of a child table; body rows with their text."""
        rows, docs = self.table(name, gen), self.base(gen) if name in BASES else self.docs(gen)
        if rows is None or docs is None:
            return None
        if name not in (*BASES, *views.RESOLVED):
            docs = docs.select("path", F.col("parsed").alias("gen"))
        kept = of_live(rows, docs).drop("gen")
        return kept if name != "body" else kept.join(self.table("body_text", gen).select("body_key", "text"), "body_key").drop("body_key")

    def _append(self, name: str, rows: DataFrame, gen: int) -> None:
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/{name}/gen={gen}")

    def sync(self, pages: DataFrame, bases: DataFrame | None = None) -> dict | None:
        """Bring the log to the state of `pages` and base files (path, raw); None if nothing changed.

        Only pages that are new or changed are parsed. Of those that link to or pin a name that moved, the links are
        taken from the log and resolved again. Without `bases` nothing is said about base files, and those of the log stay.
        """
        before, gen = self.docs(), self.generation() + 1
        manifest = before.select("path", "file_rev") if before is not None else None
        current = scratch.written(project.parse_changed(pages, manifest, self.names_only), "current")
        fingerprint = merkle.root(current, stored=True)
        base_diff = self._base_diff(bases) if bases is not None else None
        if before is not None and self.pins()[-1]["fingerprint"] == fingerprint and (base_diff is None or base_diff.isEmpty()):
            return None
        diff, parsed = current.where("change IS NOT NULL").select("path", "change"), current.where("change IS NOT NULL")
        aliases = parsed.select("path", F.explode("alias").alias("alias"))
        again = None
        if before is not None:
            removed = manifest.join(current, "path", "left_anti").select("path", F.lit("removed").alias("change"))
            diff = scratch.written(diff.union(removed), "diff")
            old_aliases = self.relation("alias")
            spelled = reduce(DataFrame.union, (self.relation(n).select("src_path", "target_raw") for n in self.resolved))
            again = scratch.written(affected(spelled, moved_names(diff, old_aliases, aliases), diff), "affected")
            aliases = aliases.union(old_aliases.join(diff, "path", "left_anti").select("path", "alias"))
        self._write(parsed, before, again, diff, current.select("path"), aliases, gen)
        if base_diff is not None:
            self._write_bases(bases, base_diff, gen)
        counts = {r.change: r.n for r in diff.groupBy("change").agg(F.count("*").alias("n")).collect()}
        pin = {"gen": gen, "fingerprint": fingerprint, **{c: counts.get(c, 0) for c in ("added", "changed", "removed")}}
        self.spark.createDataFrame([pin], "gen long, fingerprint string, added long, changed long, removed long").coalesce(1).write.mode("append").parquet(f"{self.folder}/pin")
        return pin

    def _write(self, parsed: DataFrame, before: DataFrame | None, again: DataFrame | None, diff: DataFrame, paths: DataFrame, aliases: DataFrame, gen: int) -> None:
        docs = project.doc(parsed).withColumn("tombstone", F.lit(False)).withColumn("parsed", F.lit(gen).cast("long"))
        gone = diff.where("change = 'removed'").select("path", F.lit(True).alias("tombstone"))
        if again is not None:
            docs = docs.unionByName(before.join(again, "path", "left_semi").drop("gen").withColumn("tombstone", F.lit(False)))
        self._append("doc", docs.unionByName(gone, allowMissingColumns=True), gen)
        for name in self.children:
            self._append(name, project.relation(parsed, name), gen)
        self._append("alias", parsed.select("path", F.explode("alias").alias("alias")), gen)
        for name in self.resolved:
            rows = views.spelled(parsed, name)
            if again is not None:
                rows = rows.unionByName(self.relation(name).join(again, "path", "left_semi").select(*rows.columns))
            self._append(name, resolve.resolve(rows, paths, aliases).withColumn("path", F.col("src_path")), gen)
        if self.names_only:
            return
        body = project.relation(parsed, "body").withColumn("body_key", F.sha2("text", 256))
        known = self.table("body_text", gen - 1)
        texts = body.select("body_key", "text").dropDuplicates(["body_key"])
        self._append("body_text", texts if known is None else texts.join(known, "body_key", "left_anti"), gen)
        self._append("body", body.drop("text"), gen)

    def _base_revisions(self, bases: DataFrame) -> DataFrame:
        return bases.select("path", F.when(F.col("raw").isNotNull(), F.substring(F.sha2(F.col("raw").cast("binary"), 256), 1, 16)).alias("file_rev"))

    def _base_diff(self, bases: DataFrame) -> DataFrame:
        now, before = self._base_revisions(bases), self.base()
        return scratch.written(base_changes(now.limit(0) if before is None else before, now), "base-diff")

    def _write_bases(self, bases: DataFrame, diff: DataFrame, gen: int) -> None:
        touched = bases.join(diff.where("change <> 'removed'").select("path"), "path", "left_semi")
        parsed = scratch.written(workspace.bases(touched), "bases")
        rows = self._base_revisions(touched).join(parsed.drop("views", "formulas"), "path").withColumn("tombstone", F.lit(False))
        gone = diff.where("change = 'removed'").select("path", F.lit(True).alias("tombstone"))
        self._append("base", rows.unionByName(gone, allowMissingColumns=True), gen)
        self._append("base_view", parsed.selectExpr("path", "inline(views)"), gen)
        self._append("base_formula", parsed.selectExpr("path", "inline(formulas)"), gen)

    def compacted(self, folder: str) -> History:
        """A new log in `folder` that holds this one's latest state as its only generation."""
        gen, other = self.generation(), History(self.spark, folder, self.names_only)
        other._append("doc", self.docs().drop("gen").withColumn("tombstone", F.lit(False)).withColumn("parsed", F.lit(gen).cast("long")), gen)
        for name in (*self.children, "alias", *self.resolved):
            other._append(name, self.relation(name), gen)
        if self.base() is not None:
            other._append("base", self.base().drop("gen").withColumn("tombstone", F.lit(False)), gen)
            for name in BASES:
                other._append(name, self.relation(name), gen)
        if not self.names_only:
            body = of_live(self.table("body"), self.docs().select("path", F.col("parsed").alias("gen"))).drop("gen")
            other._append("body", body, gen)
            other._append("body_text", self.table("body_text").drop("gen").join(body, "body_key", "left_semi"), gen)
        self.spark.createDataFrame([self.pins()[-1]], "gen long, fingerprint string, added long, changed long, removed long").coalesce(1).write.parquet(f"{folder}/pin")
        return other

    def needs_compaction(self, multiple: float = 4.0) -> bool:
        log = self.table("doc")
        return log is not None and log.count() >= multiple * max(1, self.docs().count())

    def freshness(self, pages: DataFrame) -> str:
        """NO_VIEW, FRESH or STALE, against the pages as they are."""
        if not self.generation():
            return "NO_VIEW"
        return "FRESH" if merkle.root(revisions(pages)) == self.pins()[-1]["fingerprint"] else "STALE"
