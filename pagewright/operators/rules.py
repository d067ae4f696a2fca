"""Rules over the corpus: SQL rules, predicates over changes, and the shape that a type's pages have to have."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import frontmatter as fm
from pagewright.plans import sql_door

FINDING = "rule string, severity string, path string, detail string"
#: Words that a pure rule's facts can't name.
IMPURE = ("git", "clock", "now", "random", "time", "env", "socket", "file_io")


class QueryRule(NamedTuple):
    """A SQL text whose rows (path, detail) are findings; control is a path that it has to find."""

    name: str
    sql: str
    root: str = ""
    severity: str = "warn"
    control: str | None = None


class Shape(NamedTuple):
    """What the pages of a type need: keys with the type their value reads as, allowed values, headings, guards."""

    type: str
    required: tuple[tuple[str, str], ...] = ()
    allowed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    headings: tuple[str, ...] = ()
    guards: tuple[tuple[str, str, str], ...] = ()


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression: * within a segment, ** across segments."""
    out = re.escape(glob).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return f"^{out}$"


def in_scope(path: Column, root: str) -> Column:
    return F.lit(True) if not root else (path == root) | path.startswith(root.rstrip("/") + "/")


def pure(keys: list[str]) -> list[str]:
    """The keys that a rule may not read."""
    return [k for k in keys if any(w in k.lower() for w in IMPURE)]


def run_query_rule(spark: SparkSession, rule: QueryRule) -> DataFrame:
    """The rule's findings where its root governs; a broken rule, a null path or a missed control is a finding too."""
    fault = lambda text: spark.createDataFrame([(rule.name, rule.severity, None, text)], FINDING)
    try:
        rows = sql_door.run(spark, rule.sql)
    except Exception as error:  # whatever the text of a rule brings up is the rule's finding
        return fault(str(error).splitlines()[0])
    if "path" not in rows.columns:
        return fault("the rule's result has no path")
    detail = F.col("detail").cast("string") if "detail" in rows.columns else F.lit(None).cast("string")
    found = rows.select(F.lit(rule.name).alias("rule"), F.lit(rule.severity).alias("severity"), F.col("path").cast("string").alias("path"), detail.alias("detail"))
    governed = found.where(F.col("path").isNull() | in_scope(F.col("path"), rule.root))
    governed = governed.withColumn("detail", F.when(F.col("path").isNull(), "the rule gave a null path").otherwise(F.col("detail")))
    if rule.control is None:
        return governed
    out = governed.where(F.col("path").isNull() | (F.col("path") != rule.control))
    return out if not found.where(F.col("path") == rule.control).isEmpty() else out.unionByName(fault(f"the control {rule.control} was not found"))


def check_changes(changes: DataFrame, check: Column | Callable[[dict], str | None], rule: str, severity: str = "block") -> DataFrame:
    """Findings of a check over change facts: a column, or else a function of one row at a time, that gives a detail or null."""
    if isinstance(check, Column):
        return changes.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "path", check.cast("string").alias("detail")).where("detail IS NOT NULL")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"rule": rule, "severity": severity, "path": r["path"], "detail": d} for r in batch.to_pylist() if (d := check(r)) is not None]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(n, pa.string()) for n in ("rule", "severity", "path", "detail")]))

    return changes.mapInArrow(judge, FINDING)


def gate(findings: DataFrame) -> DataFrame:
    """One row: findings by severity, and whether they block."""
    return findings.agg(F.count_if(F.col("severity") == "block").alias("blocking"), F.count_if(F.col("severity") == "warn").alias("warnings"), (F.count_if(F.col("severity") == "block") > 0).alias("blocked"))


def typed_properties(frontmatter: DataFrame) -> DataFrame:
    """Properties with the type that their text reads as."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["path", "key", "value"]).append_column("value_type", pa.array([fm.typed(v) for v in batch.column("value").to_pylist()], pa.string()))

    return frontmatter.select("path", "key", "value").mapInArrow(judge, "path string, key string, value string, value_type string")


def conformance(frontmatter: DataFrame, sections: DataFrame, shape: Shape) -> DataFrame:
    """(path, rule, message): where pages of the shape's type depart from it."""
    of_type = frontmatter.where((F.col("key") == "type") & (F.col("value") == shape.type)).select("path").distinct()
    typed = typed_properties(frontmatter.join(of_type, "path", "left_semi"))
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(t).alias("wanted")) for k, t in shape.required])) if shape.required else None
    out = of_type.limit(0).select("path", F.lit("").alias("rule"), F.lit("").alias("message"))
    if wanted is not None:
        asked = of_type.select("path", wanted.alias("w")).select("path", "w.key", "w.wanted").join(typed, ["path", "key"], "left")
        missing = asked.where("value IS NULL").select("path", F.lit("missing").alias("rule"), F.concat(F.lit("no "), "key").alias("message"))
        wrong = asked.where("value IS NOT NULL AND wanted <> 'any' AND value_type <> wanted").select("path", F.lit("type").alias("rule"), F.concat("key", F.lit(" reads as "), "value_type", F.lit(", not "), "wanted").alias("message"))
        out = out.unionByName(missing).unionByName(wrong)
    for key, values in shape.allowed:
        out = out.unionByName(typed.where((F.col("key") == key) & ~F.col("value").isin(*values)).select("path", F.lit("value").alias("rule"), F.concat(F.lit(f"{key} is "), "value").alias("message")))
    for key, value, needs in shape.guards:
        held = typed.where((F.col("key") == key) & (F.col("value") == value)).select("path")
        out = out.unionByName(held.join(typed.where(F.col("key") == needs).select("path"), "path", "left_anti").select("path", F.lit("guard").alias("rule"), F.lit(f"{key} {value} needs {needs}").alias("message")))
    for heading in shape.headings:
        there = sections.where(F.col("heading") == heading).select("path")
        out = out.unionByName(of_type.join(there, "path", "left_anti").select("path", F.lit("heading").alias("rule"), F.lit(f"no heading {heading}").alias("message")))
    return out


def new_findings(after: DataFrame, before: DataFrame) -> DataFrame:
    """Findings that the state before didn't have."""
    return after.join(before, ["path", "rule", "message"], "left_anti")


def nearest_layer(layers: DataFrame) -> DataFrame:
    """Of (def, key, depth, value) the value of the deepest layer for each def and key."""
    return layers.groupBy("def", "key").agg(F.max_by("value", "depth").alias("value"), F.max("depth").alias("depth"))


def nearest_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """paths (path) with the longest of roots (root) that holds each; one equi-join on the path's folders."""
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    held = paths.select("path", F.explode(folders).alias("root")).join(roots.select("root").distinct(), "root")
    return paths.join(held.groupBy("path").agg(F.max_by("root", F.length("root")).alias("root")), "path", "left")


def armed_drift(armed: DataFrame, doc: DataFrame) -> DataFrame:
    """(path, state) of armed rule pages (path, file_rev): current, drifted or gone."""
    live = doc.select("path", F.col("file_rev").alias("live_rev"))
    state = F.when(F.col("live_rev").isNull(), "gone").when(F.col("live_rev") != F.col("file_rev"), "drifted").otherwise("current")
    return armed.join(live, "path", "left").select("path", state.alias("state"))


def registered(tags: DataFrame) -> DataFrame:
    """(path, kind) of pages that a tag makes a rule."""
    return tags.where(F.col("tag").isin("rules/check", "rules/hook", "rules/middleware", "rules/query")).select("path", F.substring_index("tag", "/", -1).alias("kind")).distinct()
