"""Files of a workspace: pages that belong to it, what is left out and why, and files beside the pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import side_files


def read_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path below the folder, raw, modified, length) of its files of that name pattern, on any store."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    name = F.url_decode(F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/"), r"\+", "%2B"))
    top = "/" + re.sub(r"^[a-z0-9]+:/*", "", folder).strip("/") + "/"
    return found.select(F.substring_index(name, top, -1).alias("path"), F.col("content").alias("raw"), F.col("modificationTime").alias("modified"), "length")


def rule_pattern(rule: str) -> str:
    """An ignore rule as a regular expression over whole paths."""
    rule = rule.removeprefix("!").strip()
    anchored, only_dir = rule.startswith("/") or "/" in rule.rstrip("/"), rule.endswith("/")
    body = re.escape(rule.strip("/")).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return ("^" if anchored else "(^|.*/)") + body + ("/.*$" if only_dir else "(/.*)?$")


def left_out(path: Column, rules: list[str]) -> Column:
    """Why a file is outside: not a page, a hidden segment, or the last rule that matches it; null inside."""
    ignored = F.lit(False)
    for rule in rules:
        ignored = F.when(path.rlike(rule_pattern(rule)), F.lit(not rule.startswith("!"))).otherwise(ignored)
    return F.when(~path.endswith(".md"), "not-markdown").when(path.rlike(r"(^|/)\."), "dot-segment").when(ignored, "ignored")


def domain(files: DataFrame, rules: list[str]) -> tuple[DataFrame, DataFrame]:
    """The pages inside, and what is outside with its reason."""
    judged = files.withColumn("reason", left_out(F.col("path"), rules))
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL").select("path", "reason")


def unmoved(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose length and time differ from the manifest (path, modified, length): what has to be read again."""
    return files.join(manifest.select("path", "modified", "length"), ["path", "modified", "length"], "left_anti")


BASE = "path string, error string, filters string, properties string, extra string, views array<struct<ord:bigint,name:string,type:string,filters:string,config:string>>, formulas array<struct<ord:bigint,name:string,expr:string>>"


def bases(files: DataFrame) -> DataFrame:
    """Base files (path, raw) as rows of BASE."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = pa.string()
        view = pa.struct([("ord", pa.int64()), *[(n, text) for n in ("name", "type", "filters", "config")]])
        formula = pa.struct([("ord", pa.int64()), ("name", text), ("expr", text)])
        for batch in batches:
            found = [side_files.parse_base((raw or b"").decode("utf-8", "replace")) for raw in batch.column("raw").cast(pa.large_binary()).to_pylist()]
            columns = [batch.column("path"), *[pa.array([getattr(b, n) for b in found], text) for n in ("error", "filters", "properties", "extra")]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([b.views for b in found], pa.list_(view)), pa.array([b.formulas for b in found], pa.list_(formula))], ["path", "error", "filters", "properties", "extra", "views", "formulas"])

    return files.select("path", "raw").mapInArrow(parse, BASE)


def canvases(files: DataFrame) -> DataFrame:
    """(path, seq, slot, text, span_start, span_end) of canvas files (path, raw)."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, i, *s) for p, raw in zip(batch.column("path").to_pylist(), batch.column("raw").cast(pa.large_binary()).to_pylist()) for i, s in enumerate(side_files.canvas_slots(raw or b""))]
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "seq", "slot", "text", "span_start", "span_end"])

    return files.select("path", "raw").mapInArrow(parse, "path string, seq long, slot string, text string, span_start long, span_end long")


def rooted(corpora: dict[str, DataFrame]) -> DataFrame:
    """Several workspaces as one, each page with the name of its root."""
    out = None
    for name, pages in corpora.items():
        named = pages.withColumn("root", F.lit(name))
        out = named if out is None else out.unionByName(named)
    return out


ADDRESS = re.compile(r"^(?:([a-z][a-z0-9-]*):)?([^#]*)(?:#(.*))?$")


def parse_address(text: str) -> tuple[str | None, str, str | None]:
    """root, path, selector of an address."""
    m = ADDRESS.match(text)
    return (m[1], m[2], m[3]) if m else (None, text, None)


def to_uri(vault: str, path: str) -> str:
    return f"obsidian://open?vault={quote(vault, safe='')}&file={quote(path, safe='')}"


def from_uri(uri: str) -> tuple[str, str] | None:
    m = re.fullmatch(r"obsidian://open\?vault=([^&]*)&file=([^&]*)", uri)
    return (unquote(m[1]), unquote(m[2])) if m else None
