"""Link resolution: from what a link says to the page it names, with the candidates it was chosen from.

Candidates and the shortest of them are found once per distinct spelling, by an equi-join on whole
spellings (a page has one for each folder of its path), so a name that many pages share or many links
use costs one row per page that has it, not one per link and page. A candidate in
the link's own directory wins; that is one more equi-join on (spelling, directory).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def spelling(target: Column) -> Column:
    """A target as it is looked up: trimmed, without .md, lower case."""
    return F.lower(F.regexp_replace(F.trim(target), r"(\.md)+$", ""))


def is_rooted(target: Column) -> Column:
    """A colon in the first segment names another root."""
    return F.instr(F.substring_index(target, "/", 1), ":") > 0


def last_segment(key: Column) -> Column:
    return F.substring_index(key, "/", -1)


def names(paths: DataFrame) -> DataFrame:
    """(key, page, dir, size): every spelling of each page: its base name, and each ending of its path from a folder on."""
    lower = F.lower("path")
    parts = F.split(F.regexp_replace(lower, r"\.md$", ""), "/")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    qualified = F.when(F.endswith(lower, F.lit(".md")) & (F.size(parts) > 1), endings).otherwise(F.array().cast("array<string>"))
    base = last_segment(F.regexp_replace(lower, r"(\.md)+$", ""))
    spelled = F.array_distinct(F.concat(F.array(base), qualified))
    return paths.select(F.explode(spelled).alias("key"), F.col("path").alias("page"), directory(F.col("path")).alias("dir"), F.octet_length("path").alias("size"))


def candidates(keys: DataFrame, paths: DataFrame, aliases: DataFrame) -> DataFrame:
    """(key, page, dir, size): every page that a spelling names; by path or base name, else by alias.

    keys: (key) distinct; paths: (path); aliases: (path, alias), lower case.
    """
    by_name = keys.join(names(paths), "key").select("key", "page", "dir", "size")
    rest = keys.join(by_name.select("key").distinct(), "key", "left_anti")
    by_alias = rest.join(aliases.select(F.col("alias").alias("key"), F.col("path").alias("page")).distinct(), "key")
    return by_name.unionByName(by_alias.select("key", "page", directory(F.col("page")).alias("dir"), F.octet_length("page").alias("size")))


def resolve(links: DataFrame, paths: DataFrame, aliases: DataFrame) -> DataFrame:
    """`links` (src_path, target_raw and others) with dest_path, candidates and dest_root.

    An empty target names the source page itself. A target in another root stays unresolved here and
    names its root. candidates is the sorted list of pages, only where there is more than one.
    """
    target = F.trim("target_raw")
    asked = links.withColumn("to_self", target == "").withColumn("rooted", is_rooted(target))
    sought = ~F.col("to_self") & ~F.col("rooted")
    nothing = F.concat(F.lit("\0"), "src_path")  # no page's spelling, and not one key for all links that seek none
    asked = asked.withColumn("looked_up", F.when(sought, spelling(F.col("target_raw"))).otherwise(nothing)).withColumn("src_dir", directory(F.col("src_path")))
    found = candidates(asked.where(sought).select(F.col("looked_up").alias("key")).distinct(), paths, aliases)
    best = found.groupBy(F.col("key").alias("looked_up")).agg(F.min(F.struct("size", "page")).alias("best"), F.sort_array(F.collect_list("page")).alias("all"))
    near = found.groupBy(F.col("key").alias("looked_up"), F.col("dir").alias("src_dir")).agg(F.min(F.struct("size", "page")).alias("near"))
    picked = asked.join(best, "looked_up", "left").join(near, ["looked_up", "src_dir"], "left")
    dest = F.when(F.col("to_self"), F.col("src_path")).otherwise(F.coalesce("near.page", "best.page"))
    return picked.select(
        *[F.col(c) for c in links.columns],
        dest.alias("dest_path"),
        F.when(F.size("all") > 1, F.col("all")).alias("candidates"),
        F.when(F.col("rooted"), F.substring_index(target, ":", 1)).alias("dest_root"),
        F.when(F.col("rooted"), F.regexp_replace(target, "^[^:]*:", "")).alias("dest_root_path"),
    )


def exclusions(dangling: DataFrame, listing: DataFrame) -> DataFrame:
    """Dangling links (src_path, seq, target_raw) with exclusion and exclusion_path, where a file outside
    the corpus has the spelled path, or else the bare name; listing: (path, reason)."""
    target = F.trim("target_raw")
    spelled = dangling.withColumn("spelled", target)
    here = listing.select(F.col("path").alias("spelled"), F.col("path").alias("at_path"), F.col("reason").alias("at_reason"))
    bare = listing.groupBy(last_segment(F.col("path")).alias("spelled")).agg(F.min(F.struct(F.octet_length("path").alias("size"), "path", "reason")).alias("bare"))
    both = spelled.join(here, "spelled", "left").join(bare, "spelled", "left")
    return both.select(*dangling.columns, F.coalesce("at_reason", "bare.reason").alias("exclusion"), F.coalesce("at_path", "bare.path").alias("exclusion_path"))


def edge_counts(resolved: DataFrame) -> DataFrame:
    """(src_path, channel, key, n): links of a page to a page, to a missing name or to another root."""
    channel = F.when(F.col("dest_path").isNotNull(), "resolved").when(F.col("dest_root").isNotNull(), "rooted").otherwise("unresolved")
    return resolved.groupBy("src_path", channel.alias("channel"), F.coalesce("dest_path", F.trim("target_raw")).alias("key")).agg(F.count("*").alias("n"))


def edge_map(pages: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per page: maps of its counts by channel; pages without links have empty maps."""
    entry = F.struct(F.col("key"), F.col("n"))
    maps = counts.groupBy("src_path").agg(*[F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("channel") == c, entry)))).alias(c) for c in ("resolved", "unresolved", "rooted")])
    empty = F.create_map().cast("map<string,bigint>")
    return pages.select(F.col("path").alias("src_path")).join(maps, "src_path", "left").select("src_path", *[F.coalesce(c, empty).alias(c) for c in ("resolved", "unresolved", "rooted")])


def census(resolved: DataFrame) -> DataFrame:
    """Resolved, dangling and rooted links in one row."""
    return resolved.agg(F.count_if(F.col("dest_path").isNotNull()).alias("resolved"), F.count_if(F.col("dest_path").isNull() & F.col("dest_root").isNull()).alias("dangling"), F.count_if(F.col("dest_root").isNotNull()).alias("rooted"))


def subpath(resolved: DataFrame, sections: DataFrame, anchors: DataFrame) -> DataFrame:
    """Links with a fragment, and the span it names: the first heading of that text, or the last block of that id."""
    heads = sections.groupBy(F.col("path").alias("dest_path"), F.lower("heading").alias("fragment")).agg(F.min(F.struct("span_start", "span_end")).alias("head"))
    blocks = anchors.groupBy(F.col("path").alias("dest_path"), F.lower("id").alias("fragment")).agg(F.max(F.struct("span_start", "span_end")).alias("tail"))
    asked = resolved.where("heading IS NOT NULL OR block IS NOT NULL")
    by_head = asked.where("heading IS NOT NULL").withColumn("fragment", F.lower(F.trim(F.element_at(F.split("heading", "#"), -1)))).join(heads, ["dest_path", "fragment"], "left")
    by_block = asked.where("heading IS NULL").withColumn("fragment", F.lower(F.trim("block"))).join(blocks, ["dest_path", "fragment"], "left")
    keep = resolved.columns
    both = by_head.select(*keep, F.col("head").alias("found")).unionByName(by_block.select(*keep, F.col("tail").alias("found")))
    return both.select(*keep, F.col("found.span_start").alias("dest_start"), F.col("found.span_end").alias("dest_end"))


def resolve_refs(asked: DataFrame, corpora: DataFrame, aliases: DataFrame) -> DataFrame:
    """asked (src_path, ref) with outcome, dest_root and dest_path: an address by the three rules.

    The page of exactly that path, else with .md, else what the link rule picks. corpora: (root, path)
    of every mounted root, null for the own one; aliases: (root, path, alias). Outcomes: ambient, rooted,
    not-found, unmounted, malformed.
    """
    ref = F.substring_index("ref", "#", 1)
    peeled = asked.withColumn("dest_root", F.when(is_rooted(ref), F.substring_index(ref, ":", 1))).withColumn("asked_path", F.when(is_rooted(ref), F.regexp_replace(ref, "^[^:]*:", "")).otherwise(ref))
    mounts = corpora.select(F.col("root").alias("mount"), F.lit(True).alias("mounted")).distinct()
    known = peeled.join(mounts, F.col("dest_root").eqNullSafe(F.col("mount")), "left").drop("mount")
    exact = corpora.select(F.col("root").alias("exact_root"), F.col("path").alias("exact"))
    with_md = corpora.select(F.col("root").alias("md_root"), F.col("path").alias("with_md"))
    ruled = known.join(exact, F.col("dest_root").eqNullSafe(F.col("exact_root")) & (F.col("asked_path") == F.col("exact")), "left")
    ruled = ruled.join(with_md, F.col("dest_root").eqNullSafe(F.col("md_root")) & (F.concat("asked_path", F.lit(".md")) == F.col("with_md")), "left")
    key = spelling(F.col("asked_path"))
    pages = corpora.select(F.col("root").alias("page_root"), F.col("path").alias("page"), last_segment(F.lower(F.regexp_replace("path", r"(\.md)+$", ""))).alias("base"))
    left = ruled.where("exact IS NULL AND with_md IS NULL").select("dest_root", key.alias("key"), last_segment(key).alias("base"), directory(F.col("src_path")).alias("src_dir")).distinct()
    suffix = F.concat(F.col("key"), F.lit(".md"))
    fits = (F.instr("key", "/") == 0) | (F.lower("page") == suffix) | F.endswith(F.lower("page"), F.concat(F.lit("/"), suffix))
    by_name = left.join(pages, "base").where(F.col("dest_root").eqNullSafe(F.col("page_root")) & fits).select("dest_root", "key", "src_dir", "page")
    named = aliases.select(F.col("root").alias("page_root"), F.col("alias").alias("key"), F.col("path").alias("page"))
    rest = left.join(by_name.select(F.col("dest_root").alias("r"), F.col("key").alias("k")).distinct(), F.col("dest_root").eqNullSafe(F.col("r")) & (F.col("key") == F.col("k")), "left_anti")
    by_alias = rest.join(named, "key").where(F.col("dest_root").eqNullSafe(F.col("page_root"))).select("dest_root", "key", "src_dir", "page")
    rank = F.struct((directory(F.col("page")) != F.col("src_dir")).alias("far"), F.octet_length("page").alias("size"), F.col("page"))
    best = by_name.unionByName(by_alias).groupBy(F.col("dest_root").alias("best_root"), F.col("key").alias("best_key"), F.col("src_dir").alias("best_dir")).agg(F.min(rank).alias("best"))
    found = ruled.join(best, F.col("dest_root").eqNullSafe(F.col("best_root")) & (key == F.col("best_key")) & (directory(F.col("src_path")) == F.col("best_dir")), "left")
    dest = F.coalesce("exact", "with_md", "best.page")
    outcome = (
        F.when(F.trim(ref) == "", "malformed").when(F.col("dest_root").isNotNull() & F.col("mounted").isNull(), "unmounted")
        .when(F.instr("asked_path", ":") > 0, "malformed").when(dest.isNull(), "not-found").when(F.col("dest_root").isNull(), "ambient").otherwise("rooted")
    )
    return found.select("src_path", "ref", outcome.alias("outcome"), "dest_root", F.when(outcome.isin("ambient", "rooted"), dest).alias("dest_path"))
