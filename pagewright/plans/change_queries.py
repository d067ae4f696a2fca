"""Queries over change: deltas, upkeep, history, streams, walks, plans and rules, with oracles from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import delta, graph, history, merkle, project, read, relocate, rules, views
from pagewright.plans import sql_door
from pagewright.plans.workspace_queries import BODIES, LINKS, PAGES, PROPERTIES, SECTIONS, TASKS, named, parsed, space
from pagewright.session import table
from pagewright.sources import scratch, synth
from pagewright.streaming import feed


def states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the customer pages: every fifth comes, every seventh goes, every third is edited."""
    key = F.regexp_extract("path", r"(\d+)\.md$", 1).cast("long")
    pages = synth.workspace(spark, sf_dir, ("customers",)).withColumn("k", key)
    edited = F.when(F.col("k") % 3 == 0, F.replace(F.col("raw"), F.lit("\n## Notes\n"), F.lit("\nMore.\n\n## Notes\n"))).otherwise(F.col("raw"))
    return pages.where("k % 5 <> 0").select("path", "raw"), pages.where("k % 7 <> 0").select("path", edited.alias("raw"))


def delta_files(spark, sf_dir):
    before, after = states(spark, sf_dir)
    return delta.file_delta(history.revisions(before), history.revisions(after)).select("path", "change")


def delta_nodes(spark, sf_dir):
    return delta.node_delta(*states(spark, sf_dir))


def delta_sections(spark, sf_dir):
    before, after = (project.relation(project.parse_pages(s), "section") for s in states(spark, sf_dir))
    both = delta.section_changes(before, after)
    return both.groupBy("hpath", "change").agg(F.count("*").alias("n"))


def delta_frame(spark, sf_dir):
    before, after = states(spark, sf_dir)
    frame = delta.framed(delta.file_delta(history.revisions(before), history.revisions(after)), 1, "a", "b")
    return frame.select("seq", F.size("files").cast("long").alias("files"), F.col("dropped").cast("long").alias("dropped"))


def upkeep_links(spark, sf_dir):
    """The link relation after two appends, the second with the pages that change what names mean."""
    log = history.History(spark, scratch.new_folder(spark, "history"), names_only=True)
    log.sync(synth.workspace(spark, sf_dir, ("customers", "orders", "archive", "geo")))
    log.sync(synth.workspace(spark, sf_dir))
    return log.relation("link").select("src_path", "seq", "target_raw", "dest_path", F.array_join("candidates", ",").alias("candidates"))


def base_states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of a base file per nation: every fifth comes, every seventh goes, every third gets a formula more."""
    k = F.col("n_nationkey")
    raw = F.concat(F.lit("views:\n  - name: "), "n_name", F.lit("\n    type: table\nformulas:\n  f: a + "), k.cast("string"), F.lit("\n"))
    files = table(spark, sf_dir, "nation").select(k, F.concat(F.lit("geo/"), k.cast("string"), F.lit(".base")).alias("path"), raw.alias("raw"))
    after = F.concat("raw", F.when(k % 3 == 0, "  g: b\n").otherwise(""))
    return files.where(k % 5 != 0).select("path", "raw"), files.where(k % 7 != 0).select("path", after.alias("raw"))


def upkeep_bases(spark, sf_dir):
    """Views and formulas of the base files after two appends, with the generation that each file was last read in."""
    log = history.History(spark, scratch.new_folder(spark, "history"))
    for bases in base_states(spark, sf_dir):
        log.sync(synth.workspace(spark, sf_dir, ("geo",)), bases)
    named = log.relation("base_view").select("path", "ord", F.lit("view").alias("part"), "name", F.col("type").alias("value"))
    formulas = log.relation("base_formula").select("path", "ord", F.lit("formula").alias("part"), "name", F.col("expr").alias("value"))
    return named.unionByName(formulas).join(log.base().select("path", "gen"), "path")


def upkeep_affected(spark, sf_dir):
    """Unchanged pages that an added archive makes the engine resolve again."""
    ws = space(spark, sf_dir, ("customers", "orders", "parts", "geo"))
    diff = synth.archive_pages(spark, sf_dir).select("path", F.lit("added").alias("change"))
    names = history.moved_names(diff, ws.aliases, ws.aliases.limit(0))
    return history.affected(ws.link.select("src_path", "target_raw"), names, diff)


def upkeep_compacted(spark, sf_dir):
    """The live pages of a compacted log, after pages went."""
    log = history.History(spark, scratch.new_folder(spark, "history"))
    before, after = states(spark, sf_dir)
    log.sync(before)
    log.sync(after)
    return log.compacted(scratch.new_folder(spark, "history")).docs().select("path", "bytes")


def history_by_generation(spark, sf_dir):
    """Events as page versions: the live pages after each page's first five versions."""
    log = table(spark, sf_dir, "events").selectExpr("CAST(user_id AS STRING) AS path", "event_id", "event_type = 'error' AS tombstone", "row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS gen")
    return history.live(log.where("gen <= 5")).select("path", "event_id")


def stream_state(spark, sf_dir):
    """The state that a stream of events leads to, frame by frame."""
    found = feed.read_events(spark, f"{sf_dir}/event[s].parquet", "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    events = found.selectExpr("CAST(user_id AS STRING) AS path", "lpad(CAST(event_id AS STRING), 18, '0') AS file_rev", "event_type = 'error' AS deleted", "ts")
    log = feed.Feed(spark, scratch.new_folder(spark, "feed"))
    log.start(events).awaitTermination()
    last = log.frames().agg(F.max("seq")).first()[0]
    return log.state(last).select("path", F.col("file_rev").cast("long").alias("event_id"))


def stream_windows(spark, sf_dir):
    """Six-hour windows over the stream of events."""
    found = feed.read_events(spark, f"{sf_dir}/event[s].parquet", "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    folder = scratch.new_folder(spark, "windows")
    windows = feed.windowed(found, "6 hours", "1 day").select(F.col("w.start").alias("begins"), "event_type", "n", "total")
    writer = windows.writeStream.outputMode("complete").foreachBatch(lambda df, seq: df.write.mode("overwrite").parquet(f"{folder}/out"))
    writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def edges(spark, sf_dir) -> DataFrame:
    link = named(spark, sf_dir).link
    return link.where("dest_path IS NOT NULL").select(F.col("src_path").alias("src"), F.col("dest_path").alias("dst"))


def graph_walk_down(spark, sf_dir):
    start = spark.createDataFrame([("customers/customer-1.md",)], "node string")
    return graph.walk(scratch.written(edges(spark, sf_dir), "edges"), start, 2).select(F.col("node").alias("path"), F.col("depth").cast("long").alias("depth"))


def graph_walk_up(spark, sf_dir):
    start = spark.createDataFrame([("geo/region-1.md",)], "node string")
    return graph.walk(scratch.written(edges(spark, sf_dir), "edges"), start, 2, up=True).select(F.col("node").alias("path"), F.col("depth").cast("long").alias("depth"))


def graph_cycles(spark, sf_dir):
    """Customers and orders link each other."""
    return graph.cyclic(edges(spark, sf_dir)).select(F.col("node").alias("path"))


def plan_move(spark, sf_dir):
    """Every part with an archive page moves; links that would go elsewhere are respelled."""
    ws = named(spark, sf_dir)
    moves = synth.archive_pages(spark, sf_dir).select(F.replace(F.col("path"), F.lit("archive/"), F.lit("parts/")).alias("from_path"), F.replace(F.col("path"), F.lit("archive/part-"), F.lit("stock/kept-")).alias("to_path"))
    return relocate.move_plan(ws.link.select("src_path", "seq", "target_raw"), ws.paths, ws.aliases, moves).select("src_path", "seq", "target_raw", "dest_path", "new_target", "kind")


def plan_rename(spark, sf_dir):
    ws = space(spark, sf_dir, ("customers", "orders"))
    plan = relocate.rename_plan(ws.link, ws.section, "orders/order-7.md", "Lines", "Items")
    return plan.select("path", "text", "step")


def rules_query(spark, sf_dir):
    """Orders whose status says open and whose lines are all picked."""
    ws = space(spark, sf_dir, ("orders",))
    sql_door.register(spark, {"task": ws.task, "record": views.record(ws.doc, ws.frontmatter)})
    rule = rules.QueryRule("picked-but-open", "SELECT r.path, concat('status ', r.status) AS detail FROM record r JOIN task t ON t.path = r.path WHERE r.status = 'O' GROUP BY r.path, r.status HAVING bool_and(t.checked)", root="orders")
    return rules.run_query_rule(spark, rule).select("rule", "severity", "path", "detail")


def rules_shape(spark, sf_dir):
    ws = space(spark, sf_dir, ("customers", "orders"))
    shape = rules.Shape("customer", required=(("owner", "text"), ("session", "timestamp"), ("tags", "list")), allowed=(("status", ("BUILDING", "MACHINERY")),), headings=("Orders", "History"), guards=(("status", "BUILDING", "up"),))
    return rules.conformance(ws.frontmatter, ws.section, shape)


def rules_typed(spark, sf_dir):
    return rules.typed_properties(space(spark, sf_dir).frontmatter).groupBy("key", "value_type").agg(F.count("*").alias("n"))


def status_tasks(spark, sf_dir):
    """Open and done tasks of each page type."""
    ws = space(spark, sf_dir, ("customers", "orders"))
    kind = ws.frontmatter.where("key = 'type'").select("path", F.col("value").alias("type"))
    return ws.task.join(kind, "path").groupBy("type").agg(F.count_if(~F.col("checked")).alias("open"), F.count_if("checked").alias("done"))


def pins_coloured(spark, sf_dir):
    """Pins of each nation on its region, drifted where the region's key is odd."""
    n = table(spark, sf_dir, "nation")
    odd = F.col("n_regionkey") % 2 == 1
    pins = n.select(
        F.col("n_nationkey").alias("seq"), F.when(F.col("n_nationkey") == 3, "malformed at line 3").alias("refused"), F.lit(None).cast("string").alias("dest_root"),
        F.when(F.col("n_nationkey") % 11 != 5, F.lit("geo/region.md")).alias("dest_path"), (F.col("n_nationkey") % 2 == 1).alias("on_disk"), F.lit(True).alias("in_domain"),
        F.when(F.col("n_nationkey") == 8, "malformed").otherwise("span").alias("token"), F.when(F.col("n_nationkey") == 9, 2).otherwise(1).alias("found"), F.lit("a").alias("fingerprint"), F.when(odd, "b").otherwise("a").alias("current"),
    )
    return graph.coloured(pins).groupBy("tone", "reason").agg(F.count("*").alias("n"))


def orphan_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    anchors = e.where("event_type IN ('click', 'purchase')").selectExpr("concat(CASE event_type WHEN 'click' THEN 'p-run-' ELSE 'r-run-' END, event_id % 500) AS id")
    return graph.orphaned_runs(anchors)


def tree_digest_dirs(spark, sf_dir):
    """Directories of the workspace that have a digest."""
    return merkle.directories(history.revisions(synth.workspace(spark, sf_dir)).select("path", "digest")).select("path", F.length("digest").cast("long").alias("digits"))


def read_toc(spark, sf_dir):
    return read.toc(parsed(spark, sf_dir)).select("path", "node_seq", "heading", "ordinal")


def read_cat(spark, sf_dir):
    """The section of lines of every order, where its address is unambiguous."""
    pages = scratch.written(synth.workspace(spark, sf_dir, ("orders",)), "pages")
    found = project.parse_pages(pages)
    asked = project.relation(found, "section").where("heading = 'Lines' AND n IS NULL").select("path", "hpath")
    return read.cat(pages, found, asked).select("path", "raw", "n")


def read_extract(spark, sf_dir):
    return read.extract(parsed(spark, sf_dir), ["frontmatter", "heading", "task", "anchor", "wikilink", "embed"]).groupBy("kind").agg(F.count("*").alias("n"))


def read_words(spark, sf_dir):
    """Words of each page's text chunks."""
    found = parsed(spark, sf_dir, ("customers",))
    return read.composed(found, found.select("path")).select("path", "words")


def status_line(spark, sf_dir):
    ws = space(spark, sf_dir)
    return read.status(ws.doc, ws.link, ws.task, ws.frontmatter_fault)


def rules_change(spark, sf_dir):
    """A predicate over property changes: status may not change to BUILDING."""
    frontmatter = space(spark, sf_dir, ("customers",)).frontmatter.where("key = 'status'")
    after = frontmatter.withColumn("value", F.when(F.regexp_extract("path", r"(\d+)", 1).cast("long") % 6 == 0, "BUILDING").otherwise(F.col("value")))
    check = F.when(F.col("value_after") == "BUILDING", F.concat(F.lit("was "), "value_before"))
    return rules.check_changes(delta.property_changes(frontmatter, after), check, "no-building").select("rule", "severity", "path", "detail")


NAMES = ("read_toc", "read_cat", "read_extract", "read_words", "status_line", "rules_change", "delta_files", "delta_nodes", "delta_sections", "delta_frame", "upkeep_links", "upkeep_bases", "upkeep_affected", "upkeep_compacted", "history_by_generation", "stream_state", "stream_windows", "graph_walk_down", "graph_walk_up", "graph_cycles", "plan_move", "plan_rename", "rules_query", "rules_shape", "rules_typed", "status_tasks", "pins_coloured", "orphan_runs", "tree_digest_dirs")
QUERIES = {n: globals()[n] for n in NAMES}

CHANGES = """
changed AS (
  SELECT c_custkey AS k, 'customers/customer-' || c_custkey || '.md' AS path,
         CASE WHEN c_custkey % 5 = 0 THEN 'created' WHEN c_custkey % 7 = 0 THEN 'deleted' ELSE 'modified' END AS change
  FROM customer WHERE (c_custkey % 5 = 0) <> (c_custkey % 7 = 0) OR (c_custkey % 3 = 0 AND c_custkey % 5 <> 0 AND c_custkey % 7 <> 0)
)"""
EDGES = f"{LINKS}, edges AS (SELECT DISTINCT src_path AS src, dest_path AS dst FROM links WHERE dest_path IS NOT NULL)"


def _walk(start: str, here: str, there: str) -> str:
    return f"""WITH {EDGES}, one AS (SELECT DISTINCT {there} AS node FROM edges WHERE {here} = '{start}'), two AS (SELECT DISTINCT {there} AS node FROM edges JOIN one ON {here} = node)
SELECT node AS path, CAST(min(depth) AS BIGINT) AS depth FROM (SELECT '{start}' AS node, 0 AS depth UNION ALL SELECT node, 1 FROM one UNION ALL SELECT node, 2 FROM two) GROUP BY node"""


ORACLE = {
    "read_toc": f"""WITH {SECTIONS} SELECT path, CAST(node_seq AS BIGINT) AS node_seq, heading, CASE WHEN level = 1 THEN '1' ELSE '1.' || (row_number() OVER (PARTITION BY path, level ORDER BY node_seq)) END AS ordinal FROM heads""",
    "read_cat": f"WITH {PAGES} SELECT path, substr(raw, instr(raw, '## Lines')) AS raw, CAST(1 AS BIGINT) AS n FROM pages WHERE path LIKE 'orders/%' AND CAST(regexp_extract(path, '([0-9]+)', 1) AS BIGINT) % 5 <> 0",
    "read_extract": f"""WITH {LINKS}, {SECTIONS}, {PROPERTIES}, {TASKS} SELECT kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT kind FROM links UNION ALL SELECT 'heading' FROM heads UNION ALL SELECT 'task' FROM tasks
UNION ALL SELECT 'anchor' FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT 'frontmatter' FROM props WHERE key = 'type') GROUP BY kind""",
    "read_words": f"""WITH {PAGES}, {SECTIONS}, {BODIES} SELECT path, CAST(sum(len(regexp_extract_all(text, '[^ ' || chr(10) || ']+'))) AS BIGINT) AS words FROM bodies WHERE path LIKE 'customers/%' GROUP BY path""",
    "status_line": f"WITH {PAGES}, {LINKS}, {TASKS} SELECT (SELECT count(*) FROM pages) AS pages, (SELECT CAST(sum(strlen(raw)) AS BIGINT) FROM pages) AS bytes, (SELECT count(dest_path) FROM links) AS resolved, (SELECT count(*) - count(dest_path) FROM links) AS dangling, (SELECT count(*) FROM tasks WHERE NOT checked) AS open_tasks, CAST(0 AS BIGINT) AS faults",
    "rules_change": "SELECT 'no-building' AS rule, 'block' AS severity, 'customers/customer-' || c_custkey || '.md' AS path, 'was ' || c_mktsegment AS detail FROM customer WHERE c_custkey % 6 = 0 AND c_mktsegment <> 'BUILDING'",
    "delta_files": f"WITH {CHANGES} SELECT path, change FROM changed",
    "delta_nodes": f"""WITH {CHANGES} SELECT path, 'edited' AS change, 'section' AS kind, '[{{"h":"Profile"}},{{"h":"Orders"}}]' AS hpath FROM changed WHERE change = 'modified'""",
    "delta_sections": f"""WITH {CHANGES}, s AS (SELECT unnest(['[{{"h":"Profile"}}]', '[{{"h":"Profile"}},{{"h":"Orders"}}]', '[{{"h":"Profile"}},{{"h":"Notes"}}]']) AS hpath)
SELECT hpath, CASE change WHEN 'created' THEN 'added' WHEN 'deleted' THEN 'removed' ELSE 'edited' END AS change, CAST(count(*) AS BIGINT) AS n FROM changed, s WHERE NOT (change = 'modified' AND hpath LIKE '%Notes%') GROUP BY ALL""",
    "delta_frame": f"WITH {CHANGES} SELECT CAST(1 AS BIGINT) AS seq, CAST(least(count(*), 128) AS BIGINT) AS files, CAST(greatest(count(*) - 128, 0) AS BIGINT) AS dropped FROM changed",
    "upkeep_links": f"WITH {LINKS} SELECT src_path, CAST(seq AS BIGINT) AS seq, target_raw, dest_path, candidates FROM links",
    "upkeep_bases": """WITH b AS (SELECT n_nationkey AS k, n_name, 'geo/' || n_nationkey || '.base' AS path, CAST(CASE WHEN n_nationkey % 5 = 0 OR n_nationkey % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS gen FROM nation WHERE n_nationkey % 7 <> 0)
SELECT path, CAST(0 AS BIGINT) AS ord, 'view' AS part, n_name AS name, 'table' AS value, gen FROM b UNION ALL SELECT path, 0, 'formula', 'f', 'a + ' || k, gen FROM b UNION ALL SELECT path, 1, 'formula', 'g', 'b', gen FROM b WHERE k % 3 = 0""",
    "upkeep_affected": "SELECT DISTINCT 'orders/order-' || l_orderkey || '.md' AS path FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey % 10 = 0 AND l_partkey % 3 <> 0 AND l_partkey IN (SELECT p_partkey FROM part)",
    "upkeep_compacted": f"WITH {PAGES} SELECT path, CAST(strlen(raw) + CASE WHEN k % 3 = 0 THEN 7 ELSE 0 END AS BIGINT) AS bytes FROM (SELECT path, raw, CAST(regexp_extract(path, '([0-9]+)', 1) AS BIGINT) AS k FROM pages WHERE path LIKE 'customers/%') WHERE k % 7 <> 0",
    "history_by_generation": "SELECT CAST(user_id AS VARCHAR) AS path, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS gen FROM events QUALIFY gen <= 5) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY gen DESC) = 1 AND event_type <> 'error'",
    "stream_state": "SELECT CAST(user_id AS VARCHAR) AS path, event_id FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE event_type <> 'error'",
    "stream_windows": "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS begins, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "graph_walk_down": _walk("customers/customer-1.md", "src", "dst"),
    "graph_walk_up": _walk("geo/region-1.md", "dst", "src"),
    "graph_cycles": f"WITH {EDGES} SELECT DISTINCT src AS path FROM edges e WHERE EXISTS (SELECT 1 FROM edges b WHERE b.src = e.dst AND b.dst = e.src) OR src = dst",
    "plan_move": f"""WITH {LINKS} SELECT src_path, CAST(seq AS BIGINT) AS seq, target_raw, dest_path, 'kept-' || regexp_extract(dest_path, '([0-9]+)', 1) AS new_target, 'bare' AS kind
FROM links WHERE dest_path LIKE 'parts/%' AND CAST(regexp_extract(dest_path, '([0-9]+)', 1) AS BIGINT) % 10 = 0 AND target_raw NOT LIKE 'alias %'""",
    "plan_rename": "SELECT 'customers/customer-7.md' AS path, '![[order-7#Items]]' AS text, 'link' AS step WHERE 7 IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'orders/order-7.md', '## Items', 'heading'",
    "rules_query": f"WITH {TASKS} SELECT 'picked-but-open' AS rule, 'warn' AS severity, path, 'status O' AS detail FROM tasks JOIN orders ON path = 'orders/order-' || o_orderkey || '.md' WHERE o_orderstatus = 'O' GROUP BY path HAVING bool_and(checked)",
    "rules_shape": """WITH c AS (SELECT 'customers/customer-' || c_custkey || '.md' AS path, * FROM customer)
SELECT path, 'missing' AS rule, 'no session' AS message FROM c UNION ALL SELECT path, 'heading', 'no heading History' FROM c
UNION ALL SELECT path, 'value', 'status is ' || c_mktsegment FROM c WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')
UNION ALL SELECT path, 'guard', 'status BUILDING needs up' FROM c WHERE c_mktsegment = 'BUILDING' AND c_custkey % 4 <> 0""",
    "rules_typed": f"WITH {PROPERTIES} SELECT key, CASE WHEN key IN ('tags', 'aliases', 'up') THEN 'list' WHEN key = 'session' THEN 'timestamp' ELSE 'text' END AS value_type, CAST(count(*) AS BIGINT) AS n FROM props GROUP BY ALL",
    "status_tasks": f"WITH {TASKS} SELECT CASE WHEN path LIKE 'cust%' THEN 'customer' ELSE 'order' END AS type, CAST(count(*) FILTER (WHERE NOT checked) AS BIGINT) AS open, CAST(count(*) FILTER (WHERE checked) AS BIGINT) AS done FROM tasks GROUP BY ALL",
    "pins_coloured": """SELECT tone, reason, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN reason IN ('file-not-found', 'drifted') THEN 'red' WHEN reason = 'green' THEN 'green' ELSE 'grey' END AS tone, reason FROM (
SELECT CASE WHEN n_nationkey = 3 THEN 'lock-refused' WHEN n_nationkey % 11 = 5 AND n_nationkey % 2 = 0 THEN 'file-not-found' WHEN n_nationkey % 11 = 5 THEN 'outside-domain' WHEN n_nationkey = 8 THEN 'malformed-fingerprint' WHEN n_nationkey = 9 THEN 'ambiguous' WHEN n_regionkey % 2 = 1 THEN 'drifted' ELSE 'green' END AS reason FROM nation)) GROUP BY ALL""",
    "orphan_runs": "SELECT CAST(event_id % 500 AS VARCHAR) AS run FROM events WHERE event_type = 'click' EXCEPT SELECT CAST(event_id % 500 AS VARCHAR) FROM events WHERE event_type = 'purchase'",
    "tree_digest_dirs": f"WITH {PAGES} SELECT DISTINCT split_part(path, '/', 1) AS path, CAST(64 AS BIGINT) AS digits FROM pages UNION ALL SELECT '', 64",
}
