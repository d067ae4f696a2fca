"""Queries over the synthesized workspace; the oracles compute the same rows from the tables alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import project, resolve, views
from pagewright.sources import scratch, synth

ALL = ("customers", "orders", "parts", "archive", "geo")
PAGES = synth.PAGES_SQL


def projection(spark: SparkSession, sf_dir: str, families=ALL, anew: bool = False) -> views.Workspace:
    """The workspace's projection, written once for the tables as they are: parsed pages, and every link with its destination."""
    seen = scratch.signature(spark, sf_dir)
    pages = scratch.kept(spark, ("parsed", sf_dir, seen, families), lambda: project.parse_pages(synth.workspace(spark, sf_dir, families)), "parsed", anew)
    found = views.Workspace(pages).destinations()
    return views.Workspace(pages, {name: scratch.kept(spark, (name, sf_dir, seen, families), lambda df=df: df, name, anew) for name, df in found.items()})


def parsed(spark: SparkSession, sf_dir: str, families=ALL) -> DataFrame:
    """The parsed pages of the projection."""
    return projection(spark, sf_dir, families).parsed


def space(spark: SparkSession, sf_dir: str, families=ALL) -> views.Workspace:
    return projection(spark, sf_dir, families)


def named(spark: SparkSession, sf_dir: str, families=ALL) -> views.Workspace:
    """The workspace's pages, aliases and links (seq, target_raw): from the projection where it is written, else parsed for these alone."""
    seen = scratch.signature(spark, sf_dir)
    if all(scratch.held(spark, (name, sf_dir, seen, families)) for name in ("parsed", *views.RESOLVED)):
        return projection(spark, sf_dir, families)
    return views.Workspace(scratch.kept(spark, ("named", sf_dir, seen, families), lambda: project.parse_names(synth.workspace(spark, sf_dir, families)), "named"))


def project_workspace(spark, sf_dir):
    """The cold build: every page parsed and every link resolved anew, and written; rows by relation. Later queries read it."""
    fresh = projection(spark, sf_dir, anew=True).parsed
    sizes = [F.sum(F.size(n)).cast("long").alias(n) for n in ("frontmatter", "section", "link", "task", "body", "anchor")]
    return fresh.agg(*sizes).unpivot([], list(fresh.agg(*sizes).columns), "relation", "n")


def rel_doc(spark, sf_dir):
    return space(spark, sf_dir).doc.select("path", F.col("line_count").cast("long").alias("line_count"), "bytes")


def rel_frontmatter(spark, sf_dir):
    return space(spark, sf_dir).frontmatter.select("path", "ord", "key", "value")


def rel_section(spark, sf_dir):
    return space(spark, sf_dir).section.select("path", "node_seq", "heading", F.col("level").cast("long").alias("level"), "n", "hpath")


def rel_link(spark, sf_dir):
    return space(spark, sf_dir).link.select("src_path", "seq", "kind", "target_raw", "heading", "alias", "dest_path", F.array_join("candidates", ",").alias("candidates"))


def rel_frontmatter_link(spark, sf_dir):
    return space(spark, sf_dir, ("customers", "geo")).frontmatter_link.select("src_path", "seq", "key", "target_raw", "dest_path")


def rel_frontmatter_tag(spark, sf_dir):
    return space(spark, sf_dir, ("customers",)).frontmatter_tag.select("path", "seq", "tag", "key")


def rel_task(spark, sf_dir):
    return space(spark, sf_dir, ("customers", "orders")).task.select("path", "seq", "checked", F.col("depth").cast("long").alias("depth"), "section_seq", "hpath", "text")


def rel_body(spark, sf_dir):
    return space(spark, sf_dir).body.select("path", "seq", "section_seq", "hpath", "text", (F.col("span_end") - F.col("span_start")).alias("bytes"))


def rel_anchor(spark, sf_dir):
    return space(spark, sf_dir, ("orders",)).anchor.select("path", "id", (F.col("span_end") - F.col("span_start")).alias("bytes"))


def view_backlink(spark, sf_dir):
    ws = space(spark, sf_dir)
    return views.backlink(ws.link, ws.frontmatter_link)


def view_dangling(spark, sf_dir):
    return views.dangling(space(spark, sf_dir).link)


def view_record(spark, sf_dir):
    ws = space(spark, sf_dir)
    return views.record(ws.doc, ws.frontmatter)


def view_tag_all(spark, sf_dir):
    return views.tag_all(None, space(spark, sf_dir).frontmatter_tag).select("path", "tag", "source")


def link_edges(spark, sf_dir):
    return resolve.edge_counts(space(spark, sf_dir).link)


def link_census(spark, sf_dir):
    return resolve.census(space(spark, sf_dir).link)


def link_subpath(spark, sf_dir):
    ws = space(spark, sf_dir, ("customers", "orders"))
    found = resolve.subpath(ws.link, ws.section, ws.anchor)
    return found.select("src_path", "dest_path", "heading", F.col("dest_start").isNotNull().alias("found"))


def top_linked_pages(spark, sf_dir):
    """Flagship: resolve every link, count who links where, rank."""
    linked = view_backlink(spark, sf_dir).groupBy("path").agg(F.count("*").alias("links"), F.countDistinct("src_path").alias("pages"))
    return linked.orderBy(F.desc("links"), "path").limit(50)


def body_store_dedup(spark, sf_dir):
    """Chunks of document pages by content: one stored text for each distinct one."""
    body = space(spark, sf_dir, ("documents",)).body
    return body.groupBy(F.md5("text").alias("text_md5")).agg(F.count("*").alias("chunks"), F.countDistinct("path").alias("pages"))


def node_kinds(spark, sf_dir):
    facts = project.node_facts(parsed(spark, sf_dir))
    return facts.groupBy("kind").agg(F.count("*").alias("nodes"))


NAMES = ("project_workspace", "rel_doc", "rel_frontmatter", "rel_section", "rel_link", "rel_frontmatter_link", "rel_frontmatter_tag", "rel_task", "rel_body", "rel_anchor", "view_backlink", "view_dangling", "view_record", "view_tag_all", "link_edges", "link_census", "link_subpath", "top_linked_pages", "body_store_dedup", "node_kinds")
QUERIES = {n: globals()[n] for n in NAMES}

#: Every link of the workspace, straight from the tables.
LINKS = """
part_dest AS (
  SELECT p_partkey, 'parts/part-' || p_partkey || '.md' AS dest, CASE WHEN p_partkey % 10 = 0 THEN 'archive/part-' || p_partkey || '.md,parts/part-' || p_partkey || '.md' END AS candidates FROM part
), links AS (
  SELECT 'customers/customer-' || c_custkey || '.md' AS src_path, 0 AS seq, 'wikilink' AS kind, 'nation-' || c_nationkey AS target_raw, NULL AS heading, 'home' AS alias, 'geo/nation-' || c_nationkey || '.md' AS dest_path, NULL AS candidates FROM customer
  UNION ALL
  SELECT 'customers/customer-' || o_custkey || '.md', row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 'wikilink', 'order-' || o_orderkey, NULL, NULL, 'orders/order-' || o_orderkey || '.md', NULL FROM orders JOIN customer ON c_custkey = o_custkey
  UNION ALL
  SELECT 'customers/customer-' || c_custkey || '.md', 1 + coalesce(n, 0) + i, ['wikilink', 'embed'][i + 1], ['lost-', 'order-'][i + 1] || c_custkey, [NULL, 'Lines'][i + 1], NULL,
         CASE WHEN i = 1 AND c_custkey IN (SELECT o_orderkey FROM orders) THEN 'orders/order-' || c_custkey || '.md' END, NULL
  FROM (SELECT c_custkey, unnest([0, 1]) AS i FROM customer WHERE c_custkey % 7 = 0) LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey
  UNION ALL
  SELECT 'orders/order-' || o_orderkey || '.md', 0, 'wikilink', 'customer-' || o_custkey, NULL, NULL, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer) THEN 'customers/customer-' || o_custkey || '.md' END, NULL FROM orders
  UNION ALL
  SELECT 'orders/order-' || l_orderkey || '.md', row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_linestatus), 'wikilink', CASE WHEN l_partkey % 3 = 0 THEN 'alias ' ELSE 'part-' END || l_partkey, NULL, NULL,
         dest, CASE WHEN l_partkey % 3 <> 0 THEN candidates END FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN part_dest ON p_partkey = l_partkey
  UNION ALL
  SELECT 'archive/part-' || p_partkey || '.md', i, 'wikilink', ['parts/part-', 'part-'][i + 1] || p_partkey, NULL, NULL, ['parts/part-', 'archive/part-'][i + 1] || p_partkey || '.md', CASE WHEN i = 1 THEN candidates END
  FROM (SELECT p_partkey, candidates, unnest([0, 1]) AS i FROM part_dest WHERE p_partkey % 10 = 0)
  UNION ALL
  SELECT 'geo/nation-' || n_nationkey || '.md', 0, 'wikilink', 'geo/region-' || n_regionkey, NULL, NULL, 'geo/region-' || n_regionkey || '.md', NULL FROM nation
)"""

HEAD_LINKS = "head_links AS (SELECT 'customers/customer-' || c_custkey || '.md' AS src_path, 0 AS seq, 'up' AS key, 'nation-' || c_nationkey AS target_raw, 'geo/nation-' || c_nationkey || '.md' AS dest_path FROM customer WHERE c_custkey % 4 = 0)"
BACKLINKS = "backlinks AS (SELECT dest_path AS path, src_path, kind, alias, NULL AS key FROM links WHERE dest_path IS NOT NULL UNION ALL SELECT dest_path, src_path, 'frontmatter', NULL, key FROM head_links)"

SECTIONS = """
heads AS (
  SELECT 'customers/customer-' || c_custkey || '.md' AS path, unnest([0, 1, 2]) AS node_seq, unnest(['Profile', 'Orders', 'Notes']) AS heading, unnest([1, 2, 2]) AS level, NULL AS n, unnest(['[{"h":"Profile"}]', '[{"h":"Profile"},{"h":"Orders"}]', '[{"h":"Profile"},{"h":"Notes"}]']) AS hpath FROM customer
  UNION ALL
  SELECT 'orders/order-' || o_orderkey || '.md', i, CASE i WHEN 0 THEN 'Order ' || o_orderkey ELSE 'Lines' END, CASE i WHEN 0 THEN 1 ELSE 2 END, CASE WHEN i > 0 AND o_orderkey % 5 = 0 THEN i END,
         '[{"h":"Order ' || o_orderkey || '"}' || CASE WHEN i > 0 THEN ',{"h":"Lines"' || CASE WHEN o_orderkey % 5 = 0 THEN ',"n":' || i ELSE '' END || '}' ELSE '' END || ']'
  FROM (SELECT o_orderkey, unnest(CASE WHEN o_orderkey % 5 = 0 THEN [0, 1, 2] ELSE [0, 1] END) AS i FROM orders)
  UNION ALL
  SELECT 'parts/part-' || p_partkey || '.md', 0, p_name, 1, NULL, '[{"h":"' || p_name || '"}]' FROM part
  UNION ALL
  SELECT 'archive/part-' || p_partkey || '.md', 0, 'Old part ' || p_partkey, 1, NULL, '[{"h":"Old part ' || p_partkey || '"}]' FROM part WHERE p_partkey % 10 = 0
  UNION ALL
  SELECT 'geo/nation-' || n_nationkey || '.md', 0, n_name, 1, NULL, '[{"h":"' || n_name || '"}]' FROM nation
  UNION ALL
  SELECT 'geo/region-' || r_regionkey || '.md', 0, r_name, 1, NULL, '[{"h":"' || r_name || '"}]' FROM region
)"""

PROPERTIES = """
props AS (
  SELECT 'customers/customer-' || c_custkey || '.md' AS path, unnest([0, 1, 2, 3]) AS ord, unnest(['type', 'status', 'owner', 'tags']) AS key, unnest(['customer', c_mktsegment, 'nation-' || c_nationkey, '[' || lower(c_mktsegment) || ', "#vip"]']) AS value FROM customer
  UNION ALL SELECT 'customers/customer-' || c_custkey || '.md', 4, 'up', '[[nation-' || c_nationkey || ']]' FROM customer WHERE c_custkey % 4 = 0
  UNION ALL SELECT 'orders/order-' || o_orderkey || '.md', unnest([0, 1, 2]), unnest(['type', 'status', 'session']), unnest(['order', o_orderstatus, strftime(o_orderdate, '%Y-%m-%d')]) FROM orders
  UNION ALL SELECT 'parts/part-' || p_partkey || '.md', unnest([0, 1]), unnest(['type', 'aliases']), unnest(['part', '[Alias ' || p_partkey || ']']) FROM part
  UNION ALL SELECT 'geo/nation-' || n_nationkey || '.md', 0, 'type', 'nation' FROM nation
)"""

TASKS = """
tasks AS (
  SELECT 'customers/customer-' || o_custkey || '.md' AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS seq, o_orderstatus = 'F' AS checked, 'ship [[order-' || o_orderkey || ']]' AS text, '[{"h":"Profile"},{"h":"Orders"}]' AS hpath FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL
  SELECT 'orders/order-' || l_orderkey || '.md', row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_linestatus) - 1, l_linestatus = 'F', 'pick [[' || CASE WHEN l_partkey % 3 = 0 THEN 'alias ' ELSE 'part-' END || l_partkey || ']]',
         '[{"h":"Order ' || l_orderkey || '"},{"h":"Lines"' || CASE WHEN l_orderkey % 5 = 0 THEN ',"n":1' ELSE '' END || '}]' FROM lineitem JOIN orders ON o_orderkey = l_orderkey
)"""

#: Body chunks by cutting the page text at its headings; headings are lines that begin with # here.
BODIES = """
head_at AS (
  SELECT path, raw, CASE WHEN raw LIKE '---%' THEN instr(substr(raw, 5), '---' || chr(10)) + 7 ELSE 0 END AS head FROM pages
), cut AS (
  SELECT path, row_number() OVER (PARTITION BY path ORDER BY i) AS nth, i, piece FROM (
    SELECT path, unnest(pieces) AS piece, unnest(range(len(pieces))) AS i FROM (SELECT path, string_split(chr(10) || substr(raw, head + 1), chr(10) || '#') AS pieces FROM head_at))
), chunks AS (
  SELECT path, i, CASE WHEN i = 0 THEN substr(piece, 2) ELSE substr(piece, instr(piece, chr(10)) + 1) END AS text FROM cut
), ended AS (
  SELECT path, i, text || CASE WHEN i < max(i) OVER (PARTITION BY path) AND (i > 0 OR text <> '') THEN chr(10) ELSE '' END AS text FROM chunks
), bodies AS (
  SELECT path, row_number() OVER (PARTITION BY path ORDER BY i) - 1 AS seq, CASE WHEN i > 0 THEN i - 1 END AS section_seq, text FROM ended WHERE i > 0 OR text <> ''
)"""

ORACLE = {
    "project_workspace": f"""WITH {PAGES}, {LINKS}, {SECTIONS}, {PROPERTIES}, {TASKS}, {BODIES} SELECT 'frontmatter' AS relation, CAST(count(*) AS BIGINT) AS n FROM props UNION ALL SELECT 'section', count(*) FROM heads UNION ALL SELECT 'link', count(*) FROM links
UNION ALL SELECT 'task', count(*) FROM tasks UNION ALL SELECT 'body', count(*) FROM bodies UNION ALL SELECT 'anchor', count(*) FROM orders WHERE o_orderkey % 5 = 0""",
    "rel_doc": f"WITH {PAGES} SELECT path, CAST(length(raw) - length(replace(raw, chr(10), '')) AS BIGINT) AS line_count, CAST(strlen(raw) AS BIGINT) AS bytes FROM pages",
    "rel_frontmatter": f"WITH {PROPERTIES} SELECT path, CAST(ord AS BIGINT) AS ord, key, value FROM props",
    "rel_section": f"WITH {SECTIONS} SELECT path, CAST(node_seq AS BIGINT) AS node_seq, heading, CAST(level AS BIGINT) AS level, CAST(n AS BIGINT) AS n, hpath FROM heads",
    "rel_link": f"WITH {LINKS} SELECT src_path, CAST(seq AS BIGINT) AS seq, kind, target_raw, heading, alias, dest_path, candidates FROM links",
    "rel_frontmatter_link": f"WITH {HEAD_LINKS} SELECT src_path, CAST(seq AS BIGINT) AS seq, key, target_raw, dest_path FROM head_links",
    "rel_frontmatter_tag": "SELECT 'customers/customer-' || c_custkey || '.md' AS path, CAST(unnest([0, 1]) AS BIGINT) AS seq, unnest([lower(c_mktsegment), 'vip']) AS tag, 'tags' AS key FROM customer",
    "rel_task": f"WITH {TASKS} SELECT path, CAST(seq AS BIGINT) AS seq, checked, CAST(1 AS BIGINT) AS depth, CAST(1 AS BIGINT) AS section_seq, hpath, text FROM tasks",
    "rel_body": f"WITH {PAGES}, {SECTIONS}, {BODIES} SELECT b.path, CAST(seq AS BIGINT) AS seq, CAST(section_seq AS BIGINT) AS section_seq, hpath, text, CAST(strlen(text) AS BIGINT) AS bytes FROM bodies b LEFT JOIN heads h ON h.path = b.path AND h.node_seq = b.section_seq",
    "rel_anchor": "SELECT 'orders/order-' || o_orderkey || '.md' AS path, 'tail-' || o_orderkey AS id, CAST(strlen('Counted twice. ^tail-' || o_orderkey) AS BIGINT) AS bytes FROM orders WHERE o_orderkey % 5 = 0",
    "view_backlink": f"WITH {LINKS}, {HEAD_LINKS}, {BACKLINKS} SELECT * FROM backlinks",
    "view_dangling": f"WITH {LINKS} SELECT src_path, target_raw FROM links WHERE dest_path IS NULL",
    "view_record": f"WITH {PAGES}, {PROPERTIES} SELECT pages.path, max(value) FILTER (WHERE key = 'type') AS type, max(value) FILTER (WHERE key = 'status') AS status, max(value) FILTER (WHERE key = 'owner') AS owner, max(value) FILTER (WHERE key = 'session') AS session FROM pages LEFT JOIN props ON props.path = pages.path GROUP BY 1",
    "view_tag_all": "SELECT 'customers/customer-' || c_custkey || '.md' AS path, unnest([lower(c_mktsegment), 'vip']) AS tag, 'frontmatter' AS source FROM customer",
    "link_edges": f"WITH {LINKS} SELECT src_path, CASE WHEN dest_path IS NULL THEN 'unresolved' ELSE 'resolved' END AS channel, coalesce(dest_path, target_raw) AS key, CAST(count(*) AS BIGINT) AS n FROM links GROUP BY ALL",
    "link_census": f"WITH {LINKS} SELECT CAST(count(dest_path) AS BIGINT) AS resolved, CAST(count(*) - count(dest_path) AS BIGINT) AS dangling, CAST(0 AS BIGINT) AS rooted FROM links",
    "link_subpath": f"WITH {LINKS} SELECT src_path, dest_path, heading, dest_path IS NOT NULL AS found FROM links WHERE heading IS NOT NULL",
    "top_linked_pages": f"WITH {LINKS}, {HEAD_LINKS}, {BACKLINKS} SELECT path, CAST(count(*) AS BIGINT) AS links, CAST(count(DISTINCT src_path) AS BIGINT) AS pages FROM backlinks GROUP BY path ORDER BY links DESC, path LIMIT 50",
    "body_store_dedup": "SELECT md5(chr(10) || coalesce(text, '') || chr(10)) AS text_md5, CAST(count(*) AS BIGINT) AS chunks, CAST(count(DISTINCT doc_id) AS BIGINT) AS pages FROM documents GROUP BY 1",
    "node_kinds": f"WITH {PAGES}, {SECTIONS}, {PROPERTIES} SELECT 'document' AS kind, CAST(count(*) AS BIGINT) AS nodes FROM pages UNION ALL SELECT 'section', count(*) FROM heads UNION ALL SELECT 'frontmatter', count(DISTINCT path) FROM props UNION ALL SELECT 'anchor', count(*) FROM orders WHERE o_orderkey % 5 = 0",
}
