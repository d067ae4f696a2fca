"""A workspace of pages built from the shared tables, so that what it holds follows from plain SQL.

Customers list their orders as tasks, orders link their parts by name or alias, some parts have a
second page in an archive (an ambiguous name), nations and regions are hubs, some links dangle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.session import table

FAMILIES = ("customers", "orders", "parts", "archive", "geo", "documents")


def text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def joined(rows: DataFrame, key: str, order: tuple[str, ...], line: Column, name: str) -> DataFrame:
    """The lines of each key, in order, one after the other."""
    listed = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["line"]), "").alias(name))


def customer_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus") == "F")
    orders = orders.toDF("o_custkey", "o_orderkey", "done")
    box = F.when(F.col("done"), "- [x] ship [[order-").otherwise("- [ ] ship [[order-")
    lists = joined(orders, "o_custkey", ("o_orderkey",), text(box, F.col("o_orderkey").cast("string"), "]]\n"), "lines")
    c = table(spark, sf_dir, "customer").join(lists, F.col("c_custkey") == F.col("o_custkey"), "left")
    k, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    up = F.when(F.col("c_custkey") % 4 == 0, text('up: "[[nation-', nation, ']]"\n')).otherwise("")
    notes = F.when(F.col("c_custkey") % 7 == 0, text("See [[lost-", k, "]] and ![[order-", k, "#Lines]].\n")).otherwise("Nothing.\n")
    raw = text(
        "---\ntype: customer\nstatus: ", F.col("c_mktsegment"), "\nowner: nation-", nation, "\ntags: [", F.lower("c_mktsegment"), ', "#vip"]\n', up, "---\nAbout ", F.col("c_name"),
        ".\n\n# Profile\n\nLives in [[nation-", nation, "|home]].\n\n## Orders\n\n", F.coalesce("lines", F.lit("")), "\n## Notes\n\n", notes,
    )
    return c.select(text("customers/customer-", k, ".md").alias("path"), raw.alias("raw"))


def order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("l_partkey").cast("string")
    target = F.when(F.col("l_partkey") % 3 == 0, text("alias ", part)).otherwise(text("part-", part))
    box = F.when(F.col("l_linestatus") == "F", "- [x] pick [[").otherwise("- [ ] pick [[")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus")
    lists = joined(items, "l_orderkey", ("l_linenumber", "l_partkey", "l_linestatus"), text(box, target, "]]\n"), "lines")
    o = table(spark, sf_dir, "orders").join(lists, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    k = F.col("o_orderkey").cast("string")
    again = F.when(F.col("o_orderkey") % 5 == 0, text("\n## Lines\n\nCounted twice. ^tail-", k, "\n")).otherwise("")
    raw = text(
        "---\ntype: order\nstatus: ", F.col("o_orderstatus"), "\nsession: ", F.date_format("o_orderdate", "yyyy-MM-dd"), "\n---\n# Order ", k,
        "\n\nFor [[customer-", F.col("o_custkey").cast("string"), "]].\n\n## Lines\n\n", F.coalesce("lines", F.lit("")), again,
    )
    return o.select(text("orders/order-", k, ".md").alias("path"), raw.alias("raw"))


def part_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("string")
    raw = text("---\ntype: part\naliases:\n  - Alias ", k, "\n---\n# ", F.col("p_name"), "\n\nBrand ", F.col("p_brand"), ", size ", F.col("p_size").cast("string"), ".\n")
    return p.select(text("parts/part-", k, ".md").alias("path"), raw.alias("raw"))


def archive_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where("p_partkey % 10 = 0")
    k = F.col("p_partkey").cast("string")
    return p.select(text("archive/part-", k, ".md").alias("path"), text("# Old part ", k, "\n\nNow [[parts/part-", k, "]], once [[part-", k, "]].\n").alias("raw"))


def geo_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(
        text("geo/nation-", F.col("n_nationkey").cast("string"), ".md").alias("path"),
        text("---\ntype: nation\n---\n# ", F.col("n_name"), "\n\nIn [[geo/region-", F.col("n_regionkey").cast("string"), "]].\n").alias("raw"),
    )
    r = table(spark, sf_dir, "region").select(text("geo/region-", F.col("r_regionkey").cast("string"), ".md").alias("path"), text("# ", F.col("r_name"), "\n").alias("raw"))
    return n.unionByName(r)


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select(text("documents/", F.col("doc_id").cast("string"), ".md").alias("path"), text("# Text\n\n", F.coalesce("text", F.lit("")), "\n").alias("raw"))


BUILDERS = {"customers": customer_pages, "orders": order_pages, "parts": part_pages, "archive": archive_pages, "geo": geo_pages, "documents": document_pages}


def workspace(spark: SparkSession, sf_dir: str, families: tuple[str, ...] = ("customers", "orders", "parts", "archive", "geo")) -> DataFrame:
    """The pages (path, raw) of the named families."""
    pages = [BUILDERS[f](spark, sf_dir) for f in families]
    out = pages[0]
    for more in pages[1:]:
        out = out.unionByName(more)
    return out


#: The same pages as DuckDB SQL, for the oracles: a CTE named pages(path, raw).
PAGES_SQL = """
customer_lines AS (
  SELECT o_custkey, string_agg(CASE WHEN o_orderstatus = 'F' THEN '- [x] ship [[order-' ELSE '- [ ] ship [[order-' END || o_orderkey || ']]' || chr(10), '' ORDER BY o_orderkey) AS lines
  FROM orders GROUP BY o_custkey
), order_lines AS (
  SELECT l_orderkey, string_agg(CASE WHEN l_linestatus = 'F' THEN '- [x] pick [[' ELSE '- [ ] pick [[' END || CASE WHEN l_partkey % 3 = 0 THEN 'alias ' ELSE 'part-' END || l_partkey || ']]' || chr(10), ''
         ORDER BY l_linenumber, l_partkey, l_linestatus) AS lines
  FROM lineitem GROUP BY l_orderkey
), pages AS (
  SELECT 'customers/customer-' || c_custkey || '.md' AS path,
    replace('---~type: customer~status: ' || c_mktsegment || '~owner: nation-' || c_nationkey || '~tags: [' || lower(c_mktsegment) || ', "#vip"]~'
    || CASE WHEN c_custkey % 4 = 0 THEN 'up: "[[nation-' || c_nationkey || ']]"~' ELSE '' END || '---~About ' || c_name || '.~~# Profile~~Lives in [[nation-' || c_nationkey || '|home]].~~## Orders~~'
    || coalesce(lines, '') || '~## Notes~~' || CASE WHEN c_custkey % 7 = 0 THEN 'See [[lost-' || c_custkey || ']] and ![[order-' || c_custkey || '#Lines]].~' ELSE 'Nothing.~' END, '~', chr(10)) AS raw
  FROM customer LEFT JOIN customer_lines ON c_custkey = o_custkey
  UNION ALL
  SELECT 'orders/order-' || o_orderkey || '.md',
    replace('---~type: order~status: ' || o_orderstatus || '~session: ' || strftime(o_orderdate, '%Y-%m-%d') || '~---~# Order ' || o_orderkey || '~~For [[customer-' || o_custkey || ']].~~## Lines~~'
    || coalesce(lines, '') || CASE WHEN o_orderkey % 5 = 0 THEN '~## Lines~~Counted twice. ^tail-' || o_orderkey || '~' ELSE '' END, '~', chr(10))
  FROM orders LEFT JOIN order_lines ON o_orderkey = l_orderkey
  UNION ALL
  SELECT 'parts/part-' || p_partkey || '.md', replace('---~type: part~aliases:~  - Alias ' || p_partkey || '~---~# ' || p_name || '~~Brand ' || p_brand || ', size ' || p_size || '.~', '~', chr(10)) FROM part
  UNION ALL
  SELECT 'archive/part-' || p_partkey || '.md', replace('# Old part ' || p_partkey || '~~Now [[parts/part-' || p_partkey || ']], once [[part-' || p_partkey || ']].~', '~', chr(10)) FROM part WHERE p_partkey % 10 = 0
  UNION ALL
  SELECT 'geo/nation-' || n_nationkey || '.md', replace('---~type: nation~---~# ' || n_name || '~~In [[geo/region-' || n_regionkey || ']].~', '~', chr(10)) FROM nation
  UNION ALL
  SELECT 'geo/region-' || r_regionkey || '.md', replace('# ' || r_name || '~', '~', chr(10)) FROM region
)"""
