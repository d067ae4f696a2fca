"""Relational coverage of the SQL door: each text runs as it stands, or in two spellings where the dialects differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.plans import sql_door
from pagewright.session import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: The same text in both engines; the door rewrites what Spark spells differently.
SAME = {
    "join_inner": "SELECT o.o_orderkey, c.c_name, o.o_totalprice FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING'",
    "join_left": "SELECT c.c_custkey, CAST(count(o.o_orderkey) AS BIGINT) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey",
    "join_right": "SELECT n.n_nationkey, CAST(count(s.s_suppkey) AS BIGINT) AS n FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY n.n_nationkey",
    "join_full": "SELECT a.k AS left_key, b.k AS right_key FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0) a FULL OUTER JOIN (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 = 0) b ON a.k = b.k",
    "join_semi": "SELECT c_custkey, c_name FROM customer SEMI JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F'",
    "join_anti": "SELECT p_partkey FROM part ANTI JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 45",
    "join_not_exists": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 490000)",
    "join_using": "SELECT k, a, b FROM (SELECT n_regionkey AS k, count(*) AS a FROM nation GROUP BY 1) JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) USING (k)",
    "join_natural": "SELECT k, a, b FROM (SELECT n_regionkey AS k, min(n_name) AS a FROM nation GROUP BY 1) NATURAL JOIN (SELECT r_regionkey AS k, r_name AS b FROM region)",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_three_way": "SELECT r.r_name, CAST(count(*) AS BIGINT) AS n, round(sum(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name",
    "join_range": "SELECT e.event_id, w.lo FROM events e JOIN (SELECT DISTINCT CAST(floor(value / 10) * 10 AS BIGINT) AS lo FROM events) w ON e.value >= w.lo AND e.value < w.lo + 10 WHERE e.event_type = 'purchase'",
    "join_range_within_key": "SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_id > a.event_id AND b.event_id <= a.event_id + 200 WHERE a.event_type = 'click' AND b.event_type = 'purchase'",
    "join_correlated": "SELECT o_orderkey, (SELECT max(l_quantity) FROM lineitem WHERE l_orderkey = o_orderkey) AS most FROM orders WHERE o_orderstatus = 'P'",
    "scan_filter_project": "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS price FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01 00:00:00' AND l_returnflag <> 'N'",
    "predicate_in_between_like": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'red%' AND p_size BETWEEN 5 AND 25 AND p_type IN ('ECONOMY', 'SMALL')",
    "predicate_case_coalesce": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'high' END AS class, coalesce(nullif(c_mktsegment, 'BUILDING'), '-') AS segment FROM customer",
    "agg_group_having": "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(avg(l_quantity), 4) AS mean, min(l_discount) AS low, max(l_tax) AS high FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10",
    "agg_filtered": "SELECT o_orderpriority, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS filled, max(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS top FROM orders GROUP BY o_orderpriority",
    "agg_distinct": "SELECT l_returnflag, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS suppliers FROM lineitem GROUP BY l_returnflag",
    "agg_all": "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL",
    "agg_bool": "SELECT user_id, bool_or(event_type = 'error') AS failed, bool_and(value > 1) AS paid FROM events GROUP BY user_id",
    "agg_stddev_corr": "SELECT l_linestatus, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS var, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY l_linestatus",
    "agg_rollup": "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "agg_cube": "SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "agg_grouping_sets": "SELECT p_brand, p_type, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), ())",
    "agg_median": "SELECT l_returnflag, median(l_quantity) AS mid FROM lineitem GROUP BY l_returnflag",
    "window_rank": "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS place, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS dense, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders",
    "window_lag_lead": "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before, lead(value, 2) OVER (PARTITION BY user_id ORDER BY event_id) AS later FROM events",
    "window_frame": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS three, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top, CAST(count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 500 PRECEDING AND CURRENT ROW) AS BIGINT) AS near FROM events",
    "window_first_last": "SELECT event_id, first_value(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS first_type, last_value(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_type FROM events",
    "window_ntile": "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS quarter, round(percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_custkey), 6) AS share, round(cume_dist() OVER (PARTITION BY c_nationkey ORDER BY c_custkey), 6) AS below FROM customer",
    "window_qualify": "SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "sort_topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25",
    "sort_offset": "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10 OFFSET 20",
    "set_union_all": "SELECT s_nationkey AS nation, 'supplier' AS kind FROM supplier UNION ALL SELECT c_nationkey, 'customer' FROM customer",
    "set_union": "SELECT s_nationkey AS nation FROM supplier UNION SELECT c_nationkey FROM customer",
    "set_intersect": "SELECT s_nationkey AS nation FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 5000",
    "set_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 100000",
    "set_except_all": "SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer",
    "cte_nested": "WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), ranked AS (SELECT o_custkey, total, row_number() OVER (ORDER BY total DESC, o_custkey) AS place FROM spend) SELECT o_custkey, round(total, 2) AS total, place FROM ranked WHERE place <= 20",
    "scalar_string": "SELECT c_custkey, upper(c_name) AS a, substring(c_name, 1, 8) AS b, length(c_name) AS c, replace(c_name, '#', '-') AS d, trim('  x ') AS e, concat(c_mktsegment, ':', c_name) AS f, lpad(CAST(c_custkey AS VARCHAR(20)), 8, '0') AS g, reverse(c_mktsegment) AS h FROM customer",
    "scalar_math": "SELECT l_orderkey, l_linenumber, l_partkey, abs(l_discount - 0.05) > 0.02 AS a, CAST(floor(l_extendedprice / 1000) AS BIGINT) AS b, CAST(ceil(l_extendedprice / 1000) AS BIGINT) AS c, round(sqrt(l_quantity), 6) AS d, l_partkey % 7 AS e, round(ln(l_extendedprice), 6) AS f, round(power(l_quantity, 2), 2) AS g, CAST(sign(l_tax - 0.04) AS INT) AS h FROM lineitem",
    "scalar_conditional": "SELECT event_id, greatest(value, 10.0) AS a, least(value, 10.0) AS b, nullif(event_type, 'view') AS c, if(value > 50, 'big', 'small') AS d FROM events",
    "scalar_date": "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(quarter(o_orderdate) AS BIGINT) AS q, date_trunc('month', o_orderdate) AS month_start, CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) AS d FROM orders",
    "information_schema": "SELECT c.table_name, c.column_name, CAST(c.ordinal_position AS BIGINT) AS ordinal_position, t.table_type FROM information_schema.columns c JOIN Information_Schema . tables t ON t.table_name = c.table_name WHERE c.table_name IN ('region', 'nation')",
    "scalar_regex": "SELECT c_custkey, regexp_replace(c_name, '[0-9]+', 'N') AS a, regexp_extract(c_name, '([A-Za-z]+)#', 1) AS b, regexp_matches(c_name, '0{5}') AS c FROM customer",
    "scalar_bytes": "SELECT n_name, strlen(n_name) AS bytes, starts_with(n_name, 'NATION') AS a, ends_with(n_name, '1') AS b, contains(n_name, '_2') AS c, md5(n_name) AS d FROM nation",
    "scalar_cast": "SELECT event_id, CAST(value AS BIGINT) >= 0 AS a, try_cast(event_type AS INT) AS b, CAST(event_id AS VARCHAR(20)) AS c, (value * 100)::BIGINT > 500 AS d FROM events",
    "unnested": "SELECT n_nationkey, unnest(string_split(n_name, '_')) AS part FROM nation",
    "tpch_q1": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_discount), 6) AS avg_disc, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "tpch_q3": "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10",
    "tpch_q5": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' GROUP BY n_name",
    "tpch_q6": "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "tpch_q18": "SELECT c_custkey, o_orderkey, round(sum(l_quantity), 2) AS quantity FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 150) GROUP BY c_custkey, o_orderkey",
    "history_latest": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "history_live": "SELECT user_id, event_id FROM (SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) latest WHERE event_type <> 'error'",
}

#: name -> (Spark, DuckDB)
PAIRS = {
    # Of equal prices DuckDB takes the row that it meets first (on one thread, that is the smallest key of a table stored by key), and passes over rows with a null.
    "agg_max_by": (
        "SELECT o_custkey, max_by(o_orderkey, CASE WHEN o_orderkey IS NOT NULL AND o_totalprice IS NOT NULL THEN struct(o_totalprice, ~o_orderkey) END) AS top_order, min_by(o_orderkey, CASE WHEN o_orderkey IS NOT NULL AND o_totalprice IS NOT NULL THEN struct(o_totalprice, o_orderkey) END) AS low_order FROM orders GROUP BY o_custkey",
        "SELECT o_custkey, max_by(o_orderkey, o_totalprice) AS top_order, min_by(o_orderkey, o_totalprice) AS low_order FROM orders GROUP BY o_custkey",
    ),
    "agg_listed": (
        "SELECT c_nationkey, listagg(c_mktsegment, '|') WITHIN GROUP (ORDER BY c_mktsegment, c_custkey) AS segments FROM customer GROUP BY c_nationkey",
        "SELECT c_nationkey, string_agg(c_mktsegment, '|' ORDER BY c_mktsegment, c_custkey) AS segments FROM customer GROUP BY c_nationkey",
    ),
    "pivoted": (
        "SELECT * FROM (SELECT user_id, event_type, value FROM events) PIVOT (count(value) FOR event_type IN ('click' AS click, 'view' AS view, 'error' AS error))",
        "SELECT user_id, CASE WHEN count(*) FILTER (WHERE event_type = 'click') > 0 THEN CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) END AS click, CASE WHEN count(*) FILTER (WHERE event_type = 'view') > 0 THEN CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) END AS view, CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) END AS error FROM events GROUP BY user_id",
    ),
    "lateral": (
        "SELECT n.n_name, t.c_custkey FROM nation n, LATERAL (SELECT c_custkey FROM customer c WHERE c.c_nationkey = n.n_nationkey ORDER BY c_custkey LIMIT 1) t",
        "SELECT n.n_name, t.c_custkey FROM nation n, LATERAL (SELECT c_custkey FROM customer c WHERE c.c_nationkey = n.n_nationkey ORDER BY c_custkey LIMIT 1) t",
    ),
    "recursive": (
        "WITH RECURSIVE t(n, s) MAX RECURSION LEVEL 200 AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, s + n + 1 FROM t WHERE n < 150) SELECT n, s FROM t",
        "WITH RECURSIVE t(n, s) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, s + n + 1 FROM t WHERE n < 150) SELECT n, s FROM t",
    ),
    "scalar_json": (
        "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events",
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    ),
    "scalar_arrays": (
        "SELECT r_regionkey, size(names) AS n, array_join(names, ',') AS names, names[0] AS first_name, array_contains(names, 'NATION_3') AS has_3 FROM (SELECT n_regionkey AS r_regionkey, array_sort(collect_list(n_name)) AS names FROM nation GROUP BY 1)",
        "SELECT r_regionkey, CAST(len(names) AS INTEGER) AS n, array_to_string(names, ',') AS names, names[1] AS first_name, list_contains(names, 'NATION_3') AS has_3 FROM (SELECT n_regionkey AS r_regionkey, list(n_name ORDER BY n_name) AS names FROM nation GROUP BY 1)",
    ),
    "join_asof": (
        "SELECT p.event_id, max_by(c.event_id, c.event_id) AS before_id FROM events p LEFT JOIN events c ON c.user_id = p.user_id AND c.event_type = 'click' AND c.ts <= p.ts WHERE p.event_type = 'purchase' GROUP BY p.event_id",
        "SELECT p.event_id, c.event_id AS before_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts",
    ),
    "relation_digest": (
        "SELECT md5(listagg(concat(n_name, ':', CAST(n_regionkey AS STRING)), '|') WITHIN GROUP (ORDER BY n_nationkey)) AS digest FROM nation",
        "SELECT md5(string_agg(n_name || ':' || n_regionkey, '|' ORDER BY n_nationkey)) AS digest FROM nation",
    ),
    "windows_by_time": (
        "SELECT date_trunc('hour', w.start) AS begins, event_type, count(*) AS n FROM (SELECT window(ts, '6 hours') AS w, event_type FROM events) GROUP BY ALL",
        "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS begins, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL",
    ),
    "sessions": (
        "SELECT user_id, count(*) AS sessions FROM (SELECT user_id, session_window(ts, '12 hours') AS w FROM events GROUP BY user_id, session_window(ts, '12 hours')) GROUP BY user_id",
        "SELECT user_id, CAST(sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 12 HOUR THEN 1 ELSE 0 END) AS BIGINT) AS sessions FROM (SELECT user_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events) GROUP BY user_id",
    ),
}


def _query(sql: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        sql_door.register(spark, {t: table(spark, sf_dir, t) for t in TABLES})
        return sql_door.run(spark, sql)

    return query


QUERIES = {f"sql_{n}": _query(sql) for n, sql in SAME.items()} | {f"sql_{n}": _query(spark) for n, (spark, _) in PAIRS.items()}
ORACLE = {f"sql_{n}": sql for n, sql in SAME.items()} | {f"sql_{n}": duck for n, (_, duck) in PAIRS.items()}
