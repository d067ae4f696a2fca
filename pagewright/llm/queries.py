"""The registered queries of the training-data operators, at production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import decontaminate, jaccard_join, licenses, mixing, quality, secret_scan, substring_dedup, token_counts, token_shards, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.write_shards(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return planned.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(table(spark, sf_dir, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > token_counts.LIMIT)


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_token_shards": op2_token_shards,
    "op3_mix_sources": op3_mix_sources,
    "op4_quality_rules": op4_quality_rules,
    "op5_token_counts": op5_token_counts,
    "op6_warc_round_trip": op6_warc_round_trip,
    "op7_secret_scan": op7_secret_scan,
    "op8_license_scan": op8_license_scan,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_decontaminate": op10_decontaminate,
}

OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), placed AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sums
), weighed AS (
  SELECT source, source_size, place, CASE place % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight,
         source_size * 2.0::DOUBLE AS cap FROM placed
), run AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS total,
         sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM weighed
), levelled AS (
  SELECT *, max((total - before) / rest) OVER () AS level FROM run
), targets AS (
  SELECT source, source_size, least(cap, level * weight) AS target,
         CASE WHEN source_size > 0 THEN least(cap, level * weight) / source_size ELSE 0 END AS rate FROM levelled
), planned AS (
  SELECT doc_id, size, source_size, target, rate,
         ('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM planned
"""

OP4_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, text, row_number() OVER () AS row_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t
), places AS (
  SELECT row_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3
), windows AS (
  SELECT row_id, i, count(*) OVER (PARTITION BY row_id, words[i], words[i + 1], words[i + 2]) AS n FROM places
), inside AS (
  SELECT row_id, count(DISTINCT p) AS n FROM (SELECT row_id, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE n > 1) GROUP BY row_id
), m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(inside.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
         len(list_filter(words, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS capitals,
         len(list_filter(words, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS letters
  FROM w LEFT JOIN inside USING (row_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * capitals > n_words OR 10 * letters < 6 * n_words) AS kept
FROM m
"""

OP6_SQL = """
WITH p AS (
  SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

OP8_SQL = (
    r"""
WITH parts AS (
  SELECT row_id, doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS place FROM (
    SELECT row_number() OVER () AS row_id, doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)) AS parts FROM documents)
), known(id, words) AS (
  VALUES """
    + ", ".join(f"('{name}', '{words}')" for name, words in licenses.SENTENCES.items())
    + r"""
), f0 AS (
  SELECT row_id, string_agg(id, ',' ORDER BY place) AS sentences, count(*) AS n_sentences, string_agg('|' || id || '|', '' ORDER BY place) AS l0
  FROM parts JOIN known ON words = trim(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g')) GROUP BY row_id
)"""
    + "".join(
        f""", f{i + 1} AS (SELECT * EXCLUDE (l{i}), contains(l{i}, '|{"||".join(ids)}|') AS hit_{i}, replace(l{i}, '|{"||".join(ids)}|', '#') AS l{i + 1} FROM f{i})"""
        for i, (_, ids) in enumerate(licenses.RULES)
    )
    + f"""
SELECT doc_id, CAST(coalesce(n_sentences, 0) AS BIGINT) AS n_sentences, coalesce(sentences, '') AS sentences,
       coalesce(array_to_string(list_filter([{", ".join(f"CASE WHEN hit_{i} {' '.join(f'AND NOT hit_{j}' for j in range(i) if licenses.RULES[j][0] == name)} THEN '{name}' END" for i, (name, _) in enumerate(licenses.RULES))}], lambda x: x IS NOT NULL), ','), '') AS licences,
       CAST(coalesce(len(list_filter(string_split(replace(l{len(licenses.RULES)}, '#', '|'), '|'), lambda x: x <> '')), 0) AS BIGINT) AS n_unclaimed
FROM (SELECT DISTINCT row_id, doc_id FROM parts) LEFT JOIN f{len(licenses.RULES)} USING (row_id)
"""
)

OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), sh AS (
  SELECT DISTINCT row_id, array_to_string(list_slice(words, i, i + 2), ' ') AS g
  FROM (SELECT row_id, words, unnest(range(1, greatest(1, len(words) - 2) + 1)) AS i FROM w WHERE len(words) > 0)
), n AS (
  SELECT row_id, count(*) AS n FROM sh GROUP BY row_id
), common AS (
  SELECT a.row_id AS x, b.row_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.row_id <> b.row_id GROUP BY ALL
), links AS (
  SELECT x, y FROM common JOIN n p ON p.row_id = x JOIN n q ON q.row_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)
), reach(x, y) AS (
  SELECT row_id, row_id FROM w UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
)
SELECT w.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM w LEFT JOIN n USING (row_id) JOIN reach ON reach.x = w.row_id JOIN w o ON o.row_id = reach.y GROUP BY w.row_id, w.doc_id
"""

OP10_SQL = r"""
WITH it AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, len(win) AS width, array_to_string(win, ' ') AS win FROM (
    SELECT item_id, list_slice(words, i, least(i + 9, len(words))) AS win FROM (
      SELECT item_id, words, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS i FROM it WHERE len(words) > 0))
), d AS (
  SELECT doc_id, row_number() OVER () AS row_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), widths AS (
  SELECT DISTINCT width FROM iw
), dw AS (
  SELECT row_id, i, width, array_to_string(list_slice(words, i, i + width - 1), ' ') AS win FROM (
    SELECT row_id, words, width, unnest(range(1, len(words) - width + 2)) AS i FROM d, widths)
), hits AS (
  SELECT dw.row_id, dw.i, dw.width, iw.item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.width = iw.width
), n AS (
  SELECT row_id, count(DISTINCT p) AS n_hit FROM (SELECT row_id, unnest(range(i, i + width)) AS p FROM hits) GROUP BY row_id
), its AS (
  SELECT row_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT row_id, item_id FROM hits) GROUP BY row_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (row_id) LEFT JOIN its USING (row_id)
"""

ORACLE = {
    "op4_quality_rules": OP4_SQL,
    "op6_warc_round_trip": OP6_SQL,
    "op8_license_scan": OP8_SQL,
    "op9_jaccard_join": OP9_SQL,
    "op10_decontaminate": OP10_SQL,
    "op3_mix_sources": OP3_SQL,
}
