"""The pipeline's stages one after the other, each against what it may and may not drop."""

import os

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from pagewright.llm import quality
from pagewright.llm.common import materialise


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], sf_dir), f"test-{name}"))
    return out


def test_stages(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_copies", "benchmark_words", "source_mix", "token_shards"]
    for before, after in zip(stages, stages[1:-1]):
        assert after.columns == before.columns
    texts = [{r.text for r in s.select("text").collect()} for s in stages[:-1]]
    assert texts[1] == {t for t in texts[0] if quality.passes(quality.Measures((t or "").encode()), quality.RULES)}
    assert texts[3] <= texts[2] <= texts[1] and texts[4] <= texts[3]
    assert stages[2].count() == len(texts[2])
    held = {d for r in stages[5].select("doc_ids").collect() for d in r.doc_ids}
    assert held == {r.doc_id for r in stages[4].select("doc_id").collect()}


def test_registered_queries_against_sql(spark, sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    mine = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in mine) == list(range(1, 11))
    for name in mine:
        if sql := __spark_entry__.oracle_sql().get(name):
            df, expected = __spark_entry__.queries()[name](spark, sf_dir), con.sql(sql)
            assert sorted(df.columns) == sorted(expected.columns)
            names = sorted(df.columns)
            got = sorted(str([r[n] for n in names]) for r in df.collect())
            at = [expected.columns.index(n) for n in names]
            assert got == sorted(str([r[i] for i in at]) for r in expected.fetchall()), name
