"""Session defaults shared by the entry point, the bench and the tests."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session with this library's defaults; `extra` adds or replaces settings."""
    conf = DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions)} | extra
    spark = SparkSession.builder.master(master).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the shared Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
