"""Tables in the folder that the driver and all executors share, to compute something once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pagewright-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to a new shared folder, and read from there."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_kept: dict[tuple, tuple[str, DataFrame]] = {}


def exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def held(spark: SparkSession, key: tuple) -> bool:
    """Whether kept() has this table."""
    path = _kept.get((spark.sparkContext.applicationId, *key), ("",))[0]
    return bool(path) and exists(spark, f"{path}/_SUCCESS")


def kept(spark: SparkSession, key: tuple, make, name: str, anew: bool = False) -> DataFrame:
    """The table that `make` gives, written once per application and key, again if it is gone, or anew."""
    whole = (spark.sparkContext.applicationId, *key)
    path, df = _kept.get(whole, ("", None))
    if anew or df is None or not exists(spark, f"{path}/_SUCCESS"):
        path = new_folder(spark, name)
        make().write.option("compression", "zstd").parquet(path)
        df = spark.read.parquet(path)
        _kept[whole] = (path, df)
    return df


def signature(spark: SparkSession, folder: str) -> tuple:
    """What tells whether the tables of a folder changed: each file's name, length and time."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files = store.listFiles(path, True) if store.exists(path) else None
    found = []
    while files is not None and files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))
