"""The change feed as a stream: page events to frames, and a log with bounded history.

Frames are numbered by micro-batch, so a retried batch writes the same frame again instead of a second
one. Windows with watermarks over the feed are an extension for event-time analysis.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagewright.operators import delta

RING = 256
EVENT = "path string, file_rev string, deleted boolean, ts timestamp"


def read_events(spark: SparkSession, folder: str, schema: str = EVENT, files_a_batch: int = 100) -> DataFrame:
    """Page events from Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def apply_events(state: DataFrame, events: DataFrame) -> DataFrame:
    """The (path, file_rev) state after a batch of events; of several for a path the last one counts."""
    last = events.groupBy("path").agg(F.max_by(F.struct("file_rev", "deleted"), F.struct("ts", "file_rev")).alias("last")).select("path", "last.*")
    kept = state.join(last, "path", "left_anti").select("path", "file_rev")
    return kept.unionByName(last.where("NOT deleted").select("path", "file_rev"))


class Feed:
    """Writes one frame and one state per micro-batch below a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def state(self, seq: int) -> DataFrame:
        if seq < 0:
            return self.spark.createDataFrame([], "path string, file_rev string")
        return self.spark.read.parquet(f"{self.folder}/state/seq={seq}")

    def on_batch(self, events: DataFrame, seq: int) -> None:
        before = self.state(seq - 1)
        apply_events(before, events).write.mode("overwrite").parquet(f"{self.folder}/state/seq={seq}")
        changed = delta.file_delta(before, self.state(seq)).withColumn("dropped", F.lit(0))
        changed.write.mode("overwrite").parquet(f"{self.folder}/frames/seq={seq}")

    def start(self, events: DataFrame, available_now: bool = True) -> StreamingQuery:
        writer = events.writeStream.foreachBatch(self.on_batch).option("checkpointLocation", f"{self.folder}/checkpoint")
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="250 milliseconds")).start()

    def frames(self, ring: int = RING) -> DataFrame:
        """The rows of the last `ring` frames; older ones have left the history."""
        log = self.spark.read.parquet(f"{self.folder}/frames").withColumn("seq", F.col("seq").cast("long"))
        newest = log.agg(F.max("seq").alias("newest"))
        return log.join(F.broadcast(newest), F.col("seq") > F.col("newest") - ring).drop("newest")

    def since(self, seq: int, ring: int = RING) -> DataFrame | None:
        """What changed after a frame; None if that frame has left the history."""
        held = self.frames(ring)
        oldest = held.agg(F.min("seq")).first()[0]
        return held.where(F.col("seq") > seq) if oldest is None or seq >= oldest - 1 else None


def windowed(events: DataFrame, width: str, watermark: str) -> DataFrame:
    """Events by time window and type, late ones up to the watermark."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
