"""Change events as a stream: an extension, as the documents' changes are otherwise derived in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, name: str = "events.parquet", files: int = 1) -> DataFrame:
    """Event files of a folder as a stream, a few at a time."""
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).option("pathGlobFilter", name).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def distinct_changes(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark: state is dropped as it passes."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def counted(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events by kind in tumbling windows, given out once late events can't change them."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))


def latest_state(events: DataFrame) -> DataFrame:
    """The latest event of each user so far (complete or update mode)."""
    return events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("last")).select("user_id", "last.event_id", "last.event_type")


def run_once(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there, into a memory table."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return stream.sparkSession.table(name)
