"""Structured Streaming: incremental file ingest and a windowed summary of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FILES = "value string"


def latest_per_file(files: DataFrame) -> DataFrame:
    """Of several copies of a file (path, modified, value) the newest, by name without its folder."""
    name = F.element_at(F.split("path", "/"), -1)
    newest = files.withColumn("file", name).groupBy("file").agg(F.max_by(F.struct("path", "modified", "value"), F.struct("modified", "path")).alias("f"))
    return newest.select("file", "f.*")


def watch_files(spark: SparkSession, folder: str, handle: Callable[[DataFrame, int], None], checkpoint: str, pattern: str = "*.las") -> StreamingQuery:
    """Hands each batch of new or changed whole files (file, path, modified, value; the newest of a name) to `handle`, which
    recomputes the wells concerned. Processes what is there and stops."""
    rows = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", pattern).schema(FILES).load(folder)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), "value")
    return rows.writeStream.foreachBatch(lambda batch, n: handle(latest_per_file(batch), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) per hour and type; on a stream rows later than `late` are dropped."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: start, end, number of events."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
