"""Stateful parts: heartbeat reaping, idempotent events and per-task event logs, in batch and streaming form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reaped(events: DataFrame, clock: DataFrame, minutes: int = 10) -> DataFrame:
    """Live jobs whose last beat is not after ``now`` minus ``minutes`` (the boundary is reaped); ``clock`` is one row with ``now``."""
    last = events.groupBy("user_id").agg(F.max("ts").alias("last_beat"), F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))
    cutoff = F.col("now") - F.expr(f"INTERVAL {minutes} MINUTES")
    return last.crossJoin(F.broadcast(clock)).withColumn("reaped", F.col("last_beat") <= cutoff).drop("now")


def session_stream(events: DataFrame, gap: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """Streaming form: a job's beats form a session that ends after ``gap`` without one; late beats are taken up to ``lateness``."""
    beats = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    return beats.groupBy(F.session_window("at", gap).alias("session"), "user_id").agg(F.count(F.lit(1)).alias("beats"))


def first_per_key_stream(events: DataFrame, key: str, lateness: str = "1 hour") -> DataFrame:
    """Idempotent intake: of events with one key only the first within the watermark passes."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness).dropDuplicatesWithinWatermark([key])


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drive a stream over all data that is there into a Parquet table and return it."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
