"""Feedback by event time: tumbling windows and sessions, of a stream as of a table.

In a stream, windows stay open until the watermark has passed them; rows that come after that are dropped and counted. Every micro-batch writes the windows that
it changed, under its own number, so a batch that is run again overwrites what it wrote; the table of windows is each one's latest row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _timed(rows: DataFrame, delay: str) -> DataFrame:
    rows = rows.withColumn("time", F.col("time").cast("timestamp"))
    return rows.withWatermark("time", delay) if rows.isStreaming else rows.where("time is not null")


def tumbling(rows: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(start, end, kind, n, users, value) of rows (time, kind, user, value): for each window and kind how many, by about how many users, their sum of value.

    Rows without a time are in no window; a null kind is one of its own. users is by a sketch, exact for windows of few users.
    """
    timed = _timed(rows, delay)
    found = timed.groupBy(F.window("time", width).alias("w"), "kind").agg(F.count("*").alias("n"), F.approx_count_distinct("user", 0.02).alias("users"), F.sum("value").alias("value"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "kind", "n", "users", "value")


def sessions(rows: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """(start, end, user, n, value) of rows (time, kind, user, value): a user's rows with less than `gap` between neighbours are one session, which ends a gap after the last."""
    timed = _timed(rows, delay)
    found = timed.groupBy(F.session_window("time", gap).alias("w"), "user").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user", "n", "value")


def start(rows: DataFrame, made: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """made (tumbling or sessions) of a stream, into the table at path. Sessions, which a late row may join, take mode append: they are written when they are closed."""

    def batch(df: DataFrame, number: int) -> None:
        df.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/{number:010d}")

    return made(rows).writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def table(spark: SparkSession, path: str, *key: str) -> DataFrame:
    """The latest row of each key of the table that `start` writes."""
    rows = spark.read.parquet(f"{path}/*")
    names = [c for c in rows.columns if c not in (*key, "batch")]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*names), "batch").alias("x"))
    return last.select(*key, "x.*")


def late(query: StreamingQuery) -> int:
    """How many rows came too late for their windows in what is known of a query's batches."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])
