"""Structured Streaming: windows, sessions, change detection over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str, at: str = "ts", late: str = "1 hour", by: tuple[str, ...] = ()) -> DataFrame:
    """(window start, by, n): counts of each window; rows later than ``late`` behind the newest are dropped in a stream."""
    stamped = events.withWatermark(at, late) if events.isStreaming else events
    return stamped.groupBy(F.window(at, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sliding(events: DataFrame, width: str, step: str, at: str = "ts", late: str = "1 hour") -> DataFrame:
    stamped = events.withWatermark(at, late) if events.isStreaming else events
    return stamped.groupBy(F.window(at, width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, by: str, at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Debounced batches by event time: a batch of a key ends when nothing comes for ``gap``."""
    stamped = events.withWatermark(at, late) if events.isStreaming else events
    return stamped.groupBy(F.session_window(at, gap).alias("w"), F.col(by)).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def daily(events: DataFrame, at: str = "ts", start: str = "0 hours", late: str = "1 hour") -> DataFrame:
    """One row for each day (from ``start`` past midnight) with events."""
    stamped = events.withWatermark(at, late) if events.isStreaming else events
    return stamped.groupBy(F.window(at, "1 day", "1 day", start).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def new_files(listing: DataFrame, at: str = "ts", late: str = "1 day") -> DataFrame:
    """First sight of each path with content: modifications and empty files are left out."""
    sized = listing.where("size > 0")
    return sized.withWatermark(at, late).dropDuplicatesWithinWatermark(["path"]) if listing.isStreaming else sized.dropDuplicates(["path"])


def status_changes(rows: DataFrame, key: str, status: str, at: str) -> DataFrame:
    """Rows whose status differs from the key's one before (the first counts): a batch form of change detection."""
    from pyspark.sql import Window

    before = F.lag(status).over(Window.partitionBy(key).orderBy(at))
    return rows.withColumn("_b", before).where(~F.col("_b").eqNullSafe(F.col(status))).drop("_b")
