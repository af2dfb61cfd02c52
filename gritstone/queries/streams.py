"""Streams: event replays, as batch queries with SQL and as real streams drained to a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from gritstone.catalog import table
from gritstone.queries.book import Book
from gritstone.session import rocks, scratch_path
from gritstone.streaming import monitor, watch
from gritstone.streaming.drain import Backlog, table_stream

Q = Book()


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _us(df, *names):
    return df.select(*[F.unix_micros(c).alias(c) if c in names else c for c in df.columns])


@Q.query("SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_windows(spark, sf_dir):
    return _us(watch.tumbling(events(spark, sf_dir), "1 hour", by=("event_type",)), "start")


@Q.query("SELECT epoch_us(date_trunc('day', ts)::TIMESTAMP) AS start, count(*) AS n FROM events GROUP BY 1")
def daily_windows(spark, sf_dir):
    return _us(watch.daily(events(spark, sf_dir)), "start")


@Q.query("""WITH b AS (SELECT user_id, ts, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 7200000000)::INT, 0) AS x FROM events),
    i AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM b)
    SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 7200000000 AS "end", count(*) AS n FROM i GROUP BY user_id, k""")
def session_windows(spark, sf_dir):
    return _us(watch.sessions(events(spark, sf_dir), "2 hours", "user_id"), "start", "end")


@Q.query("""SELECT user_id, event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS DISTINCT FROM event_type""")
def status_change_events(spark, sf_dir):
    from pyspark.sql import Window

    rows = events(spark, sf_dir).withColumn("at", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return watch.status_changes(rows, "user_id", "event_type", "at").select("user_id", "event_id")


@Q.query("SELECT epoch_us(time_bucket(INTERVAL '1 day', ts)) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streamed_windows(spark, sf_dir):
    """The replay as a stream: counted by window, each batch's counts written over the last one's as Parquet in the shared folder, open windows too."""
    stream = table_stream(spark, f"{sf_dir.rstrip('/')}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    counted = watch.tumbling(stream, "1 day", by=("event_type",))
    out, log = scratch_path(spark, "windows"), scratch_path(spark, "windows-log")
    write = lambda rows, _: rows.write.mode("overwrite").parquet(out)
    counted.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    return _us(spark.read.schema(counted.schema).parquet(out), "start")


@Q.query("""WITH b AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM events), x AS (SELECT *, coalesce((ms - lag(ms) OVER w > 7200000)::INT, 0) AS x FROM b WINDOW w AS (PARTITION BY user_id ORDER BY ms)),
    i AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY ms RANGE UNBOUNDED PRECEDING) AS k FROM x),
    s AS (SELECT user_id, event_id, max(ms) OVER (PARTITION BY user_id, k) + 7200000 AS left_ms FROM i) SELECT user_id, event_id, left_ms FROM s WHERE left_ms <= (SELECT max(ms) FROM b)""")
def quiet_batches(spark, sf_dir):
    """Events as files of their user's folder, leaving in batches after two quiet hours: state for each file, event-time timers."""
    stream = table_stream(spark, f"{sf_dir.rstrip('/')}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "0 seconds")
    seen = stream.select("user_id", "ts", F.col("event_id").cast("string").alias("path"), F.lit(1).alias("size"), F.lit(0).alias("modified_s"), F.lit("seen").alias("kind"))
    left = monitor.quiet_batches(seen, "user_id", 7_200_000, at="ts")
    out, log = scratch_path(spark, "quiet"), scratch_path(spark, "quiet-log")
    with rocks(spark):
        left.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(left.schema).parquet(out).select("user_id", F.col("path").cast("long").alias("event_id"), "left_ms")


@Q.query(r"""SELECT doc_id, length(text)::BIGINT AS n_chars, CASE WHEN text IS NULL OR trim(text) = '' THEN 'nothing to read' END AS error FROM documents""")
def drained_backlog(spark, sf_dir):
    """Every document once through a backlog: drained, drained again without work, read from its committed batches."""
    def work(rows):
        empty = F.col("text").isNull() | (F.trim("text") == "")
        return rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.when(empty, "nothing to read").alias("error"))

    backlog = Backlog(spark, scratch_path(spark, "backlog"), "doc_id", work, "doc_id long, n_chars long, error string")
    stream = table_stream(spark, f"{sf_dir.rstrip('/')}/documents.parquet")
    backlog.drain(stream)
    return backlog.drain(stream).drop("batch")
