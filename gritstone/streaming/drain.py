"""Backlogs drained exactly once: micro-batches with a commit table, and failures as rows.

Results lie under <path>/rows/batch=<n>, commits under <path>/commits/batch=<n>.
A batch's rows count once its commit is there.  A run that is killed between the
two writes the batch again, in its own folder; one that is killed between the
commit and the stream's own log skips it.  A key that has a result, failed or
not, is not met again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

COMMITS = "batch long, rows long, failed long"


class Backlog:
    """Results of ``work`` for every key of a stream.

    work takes rows and returns one row for each, with the key and a string
    ``error`` that is null where it succeeded (sources.listing.extract makes such
    work from a Python function).  schema is that of its rows.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, work: Callable[[DataFrame], DataFrame], schema: str) -> None:
        self.spark, self.path, self.key, self.work, self.schema = spark, path.rstrip("/"), key, work, schema

    def _read(self, part: str, schema: str) -> DataFrame:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")

    def commits(self) -> DataFrame:
        return self._read("commits", COMMITS).select("batch", "rows", "failed")

    def results(self) -> DataFrame:
        """The rows of committed batches, with their batch.  Committed batches are one row each; rows are pruned by the folder they lie in."""
        return self._read("rows", f"{self.schema}, batch long").join(self.commits().select("batch"), "batch", "left_semi")

    def _step(self, rows: DataFrame, batch: int) -> None:
        if not self.commits().where(F.col("batch") == batch).isEmpty():
            return
        fresh = rows.where(F.col(self.key).isNotNull()).dropDuplicates([self.key]).join(self.results().select(self.key), self.key, "left_anti")
        self.work(fresh).write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")
        self.written(batch)
        done = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows/batch={batch}")
        done.agg(F.count("*").alias("rows"), F.count("error").alias("failed")).write.mode("overwrite").parquet(f"{self.path}/commits/batch={batch}")

    def written(self, batch: int) -> None:
        """Called between a batch's rows and its commit."""

    def start(self, stream: DataFrame, every: str | None = None) -> StreamingQuery:
        """Drain what is there and stop, or go on looking ``every`` so often."""
        trigger = {"processingTime": every} if every else {"availableNow": True}
        return stream.writeStream.foreachBatch(self._step).option("checkpointLocation", f"{self.path}/log").trigger(**trigger).start()

    def drain(self, stream: DataFrame) -> DataFrame:
        self.start(stream).awaitTermination()
        return self.results()

    def failed(self) -> DataFrame:
        return self.results().where("error is not null")


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file or folder as a stream of its files."""
    found = spark.read.parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(found.schema)
    whole = any(f.rstrip("/").rpartition("/")[2] != name for f in found.inputFiles())
    return reader.parquet(path) if whole else reader.option("pathGlobFilter", name).parquet(folder)
