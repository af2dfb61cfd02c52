"""Bounded samples of rows by hash of an id, and small tables of the driver's."""

from __future__ import annotations

import math
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def smallest_hashes(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """(id, grp) of rows(id, grp) with the limit smallest hashes of the id in each group; limits(grp, n, most) gives n, the group's rows, and its limit.

    A threshold on the hash, eight standard deviations above what the limit
    needs, leaves little more than the limit of each group before anything is
    shuffled or ranked, however many rows and tasks there are.  An id counts
    once in a group; where ids repeat, n is too large by that much and the
    sample smaller than its limit.  Null groups and ids are left out.  limits
    has a row for each label or language and is broadcast.
    """
    at = F.xxhash64(F.col("id").cast("string"))
    share = F.least(F.lit(1.0), (F.col("most") + 8 * F.sqrt("most") + 64) / F.greatest(F.col("n"), F.lit(1)))
    bounds = limits.select("grp", "most", share.alias("share"))
    near = rows.withColumn("at", at).join(F.broadcast(bounds), "grp").where((F.col("at") / math.ldexp(1.0, 64) + 0.5) <= F.col("share"))
    place = F.row_number().over(Window.partitionBy("grp").orderBy("at", "id"))
    return near.select("id", "grp", "at", "most").distinct().withColumn("place", place).where("place <= most").select("id", "grp")


_ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}


def local_rows(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """Rows of the driver's as a table, handed over in Arrow's form: a list of tuples would go through a Python worker in every executor."""
    fields = [x.split() for x in schema.split(",")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return spark.createDataFrame(pa.table([pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields]))
