"""Catalogue changes as expressions over whole tables: merge, reconcile, diff, touch, remap.

A change takes the old table and gives the new one; writing it is the caller's
business (write beside the old one, then swap).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HASHES = ("quick_hash", "content_hash", "perceptual_hash")


def merge_scan(catalogue: DataFrame, batch: DataFrame, keys: tuple[str, ...] = ("drive_id", "path"), keep_hashes: bool = True) -> DataFrame:
    """The catalogue after a scan's batch: new rows come in, known ones are updated and undeleted.

    Hashes are dropped where size or modification time changed (null-safe);
    keep_hashes=False takes the batch's own instead.  ``change`` says new,
    modified, unchanged or unseen.
    """
    old, new = catalogue.alias("o"), batch.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    joined = old.join(new, on, "full_outer")
    there, known = F.col(f"n.{keys[0]}").isNotNull(), F.col(f"o.{keys[0]}").isNotNull()
    same = F.col("o.size").eqNullSafe(F.col("n.size")) & F.col("o.modified_s").eqNullSafe(F.col("n.modified_s"))
    out = []
    for c in catalogue.columns:
        mine, theirs = F.col(f"o.{c}"), F.col(f"n.{c}") if c in batch.columns else F.lit(None)
        if c in keys:
            value = F.coalesce(theirs, mine)
        elif c in HASHES and keep_hashes:
            value = F.when(~there | same, mine)
        elif c == "is_deleted":
            value = F.when(there, F.lit(False)).otherwise(mine)
        elif c in batch.columns and c != "created":
            value = F.when(there, theirs).otherwise(mine)
        else:
            value = F.coalesce(mine, theirs)
        out.append(value.alias(c))
    change = F.when(~there, "unseen").when(~known, "new").when(same, "unchanged").otherwise("modified")
    return joined.select(*out, change.alias("change"))


def mark_unseen(catalogue: DataFrame, seen: DataFrame, drive: str, key: str = "id") -> DataFrame:
    """The drive's rows whose id was not seen are deleted."""
    flags = seen.select(key).distinct().withColumn("_seen", F.lit(True))
    gone = (F.col("drive_id") == drive) & F.col("_seen").isNull()
    return catalogue.join(flags, key, "left").withColumn("is_deleted", F.when(gone, True).otherwise(F.col("is_deleted"))).drop("_seen")


def mark_before(catalogue: DataFrame, drive: str, start, column: str = "scan_s") -> DataFrame:
    """The drive's rows not scanned since start, or never, are deleted."""
    old = (F.col("drive_id") == drive) & (F.col(column).isNull() | (F.col(column) < start))
    return catalogue.withColumn("is_deleted", F.when(old, True).otherwise(F.col("is_deleted")))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "path", value: tuple[str, ...] = ("size", "modified_s")) -> DataFrame:
    """(key, change): added, removed or changed between two listings."""
    a = old.select(F.col(key), F.struct(*value).alias("_a"))
    b = new.select(F.col(key), F.struct(*value).alias("_b"))
    joined = a.join(b, key, "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return joined.select(key, change.alias("change")).where("change is not null")


def remap_prefix(rows: DataFrame, old: str, new: str, path: str = "path") -> DataFrame:
    """Paths under old move to new; a prefix ends at a separator."""
    inside = (F.col(path) == old) | F.col(path).startswith(old.rstrip("/") + "/")
    return rows.withColumn(path, F.when(inside, F.concat(F.lit(new.rstrip("/")), F.expr(f"substring({path}, {len(old.rstrip('/')) + 1})"))).otherwise(F.col(path)))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], only: list[str] | None = None, insert: bool = True) -> DataFrame:
    """rows into table by key, nulls of a key being equal.  only: columns that an existing row takes over; insert=False leaves unknown keys out."""
    old, new = table.withColumn("_old", F.lit(True)).alias("o"), rows.withColumn("_new", F.lit(True)).alias("n")
    joined = old.join(new, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer" if insert else "left")
    there, known = F.col("n._new").isNotNull(), F.col("o._old").isNotNull()
    out = []
    for c in table.columns:
        if c in keys:
            out.append(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c))
        elif c not in rows.columns:
            out.append(F.col(f"o.{c}").alias(c))
        else:
            takes = there if only is None or c in only else there & ~known
            out.append(F.when(takes, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return joined.select(*out)


def keep_latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key: replace-on-conflict.  Rows equal in ``order`` are ordered by all their columns, so reruns agree.

    The winner is a combined maximum, so a key with most rows is no single task.
    """
    last = F.struct(F.col(order).alias("_o"), *[c for c in rows.columns if c not in keys and c != order])
    return rows.groupBy(*keys).agg(F.max(last).alias("_x")).select(*[F.col("_x._o").alias(c) if c == order else F.col(c) if c in keys else F.col(f"_x.{c}") for c in rows.columns])


def get_or_create(names: DataFrame, known: DataFrame, column: str = "name") -> DataFrame:
    """Names that known lacks, compared without case."""
    have = known.select(F.lower(column).alias("_k")).distinct()
    return names.withColumn("_k", F.lower(column)).join(have, "_k", "left_anti").dropDuplicates(["_k"]).drop("_k")


def next_unknown(persons: DataFrame, prefix: str = "Unknown #") -> int:
    return persons.where(F.col("name").startswith(prefix)).count() + 1


def backfill(faces: DataFrame, status: DataFrame, key: str = "file_id") -> DataFrame:
    """Status rows for files with faces and none yet."""
    return faces.groupBy(key).agg(F.count("*").alias("faces_found")).join(status.select(key), key, "left_anti").withColumn("faces_analyzed", F.lit(True))


def delete_where(rows: DataFrame, condition) -> DataFrame:
    """rows without those that meet the condition (a null condition keeps)."""
    return rows.where(~F.coalesce(condition, F.lit(False)))
