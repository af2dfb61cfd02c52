"""The plan and the log of file actions. Nothing here touches a file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds of action, and those that can be undone.
KINDS = ("quarantine", "trash", "delete", "copy", "move", "hard_link", "symlink")
UNDOABLE = ("quarantine", "move", "copy", "hard_link", "symlink")


def log_page(log: DataFrame, kinds: list[str] | None = None, start_us: int | None = None, end_us: int | None = None, contains: str | None = None, reversed_: bool | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the log, newest first, equal times by id; each filter applies if given."""
    rows = log
    if kinds:
        rows = rows.where(F.col("kind").isin(kinds))
    if start_us is not None:
        rows = rows.where(F.col("us") >= start_us)
    if end_us is not None:
        rows = rows.where(F.col("us") <= end_us)
    if contains:
        rows = rows.where(F.coalesce(F.contains("source_path", F.lit(contains)), F.lit(False)) | F.coalesce(F.contains("dest_path", F.lit(contains)), F.lit(False)))
    if reversed_ is not None:
        rows = rows.where(F.col("reversed") == reversed_)
    return rows.orderBy(F.desc("us"), "photo_id" if "photo_id" in rows.columns else "id").offset(offset).limit(limit)


def pending_summary(plan: DataFrame) -> DataFrame:
    """(kind, actions, bytes), with zeros for kinds without actions."""
    one = plan.agg(*[x for k in KINDS for x in (F.count_if(F.col("kind") == k).alias(f"{k}_n"), F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("size"))), F.lit(0)).alias(f"{k}_b"))])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_n").alias("actions"), F.col(f"{k}_b").alias("bytes")) for k in KINDS])).alias("x")).select("x.*")


def quarantine_path(root: str, day: str, path: str = "path"):
    """root/day/safe folder/filename; what is unsafe in a folder's name becomes one underscore."""
    folder = F.regexp_replace(path, r"[/\\][^/\\]*$", "")
    safe = F.regexp_replace(F.regexp_replace(folder, r"[^A-Za-z0-9]+", "_"), "^_|_$", "")
    return F.concat_ws("/", F.lit(root), F.lit(day), safe, F.regexp_extract(path, r"[^/\\]*$", 0))


def execute(plan: DataFrame, catalogue: DataFrame, confirm_delete: bool = False) -> DataFrame:
    """plan with a status: failed where the source is not in the live catalogue, refused (all rows) where the plan holds
    a delete that is not confirmed, else done."""
    there = catalogue.where(~F.coalesce(F.col("is_deleted"), F.lit(False))).select(F.col("path").alias("source_path"), F.lit(True).alias("_there")).distinct()
    checked = plan.join(there, "source_path", "left")
    blocked = not confirm_delete and not plan.where("kind = 'delete'").isEmpty()
    status = F.lit("refused") if blocked else F.when(F.col("_there"), "done").otherwise("failed")
    return checked.withColumn("status", status).drop("_there")


def undoable(log: DataFrame) -> DataFrame:
    """Log rows whose action can be reversed: reversible, not reversed yet, of a kind that leaves the content somewhere."""
    return log.where(F.col("reversible") & ~F.coalesce(F.col("reversed"), F.lit(False)) & F.col("kind").isin(*UNDOABLE))


def undo(log: DataFrame) -> DataFrame:
    """Restore rows for what can be undone: source and destination change places."""
    return undoable(log).select(F.col("id").alias("undoes"), F.lit("restore").alias("kind"), F.col("dest_path").alias("source_path"), F.col("source_path").alias("dest_path"))


def retain(log: DataFrame, cutoff_us: int, only_reversed: bool = True) -> DataFrame:
    """The log without rows older than the cutoff (only those already reversed, unless told otherwise)."""
    old = F.col("us") < cutoff_us
    return log.where(~(old & F.coalesce(F.col("reversed"), F.lit(False)))) if only_reversed else log.where(~old)
