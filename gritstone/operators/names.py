"""Free names for files that are to be moved: every claimant of a taken name gets the smallest free suffix, all at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.operators.timeline import running

#: The first suffix that a second file of a name gets, written with three digits at least.
FIRST = 2
_NUMBERED = r"^(.*)_([0-9]{3,9})$"


def _families(rows: DataFrame) -> DataFrame:
    low = rows.withColumn("low", F.lower("name")).withColumn("ext", F.regexp_extract("low", r"^.+(\.[^.]*)$", 1))
    return low.withColumn("stem", F.expr("substring(low, 1, length(low) - length(ext))"))


def allocate(claims: DataFrame, existing: DataFrame) -> DataFrame:
    """claims(id, folder, name) with final: the name, or the name with _002, _003, ... before its extension.

    Names are compared without case, in one folder.  First every name that exists
    nowhere goes to its claimant with the smallest id; then each name's other
    claimants, by id, get the smallest numbers whose names neither exist nor were
    given away.  (A numbered name belongs to one stem only, so different names'
    claimants can't meet.)  Reruns agree.  Null folders and names are a folder and
    a name of their own without a final name.

    A name with most claimants is no single task: ranks and the count of taken
    numbers below them are running sums over ranges.
    """
    named = _families(claims.where("folder is not null and name is not null"))
    there = existing.where("folder is not null and name is not null").select("folder", F.lower("name").alias("low")).distinct()
    first = named.groupBy("folder", "low").agg(F.min("id").alias("id")).join(there, ["folder", "low"], "left_anti").withColumn("bare", F.lit(True))
    marked = named.join(first.select("folder", "low", "id", "bare"), ["folder", "low", "id"], "left")
    rest = marked.where("bare is null").drop("bare")
    # Numbers of each name that are taken, and how many free ones lie below each of them.
    used = _families(there.unionByName(first.select("folder", "low")).select("folder", F.col("low").alias("name")))
    taken = used.select("folder", F.regexp_extract("stem", _NUMBERED, 1).alias("stem"), F.regexp_extract("stem", _NUMBERED, 2).alias("digits"), "ext").where("digits <> ''")
    taken = taken.withColumn("number", F.col("digits").cast("long")).where((F.col("number") >= FIRST) & (F.col("digits") == F.lpad(F.col("number").cast("string"), F.greatest(F.lit(3), F.length(F.col("number").cast("string"))), F.lit("0"))))
    taken = taken.join(rest.select("folder", "stem", "ext").distinct(), ["folder", "stem", "ext"], "left_semi").select("folder", "stem", "ext", "number")
    keys = ["folder", "stem", "ext"]
    taken = running(taken, keys, [F.col("number")], "nth", F.lit(1)).select(*keys, (F.col("number") - F.col("nth") - FIRST + 1).alias("free"))
    ranked = running(rest, keys, [F.col("id")], "rank", F.lit(1))
    # A number with f free ones below it is passed by every rank above f.
    line = ranked.select(*keys, F.col("rank").cast("long").alias("spot"), F.lit(1).alias("turn"), F.lit(0).alias("passed"), "id", "name", F.col("ext").alias("_e")).unionByName(
        taken.select(*keys, (F.col("free") + 1).cast("long").alias("spot"), F.lit(0).alias("turn"), F.lit(1).alias("passed"), F.lit(None).cast(dict(claims.dtypes)["id"]).alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("_e"))
    )
    counted = running(line, keys, [F.col("spot"), F.col("turn"), F.col("id")], "skipped", F.col("passed")).where("turn = 1")
    number = (F.col("spot") + F.col("skipped") + FIRST - 1).cast("string")
    suffix = F.concat(F.lit("_"), F.lpad(number, F.greatest(F.lit(3), F.length(number)), F.lit("0")))
    cut_at = F.length("name") - F.length("_e")
    final = F.concat(F.col("name").substr(F.lit(1), cut_at), suffix, F.col("name").substr(cut_at + 1, F.length("name")))
    found = counted.select("id", final.alias("final")).unionByName(marked.where("bare").select("id", F.col("name").alias("final")))
    return claims.join(found, "id", "left").select("id", "folder", "name", "final")
