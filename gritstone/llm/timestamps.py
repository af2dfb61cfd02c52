"""Mixed timestamp normalisation: stamps of many written forms become instants.

Wall times without an offset meet the transitions of their zones in one sweep:
both are range-partitioned and sorted together by zone and time, the offset in
force is carried forward row by row, and each partition begins with what the
partitions before it carry over.  Whether a wall time lies in a gap or an
overlap is told by the same marker.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gritstone.session import cut, scratch_path

BLANKS = " \t\n\x0b\x0c\r"
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
#: Every form that a stamp can have, but for epochs.
FORM = (
    rf"\A(?:20[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}|20[0-9]{{6}}|[0-9]{{2}}\.[0-9]{{2}}\.20[0-9]{{2}}|[0-9]{{2}} (?:{'|'.join(MONTHS)}) 20[0-9]{{2}}|[0-9]{{2}}/[0-9]{{2}}/20[0-9]{{2}})"
    r"(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2})?(?: ?[AP]M)?(?: ?(?:Z|[+-][0-9]{2}:?[0-9]{2}))?)?\z"
)
#: Years whose transitions are looked up: those that a stamp can name, with a day on either side.
FIRST_DAY, LAST_DAY = "1999-12-30", "2100-01-02"
#: Copies of a source's votes, so that the stamps of one source meet them in as many tasks.
SALTS = 64


def _number(text: Column, at: int | Column, size: int) -> Column:
    return text.substr(at if isinstance(at, Column) else F.lit(at), F.lit(size)).try_cast("int")


def _day(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970 of a date of 2000 to 2099, null where there is no such date."""
    longest = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(y % 4 == 0, 29).otherwise(28)).otherwise(31)
    return F.when(m.between(1, 12) & (d >= 1) & (d <= longest), F.unix_date(F.make_date(y, m, d)))


def parse(stamps: DataFrame, keep: tuple[str, ...] = ("stamp_id",)) -> DataFrame:
    """stamps(source, zone, raw and the columns to keep) as written, before zones and votes.

    epoch (microseconds), day and other_day (days since 1970; two for a slashed
    date that can be read in both orders and gives two dates), vote (1: only day
    first, 2: only month first), second (of the day), offset (seconds, null for
    none) and salt, which deals out equal rows.  All of them but salt are null for
    a bad stamp.
    """
    text = F.btrim("raw", F.lit(BLANKS))
    rows = stamps.select(*keep, "source", "zone", text.alias("s")).withColumn("fits", F.col("s").rlike(FORM))
    s, third, fifth = F.col("s"), F.col("s").substr(3, 1), F.col("s").substr(5, 1)
    words = third == " "
    size = F.when(words, 11).when(third.isin(".", "/") | (fifth == "-"), 10).otherwise(8)
    rows = rows.select(*keep, "source", "zone", "s", "fits", F.when(F.col("fits"), s.substr(size + 1, F.length("s"))).alias("rest"))
    rest, fits = F.col("rest"), F.col("fits")
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), s.substr(4, 3)).cast("int")
    plain = (
        F.when(words, _day(_number(s, 8, 4), month, _number(s, 1, 2)))
        .when(third == ".", _day(_number(s, 7, 4), _number(s, 4, 2), _number(s, 1, 2)))
        .when(fifth == "-", _day(_number(s, 1, 4), _number(s, 6, 2), _number(s, 9, 2)))
        .when(third != "/", _day(_number(s, 1, 4), _number(s, 5, 2), _number(s, 7, 2)))
    )
    slashed = third == "/"
    day_first = F.when(slashed, _day(_number(s, 7, 4), _number(s, 4, 2), _number(s, 1, 2)))
    month_first = F.when(slashed, _day(_number(s, 7, 4), _number(s, 1, 2), _number(s, 4, 2)))
    seconds = rest.substr(7, 1) == ":"
    noon = F.when(F.instr(rest, "PM") > 0, 12).when(F.instr(rest, "AM") > 0, 0)
    hour, minute, second = _number(rest, 2, 2), _number(rest, 5, 2), F.when(seconds, _number(rest, 8, 2)).otherwise(0)
    hour24 = F.when(noon.isNull(), F.when(hour <= 23, hour)).when(hour.between(1, 12), hour % 12 + noon)
    clock = F.when(F.length(rest) == 0, 0).when((minute <= 59) & (second <= 59), hour24 * 3600 + minute * 60 + second)
    sign = F.greatest(F.instr(rest, "+"), F.instr(rest, "-"))
    far, near = _number(rest, sign + 1, 2), F.substring(rest, -2, 2).try_cast("int")
    offset = F.when(rest.endswith("Z"), 0).when((sign > 0) & (far <= 14) & (near <= 59), F.when(F.instr(rest, "-") > 0, -1).otherwise(1) * (far * 3600 + near * 60))
    epoch = F.when(s.rlike(r"\A[0-9]{10}\z"), s.try_cast("long") * 1_000_000).when(s.rlike(r"\A[0-9]{13}\z"), s.try_cast("long") * 1_000)
    rows = rows.select(
        *keep, "source", "zone",
        F.when(~fits, epoch).alias("epoch"),
        F.when(fits, plain).alias("plain"), F.when(fits, day_first).alias("day_first"), F.when(fits, month_first).alias("month_first"),
        F.when(fits, clock).alias("second"), F.when(fits, offset).alias("offset"),
        (fits & (rest.endswith("Z") | (sign > 0))).alias("has_offset"),
    )
    zones = sorted(stamps.sparkSession.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds())
    known = F.coalesce(F.col("zone").isin(zones), F.lit(False))
    fine = F.coalesce(F.col("second").isNotNull() & F.when(F.col("has_offset"), F.col("offset").isNotNull()).otherwise(known), F.lit(False))
    a, b = F.col("day_first"), F.col("month_first")
    return rows.select(
        *keep, "source", "zone", "epoch",
        F.when(fine, F.coalesce("plain", a, b)).alias("day"),
        F.when(fine & (a != b), b).alias("other_day"),
        F.when(fine & a.isNotNull() & b.isNull(), 1).when(fine & a.isNull() & b.isNotNull(), 2).alias("vote"),
        "second", "offset",
        F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20)).cast("int").alias("salt"),
    )


def settle_orders(parsed: DataFrame) -> DataFrame:
    """Dates that both orders allow take the one that more stamps of their source vote for, else day first.

    A null source is one of its own.  Votes are counted before anything is dealt
    out and come in SALTS copies to the stamps that need them, so a source with
    most rows is as many tasks.
    """
    count = lambda v: F.count(F.when(F.col("vote") == v, 1))
    votes = parsed.where("vote is not null").groupBy("source").agg(count(1).alias("for_day"), count(2).alias("for_month"))
    votes = votes.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("source", "voted")
    both = parsed.where("other_day is not null").withColumn("at", F.col("salt") % SALTS)
    met = both.join(votes, F.col("source").eqNullSafe(F.col("voted")) & (both["at"] == votes["at"]), "left").drop("at", "voted")
    day, month = F.coalesce("for_day", F.lit(0)), F.coalesce("for_month", F.lit(0))
    met = met.withColumn("rule", F.when(day == month, "default").otherwise("votes")).withColumn("day", F.when(month > day, F.col("other_day")).otherwise(F.col("day")))
    rest = parsed.where("other_day is null").withColumn("rule", F.when(F.col("epoch").isNotNull(), "epoch").when(F.col("day").isNull(), "bad").otherwise("plain"))
    return rest.unionByName(met.drop("for_day", "for_month"))


def transitions(zones: DataFrame) -> DataFrame:
    """zones(zone) with (at, offset, until): from the wall second at on the offset holds, and wall times before until are skipped or repeated ones.

    The offset at each midnight (UTC) of a century comes from Spark's zone rules;
    a day with a change is searched by the minute.  Each zone starts with a marker
    before all times.  A zone has at most a few hundred markers, and there are
    some 600 zones, whatever the input.
    """
    offset = F.unix_timestamp(F.from_utc_timestamp("instant", F.col("zone"))) - F.unix_timestamp("instant")
    days = zones.withColumn("instant", F.explode(F.expr(f"sequence(timestamp_seconds(unix_date(date'{FIRST_DAY}') * 86400L), timestamp_seconds(unix_date(date'{LAST_DAY}') * 86400L), interval 1 day)")))
    days = days.select("zone", F.unix_timestamp("instant").alias("t"), offset.alias("offset"))
    changed = days.selectExpr("zone", "t - 86400 as was_t", "lag(offset) over (partition by zone order by t) as was", "offset", "t").where("was <> offset or was is null")
    first = changed.where("was is null").selectExpr("zone", "-9223372036854775808 as at", "offset", "-9223372036854775808 as until")
    minutes = changed.where("was is not null").withColumn("instant", F.explode(F.expr("transform(sequence(was_t, t, 60L), x -> timestamp_seconds(x))")))
    minutes = minutes.select("zone", "t", F.unix_timestamp("instant").alias("at"), offset.alias("offset"))
    steps = minutes.selectExpr("zone", "at", "offset", "lag(offset) over (partition by zone, t order by at) as was").where("was <> offset")
    return first.unionByName(steps.selectExpr("zone", "at + least(was, offset) as at", "offset", "at + greatest(was, offset) as until"))


_FILLED = T.StructType([T.StructField(n, t) for n, t in (("utc", T.LongType()), ("shifted", T.BooleanType()))])


def sweep(rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """rows(zone, wall, salt, and the columns to keep) with utc (seconds) and shifted (the wall time is skipped or repeated).

    Rows and markers are range-partitioned by (zone, wall, salt), so equal wall
    times of one zone are several tasks as well.  The sorted partitions are kept
    in the shared folder; the last marker of each partition that has one (never
    more than there are markers) is what later ones may begin with.
    """
    marks = cut(transitions(rows.select("zone").distinct()))
    kept = F.struct(*[F.col(c) for c in keep])
    walls = rows.select("zone", F.col("wall").alias("at"), F.lit(1).alias("kind"), "salt", kept.alias("row"), F.lit(None).cast("long").alias("offset"), F.lit(None).cast("long").alias("until"))
    signs = marks.select("zone", "at", F.lit(0).alias("kind"), F.lit(0).alias("salt"), F.lit(None).cast(walls.schema["row"].dataType).alias("row"), "offset", "until")
    order = ("zone", "at", "kind", "salt")
    swept = walls.unionByName(signs).repartitionByRange(*order).sortWithinPartitions(*order)
    swept = cut(swept.select(F.spark_partition_id().alias("part"), "at", F.when(F.col("kind") == 0, F.col("zone")).alias("zone"), "offset", "until", "row"))
    last = swept.where("offset is not null").groupBy("part").agg(F.max_by(F.struct("offset", "until"), F.struct("zone", "at")).alias("mark"))
    carried = sorted((r.part, r.mark.offset, r.mark.until) for r in last.collect())
    parts, offsets, untils = ([x[i] for x in carried] for i in range(3))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if now is None:
                before = bisect_left(parts, batch["part"][0].as_py()) - 1
                now = (offsets[before], untils[before]) if before >= 0 else (0, 0)
            is_mark = np.asarray(batch["offset"].is_valid())
            nth = np.cumsum(is_mark)
            offset = np.append(now[0], np.asarray(batch["offset"].drop_null()))[nth]
            until = np.append(now[1], np.asarray(batch["until"].drop_null()))[nth]
            now = (int(offset[-1]), int(until[-1]))
            at, wall = np.asarray(batch["at"]), pa.array(~is_mark)
            out = pa.record_batch([batch["row"], pa.array(at - np.where(is_mark, 0, offset)), pa.array(at < until)], names=["row", "utc", "shifted"])
            yield out.filter(wall)

    schema = T.StructType([swept.schema["row"], *_FILLED.fields])
    return swept.mapInArrow(fill, schema).select("row.*", "utc", "shifted")


def normalise(stamps: DataFrame, keep: tuple[str, ...] = ("stamp_id",)) -> DataFrame:
    """The kept columns of stamps(source, zone, raw, ...) with utc_us, rule and ambiguous: one row for each row.

    A null raw, an empty or very long text, an impossible date or time, and a wall
    time whose zone is null or not a name of the time-zone database are bad: null
    utc_us, no vote.  Equal votes are no majority: day first.  Repeated rows,
    repeated and null ids stay and vote row by row; a null source is one of its
    own; no stamps give none.  Other columns are kept only if asked for and may
    have any name: they travel within a struct.
    """
    spark = stamps.sparkSession
    whole = stamps.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.col("source").alias("source"), F.col("zone").alias("zone"), F.col("raw").alias("raw"))
    path = scratch_path(spark, "stamps")
    parse(whole, ("row",)).write.parquet(path)
    rows = settle_orders(spark.read.parquet(path)).withColumn("wall", F.col("day").cast("long") * 86400 + F.col("second"))
    asks = F.col("day").isNotNull() & F.col("offset").isNull()
    by_rule = F.col("rule").isin("votes", "default")
    told = rows.where(~asks).select("row", F.coalesce("epoch", (F.col("wall") - F.col("offset")) * 1_000_000).alias("utc_us"), "rule", by_rule.alias("ambiguous"))
    swept = sweep(rows.where(asks), ("row", "rule"))
    swept = swept.select("row", (F.col("utc") * 1_000_000).alias("utc_us"), "rule", (by_rule | F.col("shifted")).alias("ambiguous"))
    return told.unionByName(swept).select("row.*", "utc_us", "rule", "ambiguous")
