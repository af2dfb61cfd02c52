"""Timestamp normalisation against a plain reading of the rules, stamp by stamp."""

from __future__ import annotations

import datetime as dt
import random
import re
from collections import Counter
from zoneinfo import ZoneInfo

import pytest

from gritstone.llm import timestamps

KIND = "stamp_id long, source string, zone string, raw string, row string, rule string, at string, salt string, utc_us string"
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
EPOCH = dt.datetime(1970, 1, 1)
ZONES = ("America/New_York", "Europe/Berlin", "Australia/Lord_Howe", "Pacific/Apia", "Asia/Kolkata", "UTC")
SHAPES = (
    (r"(20\d\d)-(\d\d)-(\d\d)", "ymd"), (r"(20\d\d)(\d\d)(\d\d)", "ymd"), (r"(\d\d)\.(\d\d)\.(20\d\d)", "dmy"),
    (rf"(\d\d) ({'|'.join(MONTHS)}) (20\d\d)", "dmy"), (r"(\d\d)/(\d\d)/(20\d\d)", "slash"),
)


def date(y, m, d):
    try:
        return dt.datetime(int(y), MONTHS.index(m) + 1 if m in MONTHS else int(m), int(d))
    except ValueError:
        return None


def read(raw):
    """('epoch', microseconds), or ([dates], [only reading], offset): None if it is bad."""
    s = (raw or "").strip(" \t\n\x0b\x0c\r")
    if re.fullmatch("[0-9]{10}|[0-9]{13}", s):
        return "epoch", int(s) * (1_000_000 if len(s) == 10 else 1_000), None
    for shape, order in SHAPES:
        if not (m := re.fullmatch(shape + r"(?:[T ](\d\d):(\d\d)(?::(\d\d))?(?: ?([AP]M))?(?: ?(Z|[+-]\d\d:?\d\d))?)?", s, re.ASCII)):
            continue
        a, b, c, h, mi, sec, half, off = m.groups()
        days = [date(a, b, c)] if order == "ymd" else [date(c, b, a)] if order == "dmy" else [date(c, b, a), date(c, a, b)]
        clock = dt.timedelta()
        if h:
            h, mi, sec = int(h), int(mi), int(sec or 0)
            if mi > 59 or sec > 59 or (half and not 1 <= h <= 12) or h > 23:
                return None
            clock = dt.timedelta(hours=h % 12 + 12 * (half == "PM") if half else h, minutes=mi, seconds=sec)
        shift = None
        if off:
            oh, om = (0, 0) if off == "Z" else (int(off[1:3]), int(off[-2:]))
            if oh > 14 or om > 59:
                return None
            shift = dt.timedelta(hours=oh, minutes=om) * (-1 if off[0] == "-" else 1)
        return ([d and d + clock for d in days], shift, order) if any(days) else None
    return None


def local(wall, zone):
    """(instant, the wall time is skipped or repeated), by trying every minute's offset near it."""
    z, us = ZoneInfo(zone), lambda t: (t - EPOCH) // dt.timedelta(microseconds=1)
    offset = lambda t: t.replace(tzinfo=dt.UTC).astimezone(z).utcoffset()
    near = {offset(wall + dt.timedelta(hours=h)) for h in range(-40, 41)}
    real = sorted(wall - o for o in near if offset(wall - o) == o)
    if len(real) == 1:
        return us(real[0]), False
    return us(real[-1] if real else wall - offset(wall + dt.timedelta(hours=40))), True


def brute(rows):
    known = {i: read(r[3]) for i, r in enumerate(rows)}
    for i, x in known.items():
        if x and x[0] != "epoch" and x[1] is None and rows[i][2] not in ZONES:
            known[i] = None
    votes = Counter()
    for i, x in known.items():
        if x and x[2] == "slash" and None in x[0]:
            votes[rows[i][1], x[0][0] is not None] += 1
    out = []
    for i, (sid, source, zone, *_) in enumerate(rows):
        x = known[i]
        if x is None:
            out.append((sid, None, "bad", False))
        elif x[0] == "epoch":
            out.append((sid, x[1], "epoch", False))
        else:
            days, shift, _ = x
            rule, wall = "plain", next(d for d in days if d)
            if len({*days} - {None}) == 2:
                first, second = votes[source, True], votes[source, False]
                rule, wall = ("default", days[0]) if first == second else ("votes", days[0 if first > second else 1])
            if shift is not None:
                out.append((sid, (wall - shift - EPOCH) // dt.timedelta(microseconds=1), rule, rule != "plain"))
            else:
                us, shifted = local(wall, zone)
                out.append((sid, us, rule, rule != "plain" or shifted))
    return out


FIXED = [
    None, "", "   ", "x" * 300_000, " " * 300_000 + "2024-01-02", "2024-02-30", "2023-02-29", "2024-02-29", "2024-01-02T24:00", "2024-01-02 10:60", "2024-01-02 10:59:60", "2024-13-01", "1999-01-01", "2100-01-01",
    "2024-01-02t10:00", "2024-01-02T10:00\u0085", "2024-01-02 ", "\x0b2024-01-02\x0c", "20240102", "2024010", "1700000000", "1700000000123", "170000000", "0000000000", "02.01.2024 12:00AM", "02.01.2024 12:00:01 PM", "02.01.2024 13:00 PM",
    "02.01.2024 00:10 AM", "2 Jan 2024", "02 jan 2024", "02 Jan 2024T10:00Z", "31 Apr 2024", "2024-01-02 10:00+14:59", "2024-01-02 10:00+15:00", "2024-01-02 10:00 -0860", "2024-01-02 10:00 -0830", "2024-01-02 10:00 PM+01:00", "2024-01-02 10:00Z",
    "2024-01-02Z", "03/10/2024 02:30", "10/03/2024 02:30", "13/03/2024", "03/13/2024", "13/13/2024", "05/05/2024", "2024-03-10 02:00", "2024-03-10 02:59:59", "2024-03-10 03:00", "2024-11-03 01:00", "2024-11-03 01:59:59", "2024-11-03 00:59:59",
    "2024-11-03 02:00", "2024-03-31 02:30", "2024-10-27 02:30", "2024-10-27 03:00", "2011-12-30 12:00", "2011-12-31", "2024-04-07 01:45", "2024-10-06 02:15", "2000-01-01", "2099-12-31 23:59:59", "２024-01-02", "2024-01-02 10:00  Z", "2024-01-02  10:00",
]


def rows():
    rng, out = random.Random(5), []
    for zone in (*ZONES, None, "Mars/Base"):
        out += [(len(out) + i, ("a", "b", None)[i % 3], zone, raw) for i, raw in enumerate(FIXED)]
    for i in range(600):
        d, m, h = rng.randint(1, 31), rng.randint(1, 12), rng.randint(0, 24)
        raw = rng.choice([f"{d:02}/{m:02}/2024", f"{m:02}/{d:02}/2024 {h:02}:30", f"2024-{m:02}-{d:02} 02:{rng.randint(0, 59):02}", f"{d:02} {MONTHS[m - 1]} 2011 {h:02}:15:0{rng.randint(0, 9)}", f" {d:02}.{m:02}.2030\t"])
        out.append((rng.choice([None, 7, 10_000 + i]), rng.choice(["a", "b", "c", None]), rng.choice(ZONES), raw))
    out += [(9, "hot", "America/New_York", "2024-11-03 01:30")] * 500
    return out


def key(r):
    return (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0, r[2], r[3])


def test_equals_a_plain_reading(spark):
    given = rows()
    stamps = spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in given], KIND).repartition(7)
    found = [tuple(r) for r in timestamps.normalise(stamps).collect()]
    assert sorted(found, key=key) == sorted(brute(given), key=key)


def test_hot_wall_times_are_several_partitions(spark):
    rows = spark.range(0, 4_000, 1, 8).selectExpr("id as stamp_id", "'s' as source", "'Europe/Berlin' as zone", "'2024-10-27 02:30' as raw")
    parsed = timestamps.settle_orders(timestamps.parse(rows)).withColumn("wall", timestamps.F.col("day").cast("long") * 86400 + timestamps.F.col("second"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        swept = timestamps.sweep(parsed, ("stamp_id",))
        sizes = [n for n in swept.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect() if n]
        assert len(sizes) >= 3 and max(sizes) <= 2_000
        assert swept.select("utc", "shifted").distinct().collect() == [(1729989000 + 3600, True)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_markers_of_a_zone(spark):
    zones = spark.createDataFrame([("America/New_York",), ("UTC",)], "zone string")
    found = {(r.zone, r.at): (r.offset, r.until) for r in timestamps.transitions(zones).collect()}
    spring = int(dt.datetime(2024, 3, 10, 2, tzinfo=dt.UTC).timestamp())
    autumn = int(dt.datetime(2024, 11, 3, 1, tzinfo=dt.UTC).timestamp())
    assert found["America/New_York", spring] == (-14_400, spring + 3_600) and found["America/New_York", autumn] == (-18_000, autumn + 3_600)
    assert [k for k in found if k[0] == "UTC"] == [("UTC", -(2**63))]


@pytest.mark.parametrize("table", ["none", "all bad"])
def test_tables_without_wall_times(spark, table):
    rows = [] if table == "none" else [(1, None, None, None, *"xxxxx"), (None, "a", "UTC", "?", *"xxxxx")]
    found = timestamps.normalise(spark.createDataFrame(rows, KIND)).collect()
    assert [(r.utc_us, r.rule, r.ambiguous) for r in found] == [(None, "bad", False)] * len(rows)
