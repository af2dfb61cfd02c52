"""Date expressions: EXIF parsing, folder layouts, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted date formats, tried in order, and folder layouts.
FORMATS = ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy:MM:dd")
LAYOUTS = {"year_month_name": "yyyy/MM-MMMM", "year_month": "yyyy/MM", "year_month_day": "yyyy/MM/dd", "year": "yyyy"}


def parse(text: str | Column) -> Column:
    """The first format that fits; null if none does."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in FORMATS])


def folder(when: Column, layout: str = "year_month_name", suffix: Column | None = None) -> Column:
    """Folder of a date, with an event's or place's name after it; Undated without one."""
    base = F.coalesce(F.date_format(when, LAYOUTS[layout]), F.lit("Undated"))
    return base if suffix is None else F.when(F.coalesce(suffix, F.lit("")) != "", F.concat_ws("/", base, suffix)).otherwise(base)


def filename(template: str, path: Column, when: Column, sequence: Column, location: Column) -> Column:
    """Template with {date}, {time}, {seq}, {location} and {original}; an empty place leaves no doubled underscores; the suffix is lower-cased."""
    from gritstone.functions.paths import extension, stem

    out = F.lit(template)
    parts = {
        "{date}": F.coalesce(F.date_format(when, "yyyy-MM-dd"), F.lit("undated")),
        "{time}": F.coalesce(F.date_format(when, "HHmmss"), F.lit("000000")),
        "{seq}": F.lpad(sequence.cast("string"), 3, "0"),
        "{location}": F.coalesce(location, F.lit("")),
        "{original}": stem(path),
    }
    for mark, value in parts.items():
        out = F.replace(out, F.lit(mark), value)
    return F.concat(F.regexp_replace(F.regexp_replace(out, "_{2,}", "_"), "^_|_$", ""), F.coalesce(extension(path), F.lit("")))


def day_gap(later_us: Column, earlier_us: Column) -> Column:
    """Whole days of a difference, floored, then its absolute value."""
    return F.abs(F.floor((later_us - earlier_us) / F.lit(86_400_000_000)))


def decimal_degrees(d: Column, m: Column, s: Column, ref: Column) -> Column:
    value = d + m / 60.0 + s / 3600.0
    return F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value)


def daily_time(text: Column) -> Column:
    """Minutes past midnight of HH:MM, 0 on any error."""
    hour, minute = F.get(F.split(text, ":"), 0).try_cast("int"), F.get(F.split(text, ":"), 1).try_cast("int")
    return F.when(hour.between(0, 23) & minute.between(0, 59), hour * 60 + minute).otherwise(0)


def commit_message(paths: Column) -> Column:
    """One file's name, or how many there are."""
    return F.when(F.size(paths) == 1, F.concat(F.lit("Update "), F.element_at(F.split(F.element_at(paths, 1), "/"), -1))).otherwise(F.concat(F.lit("Update "), F.size(paths).cast("string"), F.lit(" files")))


def within_days(at: Column, days: int) -> Column:
    """at lies in the last ``days`` days; 0 means today."""
    return at >= F.current_date().cast("timestamp") if days == 0 else at >= F.current_timestamp() - F.make_dt_interval(F.lit(days))
