"""Folder trees as a data source: one ordered listing for batch reads and for streams that resume.

Entries come depth first, names without regard to case (then with it), hidden
and ignored ones and too large files left out, links not followed.  The folder
must be mounted at the same path on all executors; for object stores use
listing.listing, which goes through Spark's own file systems.

    register(spark)
    spark.read.format("folders").load("/mnt/drive").where("file_type = '.jpg'")
    spark.readStream.format("folders").option("perBatch", 10_000).load("/mnt/drive")
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith,
)

from gritstone.functions.paths import is_ignored

_PLACES = {"path": 0, "file_type": 3, "size": 4}
SCHEMA = "path string, folder string, filename string, file_type string, size long, modified_s long, error string"


def _rank(name: str) -> tuple[str, str]:
    return name.lower(), name


def _extension(name: str) -> str | None:
    return os.path.splitext(name)[1].lower() or None


@dataclass(frozen=True)
class Rules:
    """What a listing leaves out."""

    hidden: bool = False
    most_bytes: int = 50 << 30

    def skips(self, name: str) -> bool:
        return is_ignored(name) or (not self.hidden and name.startswith("."))


def entries(root: str, rules: Rules, after: tuple[str, ...] = (), deep: bool = True) -> Iterator[tuple[tuple[str, ...], os.DirEntry | None, str | None]]:
    """(path below root in parts, entry, error) of what follows ``after``, in order; a folder that can't be read is a row with its error.

    What ``after`` names need not exist any more.  Only the folders above it are
    read again, not those before it.
    """

    def inside(parts: tuple[str, ...], after: tuple[str, ...]) -> Iterator:
        folder = os.path.join(root, *parts)
        try:
            with os.scandir(folder) as found:
                own = sorted((e for e in found if not rules.skips(e.name)), key=lambda e: _rank(e.name))
        except OSError as e:
            if not after:
                yield parts, None, f"{type(e).__name__}: {e.strerror}"
            return
        for e in own:
            if after and _rank(e.name) < _rank(after[0]):
                continue
            here = bool(after) and e.name == after[0]
            if e.is_dir(follow_symlinks=False):
                if deep:
                    yield from inside((*parts, e.name), after[1:] if here else ())
            elif e.is_file(follow_symlinks=False) and not (here and len(after) == 1):
                yield (*parts, e.name), e, None

    yield from inside((), after)


def _row(root: str, parts: tuple[str, ...], entry: os.DirEntry | None, error: str | None) -> tuple:
    path = "/".join([root.rstrip("/"), *parts])
    if entry is None:
        return path, path, None, None, None, None, error
    folder = path.rpartition("/")[0]
    try:
        stat = entry.stat(follow_symlinks=False)
    except OSError as e:
        return path, folder, parts[-1], _extension(parts[-1]), None, None, f"{type(e).__name__}: {e.strerror}"
    return path, folder, parts[-1], _extension(parts[-1]), stat.st_size, int(stat.st_mtime), None


@dataclass
class Part(InputPartition):
    """A folder (all below it, or only its own files), or a stretch of the order: behind ``after`` up to ``upto``."""

    parts: tuple[str, ...] = ()
    deep: bool = True
    after: tuple[str, ...] = ()
    upto: tuple[str, ...] | None = None


@dataclass
class Wanted:
    """The conditions on path, type and size that a reader checks itself."""

    prefixes: list[str] = field(default_factory=list)
    types: set[str] | None = None
    sizes: list[tuple[str, int]] = field(default_factory=list)
    present: set[int] = field(default_factory=set)

    def take(self, f: Filter) -> bool:
        """Whether the condition is met here from now on."""
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if isinstance(f, StringStartsWith) and name == "path":
            self.prefixes.append(f.value)
        elif isinstance(f, EqualTo | In) and name == "file_type":
            own = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.types = own if self.types is None else self.types & own
        elif isinstance(f, GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and name == "size":
            self.sizes.append((type(f).__name__, f.value))
        elif isinstance(f, IsNotNull) and name in _PLACES:
            self.present.add(_PLACES[name])
        else:
            return False
        return True

    def may_hold(self, folder: str) -> bool:
        """Whether something below the folder can have the prefixes."""
        return all((folder + "/").startswith(p) or p.startswith(folder + "/") for p in self.prefixes)

    def row(self, row: tuple) -> bool:
        compare = {"GreaterThan": lambda a, b: a > b, "GreaterThanOrEqual": lambda a, b: a >= b, "LessThan": lambda a, b: a < b, "LessThanOrEqual": lambda a, b: a <= b}
        path, _, _, kind, size = row[:5]
        return all(row[i] is not None for i in self.present) and all(path.startswith(p) for p in self.prefixes) and (self.types is None or kind in self.types) and all(size is not None and compare[op](size, v) for op, v in self.sizes)


class FolderReader(DataSourceReader):
    def __init__(self, root: str, rules: Rules, parts: int) -> None:
        self.root, self.rules, self.most, self.wanted = root, rules, parts, Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return [f for f in filters if not self.wanted.take(f)]

    def partitions(self) -> list[Part]:
        """Sub-folders, level by level, until there are enough; a folder that was opened is a partition for its own files."""
        todo, done = [()], []
        while todo and len(todo) + len(done) < self.most:
            parts = todo.pop(0)
            try:
                with os.scandir(os.path.join(self.root, *parts)) as found:
                    inner = sorted((e.name for e in found if not self.rules.skips(e.name) and e.is_dir(follow_symlinks=False)), key=_rank)
            except OSError:
                done.append(Part(parts))
                continue
            done.append(Part(parts, deep=False))
            todo += [(*parts, n) for n in inner if self.wanted.may_hold("/".join([self.root.rstrip("/"), *parts, n]))]
        return done + [Part(p) for p in todo]

    def read(self, partition: Part) -> Iterator[tuple]:
        base = os.path.join(self.root, *partition.parts)
        for parts, entry, error in entries(base, self.rules, deep=partition.deep):
            row = _row(self.root, (*partition.parts, *parts), entry, error)
            if (row[4] is None or row[4] <= self.rules.most_bytes) and self.wanted.row(row):
                yield row


class FolderStream(DataSourceStreamReader):
    """The listing in stretches of perBatch files.  An offset is the last path of its stretch, so the order alone says what comes next.

    A listing that came to its end stays there: what is added before that point
    later is for another scan (or for streaming.monitor).
    """

    def __init__(self, root: str, rules: Rules, per_batch: int, slices: int) -> None:
        self.root, self.rules, self.per_batch, self.slices, self.at = root, rules, per_batch, slices, None

    def initialOffset(self) -> dict:
        return {"last": ""}

    @staticmethod
    def _parts(offset: dict) -> tuple[str, ...]:
        return tuple(offset["last"].split("/")) if offset["last"] else ()

    def _follow(self, after: tuple[str, ...], most: int) -> list[tuple[str, ...]]:
        out = []
        for parts, _, _ in entries(self.root, self.rules, after):
            out.append(parts)
            if len(out) == most:
                break
        return out

    def latestOffset(self) -> dict:
        after = self.at if self.at is not None else ()
        found = self._follow(after, self.per_batch)
        self.at = found[-1] if found else after
        return {"last": "/".join(self.at)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        """The stretch as at most ``slices`` shorter ones.  After a restart the offset of the log is where the next one begins."""
        after, upto = self._parts(start), self._parts(end)
        if self.at is None or _order(self.at) < _order(upto):
            self.at = upto
        names = []
        for parts, _, _ in entries(self.root, self.rules, after):
            if _order(parts) > _order(upto):
                break
            names.append(parts)
        step = max(1, -(-len(names) // self.slices))
        bounds = [after, *names[step - 1 : -1 : step], upto]
        return [Part(after=a, upto=b) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if a != b]

    def read(self, partition: Part) -> Iterator[tuple]:
        for parts, entry, error in entries(self.root, self.rules, partition.after):
            if _order(parts) > _order(partition.upto):
                return
            row = _row(self.root, parts, entry, error)
            if row[4] is None or row[4] <= self.rules.most_bytes:
                yield row

    def commit(self, end: dict) -> None:
        return None


def _order(parts: tuple[str, ...]) -> tuple:
    return tuple(_rank(p) for p in parts)


class Folders(DataSource):
    """Options: path; hidden (false), mostBytes (50 GiB), partitions (64) of a batch read, perBatch (10,000) files and slices (8) of a stream."""

    @classmethod
    def name(cls) -> str:
        return "folders"

    def schema(self) -> str:
        return SCHEMA

    def _rules(self) -> Rules:
        return Rules(self.options.get("hidden", "false").lower() == "true", int(self.options.get("mostBytes", 50 << 30)))

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options["path"], self._rules(), int(self.options.get("partitions", 64)))

    def streamReader(self, schema) -> FolderStream:
        return FolderStream(self.options["path"], self._rules(), int(self.options.get("perBatch", 10_000)), int(self.options.get("slices", 8)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Folders)


def classify(seen: DataFrame, catalogue: DataFrame, drive: str) -> DataFrame:
    """The rows of a scan with drive_id and change: new, modified or unchanged against the catalogue's live rows by (drive_id, path); the quick mode drops the unchanged.

    Rows with an error are left out; a size or time that is null on both sides is no change.
    """
    old = catalogue.where(F.col("drive_id") == drive).select("path", F.col("size").alias("_size"), F.col("modified_s").alias("_modified"), F.lit(True).alias("_known"))
    joined = seen.where("error is null").join(old, "path", "left")
    same = F.col("size").eqNullSafe(F.col("_size")) & F.col("modified_s").eqNullSafe(F.col("_modified"))
    change = F.when(F.col("_known").isNull(), "new").when(same, "unchanged").otherwise("modified")
    return joined.select(F.lit(drive).alias("drive_id"), *seen.columns, change.alias("change"))


def scan_into(stream: DataFrame, path: str, checkpoint: str, observed: str = "scan") -> None:
    """Drain a stream of the listing into Parquet; counters by kind of error and bytes are taken in passing, as the query's observed metrics.

    A run that was stopped begins behind its last finished stretch; the sink's log
    keeps a stretch that was written but not noted from being written twice.
    """
    counted = stream.observe(
        observed, F.count("*").alias("rows"), F.count("error").alias("errors"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        F.count(F.when(F.col("error").startswith("PermissionError"), 1)).alias("denied"),
    )
    counted.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
