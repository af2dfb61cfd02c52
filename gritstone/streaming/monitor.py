"""Watched folders with one state entry for each file: new files and changes leave in batches once a folder is quiet.

State is keyed by folder.  A known file is an entry of a map (its size and time),
a waiting one an entry of another; a timer holds the moment at which the folder
counts as quiet.  Nothing grows within one state value.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Kinds of a sighting, and what a waiting file is waiting as.
SEEN, GONE = "seen", "gone"
ADDED, MODIFIED, REMOVED = "added", "modified", "removed"
#: Rows that leave in one table within a batch, about.
TABLE_ROWS = 10_000
COLUMNS = ("path", "size", "modified_s", "kind", "at_ms")


class FolderWatch(StatefulProcessor):
    """Sightings (path, size, modified_s, kind, at_ms) of a folder to rows (path, change, size, left_ms).

    Within a batch sightings count in the order of (at_ms, path).  A known file
    that comes again is modified if size or time differ, else it is a repetition;
    an empty file becomes known and is not reported.  A file that goes while it
    waits as added was never there; one that goes later is removed.  Whatever is
    reported puts the folder's quiet moment off; what waits when it comes leaves
    together.  report: "new" leaves out modified and removed.
    """

    def __init__(self, folder: str, kind: str, quiet_ms: int, report: str, event_time: bool, forget_ms: int | None) -> None:
        self.folder, self.kind, self.quiet_ms, self.report, self.event_time, self.forget_ms = folder, kind, quiet_ms, report, event_time, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getMapState("known", "path string", "size long, modified_s long", ttlDurationMs=self.forget_ms)
        self.waiting = handle.getMapState("waiting", "path string", "change string, size long")
        self.quiet = handle.getValueState("quiet", "at long")

    # Each call to the state is a trip to the JVM.  What waits is held in self.held while a batch is taken in (None: no longer
    # waiting) and put into the state at its end; the state's own entries are asked only if it has some (self.stored).

    def _leave(self, key: tuple, at: int) -> list[tuple]:
        waiting = {}
        if self.stored:
            waiting = {p[0]: row for p, row in self.waiting.iterator()}
            self.waiting.clear()
            self.stored = False
        rows = sorted((p, *row) for p, row in (waiting | self.held).items() if row is not None)
        self.held = {}
        return [(key[0], *row, at) for row in rows]

    def _table(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[self.folder, "path", "change", "size", "left_ms"]).astype({"size": "Int64"})

    def _waits(self, path: str) -> str | None:
        """What a file is waiting as, if it is."""
        if path in self.held:
            row = self.held[path]
        else:
            row = self.waiting.getValue((path,)) if self.stored and self.waiting.containsKey((path,)) else None
        return None if row is None else row[0]

    def _sight(self, path: str, size: int, modified: int, kind: str) -> bool:
        """Take in one sighting; whether it puts the quiet moment off."""
        one, before = (path,), self.was.get(path, False)
        if before is False:
            before = self.known.getValue(one) if self.known.containsKey(one) else None
            before = None if before is None else tuple(before)
        if kind == GONE:
            if before is None:
                return False
            was = self._waits(path)
            self.known.removeKey(one)
            self.was[path] = None
            if was == ADDED or self.report == "new" or (before[0] == 0 and was is None):
                self.held[path] = None
                return False
            self.held[path] = (REMOVED, None)
            return True
        self.was[path] = (size, modified)
        if before == (size, modified):
            if self.forget_ms:
                self.known.updateValue(one, (size, modified))
            return False
        self.known.updateValue(one, (size, modified))
        if before is None:
            if size == 0:
                return False
            self.held[path] = (MODIFIED if self._waits(path) == REMOVED else ADDED, size)
            return True
        if self.report == "new":
            return False
        self.held[path] = (self._waits(path) or MODIFIED, size)
        return True

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at_ms", "path"], kind="stable")
        now = timerValues.getCurrentProcessingTimeInMs()
        before = due = self.quiet.get()[0] if self.quiet.exists() else None
        # Entries of removed files wait too, so there are some only if a quiet moment is set.
        self.held, self.was, self.stored = {}, {}, before is not None
        # A table is dear to hand over, so what leaves within a batch goes in few of them, not in one for each moment.
        left = []
        for path, size, modified, kind, at in batch[list(COLUMNS)].itertuples(index=False, name=None):
            at = int(at) if self.event_time else now
            if due is not None and due < at:
                # The moment passed within this batch, before its timer could say so.
                left += self._leave(key, due)
                due = None
                if len(left) >= TABLE_ROWS:
                    yield self._table(left)
                    left = []
            if self._sight(path, 0 if pd.isna(size) else int(size), 0 if pd.isna(modified) else int(modified), kind):
                due = at + self.quiet_ms if due is None else max(due, at + self.quiet_ms)
        for path, row in self.held.items():
            if row is not None:
                self.waiting.updateValue((path,), row)
            elif self.stored:
                self.waiting.removeKey((path,))
        if left:
            yield self._table(left)
        if due == before:
            return
        if before is not None:
            self.handle.deleteTimer(before)
            self.quiet.clear()
        if due is not None:
            self.quiet.update((due,))
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.quiet.exists() and self.quiet.get()[0] == expiredTimerInfo.getExpiryTimeInMs():
            self.quiet.clear()
            self.held, self.stored = {}, True
            if rows := self._leave(key, expiredTimerInfo.getExpiryTimeInMs()):
                yield self._table(rows)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for path, size, modified in initialState[["path", "size", "modified_s"]].itertuples(index=False, name=None):
            self.known.updateValue((path,), (0 if pd.isna(size) else int(size), 0 if pd.isna(modified) else int(modified)))

    def close(self) -> None:
        return None


def quiet_batches(
    sightings: DataFrame, folder: str = "folder", quiet_ms: int = 60_000, report: str = "new", known: DataFrame | None = None, at: str | None = None, forget_ms: int | None = None
) -> DataFrame:
    """(folder, path, change, size, left_ms) of a stream of sightings(folder, path, size, modified_s, kind).

    known(folder, path, size, modified_s) primes the state, so nothing that is
    there already is reported.  at: a watermarked time column; then times and
    timers are the events' own, otherwise the clock's.  forget_ms (clock only): a
    file that isn't sighted for so long is forgotten.  Null folders and paths are
    left out.
    """
    when = F.unix_millis(at) if at else F.lit(0).cast("long")
    rows = sightings.where(F.col(folder).isNotNull() & F.col("path").isNotNull())
    rows = rows.select(folder, *([at] if at else []), "path", F.col("size").cast("long").alias("size"), F.col("modified_s").cast("long").alias("modified_s"), F.coalesce("kind", F.lit(SEEN)).alias("kind"), when.alias("at_ms"))
    kind = dict(rows.dtypes)[folder]
    watch = FolderWatch(folder, kind, quiet_ms, report, at is not None, forget_ms)
    first = None if known is None else known.where(F.col(folder).isNotNull() & F.col("path").isNotNull()).groupBy(folder)
    mode = "EventTime" if at else "ProcessingTime"
    return rows.groupBy(folder).transformWithStateInPandas(watch, f"{folder} {kind}, path string, change string, size long, left_ms long", "Append", mode, initialState=first)


class StatusWatch(StatefulProcessor):
    """Rows whose status differs from the key's one before; the first counts."""

    def __init__(self, key: str) -> None:
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out, last = [], self.last.get()[0] if self.last.exists() else None
        fresh = not self.last.exists()
        for at, status in sorted(pd.concat(list(rows))[["at", "status"]].itertuples(index=False, name=None), key=lambda r: (r[0], r[1] or "")):
            if fresh or status != last:
                out.append((key[0], at, status))
            last, fresh = status, False
        self.last.update((last,))
        if out:
            yield pd.DataFrame(out, columns=[self.key, "at", "status"])

    def close(self) -> None:
        return None


def status_stream(events: DataFrame, key: str, status: str, at: str) -> DataFrame:
    """(key, at, status) of a stream at each change of status; within a batch by ``at``, ties by status."""
    rows = events.where(F.col(key).isNotNull()).select(key, F.col(at).cast("long").alias("at"), F.col(status).cast("string").alias("status"))
    return rows.groupBy(key).transformWithStateInPandas(StatusWatch(key), f"{key} {dict(rows.dtypes)[key]}, at long, status string", "Append", "None")
