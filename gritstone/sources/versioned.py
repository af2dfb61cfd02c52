"""A versioned table of Parquet folders: copy-on-write by bucket, an atomic pointer, old versions, compaction.

<path>/data/<commit>/bucket=<b>/   rows whose keys hash to b, as that commit wrote them
<path>/versions/<n>.json           for each bucket the folder that holds it in version n

A change reads and writes only the buckets that its rows touch; the next version
names the others' folders again.  Writing versions/<n>.json is the commit: it is
moved into place and fails if it is there, so of two writers of one version the
second loses and may try again on what the first made.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gritstone.operators import mutation


class Conflict(RuntimeError):
    """Another writer has committed the version that this one wanted to."""


class VersionedTable:
    """The table at path; its keys and number of buckets are fixed when it is made."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    # Files of the table, through Spark's own file systems.

    def _hadoop(self, part: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")

    def _fs(self):
        return self._hadoop("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._hadoop("versions")
        found = self._fs().listStatus(folder) if self._fs().exists(folder) else []
        return sorted(int(f.getPath().getName()[:-5]) for f in found if f.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise KeyError(f"no version {version if version is not None else 'at all'} in {self.path}")
        wanted = known[-1] if version is None else version
        stream = self._fs().open(self._hadoop(f"versions/{wanted}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _commit(self, manifest: dict) -> int:
        version = manifest["version"]
        draft, final = self._hadoop(f"versions/.{uuid.uuid4().hex}"), self._hadoop(f"versions/{version}.json")
        out = self._fs().create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri() if final.toUri().getScheme() else self._fs().getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(self._fs().makeQualified(draft), self._fs().makeQualified(final), none)
        except Exception as e:
            self._fs().delete(draft, False)
            if self._fs().exists(final):
                raise Conflict(f"version {version} of {self.path} is there already") from e
            raise
        return version

    # Reading.

    def _schema(self, manifest: dict) -> StructType:
        return StructType.fromJson(manifest["schema"])

    def _folders(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        wanted = [manifest["buckets"][str(b)] for b in buckets] if buckets is not None else list(manifest["buckets"].values())
        full = [f"{self.path}/{f}" for f in wanted if f]
        reader = self.spark.read.schema(self._schema(manifest))
        return reader.parquet(*full) if full else self.spark.createDataFrame([], self._schema(manifest))

    def read(self, version: int | None = None) -> DataFrame:
        return self._folders(self.manifest(version))

    def history(self) -> list[dict]:
        """(version, operation, buckets written) of every version, oldest first."""
        return [{k: m[k] for k in ("version", "operation", "written")} for m in (self.manifest(v) for v in self.versions())]

    # Writing.

    def _bucket(self, keys: list[str], buckets: int) -> Column:
        """Null keys have a bucket as well: a null hashes to the seed."""
        return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, manifest: dict) -> dict[int, str]:
        """Rows into a new folder for each of their buckets; (bucket, folder below path)."""
        commit = f"data/{manifest['version']:08d}-{uuid.uuid4().hex[:12]}"
        names = [f.name for f in self._schema(manifest).fields]
        dealt = rows.select(*names, self._bucket(manifest["keys"], manifest["count"]).alias("bucket"))
        dealt.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{commit}")
        return {int(f.getPath().getName()[7:]): f"{commit}/{f.getPath().getName()}" for f in self._fs().listStatus(self._hadoop(commit)) if f.getPath().getName().startswith("bucket=")}

    @classmethod
    def create(cls, spark: SparkSession, path: str, rows: DataFrame, keys: list[str], buckets: int = 16) -> VersionedTable:
        """Version 0.  Choose buckets so that one is a task's size; their number bounds a manifest."""
        table = cls(spark, path)
        if table.versions():
            raise Conflict(f"there is a table at {path}")
        manifest = {"version": 0, "operation": "create", "keys": keys, "count": buckets, "schema": json.loads(rows.schema.json()), "buckets": {}, "written": [], "at": time.time()}
        folders = table._write(rows, manifest)
        manifest |= {"buckets": {str(b): folders.get(b) for b in range(buckets)}, "written": sorted(folders)}
        table._commit(manifest)
        return table

    def _replace(self, old: dict, touched: list[int], rows: DataFrame, operation: str) -> int:
        new = old | {"version": old["version"] + 1, "operation": operation, "at": time.time()}
        folders = self._write(rows, new) if touched else {}
        new["buckets"] = old["buckets"] | {str(b): folders.get(b) for b in touched}
        new["written"] = touched
        return self._commit(new)

    def merge(self, batch: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame] | None = None, operation: str = "merge") -> int:
        """The version with batch merged in: change(rows of the touched buckets, batch) gives their new rows, an upsert by key if none is given.

        change must leave rows alone whose key is not in batch, and give the
        table's columns.  Which buckets are touched comes to the driver: as many
        numbers as there are buckets, at most.  No rows: a version without change.
        """
        old = self.manifest()
        keys = old["keys"]
        touched = sorted(r.bucket for r in batch.select(self._bucket(keys, old["count"]).alias("bucket")).distinct().collect())
        apply = change or (lambda rows, new: mutation.upsert(rows, new, keys))
        return self._replace(old, touched, apply(self._folders(old, touched), batch), operation)

    def delete(self, condition: Column | str) -> int:
        """The version without the rows that meet condition; only their buckets are written."""
        old = self.manifest()
        bucket = self._bucket(old["keys"], old["count"]).alias("bucket")
        touched = sorted(r.bucket for r in self._folders(old).where(condition).select(bucket).distinct().collect())
        condition = F.expr(condition) if isinstance(condition, str) else condition
        return self._replace(old, touched, mutation.delete_where(self._folders(old, touched), condition), "delete")

    def compact(self, most_files: int = 1) -> int:
        """The version whose buckets of more than most_files files are one file each."""
        old = self.manifest()
        count = lambda f: sum(s.getPath().getName().endswith(".parquet") for s in self._fs().listStatus(self._hadoop(f)))
        touched = sorted(int(b) for b, f in old["buckets"].items() if f and count(f) > most_files)
        return self._replace(old, touched, self._folders(old, touched), "compact")

    def restore(self, version: int) -> int:
        """A new version that is an old one again; nothing is written but the manifest."""
        old, now = self.manifest(version), self.manifest()
        return self._commit(old | {"version": now["version"] + 1, "operation": f"restore {version}", "written": [], "at": time.time()})

    def vacuum(self, keep: int = 10) -> list[str]:
        """Remove all versions but the newest ``keep``, and folders that none of these names; returns the folders.

        Don't run it beside a writer: what that one has written and not yet
        committed is named by no version.
        """
        known = self.versions()
        named = {f for v in known[-keep:] for f in self.manifest(v)["buckets"].values() if f}
        for v in known[:-keep]:
            self._fs().delete(self._hadoop(f"versions/{v}.json"), False)
        gone = []
        for commit in self._fs().listStatus(self._hadoop("data")):
            for bucket in self._fs().listStatus(commit.getPath()):
                name = f"data/{commit.getPath().getName()}/{bucket.getPath().getName()}"
                if bucket.isDirectory() and name not in named:
                    self._fs().delete(bucket.getPath(), True)
                    gone.append(name)
        return sorted(gone)
