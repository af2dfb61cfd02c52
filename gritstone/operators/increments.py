"""Near-duplicate groups that grow: new hashes meet a stored band index, and groups keep their names.

<path>/add=<n>/members   (id, rep): every row of the n-th batch and the row that stands for its hash
<path>/add=<n>/reps      (id, h0, ...): hashes seen for the first time, with the group each went to
<path>/add=<n>/bands     (n, v, id, h0, ...): their bands
<path>/add=<n>/aliases   (component, now): groups that have become part of another one, up to this batch
<path>/add=<n>/done      written last; a batch without it is written again

Rows that are there already don't meet each other again: only bands of new hashes
are turned, and met with stored ones.  What the new links join are groups, so the
graph to contract has as many nodes as new hashes and the groups they touch.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.operators.graph import connected_components
from gritstone.operators.similar import _distance, bands_of
from gritstone.session import cut


class NearIndex:
    """Groups of rows whose hashes (one or several 64-bit words, none null) are at most ``most`` bits apart, or linked by such."""

    def __init__(self, spark: SparkSession, path: str, most: int, columns: tuple[str, ...] = ("hash",)) -> None:
        self.spark, self.path, self.most, self.columns = spark, path.rstrip("/"), most, columns
        self.names = [f"h{i}" for i in range(len(columns))]

    def _file(self, part: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def batches(self) -> int:
        n = 0
        while True:
            fs, path = self._file(f"add={n}/done")
            if not fs.exists(path):
                return n
            n += 1

    def _schema(self, part: str) -> str:
        words = "".join(f", {n} long" for n in self.names)
        return {"members": "id long, rep long", "reps": f"id long{words}, component long", "bands": f"n int, v long, id long{words}", "aliases": "component long, now long"}[part]

    def _stored(self, part: str, batches: int) -> DataFrame:
        paths = [f"{self.path}/add={i}/{part}" for i in range(batches)]
        return self.spark.read.schema(self._schema(part)).parquet(*paths) if paths else self.spark.createDataFrame([], self._schema(part))

    def _aliases(self, batches: int) -> DataFrame:
        return self.spark.read.schema(self._schema("aliases")).parquet(f"{self.path}/add={batches - 1}/aliases") if batches else self.spark.createDataFrame([], self._schema("aliases"))

    def _bands(self, reps: DataFrame, turned: bool) -> DataFrame:
        """(n, v, id, words): each band as it is, and if turned with every one bit changed as well."""
        out: list[Column] = []
        for i, (word, first, width) in enumerate(bands_of(len(self.names), self.most)):
            value = F.shiftrightunsigned(self.names[word], first).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))
            flips = [0, *[1 << k if k < 63 else -(1 << 63) for k in range(width)]] if turned else [0]
            out += [F.struct(F.lit(i).alias("n"), value.bitwiseXOR(F.lit(f)).alias("v")) for f in flips]
        return reps.select(F.explode(F.array(*out)).alias("b"), "id", *self.names).select("b.n", "b.v", "id", *self.names)

    def links(self, fresh: DataFrame, batches: int) -> DataFrame:
        """(src, dst): src new, dst new or stored, at most ``most`` bits apart."""
        one = self._stored("bands", batches).unionByName(self._bands(fresh, False)).alias("a")
        two = self._bands(fresh, True).alias("b")
        met = (F.col("a.n") == F.col("b.n")) & (F.col("a.v") == F.col("b.v")) & (F.col("a.id") != F.col("b.id")) & (_distance(self.names, "a", "b") <= self.most)
        return one.join(two, met).select(F.col("b.id").alias("src"), F.col("a.id").alias("dst")).distinct()

    def add(self, rows: DataFrame, key: str = "id") -> int:
        """Take in rows with ids that are not there yet; returns the batch's number.  Rows without a hash, or an id, are left out."""
        n = self.batches()
        base = f"{self.path}/add={n}"
        have = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*self.columns, key)])
        given = cut(rows.where(have).select(F.col(key).cast("long").alias("id"), *[F.col(c).cast("long").alias(m) for c, m in zip(self.columns, self.names, strict=True)]))
        own = given.groupBy(*self.names).agg(F.min("id").alias("first"))
        stored = self._stored("reps", n)
        known = stored.select(*self.names, F.col("id").alias("old"))
        named = cut(own.join(known, self.names, "left").withColumn("rep", F.coalesce("old", "first")))
        given.join(named.select(*self.names, "rep"), self.names).select("id", "rep").write.mode("overwrite").parquet(f"{base}/members")
        fresh = named.where("old is null").select(F.col("first").alias("id"), *self.names)
        self._bands(fresh, False).repartition("n").sortWithinPartitions("n", "v").write.mode("overwrite").parquet(f"{base}/bands")
        aliases = self._aliases(n)
        groups = stored.select(F.col("id").alias("dst"), "component").join(aliases, "component", "left").select("dst", F.coalesce("now", "component").alias("group"))
        found = cut(self.links(fresh, n).join(groups, "dst", "left").select("src", F.coalesce("group", "dst").alias("dst"), F.col("group").isNotNull().alias("is_old")))
        comp = connected_components(found)
        olds = found.where("is_old").select(F.col("dst").alias("node"), F.lit(True).alias("was")).distinct()
        marked = comp.join(olds, "node", "left")
        # Of old groups that meet the smallest keeps its name; a group of new rows alone is named by its smallest.
        names = marked.groupBy("component").agg(F.coalesce(F.min(F.when(F.col("was"), F.col("node"))), F.min("node")).alias("now"))
        named_nodes = cut(marked.join(names, "component").select("node", "was", "now"))
        new = fresh.join(named_nodes.where("was is null").select(F.col("node").alias("id"), "now"), "id", "left").withColumn("component", F.coalesce("now", "id")).drop("now")
        new.write.mode("overwrite").parquet(f"{base}/reps")
        moved = named_nodes.where("was and node <> now").select(F.col("node").alias("component"), "now")
        again = aliases.join(moved.select(F.col("component").alias("now"), F.col("now").alias("then")), "now", "left").select("component", F.coalesce("then", "now").alias("now"))
        again.unionByName(moved).write.mode("overwrite").parquet(f"{base}/aliases")
        fs, done = self._file(f"add={n}/done")
        fs.create(done, True).close()
        return n

    def groups(self) -> DataFrame:
        """(id, component) of all rows: the group's name is its first batch's smallest id, and stays when others join."""
        n = self.batches()
        reps = self._stored("reps", n).select(F.col("id").alias("rep"), "component").join(self._aliases(n), "component", "left").select("rep", F.coalesce("now", "component").alias("component"))
        return self._stored("members", n).join(reps, "rep").select("id", "component")
