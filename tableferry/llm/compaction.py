"""Size-tiered compaction of immutable shards, with an atomically committed, versioned manifest.

Arrivals are appended as small shards (files). When a tier (shards whose sizes lie within one power of
``FANOUT``) holds enough of them, they are read together and written as files of the target size: the
scan packs small files into partitions of that size, so no row is shuffled. What a merge writes may fill the
next tier, which is merged in turn. A manifest lists the live shards. Its rows are written aside, and one small
file that is published whole, under a number that nobody has taken, makes them a version. An arrival that finds its number
taken is listed after what others have committed; a merge is given up if the shards that it replaces are gone.

Null columns, repeated rows, very long texts and extra columns, whatever their names, are kept as they are. An
empty arrival adds no shard; a table without shards reads as an empty one. DataFrame operations only.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Conflict, Versions

TARGET_BYTES = 128 << 20
#: A tier is merged once it holds so many shards; sizes within one power of this share a tier.
FANOUT = 4
MANIFEST = "path string, bytes long, rows long, tier int"


class ShardedTable:
    def __init__(self, spark: SparkSession, root: str, schema, target_bytes: int = TARGET_BYTES):
        self.spark, self.root, self.schema, self.target = spark, root.rstrip("/"), schema, target_bytes
        self._versions = Versions(spark, f"{self.root}/manifests")

    # -- manifest ---------------------------------------------------------------------------
    def versions(self) -> list[int]:
        return self._versions.numbers()

    def version(self) -> int:
        return self._versions.latest()[0]

    def manifest(self, version: int | None = None) -> DataFrame:
        said = self._versions.latest()[1] if version is None else self._versions.get(version) if version else None
        return self.spark.read.schema(MANIFEST).parquet(said["rows"]) if said else self.spark.createDataFrame([], MANIFEST)

    def _staged(self, shards: DataFrame) -> str:
        path = f"{self.root}/staged/{uuid.uuid4().hex}"
        shards.select("path", "bytes", "rows", "tier").coalesce(1).write.parquet(path)
        return path

    def commit(self, shards: DataFrame, after: int) -> int:
        """Publish ``shards`` as the version after ``after``; fails if another writer has done so first."""
        self._versions.put(after + 1, {"rows": self._staged(shards)})
        return after + 1

    def _add(self, shards: DataFrame) -> int:
        """Publish further shards after what has been committed so far, whoever is first."""
        staged = self.spark.read.schema(MANIFEST).parquet(self._staged(shards))
        while True:
            now = self.version()
            try:
                return self.commit(self.manifest(now).unionByName(staged), now)
            except Conflict:
                continue

    # -- shards -----------------------------------------------------------------------------
    def _new_folder(self, now: int) -> str:
        return f"{self.root}/shards/{now + 1:08d}-{uuid.uuid4().hex[:8]}"

    def _listed(self, folder: str) -> DataFrame:
        """Files of a folder with their sizes and row counts."""
        tier = F.floor(F.log(F.greatest(F.col("bytes"), F.lit(1)).cast("double")) / F.log(F.lit(float(FANOUT)))).cast("int")
        return (
            self.spark.read.schema(self.schema).parquet(folder)
            .groupBy(F.col("_metadata.file_path").alias("path"))
            .agg(F.max("_metadata.file_size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
            .withColumn("tier", tier)
        )

    def append(self, arrival: DataFrame) -> int:
        """One immutable shard for each partition of the arrival, as they come."""
        folder = self._new_folder(self.version())
        arrival.select(*self.schema.names).write.option("compression", "zstd").parquet(folder)
        return self._add(self._listed(folder))

    def append_all(self, arrivals: DataFrame, by: Column) -> int:
        """Several arrivals, told apart by an expression, in one pass over their rows."""
        name = "arrival"
        while name in (c.lower() for c in self.schema.names):
            name += "_"
        folder = self._new_folder(self.version())
        arrivals.select(*self.schema.names, by.alias(name)).write.option("compression", "zstd").partitionBy(name).parquet(folder)
        return self._add(self._listed(folder))

    def full_tiers(self, shards: DataFrame) -> list[int]:
        """Tiers that hold enough shards to merge. Shards of half the target size or more rest."""
        small = shards.where(F.col("bytes") < self.target // 2).groupBy("tier").count().where(F.col("count") >= FANOUT)
        return sorted(r["tier"] for r in small.collect())  # a row a tier

    def compact(self) -> int:
        """Merge the lowest full tier, then what is full after that, until none is; one commit for all merges.

        The plan comes from the manifest, one row a shard. A tier of which a merge leaves as many shards as it
        had, as it can't hold fewer files of the target size, is not merged again. Shards that arrive meanwhile stay as
        they are; Conflict if another writer has merged the same ones.
        """
        now = self.version()
        begun = live = self.manifest(now)
        done: set[int] = set()
        while full := [t for t in self.full_tiers(live) if t not in done]:
            merging = live.where((F.col("tier") == full[0]) & (F.col("bytes") < self.target // 2))
            paths = [r["path"] for r in merging.select("path").collect()]  # the driver lists the files of any scan
            folder = self._new_folder(now)
            self._merge(paths, folder)
            merged = self._listed(folder)
            if merged.where(F.col("tier") <= full[0]).count() >= FANOUT:
                done.add(full[0])
            live = live.join(merging.select("path"), "path", "left_anti").unionByName(merged)
            live = self.spark.read.schema(MANIFEST).parquet(self._staged(live))
        if now == 0 or _less(live, begun).isEmpty():
            return now
        while True:
            try:
                return self.commit(live, now)
            except Conflict:
                now = self.version()
                others = self.manifest(now)
                if not _less(_less(begun, live), others).isEmpty():
                    raise
                live = self.spark.read.schema(MANIFEST).parquet(self._staged(live.unionByName(_less(others, begun))))
                begun = others

    def vacuum(self, hours: float = 24.0) -> int:
        """Delete shards that the latest version does not list and that are ``hours`` old: younger ones may belong to a
        writer that has not committed yet. Older versions can't be read then."""
        before = (time.time() - hours * 3600) * 1000
        fs, p = self._versions._fs(f"{self.root}/shards")
        live = self.manifest().select(F.regexp_extract("path", "/shards/([^/]+)/", 1).alias("folder")).distinct()
        kept = {r["folder"] for r in live.collect()}  # a row an append or merge
        old = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName() not in kept and s.getModificationTime() <= before]
        for path in old:
            fs.delete(path, True)
        return len(old)

    def _merge(self, paths: list[str], folder: str) -> None:
        """Write the shards again as files of the target size: each partition of the scan holds whole
        small files up to that size. The settings that make it so are those of a session of its own."""
        session = self.spark.newSession()
        for k, v in {"maxPartitionBytes": self.target, "openCostInBytes": 0, "minPartitionNum": 1}.items():
            session.conf.set(f"spark.sql.files.{k}", str(v))
        session.read.schema(self.schema).parquet(*paths).write.option("compression", "zstd").parquet(folder)

    def read(self, version: int | None = None) -> DataFrame:
        paths = [r["path"] for r in self.manifest(version).select("path").collect()]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def sound(self) -> bool:
        """Whether every shard of the latest version has the rows that the manifest says, and no other file is read."""
        held = self.read().groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("held")) if self.versions() else None
        if held is None:
            return True
        listed = self.manifest().where("rows > 0")
        return listed.join(held, "path", "full_outer").where(~F.col("rows").eqNullSafe(F.col("held"))).isEmpty()


def _less(shards: DataFrame, others: DataFrame) -> DataFrame:
    return shards.join(others.select("path"), "path", "left_anti")
