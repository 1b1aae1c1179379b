"""Tables in buckets by key with a manifest: a merge reads and writes the buckets it touches, and is there whole or not at all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skein.operators.writes import upsert
from skein.storage import drop, materialize


@dataclass(frozen=True)
class Manifest:
    """Version, key, columns and, by bucket, the folders that hold its rows."""

    version: int
    key: tuple[str, ...]
    schema: StructType
    buckets: int
    folders: dict[int, str]


class BucketTable:
    """A keyed table at `path`. Rows lie in buckets by a hash of the key; a manifest names the folder of each bucket.

    A write puts new folders beside the old ones and then one manifest, by a rename that fails if that version exists: readers
    see the version before or the one after, a failed write leaves files that no manifest names, and of two writers from one
    version the second raises. Old versions stay readable until `vacuum`.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: Sequence[str], buckets: int = 64) -> BucketTable:
        """A new table with rows (one for each key). buckets: some hundred MB each at the table's size."""
        table = cls(rows.sparkSession, path)
        first = Manifest(0, tuple(key), rows.schema, buckets, {})
        table._commit(first, table._written(rows, first))
        return table

    # Manifests lie in Hadoop's file system, so any store that Spark writes to holds them.

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at, fs = self._fs(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> Manifest:
        at = self.versions()[-1] if version is None else version
        said = json.loads("\n".join(r["value"] for r in self.spark.read.text(f"{self.path}/manifests/{at}.json").collect()))
        return Manifest(at, tuple(said["key"]), StructType.fromJson(said["schema"]), said["buckets"], {int(b): f for b, f in said["folders"].items()})

    def _commit(self, old: Manifest, folders: dict[int, str | None]) -> None:
        merged = {b: f for b, f in (old.folders | folders).items() if f is not None}
        said = json.dumps({"key": old.key, "schema": old.schema.jsonValue(), "buckets": old.buckets, "folders": merged})
        aside, fs = self._fs(f"{self.path}/manifests/{uuid.uuid4().hex}.aside")
        out = fs.create(aside, False)
        out.write(bytearray(said.encode()))
        out.close()
        target, _ = self._fs(f"{self.path}/manifests/{old.version + 1}.json")
        if fs.exists(target) or not fs.rename(aside, target):
            fs.delete(aside, False)
            raise RuntimeError(f"version {old.version + 1} was written meanwhile")

    def _bucket(self, m: Manifest) -> Column:
        return F.pmod(F.xxhash64(*m.key), F.lit(m.buckets)).cast("int")

    def _written(self, rows: DataFrame, m: Manifest, touched: Sequence[int] | None = None) -> dict[int, str | None]:
        """Writes rows by bucket into a new folder: the folder of each bucket, None for a touched one that has no row now."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        placed = rows.select(*m.schema.names).withColumn("_bucket", self._bucket(m)).repartition("_bucket")
        placed.write.partitionBy("_bucket").option("compression", "zstd").parquet(folder)
        at, fs = self._fs(folder)
        there = {int(n.split("=")[1]) for n in (s.getPath().getName() for s in fs.listStatus(at)) if n.startswith("_bucket=")}
        return {b: f"{folder}/_bucket={b}" if b in there else None for b in (range(m.buckets) if touched is None else touched)}

    def read(self, version: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """The table as a version has it, or some buckets of it."""
        m = self.manifest(version)
        folders = [f for b, f in sorted(m.folders.items()) if buckets is None or b in set(buckets)]
        return self.spark.read.schema(m.schema).parquet(*folders) if folders else self.spark.createDataFrame([], m.schema)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys: only their buckets are read."""
        m = self.manifest()
        on = reduce(lambda a, b: a & b, (F.col(f"t.{k}").eqNullSafe(F.col(f"k.{k}")) for k in m.key))
        return self.read(m.version, self._touched(keys, m)).alias("t").join(keys.select(*m.key).distinct().alias("k"), on, "left_semi")

    def _touched(self, rows: DataFrame, m: Manifest) -> list[int]:
        return sorted(r["b"] for r in rows.select(self._bucket(m).alias("b")).distinct().collect())  # as many as buckets at most

    def merge(self, incoming: DataFrame, order: str | None = None, partial: bool = False) -> list[int]:
        """Puts incoming rows in by key (see `upsert`): the buckets that were written anew."""
        m = self.manifest()
        rows, at = materialize(incoming, "incoming")
        touched = self._touched(rows, m)
        if touched:
            self._commit(m, self._written(upsert(self.read(m.version, touched), rows, m.key, order, partial), m, touched))
        drop(self.spark, at)
        return touched

    def delete(self, keys: DataFrame) -> list[int]:
        """Takes the rows of some keys out: the buckets that were written anew, those without such a row left alone."""
        m = self.manifest()
        gone, at = materialize(self.lookup(keys).select(*m.key), "gone")
        touched = self._touched(gone, m)
        if touched:
            on = reduce(lambda a, b: a & b, (F.col(f"t.{k}").eqNullSafe(F.col(f"g.{k}")) for k in m.key))
            left = self.read(m.version, touched).alias("t").join(gone.alias("g"), on, "left_anti")
            self._commit(m, self._written(left, m, touched))
        drop(self.spark, at)
        return touched

    def vacuum(self, keep: int = 2) -> int:
        """Deletes versions but the last `keep`, and all folders that no version left names, failed writes' too: how many folders went."""
        versions = self.versions()
        used = {f for v in versions[-keep:] for f in self.manifest(v).folders.values()}
        for v in versions[:-keep]:
            at, fs = self._fs(f"{self.path}/manifests/{v}.json")
            fs.delete(at, False)
        at, fs = self._fs(f"{self.path}/data")
        gone = 0
        for write in fs.listStatus(at):
            for bucket in fs.listStatus(write.getPath()):
                name = f"{self.path}/data/{write.getPath().getName()}/{bucket.getPath().getName()}"
                if bucket.isDirectory() and name not in used:
                    fs.delete(bucket.getPath(), True)
                    gone += 1
        return gone
