"""State tables as versioned Parquet snapshots: upserts that protect manual rows, seeds, audit appends.

Layout: ``root/name/v=<n>/`` and a pointer file ``root/name/CURRENT`` that is replaced whole, through Hadoop's file
system, so it lies wherever Spark can write. One writer a table; readers resolve the pointer once.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.plans.lineage import cut


def merge(state: DataFrame, updates: DataFrame, key: str = "ip", keep: tuple[str, ...] = (), protect: str | None = "manual") -> DataFrame:
    """State after an upsert. Columns in ``keep`` stay as they were on conflict, as do columns that updates lack;
    rows whose source equals ``protect`` stay whole."""
    old, new = state.alias("o"), updates.withColumn("_new", F.lit(True)).alias("n")
    both = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    guard = F.coalesce(F.col("o.source") == protect, F.lit(False)) if protect and "source" in state.columns else F.lit(False)
    take = F.coalesce(F.col("n._new"), F.lit(False)) & ~guard
    columns = []
    for c in state.columns:
        kind = state.schema[c].dataType
        if c == key:
            columns.append(F.coalesce(f"o.{c}", f"n.{c}").alias(c))
        elif c not in updates.columns:
            columns.append(F.col(f"o.{c}").alias(c))
        elif c in keep:
            columns.append(F.when(F.col(f"o.{key}").isNull(), F.col(f"n.{c}").cast(kind)).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            columns.append(F.when(take, F.col(f"n.{c}").cast(kind)).otherwise(F.col(f"o.{c}")).alias(c))
    return both.select(*columns)


def seed_if_absent(state: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """State plus the rows whose key it lacks; of seeds with one key, one stays."""
    fresh = rows.dropDuplicates([key]).join(state.select(key), key, "left_anti")
    return state.unionByName(fresh, allowMissingColumns=True)


class Table:
    """A named state table under ``root``."""

    def __init__(self, spark: SparkSession, root: str, name: str, schema: str, keep_versions: int = 3):
        self.spark, self.path, self.schema, self.keep = spark, f"{root.rstrip('/')}/{name}", schema, keep_versions
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int | None:
        pointer = self._path(f"{self.path}/CURRENT")
        if not self._fs.exists(pointer):
            return self._newest_whole()
        return int(self.spark.read.text(f"{self.path}/CURRENT").first()[0])

    def _newest_whole(self) -> int | None:
        """The newest version that was written to its end, where a pointer is lost."""
        if not self._fs.exists(self._path(self.path)):
            return None
        names = [e.getPath().getName() for e in self._fs.listStatus(self._path(self.path))]
        whole = [int(n[2:]) for n in names if n.startswith("v=") and self._fs.exists(self._path(f"{self.path}/{n}/_SUCCESS"))]
        return max(whole, default=None)

    def read(self, version: int | None = None) -> DataFrame:
        """The current (or a given) version; empty before the first."""
        version = self.version() if version is None else version
        if version is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={version}")

    def publish(self, rows: DataFrame) -> int:
        """Writes a new version, then moves the pointer to it."""
        version = (self.version() or 0) + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/v={version}")
        draft, pointer = self._path(f"{self.path}/CURRENT.new"), self._path(f"{self.path}/CURRENT")
        out = self._fs.create(draft, True)
        out.write(bytearray(str(version).encode()))
        out.close()
        # one step that overwrites: readers see the old pointer or the new one, never none
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        where = jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        where.rename(where.makeQualified(draft), where.makeQualified(pointer), options)
        old = self._path(f"{self.path}/v={version - self.keep}")
        if version > self.keep and self._fs.exists(old):
            self._fs.delete(old, True)
        return version

    def upsert(self, updates: DataFrame, key: str = "ip", keep: tuple[str, ...] = (), protect: str | None = "manual") -> int:
        return self.publish(merge(self.read(), updates, key, keep, protect))

    def append(self, rows: DataFrame, run: int = 0) -> None:
        """Audit rows, next to the versions. The rows of a pass with an id (``run`` above 0) take the place of those
        that an earlier attempt at the same pass left; without one they are added."""
        rows.write.mode("overwrite" if run else "append").parquet(f"{self.path}/log/run={run}")

    def log(self, upto: int | None = None) -> DataFrame:
        """Audit rows; with ``upto``, of passes up to that id only."""
        if not self._fs.exists(self._path(f"{self.path}/log")):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, run int").option("basePath", f"{self.path}/log").parquet(f"{self.path}/log")
        return (rows if upto is None else rows.where(F.col("run") <= upto)).drop("run")


class Conflict(RuntimeError):
    """Another writer published first, more often than a writer tries."""


class BucketedTable:
    """A state table in buckets by a hash of its key, for several writers.

    A version is a manifest, one line of JSON that names the folder of each bucket: ``root/name/m/<version>``. An upsert writes
    the buckets that its updates touch, and no others, then creates the next manifest, which fails if that is there. The
    writer that came too late keeps what it wrote where the versions between touched other buckets only, and else merges
    anew from the newest version. Readers see whole versions.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, schema: str, key: str = "ip", buckets: int = 64, attempts: int = 10):
        self.spark, self.path, self.schema, self.key, self.buckets, self.attempts = spark, f"{root.rstrip('/')}/{name}", schema, key, buckets, attempts
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest version; 0 before the first."""
        folder = self._path(f"{self.path}/m")
        if not self._fs.exists(folder):
            return 0
        names = [e.getPath().getName() for e in self._fs.listStatus(folder)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def manifest(self, version: int) -> dict[int, str]:
        if version == 0:
            return {}
        line = self.spark.read.text(f"{self.path}/m/{version:010d}").first()[0]
        return {int(k): v for k, v in json.loads(line).items()}

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The newest (or a given) version, or some buckets of it."""
        found = self.manifest(self.version() if version is None else version)
        folders = sorted(f for b, f in found.items() if buckets is None or b in buckets)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], self.schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _publish(self, version: int, manifest: dict[int, str]) -> bool:
        """Creates a manifest unless it is there."""
        try:
            out = self._fs.create(self._path(f"{self.path}/m/{version:010d}"), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        out.write(bytearray(json.dumps({str(k): v for k, v in sorted(manifest.items())}).encode()))
        out.close()
        return True

    def upsert(self, updates: DataFrame, keep: tuple[str, ...] = (), protect: str | None = "manual") -> int:
        """``merge`` into the table; returns the new version."""
        updates = cut(updates)
        touched = [r[0] for r in updates.select(self._bucket().alias("b")).distinct().collect()]  # at most ``buckets`` numbers
        base = self.version()
        folders = self._write(base, updates, touched, keep, protect)
        for _ in range(self.attempts):
            if self._publish(base + 1, self.manifest(base) | folders):
                return base + 1
            newest = self.version()
            old, new = self.manifest(base), self.manifest(newest)
            if any(old.get(b) != new.get(b) for b in touched):
                folders = self._write(newest, updates, touched, keep, protect)
            base = newest
        raise Conflict(f"{self.path}: {self.attempts} attempts came too late")

    def _write(self, version: int, updates: DataFrame, touched: list[int], keep: tuple[str, ...], protect: str | None) -> dict[int, str]:
        """Folders of the touched buckets after a merge with that version."""
        name = f"data/{uuid.uuid4().hex}"
        rows = merge(self.read(version, touched), updates, self.key, keep, protect).withColumn("_bucket", self._bucket())
        rows.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
        return {b: f"{name}/_bucket={b}" for b in touched}
