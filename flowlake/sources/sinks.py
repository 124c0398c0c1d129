"""Appends of facts, partitioned by time; reads that prune partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

HOUR = 3600 * 1_000_000


def drop_folder(spark: SparkSession, path: str) -> bool:
    """Deletes a folder, wherever Spark can write; whether it was there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def append_flows(flows: DataFrame, path: str, hours: int = 1, time: str = "recv_us", batch_id: int | None = None) -> None:
    """Appends flows in partitions of ``hours`` by time of receipt; flows without a time lie in a partition of their own.
    Those of a micro-batch with an id take the place of what an earlier attempt at it left, in ``path/batch=<id>``; a table
    is written with ids always or never."""
    rows = flows.withColumn("recv_hour", F.floor(F.col(time) / (hours * HOUR)) * hours)
    if batch_id is None:
        rows.write.mode("append").partitionBy("recv_hour").parquet(path)
    else:
        rows.write.mode("overwrite").partitionBy("recv_hour").parquet(f"{path}/batch={batch_id}")


def append_sni(log: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Six-hour partitions."""
    append_flows(log, path, 6, "ts_us", batch_id)


def read_window(spark: SparkSession, path: str, start: int, end: int, hours: int = 1, time: str = "recv_us") -> DataFrame:
    """Rows with start < time <= end; the derived partition bounds prune whole folders."""
    part = F.col("recv_hour").between(start // (hours * HOUR) * hours, end // (hours * HOUR) * hours)
    return spark.read.parquet(path).where(part & (F.col(time) > start) & (F.col(time) <= end))


def live_sink(stream: DataFrame, name: str, checkpoint: str | None = None, mode: str = "append") -> StreamingQuery:
    """The stream as an in-memory table for readers of this session; retention is by dropping partitions of S8."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def expire(spark: SparkSession, path: str, before: int, hours: int = 1) -> list[str]:
    """Deletes partitions that end at or before ``before`` (microseconds), under batches too; returns the folders
    deleted. Flows without a time never expire."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []

    def visit(folder, prefix: str) -> None:
        for entry in files.listStatus(folder):
            name = entry.getPath().getName()
            if name.startswith("batch="):
                visit(entry.getPath(), f"{name}/")
            elif name.startswith("recv_hour=") and name.split("=")[1].lstrip("-").isdigit() and (int(name.split("=")[1]) + hours) * HOUR <= before:
                files.delete(entry.getPath(), True)
                gone.append(prefix + name)

    visit(root, "")
    return gone


def newest(spark: SparkSession, path: str, n: int, hours: int = 1, time: str = "recv_us", tie: str = "flow_id") -> DataFrame:
    """The newest ``n`` rows of an appended table, for readers of any session: counts of partitions tell which of them hold
    these rows, and only the oldest of those is cut by order. Rows without a time are none."""
    rows = spark.read.parquet(path).where(F.col("recv_hour").isNotNull())
    left, whole, last = n, [], None
    # counts of partitions come from file footers
    for r in rows.groupBy("recv_hour").count().orderBy(F.desc("recv_hour")).toLocalIterator():
        if r["count"] > left:
            last = r["recv_hour"]
            break
        whole.append(r["recv_hour"])
        left -= r["count"]
    first = min(whole) if whole else None
    out = rows.where(F.col("recv_hour") >= first) if whole else rows.limit(0)
    if last is not None and left > 0:
        out = out.unionByName(rows.where(F.col("recv_hour") == last).orderBy(F.desc(time), F.desc(tie)).limit(left))
    return out.drop("recv_hour", *(["batch"] if "batch" in out.columns else []))


def keep_newest(spark: SparkSession, path: str, n: int, hours: int = 1) -> list[str]:
    """Retention of the hot tier: deletes the partitions that hold none of the newest ``n`` rows."""
    left = n
    for r in spark.read.parquet(path).where(F.col("recv_hour").isNotNull()).groupBy("recv_hour").count().orderBy(F.desc("recv_hour")).toLocalIterator():
        left -= r["count"]
        if left <= 0:
            return expire(spark, path, r["recv_hour"] * HOUR, hours)
    return []
