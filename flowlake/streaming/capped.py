"""One-second partials of bounded size, with an error bound, that merge across tasks, micro-batches and windows.

A summary keeps, for each second and axis, at most ``n`` keys with what is certain of their bytes, and ``lost``: no key's true
bytes exceed its certain bytes (0 if it is not kept) by more than that. Summaries are added up and cut again: beyond n keys,
the bytes of the (n+1)-th are taken from all (Misra and Gries' rule, which merges), so ``lost`` is at most the total / (n + 1)
however often summaries were merged, and every key with more than that is kept. Totals stay exact, and a sketch of all
keys that ever counted tells how many distinct ones there were.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowlake.operators import stats

#: Keys of a second and axis that are kept, and the sketch's size (2^k bins: an error of 1.04 / 2^(k/2), one sigma).
CAP, SKETCH = 4000, 12
SUMMARY = "axis string, key string, bytes long, lost long, total long, sketch binary"


def _cut(keys: DataFrame, facts: DataFrame, by: tuple[str, ...], n: int) -> DataFrame:
    """by, key, bytes of at most n keys, less the bytes of the (n+1)-th, and facts(by, lost, total, sketch) with that added to
    lost; a row without key carries the facts of each group."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("bytes"), "key"))
    ranked = keys.withColumn("_r", rank).where(F.col("_r") <= n + 1)
    ranked = ranked.withColumn("_least", F.coalesce(F.max(F.when(F.col("_r") == n + 1, F.col("bytes"))).over(Window.partitionBy(*by)), F.lit(0)))
    none = F.lit(None)
    cuts = ranked.groupBy(*by).agg(F.max("_least").alias("_least"))
    facts = facts.join(cuts, list(by), "left").select(*by, none.cast("string").alias("key"), none.cast("long").alias("bytes"), (F.col("lost") + F.coalesce("_least", F.lit(0))).alias("lost"), "total", "sketch")
    left = ranked.where(F.col("bytes") > F.col("_least")).select(*by, "key", (F.col("bytes") - F.col("_least")).alias("bytes"))
    return left.select("*", none.cast("long").alias("lost"), none.cast("long").alias("total"), none.cast("binary").alias("sketch")).unionByName(facts)


def summarise(rows: DataFrame, by: tuple[str, ...] = ("second_us", "axis"), n: int = CAP) -> DataFrame:
    """The summary of rows(by, key, octets): bytes of keys, and a row without key for each group."""
    keys = rows.groupBy(*by, "key").agg(F.sum("octets").alias("bytes"))
    facts = rows.groupBy(*by).agg(F.lit(0).cast("long").alias("lost"), F.sum("octets").alias("total"), F.hll_sketch_agg("key", SKETCH).alias("sketch"))
    return _cut(keys, facts, by, n)


def merged(summaries: DataFrame, by: tuple[str, ...] = ("second_us", "axis"), n: int = CAP) -> DataFrame:
    """One summary of several that were united, by the same groups or by wider ones."""
    keys = summaries.where("key is not null").groupBy(*by, "key").agg(F.sum("bytes").alias("bytes"))
    facts = summaries.where("key is null").groupBy(*by).agg(F.sum("lost").alias("lost"), F.sum("total").alias("total"), F.hll_union_agg("sketch").alias("sketch"))
    return _cut(keys, facts, by, n)


def distinct_keys(sketch: Column) -> Column:
    return F.hll_sketch_estimate(sketch)


class CappedPartials:
    """Summaries of micro-batches under ``path``, each in the folder of its batch, so a batch that is made again leaves the same;
    flows of one second may come in any number of them."""

    def __init__(self, spark: SparkSession, path: str, n: int = CAP):
        self.spark, self.path, self.n = spark, path.rstrip("/"), n

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For ``flows.run``: takes micro-batches of enriched flows."""

        def write(batch: DataFrame, batch_id: int) -> None:
            rows = stats.axis_rows(stats.nonzero(batch)).select((F.floor(F.col("recv_us") / stats.SECOND) * stats.SECOND).alias("second_us"), "axis", "key", "octets")
            summarise(rows, n=self.n).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

        return write

    def rollup(self, first: int, last: int) -> DataFrame:
        """axis, key, bytes, lost, total, keys: the summary of the seconds that begin in [first, last]; true bytes lie between
        bytes and bytes + lost; keys estimates how many distinct ones an axis had."""
        schema = f"second_us long, {SUMMARY}"
        rows = self.spark.read.schema(schema).option("basePath", self.path).parquet(f"{self.path}/batch=*")
        one = merged(rows.where(F.col("second_us").between(first, last)), ("axis",), self.n)
        facts = one.where("key is null").select("axis", "lost", "total", distinct_keys(F.col("sketch")).alias("keys"))
        return one.where("key is not null").select("axis", "key", "bytes").join(facts, "axis")
