"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.plans.lineage import cut


#: Edges that one task deals with at least: small graphs are dealt with by few tasks, whatever the session's partitions.
TASK_EDGES = 250_000


def _one_task(edges: DataFrame) -> DataFrame:
    """Labels of a graph of at most TASK_EDGES edges(u, v), by union-find in one task instead of rounds of jobs."""
    kind = dict(edges.dtypes)["u"]

    def run(batches):
        import pyarrow as pa

        up: dict = {}

        def top(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        schema = None
        for batch in batches:
            schema = batch.schema
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                u, v = top(up.setdefault(u, u)), top(up.setdefault(v, v))
                up[max(u, v)] = min(u, v)
        if up:
            ids = list(up)
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=schema.field(0).type), pa.array([top(x) for x in ids], type=schema.field(0).type)], names=["id", "component"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, f"id {kind}, component {kind}")


def component_labels(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """id, component (smallest id reachable) of every endpoint of edges(a, b).

    Each round hangs every node's larger neighbours on the smallest node next to it, then its smaller ones, so long
    paths shrink by a factor a round and the number of edges never grows. A node of many edges is only ever reduced to
    its minimum before its edges are joined with it. Self-loops and repeated edges do no harm; null endpoints are dropped.
    """
    pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u is not null and v is not null")
    stars = cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    n = stars.count()
    # text of Python and of Spark sorts by code points and by bytes, which is the same order
    if n <= TASK_EDGES and dict(stars.dtypes)["u"] in ("bigint", "int", "string"):
        return cut(_one_task(stars))
    tasks = n // TASK_EDGES + 1
    before = None
    for _ in range(max_rounds):
        stars = stars.coalesce(tasks)
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(stars.where("u = v"))
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).coalesce(tasks).distinct().coalesce(tasks)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        hung = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        stars = cut(hung.coalesce(tasks).distinct().coalesce(tasks))
        # sums of bounded hashes: equal when no edge changed
        mark = stars.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("s")).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    return stars.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).coalesce(tasks)
