"""Shortest distances and ways, as rounds of relaxation over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.plans.lineage import cut


def shortest(edges: DataFrame, sources: DataFrame, max_rounds: int = 200, width: float | None = None) -> DataFrame:
    """Source, id, dist, prev of all vertices that sources(id) reach, by relaxing the frontier until it is empty.
    Where sources have columns source and dist, a source starts at several vertices, at a distance each.

    Only vertices whose distance fell in a round send on; equal distances go to the smallest predecessor. Weights must
    be positive. With ``width``, vertices send on in buckets of so many kilometres, the nearest bucket first and until it is
    settled, so few of them send twice: more rounds, but less work in each, for graphs with many ways to a vertex.
    ``max_rounds`` bounds the rounds of a bucket then.
    """
    both = cut(edges.select("a", "b", "km").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "km")).groupBy("a", "b").agg(F.min("km").alias("km")))
    if "dist" in sources.columns:
        start = sources.groupBy("source", "id").agg(F.min("dist").alias("dist"))
    else:
        start = sources.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("dist")).distinct()
    base = cut(start.withColumn("prev", F.col("id")))
    frontier, log, waiting, limit, rounds = base, [], [], None, 0
    while rounds < max_rounds:
        rounds += 1
        if width is not None:
            if limit is not None:
                waiting.append(frontier.where(F.col("dist") >= limit))
                frontier = frontier.where(F.col("dist") < limit)
            if limit is None or frontier.isEmpty():
                # the next bucket: what waits and is not known better by now
                known = _merged(base, log) if log else base
                left = _latest(waiting).join(known.select("source", "id", F.col("dist").alias("_d"), F.col("prev").alias("_p")), ["source", "id"]).where("dist = _d and prev = _p").drop("_d", "_p") if waiting else frontier
                left = cut(left)
                least = left.agg(F.min("dist")).first()[0]
                if least is None:
                    return cut(_merged(base, log)) if log else base
                limit, rounds = least + width, 0
                frontier, waiting = left.where(F.col("dist") < limit), [left.where(F.col("dist") >= limit)]
        sent = frontier.join(both, frontier["id"] == both["a"]).select("source", F.col("b").alias("id"), (F.col("dist") + F.col("km")).alias("dist"), F.col("a").alias("prev"))
        better = sent.groupBy("source", "id").agg(F.min(F.struct("dist", "prev")).alias("new")).where("source <> id")
        # what is known stays where it is; the falls since then are looked up beside it
        better = better.join(base.select("source", "id", F.struct("dist", "prev").alias("old")), ["source", "id"], "left").where("old is null or new < old").drop("old")
        if log:
            better = better.join(_latest(log).select("source", "id", F.struct("dist", "prev").alias("fell")), ["source", "id"], "left").where("fell is null or new < fell")
        frontier = cut(better.select("source", "id", "new.dist", "new.prev"))
        if frontier.isEmpty():
            if width is None:
                return cut(_merged(base, log)) if log else base
            continue
        log.append(frontier)
        if len(log) == LOG_ROUNDS:
            base, log = cut(_merged(base, log)), []
    raise RuntimeError("distances did not settle")


#: Rounds of relaxation after which the falls are merged into the distances known.
LOG_ROUNDS = 12


def _latest(log: list[DataFrame]) -> DataFrame:
    rows = log[0]
    for more in log[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("source", "id").agg(F.min(F.struct("dist", "prev")).alias("d")).select("source", "id", "d.dist", "d.prev")


def _merged(base: DataFrame, log: list[DataFrame]) -> DataFrame:
    return _latest([base, *log])


def paths(tree: DataFrame, ends: DataFrame, max_rounds: int = 200) -> DataFrame:
    """source, id, ids: the vertices from source to each of ends(source, id), by following predecessors."""
    left = cut(ends.select("source", "id").distinct().join(tree.select("source", "id"), ["source", "id"], "left_semi").withColumn("at", F.col("id")).withColumn("ids", F.array("id")))
    done = None
    for _ in range(max_rounds):
        left = cut(left.join(tree.select("source", F.col("id").alias("at"), "prev"), ["source", "at"]))
        # a vertex that a source starts at comes before itself
        home = left.where("at = prev").select("source", "id", F.reverse("ids").alias("ids"))
        done = home if done is None else done.unionByName(home)
        left = cut(left.where("at <> prev").select("source", "id", F.col("prev").alias("at"), F.concat("ids", F.array("prev")).alias("ids")))
        if left.limit(1).count() == 0:
            return done
    raise RuntimeError("a path did not end")
