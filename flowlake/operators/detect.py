"""Fan-in detection and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SECOND = 1_000_000
#: Seconds whose sums one task carries on.
STRETCH = 3600


def fan_in(flows: DataFrame, seconds: int = 60, threshold: int = 30, method: str = "sweep") -> DataFrame:
    """Flows plus distinct_sources (sources that reached dst_addr in the last ``seconds``, flows of the same
    instant included) and flag (more than ``threshold``).

    ``sweep``: a source counts from a flow on until ``seconds`` after its last one, so each (dst, src) pair gives merged
    intervals; their starts and ends are summed over time. Only these interval ends are gathered by destination, in
    partial sums over seconds and stretches of seconds, so a flooded destination does not meet in one task. ``sets``
    collects sets, for small data and tests. A flow without a source adds none; one without a destination or time has
    none to count and gets 0.
    """
    span = seconds * SECOND
    if method == "sets":
        w = Window.partitionBy("dst_addr").orderBy("recv_us").rangeBetween(-span, 0)
        n = F.when(F.col("dst_addr").isNull() | F.col("recv_us").isNull(), 0).otherwise(F.size(F.collect_set("src_addr").over(w))).cast("long")
        return flows.withColumn("distinct_sources", n).withColumn("flag", F.col("distinct_sources") > threshold)
    pair = Window.partitionBy("dst_addr", "src_addr").orderBy("recv_us")
    timed = flows.where("dst_addr is not null and recv_us is not null")
    times = timed.where("src_addr is not null").groupBy("dst_addr", "src_addr", "recv_us").agg(F.lit(1).alias("_one"))
    gaps = times.select("dst_addr", "src_addr", "recv_us", (F.lag("recv_us").over(pair)).alias("before"), F.lead("recv_us").over(pair).alias("after"))
    starts = gaps.where(F.col("before").isNull() | (F.col("recv_us") - F.col("before") > span)).select("dst_addr", F.col("recv_us").alias("t"), F.lit(1).alias("d"))
    # an interval holds its last instant plus the span, so it ends just after
    ends = gaps.where(F.col("after").isNull() | (F.col("after") - F.col("recv_us") > span)).select("dst_addr", (F.col("recv_us") + span + 1).alias("t"), F.lit(-1).alias("d"))
    asked = timed.select("dst_addr", F.col("recv_us").alias("t"), F.lit(0).alias("d"))
    levels = running(starts.unionByName(ends).unionByName(asked)).withColumnRenamed("t", "recv_us")
    rows = flows.join(levels, ["dst_addr", "recv_us"], "left").withColumn("distinct_sources", F.coalesce("distinct_sources", F.lit(0).cast("long")))
    return rows.select(*flows.columns, "distinct_sources", (F.col("distinct_sources") > threshold).alias("flag"))


def running(changes: DataFrame) -> DataFrame:
    """dst_addr, t, distinct_sources: the sum of all changes(dst_addr, t, d) of a destination up to each of its instants, by
    sums within the instant's second, over the seconds of its stretch, and over stretches, each in tasks of its own."""
    steps = changes.groupBy("dst_addr", "t").agg(F.sum("d").alias("d"))
    steps = steps.withColumn("second", F.floor(F.col("t") / SECOND))
    by_second = steps.groupBy("dst_addr", "second").agg(F.sum("d").alias("whole")).withColumn("stretch", F.floor(F.col("second") / STRETCH))
    by_stretch = by_second.groupBy("dst_addr", "stretch").agg(F.sum("whole").alias("whole"))
    before = lambda w: F.coalesce(F.sum("whole").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stretches = by_stretch.select("dst_addr", "stretch", before(Window.partitionBy("dst_addr").orderBy("stretch")).alias("ahead"))
    seconds_ = by_second.withColumn("within", before(Window.partitionBy("dst_addr", "stretch").orderBy("second")))
    bases = seconds_.join(stretches, ["dst_addr", "stretch"]).select("dst_addr", "second", (F.col("ahead") + F.col("within")).alias("base"))
    inside = Window.partitionBy("dst_addr", "second").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    summed = steps.withColumn("run", F.sum("d").over(inside)).join(bases, ["dst_addr", "second"])
    return summed.select("dst_addr", "t", (F.col("base") + F.col("run")).cast("long").alias("distinct_sources"))


def alerts(flagged: DataFrame, big: int = 5_000_000, n: int = 100) -> DataFrame:
    """K6, C11: anomalous flows, else very large ones; the newest n."""
    kind = F.when(F.col("flag"), "ddos").when(F.coalesce("octets", F.lit(0)) >= big, "big")
    return flagged.withColumn("kind", kind).where("kind is not null").orderBy(F.desc("recv_us"), F.desc("flow_id")).limit(n)
