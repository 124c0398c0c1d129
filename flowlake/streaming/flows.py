"""Structured Streaming over flows: the same operators as in batch, with event time and watermarks."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.window import Window

from flowlake.operators import enrich, stats
from flowlake.operators.detect import running
from flowlake.plans import passes
from flowlake.plans.lineage import cut
from flowlake.sources.sinks import drop_folder


def timed(flows: DataFrame) -> DataFrame:
    """Flows with recv_time as a timestamp, for windows and watermarks."""
    return flows.withColumn("recv_time", F.timestamp_micros("recv_us"))


def resume(flows: DataFrame, delay: str = "10 minutes", key: tuple[str, ...] = ("flow_id",)) -> DataFrame:
    """Each flow once within the watermark; the checkpoint keeps the position, so a restart repeats nothing."""
    return timed(flows).withWatermark("recv_time", delay).dropDuplicatesWithinWatermark(list(key))


def run(stream: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """One query that hands every micro-batch to all sinks; ``every`` e.g. '2 seconds', or all there is now.

    The batch is kept while several sinks read it. Sinks see the batch id, so they can skip a repeated one.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        if len(sinks) > 1:
            batch = batch.persist()
        for sink in sinks:
            sink(batch, batch_id)
        if len(sinks) > 1:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def enriching_sink(dimensions: Callable[[], dict[str, DataFrame]], out: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A sink that applies corrections and applications, read anew for each batch, and hands the result on."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        d = dimensions()
        out(enrich.apply_apps(enrich.apply_overrides(batch, d["corrections"]), d["ip_app"]), batch_id)

    return sink


def second_partials(marked: DataFrame, delay: str = "10 seconds", axes: list[str] | None = None) -> DataFrame:
    """Bytes and packets by second, axis (all, or those given) and key, for append mode."""
    rows = stats.axis_rows(timed(stats.nonzero(marked)).withWatermark("recv_time", delay))
    if axes:
        rows = rows.where(F.col("axis").isin(axes))
    sums = rows.groupBy(F.window("recv_time", "1 second"), "axis", "key").agg(F.min("axis_country").alias("country"), *stats._amounts())
    return sums.select(F.unix_micros(F.col("window.start")).alias("second_us"), "axis", "key", "country", "bytes", "bytes_in", "bytes_out", "pkts_in", "pkts_out")


def rollup_partials(partials: DataFrame, now: int, seconds: int = 60) -> DataFrame:
    """T3's read: the trailing window from at most 600 one-second partials of each key."""
    seconds = int(stats.clamp(seconds, 1, 600))
    rows = partials.where((F.col("second_us") > now - seconds * stats.SECOND) & (F.col("second_us") <= now))
    sums = [F.sum(c).alias(c) for c in ("bytes", "bytes_in", "bytes_out", "pkts_in", "pkts_out")]
    return rows.groupBy("axis", "key").agg(F.min("country").alias("country"), *sums)


def cap_keys(partials: DataFrame, n: int = 4000) -> DataFrame:
    """T4: at most n keys an axis and second, those with most bytes; an option for readers, as state needs no cap."""
    rank = F.row_number().over(Window.partitionBy("second_us", "axis").orderBy(F.desc("bytes"), "key"))
    return partials.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


class _Sources(StatefulProcessor):
    """Per destination: source -> last time seen. A timer drops sources once the watermark has left them behind."""

    def __init__(self, seconds: int, threshold: int):
        self.span, self.threshold = seconds * 1_000_000, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "src string", "last_us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        flows = pd.concat(rows).sort_values(["recv_us", "flow_id"])
        last = {k[0]: v[0] for k, v in self.seen.iterator()}
        known = flows.dropna(subset=["src_addr"])
        times = pd.concat([pd.DataFrame({"src_addr": list(last), "recv_us": list(last.values())}), known[["src_addr", "recv_us"]]]).astype({"recv_us": "int64"})
        times = times.drop_duplicates().sort_values(["src_addr", "recv_us"], ignore_index=True)
        # a source counts from a time on until the span after its last one: starts and ends of such intervals
        at, src = times["recv_us"].to_numpy(), times["src_addr"].to_numpy()
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = (src[1:] != src[:-1]) | (at[1:] - at[:-1] > self.span)
        starts, ends = np.sort(at[fresh]), np.sort(at[np.append(fresh[1:], True)[: len(at)]]) + self.span
        now = flows["recv_us"].to_numpy()
        n = np.searchsorted(starts, now, side="right") - np.searchsorted(ends, now, side="left")
        newest = int(now[-1])
        for s, t in times.groupby("src_addr", sort=False)["recv_us"].max().items():
            if t < newest - self.span:
                if s in last:
                    self.seen.removeKey((s,))
            elif last.get(s) != t:
                self.seen.updateValue((s,), (int(t),))
        self._timer((newest + self.span) // 1000 + 1)
        yield flows.assign(distinct_sources=n, flag=n > self.threshold)[["flow_id", "dst_addr", "recv_us", "distinct_sources", "flag"]]

    def _timer(self, ms: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        self.handle.registerTimer(ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        return iter([])

    def close(self) -> None:
        pass


def fan_in_stream(stream: DataFrame, seconds: int = 60, threshold: int = 30, delay: str = "1 minute") -> DataFrame:
    """T5: fan-in of each flow as it arrives, from state by destination (needs the RocksDB state store). Flows must
    arrive in order of time across micro-batches; within one they are sorted. A source leaves the state ``seconds`` after
    it was last seen, at the latest when the watermark, ``delay`` behind the newest flow, has passed that time; flows later
    than the watermark are dropped. A flow without a source adds none; those without a destination or time are left out.
    One destination's flows of a micro-batch are one group: bound them by the trigger's size, or use FanIn."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    rows = timed(stream.where("dst_addr is not null and recv_us is not null").select("dst_addr", "src_addr", "recv_us", "flow_id")).withWatermark("recv_time", delay)
    return rows.groupBy("dst_addr").transformWithStateInPandas(_Sources(seconds, threshold), "flow_id long, dst_addr string, recv_us long, distinct_sources long, flag boolean", "append", "eventTime")


class FanIn:
    """T5 in two stateful steps, neither of which holds a destination in one group.

    The first keeps, by destination and source, when the source was last seen, and makes changes of the number of sources.
    The second adds them up over time by ``detect.running``, with what the micro-batches before left: each destination's
    number at their last instant, and changes still to come. Both are joins and windows over the micro-batch, without a call
    for each pair, and keep their state in ``folder`` under the batch's id, so a batch that is made again gives the same.
    Flows must arrive in order of time across micro-batches; those ``delay`` behind the newest of earlier ones are dropped."""

    def __init__(self, folder: str, seconds: int = 60, threshold: int = 30, delay: str = "1 minute"):
        self.folder, self.seconds, self.threshold, self.delay = folder.rstrip("/"), seconds, threshold, delay

    def changes(self, stream: DataFrame) -> DataFrame:
        """What the steps need of a stream of flows."""
        return stream.where("dst_addr is not null and recv_us is not null").select("dst_addr", "src_addr", F.col("recv_us").alias("t"), "flow_id")

    def _seen(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """dst_addr, src_addr, t: when each source was last seen; a row without a destination holds the newest time of all."""
        schema = "dst_addr string, src_addr string, t long"
        return spark.createDataFrame([], schema) if batch_id == 0 else spark.read.schema(schema).parquet(f"{self.folder}/seen={batch_id - 1}")

    def _intervals(self, flows: DataFrame, seen: DataFrame) -> DataFrame:
        """dst_addr, t, d: a source's interval adds a start (+1) and, just behind its span, an end (-1); a flow that comes before
        an end told earlier takes that end back (+1). A flow no newer than the last one changes nothing."""
        span, pair = self.seconds * 1_000_000, Window.partitionBy("dst_addr", "src_addr")
        times = flows.where("src_addr is not null").select("dst_addr", "src_addr", "t").distinct().withColumn("old", F.lit(False))
        rows = times.unionByName(seen.withColumn("old", F.lit(True)))
        rows = rows.withColumn("known", F.max(F.when(F.col("old"), F.col("t"))).over(pair)).where("old or known is null or t > known")
        rows = rows.withColumns({"before": F.lag("t").over(pair.orderBy("t")), "told": F.lag("old").over(pair.orderBy("t")), "after": F.lead("t").over(pair.orderBy("t"))}).where("not old")
        start = F.when(F.col("before").isNull() | (F.col("t") - F.col("before") > span), F.col("t")).when(F.col("told"), F.col("before") + span + 1)
        end = F.when(F.col("after").isNull() | (F.col("after") - F.col("t") > span), F.col("t") + span + 1)
        change = lambda at, d: F.struct(at.alias("t"), F.lit(d).cast("long").alias("d"))
        return rows.select("dst_addr", F.explode(F.array(change(start, 1), change(end, -1))).alias("c")).select("dst_addr", "c.t", "c.d").where("t is not null")

    def _left(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """dst_addr, t, d: what the batch before left; a destination's number is a change at its horizon."""
        schema = "dst_addr string, t long, d long"
        return spark.createDataFrame([], schema) if batch_id == 0 else spark.read.schema(schema).parquet(f"{self.folder}/left={batch_id - 1}")

    def sink(self, out: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        """The second step, for ``run``: hands (flow_id, dst_addr, recv_us, distinct_sources, flag) on."""

        def step(batch: DataFrame, batch_id: int) -> None:
            spark = batch.sparkSession
            past = self._seen(spark, batch_id)
            newest = past.where("dst_addr is null").agg(F.max("t")).first()[0]
            delay = F.expr(f"unix_micros(timestamp_micros(0) + interval {self.delay})")
            # read several times below
            new = cut(batch if newest is None else batch.where(F.col("t") >= F.lit(newest) - delay))
            seen = past.where("dst_addr is not null")
            every = cut(self._left(spark, batch_id).unionByName(self._intervals(new, seen)))
            # a source is forgotten once a flow of its own would begin anew
            now = F.lit(new.agg(F.greatest(F.max("t"), F.lit(newest).cast("long"))).first()[0]).cast("long")
            last = new.where("src_addr is not null").select("dst_addr", "src_addr", "t").unionByName(seen).groupBy("dst_addr", "src_addr").agg(F.max("t").alias("t"))
            last = last.where(F.col("t") + self.seconds * 1_000_000 + delay >= now)
            mark = spark.range(1).select(F.lit(None).cast("string").alias("dst_addr"), F.lit(None).cast("string").alias("src_addr"), now.alias("t"))
            last.unionByName(mark).write.mode("overwrite").parquet(f"{self.folder}/seen={batch_id}")
            drop_folder(spark, f"{self.folder}/seen={batch_id - 3}")
            asked = new.select("dst_addr", "t", F.lit(0).cast("long").alias("d"), "flow_id")
            levels = running(every.unionByName(asked.select("dst_addr", "t", "d")))
            told = asked.join(levels, ["dst_addr", "t"])
            out(told.select("flow_id", "dst_addr", F.col("t").alias("recv_us"), "distinct_sources", (F.col("distinct_sources") > self.threshold).alias("flag")), batch_id)
            horizon = asked.agg(F.max("t")).first()[0]
            if horizon is not None:
                every = every.withColumn("t", F.greatest("t", F.lit(horizon)))
            every.groupBy("dst_addr", "t").agg(F.sum("d").alias("d")).where("d <> 0").write.mode("overwrite").parquet(f"{self.folder}/left={batch_id}")
            drop_folder(spark, f"{self.folder}/left={batch_id - 3}")

        return step


def run_passes(spark: SparkSession, now: int, tables: dict, flows: DataFrame, sni_log: DataFrame, home: tuple[float, float]) -> dict[str, int]:
    """One round of all passes over state tables (see plans.state.Table), each from the versions read at its start;
    an outer scheduler, or every n-th micro-batch, calls it. Returns the new versions.

    A pass is named by the version it will publish. Its decisions are written under that name before the version, in the
    place of those an interrupted attempt left, so an attempt that is made again tells nothing twice."""
    versions = {"ip_geo": geo_pass(tables, flows, home)}
    versions["ip_app"] = app_pass(tables, sni_log, now)
    return versions


def geo_pass(tables: dict, flows: DataFrame, home: tuple[float, float]) -> int:
    """C1 to C4 on tables ip_geo, routes and geo_decisions, as in run_passes; returns the version published."""
    geo, told = tables["ip_geo"], tables["geo_decisions"]
    before = geo.version() or 0
    state, made = passes.observed_geo_pass(flows, geo.read(before or None))
    state, made = cut(state), cut(made)
    moved, why = passes.relocate(state, tables["routes"].read(), home)
    moved = cut(moved)
    reserved = passes.bogon_audit(moved, told.log(before))
    told.append(cut(made.unionByName(why, allowMissingColumns=True).unionByName(reserved, allowMissingColumns=True)), before + 1)
    return geo.publish(moved)


def app_pass(tables: dict, sni_log: DataFrame, now: int) -> int:
    """C5 on tables ip_app and app_decisions."""
    apps, told = tables["ip_app"], tables["app_decisions"]
    before = apps.version() or 0
    kept, made = passes.ip_app_pass(sni_log, apps.read(before or None), now)
    kept = cut(kept)
    told.append(cut(made), before + 1)
    return apps.publish(kept)


def trace_pass(tables: dict, flows: DataFrame, now: int, measure: Callable[[DataFrame], DataFrame], n: int = 48) -> int:
    """The n addresses to trace next, measured by ``measure`` (ip -> dst_ip, traced_us, hops), and the routes stored."""
    routes = tables["routes"]
    wanted = cut(passes.trace_candidates(flows, routes.read(), tables["ip_geo"].read(), now, n))
    return routes.publish(cut(passes.store_routes(routes.read(), measure(wanted))))


@dataclass
class Periodic:
    """A pass that is due once in each ``seconds`` of the flows' time; ``run(now)`` must be able to be made again."""

    name: str
    seconds: int
    run: Callable[[int], object]


class PassScheduler:
    """Passes with intervals of their own, driven by the time of the micro-batches.

    Time is cut into slots of each pass's interval; a pass is due if its newest finished slot, in the ledger, is an earlier
    one. The ledger is written after a pass. A run that was killed anywhere is made again: until its state is published,
    its decisions lie under the id it will have, and are replaced; afterwards it finds nothing new."""

    LEDGER = "pass string, slot long, now_us long"

    def __init__(self, ledger, periodic: list[Periodic]):
        self.ledger, self.periodic = ledger, periodic

    def due(self, now: int) -> list[Periodic]:
        done = {r["pass"]: r["slot"] for r in self.ledger.read().collect()}  # one row a pass
        return [p for p in self.periodic if now // (p.seconds * 1_000_000) > done.get(p.name, -1)]

    def tick(self, now: int) -> list[str]:
        """Runs what is due at ``now``, in order; returns the names."""
        ran = []
        for p in self.due(now):
            p.run(now)
            row = self.ledger.spark.createDataFrame([(p.name, now // (p.seconds * 1_000_000), now)], self.LEDGER)
            self.ledger.upsert(row, key="pass", protect=None)
            ran.append(p.name)
        return ran

    def sink(self, time: str = "recv_us") -> Callable[[DataFrame, int], None]:
        """For ``run``: each micro-batch's newest time drives the clock; place it behind the sinks that store the flows."""

        def step(batch: DataFrame, batch_id: int) -> None:
            now = batch.agg(F.max(time)).first()[0]
            if now is not None:
                self.tick(now)

        return step
