"""Traffic questions over flows with ``src_home``, ``dst_home`` marks and microsecond times (recv_us).

``now`` is always a parameter (microseconds). Sums are 64-bit; cast octets to decimal first where totals may pass 2^63.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowlake.functions.flow import direction, proto_key
from flowlake.functions.geo import grid_cell

SECOND = 1_000_000


def clamp(value: float, low: float, high: float) -> float:
    return max(low, min(high, value))


def trailing(flows: DataFrame, now: int, seconds: float, low: float = 1, high: float = 366 * 86400) -> DataFrame:
    """received in the last ``seconds`` (clamped), not after now."""
    since = now - int(clamp(seconds, low, high) * SECOND)
    return flows.where((F.col("recv_us") > since) & (F.col("recv_us") <= now))


def between(flows: DataFrame, now: int, start: int | None, end: int | None, since_s: float = 300) -> DataFrame:
    """(start, end] if both are given in order, else the trailing window with a minute's grace."""
    if start is None or end is None or end <= start:
        start, end = now - int(clamp(since_s, 1, 366 * 86400) * SECOND), now + 60 * SECOND
    return flows.where((F.col("recv_us") > start) & (F.col("recv_us") <= end))


def both_located(flows: DataFrame) -> DataFrame:
    """F3."""
    return flows.where("src_geo.lat is not null and dst_geo.lat is not null")


def nonzero(flows: DataFrame) -> DataFrame:
    """F8."""
    return flows.where("octets > 0")


def since(flows: DataFrame, recv_sec: int) -> DataFrame:
    """from a saved second on, that second included."""
    return flows.where(F.col("recv_us") >= recv_sec * SECOND)


def visible(flows: DataFrame, only: str | None = None, min_bytes: int = 0, services: list[str] | None = None, protocols: list[str] | None = None, hide_flagged: bool = False) -> DataFrame:
    """by direction, size, service_key, proto_key and fan-in flag."""
    out = flows.where(F.coalesce("octets", F.lit(0)) >= min_bytes)
    if only:
        out = out.where(F.col("direction") == only)
    if services is not None:
        out = out.where(F.col("service_key").isin(services))
    if protocols is not None:
        out = out.where(F.col("proto_key").isin(protocols))
    return out.where(~F.coalesce("flag", F.lit(False))) if hide_flagged else out


def inspect(flows: DataFrame, text: str, proto: str | None = None, n: int = 300) -> DataFrame:
    """flows whose addresses, ports, app, service or destination country hold the text; the n largest."""
    q = text.strip().lower()
    rows = flows.where(proto_key(F.col("protocol")) == proto) if proto else flows
    if q:
        plain = ["src_addr", "dst_addr", "src_port", "dst_port"]
        folded = [c for c in ("app", "service", "dst_country") if c in flows.columns]
        hit = F.lit(False)
        for c in plain:
            hit = hit | F.coalesce(F.col(c).cast("string").contains(q), F.lit(False))
        for c in folded:
            hit = hit | F.coalesce(F.lower(F.col(c)).contains(q), F.lit(False))
        rows = rows.where(hit)
    return rows.orderBy(F.desc_nulls_last("octets"), "flow_id").limit(n)


def incoming() -> Column:
    return F.coalesce(F.col("dst_home"), F.lit(False)) & ~F.coalesce(F.col("src_home"), F.lit(False))


def _amounts() -> list[Column]:
    bytes_, packets = F.col("octets"), F.coalesce(F.col("packets"), F.lit(0))
    inward = incoming()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return [
        total(bytes_).alias("bytes"),
        total(F.when(inward, bytes_).otherwise(0)).alias("bytes_in"),
        total(F.when(~inward, bytes_).otherwise(0)).alias("bytes_out"),
        total(F.when(inward, packets).otherwise(0)).alias("pkts_in"),
        total(F.when(~inward, packets).otherwise(0)).alias("pkts_out"),
    ]


def throughput(amount: Column, seconds: float) -> Column:
    """Bits a second, rounded."""
    return F.floor(amount * 8 / F.lit(float(seconds)) + 0.5).cast("bigint")


def totals(flows: DataFrame, now: int, seconds: float = 60) -> DataFrame:
    """Bytes and packets each way in the window, and throughput."""
    seconds = clamp(seconds, 1, 600)
    rows = nonzero(trailing(flows, now, seconds)).agg(*_amounts())
    return rows.select("*", throughput(F.col("bytes"), seconds).alias("bps"), throughput(F.col("bytes_in"), seconds).alias("bps_in"), throughput(F.col("bytes_out"), seconds).alias("bps_out"))


def axis_rows(flows: DataFrame) -> DataFrame:
    """Every flow once for each axis it counts on, from one scan: service, LAN host, peer, country, host identity."""
    way = direction(F.col("src_home"), F.col("dst_home"))
    peer = F.when(way.isin("out", "transit"), F.struct(F.col("dst_addr").alias("ip"), F.col("dst_country").alias("country"), F.col("dst_as").alias("asn"))).when(
        way == "in", F.struct(F.col("src_addr").alias("ip"), F.col("src_country").alias("country"), F.col("src_as").alias("asn"))
    )
    lan = F.when(F.col("src_home"), F.col("src_addr")).when(F.col("dst_home"), F.col("dst_addr"))
    app = F.col("app") if "app" in flows.columns else F.lit(None).cast("string")
    identity = F.concat_ws("|", F.coalesce(app, peer["ip"]), F.when(peer["asn"] > 0, peer["asn"].cast("string")).otherwise(""), F.coalesce(peer["country"], F.lit("")))
    row = lambda axis, key, country: F.struct(F.lit(axis).alias("axis"), key.alias("key"), country.alias("country"))
    none = F.lit(None).cast("string")
    axes = F.array(
        row("service", F.col("service"), none),
        row("lan", lan, none),
        row("peer", peer["ip"], peer["country"]),
        row("country", peer["country"], none),
        row("host", F.when(peer.isNotNull(), identity), peer["country"]),
    )
    rows = flows.withColumn("_axis", F.explode(F.filter(axes, lambda a: a["key"].isNotNull())))
    return rows.withColumns({"axis": F.col("_axis.axis"), "key": F.col("_axis.key"), "axis_country": F.col("_axis.country")}).drop("_axis")


def axis_rollup(flows: DataFrame, now: int, seconds: float = 60, axes: list[str] | None = None) -> DataFrame:
    """Bytes and packets by axis and key; of several countries of a peer, the first in order."""
    rows = axis_rows(nonzero(trailing(flows, now, clamp(seconds, 1, 600))))
    if axes:
        rows = rows.where(F.col("axis").isin(axes))
    return rows.groupBy("axis", "key").agg(F.min("axis_country").alias("country"), *_amounts())


TOP = {"peer": 8, "country": 6, "lan": 6, "service": 8, "host": 6}


def top_k(rollup: DataFrame, k_by_axis: dict[str, int] | None = None) -> DataFrame:
    """K1: the keys with most bytes of each axis; ties by key."""
    limit = F.lit(0)
    for axis, k in (k_by_axis or TOP).items():
        limit = F.when(F.col("axis") == axis, k).otherwise(limit)
    rank = F.row_number().over(Window.partitionBy("axis").orderBy(F.desc("bytes"), "key"))
    return rollup.withColumn("rank", rank).where(F.col("rank") <= limit)


def live_report(flows: DataFrame, now: int, seconds: float = 60) -> DataFrame:
    """The top of every axis with throughput each way, over the clamped window."""
    seconds = clamp(seconds, 1, 600)
    top = top_k(axis_rollup(flows, now, seconds))
    return top.select("axis", "rank", "key", "country", "bytes", throughput(F.col("bytes_in"), seconds).alias("bps_in"), throughput(F.col("bytes_out"), seconds).alias("bps_out"))


def app_bytes(flows: DataFrame, ip_app: DataFrame, now: int, seconds: float = 60, k: int = 15) -> DataFrame:
    """Bytes and flows of each application by destination."""
    apps = ip_app.where("app is not null").select(F.col("ip").alias("dst_addr"), "app", "category")
    rows = trailing(flows, now, seconds, 1, 3600).join(apps, "dst_addr")
    sums = rows.groupBy("app").agg(F.expr("mode() within group (order by category)").alias("category"), F.coalesce(F.sum("octets"), F.lit(0)).cast("bigint").alias("bytes"), F.count("*").alias("flows"))
    return sums.orderBy(F.desc("bytes"), "app").limit(k)


def unmatched_sni(sni_log: DataFrame, now: int, hours: float = 6, k: int = 15) -> DataFrame:
    """The names most often seen without an application."""
    rows = sni_log.where((F.col("ts_us") > now - int(hours * 3600 * SECOND)) & F.col("app").isNull())
    return rows.groupBy("sni").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "sni").limit(k)


def timeline(flows: DataFrame, now: int, since_s: float = 900, buckets: int = 120) -> DataFrame:
    """Throughput in equal buckets up to now, oldest first, empty ones zero."""
    spark = flows.sparkSession
    since_s, n = clamp(since_s, 60, 366 * 86400), int(clamp(buckets, 10, 600))
    width = since_s / n
    rows = trailing(flows, now, since_s)
    ago = F.least(F.lit(n - 1), F.floor((F.lit(now) - F.col("recv_us")) / F.lit(width * SECOND)).cast("int"))
    sums = rows.groupBy(ago.alias("ago")).agg(F.sum("octets").cast("bigint").alias("bytes"))
    every = spark.range(n).select(F.col("id").cast("int").alias("ago"))
    out = every.join(sums, "ago", "left")
    return out.select((F.lit(n - 1) - F.col("ago")).alias("i"), (F.coalesce("bytes", F.lit(0)) * 8 / F.lit(width)).cast("bigint").alias("bps"))


def protocol_share(flows: DataFrame) -> DataFrame:
    """Bytes and share of each protocol; groups without bytes are dropped."""
    sums = flows.groupBy(proto_key(F.col("protocol")).alias("proto")).agg(F.sum("octets").cast("bigint").alias("bytes")).where("bytes > 0")
    whole = sums.agg(F.sum("bytes").alias("all_bytes"))
    return sums.join(F.broadcast(whole), how="inner").select("proto", "bytes", (F.col("bytes") / F.col("all_bytes")).alias("share"))


def active_cells(flows: DataFrame, now: int, degrees: float = 3.0, seconds: float = 60) -> DataFrame:
    """Grid cells of both ends of recent flows, with how many flows touch each."""
    recent = both_located(trailing(flows, now, seconds))
    ends = recent.select(F.explode(F.array("src_geo", "dst_geo")).alias("g"))
    return ends.groupBy(grid_cell(F.col("g.lon"), degrees).alias("x"), grid_cell(F.col("g.lat"), degrees).alias("y")).agg(F.count("*").alias("n"))


def counters(flows: DataFrame, now: int) -> DataFrame:
    """Flows in the last second, flows, and flows each way."""
    way = direction(F.col("src_home"), F.col("dst_home"))
    return flows.where(F.col("recv_us") <= now).agg(
        F.count_if(F.col("recv_us") > now - SECOND).alias("last_second"),
        F.count("*").alias("total"),
        *(F.count_if(way == d).alias(d) for d in ("in", "out", "internal", "transit")),
    )


def throughput_history(flows: DataFrame, now: int, samples: int = 60) -> DataFrame:
    """Bytes of each of the last seconds that had flows."""
    rows = trailing(flows, now, samples)
    return rows.groupBy(F.floor(F.col("recv_us") / SECOND).alias("sec")).agg(F.sum("octets").cast("bigint").alias("bytes"), F.count("*").alias("flows"))


def recent(flows: DataFrame, n: int = 500) -> DataFrame:
    """K2."""
    return flows.orderBy(F.desc("recv_us"), F.desc("flow_id")).limit(int(clamp(n, 1, 5000)))


def history(flows: DataFrame, now: int, start: int | None = None, end: int | None = None, since_s: float = 300, limit: int = 6000) -> DataFrame:
    """K3: located flows of a window, newest first."""
    return both_located(between(flows, now, start, end, since_s)).orderBy(F.desc("recv_us"), F.desc("flow_id")).limit(int(clamp(limit, 1, 20000)))


def recent_routes(routes: DataFrame, n: int = 400) -> DataFrame:
    """K4."""
    return routes.orderBy(F.desc("traced_us"), "dst_ip").limit(int(clamp(n, 1, 4000)))


def shared_coords(per_ip: DataFrame, threshold: int = 8) -> DataFrame:
    """Rows with ip_share (addresses at the same place) and dirty (at least ``threshold``)."""
    share = per_ip.groupBy("lat", "lon").agg(F.count("*").alias("ip_share"))
    return per_ip.join(share, ["lat", "lon"]).withColumn("dirty", F.col("ip_share") >= threshold)


def replay_schedule(flows: DataFrame, ms: int = 15_000) -> DataFrame:
    """Flows with the delay at which a replay of ``ms`` shows them."""
    span = flows.agg(F.min("recv_us").alias("_lo"), F.max("recv_us").alias("_hi"))
    rows = flows.join(F.broadcast(span), how="inner")
    delay = (F.col("recv_us") - F.col("_lo")) / F.greatest(F.lit(1), F.col("_hi") - F.col("_lo")) * ms
    return rows.withColumn("delay_ms", delay).drop("_lo", "_hi")
