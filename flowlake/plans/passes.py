"""Self-correction passes. Each reads one snapshot of its inputs and returns new state and decisions made from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.functions.flow import app_confidence, geo_confidence, relocation_confidence
from flowlake.functions.geo import haversine_km
from flowlake.functions.ip import bogon_class, is_public
from flowlake.operators.stats import SECOND, shared_coords
from flowlake.plans.lineage import cut
from flowlake.plans.state import merge


def mode_of(column: str):
    """The most frequent value; of several, the smallest; nulls do not count."""
    return F.expr(f"mode() within group (order by {column})")


def endpoints(flows: DataFrame) -> DataFrame:
    """Ip, lat, lon, country, recv_us of both located ends of every flow, from one scan."""
    end = lambda a, g: F.struct(F.col(a).alias("ip"), F.col(f"{g}.lat").alias("lat"), F.col(f"{g}.lon").alias("lon"), F.col(f"{g}.country").alias("country"))
    rows = flows.select("recv_us", F.explode(F.array(end("src_addr", "src_geo"), end("dst_addr", "dst_geo"))).alias("e"))
    return rows.where("e.lat is not null").select("e.*", "recv_us")


def observed_places(flows: DataFrame) -> DataFrame:
    """ip, lat, lon, country, obs_count, first_seen, last_seen, dirty, confidence of observed public addresses."""
    per_ip = endpoints(flows).where(is_public(F.col("ip"), "observed")).groupBy("ip").agg(
        mode_of("lat").alias("lat"), mode_of("lon").alias("lon"), mode_of("country").alias("country"), F.count("*").alias("obs_count"), F.min("recv_us").alias("first_seen"), F.max("recv_us").alias("last_seen")
    )
    # one row an address, read twice below: the flows behind it are read once
    shared = shared_coords(per_ip if per_ip.isStreaming else cut(per_ip))
    return shared.withColumn("confidence", geo_confidence(F.col("obs_count"), F.col("dirty"))).drop("ip_share")


def observed_geo_pass(flows: DataFrame, ip_geo: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state, decisions). Unobserved addresses and manual rows stay; first_seen and source stay on conflict."""
    computed = observed_places(flows).withColumn("source", F.lit("observed"))
    old = ip_geo.select("ip", F.col("lat").alias("old_lat"), F.col("lon").alias("old_lon"), F.col("source").alias("old_source"), F.col("dirty").alias("_dirty"), F.lit(True).alias("_known"))
    rows = computed.join(old, "ip", "left")
    moved = ~(F.col("old_lat").eqNullSafe(F.col("lat")) & F.col("old_lon").eqNullSafe(F.col("lon")) & F.col("_dirty").eqNullSafe(F.col("dirty")))
    changed = rows.where((F.col("_known").isNull() | moved) & (F.col("old_source").isNull() | (F.col("old_source") != "manual")))
    reason = F.when(F.col("old_lat").isNull(), "new").when(F.col("dirty"), "flag-dirty(shared-coord)").otherwise("update")
    decisions = changed.select(
        "ip", reason.alias("reason"), "old_lat", "old_lon", "old_source", F.col("lat").alias("new_lat"), F.col("lon").alias("new_lon"), F.lit("observed").alias("new_source"),
        "obs_count", "confidence", F.concat(F.lit("obs="), F.col("obs_count").cast("string")).alias("notes"),
    )
    return merge(ip_geo, computed, keep=("first_seen", "source")), decisions


def relocations(ip_geo: DataFrame, routes: DataFrame, home: tuple[float, float]) -> DataFrame:
    """C2's anchors: ip, anchor place and index, confidence, for dirty addresses that their round-trip times rule out.

    A route's hops lie in one row, so its longest time and W1, the deepest hop that its own time allows, are found within
    the row; the join with the dirty addresses is the only exchange.
    """
    lat, lon = F.lit(float(home[0])), F.lit(float(home[1]))
    usable = F.filter("hops", lambda h: h["lat"].isNotNull() & h["rtt_ms"].isNotNull())
    far = lambda h: haversine_km(lat, lon, h["lat"], h["lon"])
    # ascending order puts the deepest hop first, of several with one index the lowest address
    key = lambda h: F.struct((-h["idx"]).alias("place"), h["ip"].alias("ip"), h["lat"].alias("lat"), h["lon"].alias("lon"), h["rtt_ms"].alias("rtt"))
    measured = routes.select(F.col("dst_ip").alias("ip"), "hop_count", usable.alias("hops")).select(
        "ip", "hop_count", F.array_max(F.transform("hops", lambda h: h["rtt_ms"])).alias("dst_rtt"), F.array_min(F.transform(F.filter("hops", lambda h: far(h) <= h["rtt_ms"] * 100 + 50), key)).alias("h")
    )
    cand = ip_geo.where("dirty and source <> 'manual'").select("ip", F.col("country").alias("mm_country"), haversine_km(lat, lon, F.col("lat"), F.col("lon")).alias("mm_dist"))
    rows = cand.join(measured.where("h is not null"), "ip").where(F.col("mm_dist") > F.col("dst_rtt") * 100)
    found = rows.select("ip", "hop_count", (-F.col("h.place")).alias("idx"), F.col("h.lat").alias("hlat"), F.col("h.lon").alias("hlon"), F.col("h.ip").alias("hip"), F.col("h.rtt").alias("rtt"), "dst_rtt", "mm_country", "mm_dist")
    return found.withColumn("conf", relocation_confidence(F.col("idx"), F.col("hop_count")))


def relocate(ip_geo: DataFrame, routes: DataFrame, home: tuple[float, float]) -> tuple[DataFrame, DataFrame]:
    """(state, decisions). Corrections of addresses that are not relocated now are taken back."""
    found = relocations(ip_geo, routes, home)
    prev = ip_geo.select("ip", F.col("corr_lat").alias("old_lat"), F.col("corr_lon").alias("old_lon"), F.coalesce("corr_source", F.lit("observed")).alias("old_source"))
    moved = found.join(prev, "ip").where(~(F.col("old_lat").eqNullSafe(F.col("hlat")) & F.col("old_lon").eqNullSafe(F.col("hlon"))))
    # Fixed value: the format of the audit note.
    notes = F.format_string(
        "mm=%s@%dkm rtt=%sms bound=%dkm -> anchor=%s hop %d/%d",
        F.coalesce("mm_country", F.lit("")), F.round("mm_dist").cast("bigint"), F.format_number("dst_rtt", 1), F.round(F.col("dst_rtt") * 100).cast("bigint"), F.coalesce("hip", F.lit("")), "idx", "hop_count",
    )
    decisions = moved.select(
        "ip", F.lit("relocate(mtr-rtt)").alias("reason"), "old_lat", "old_lon", "old_source", F.col("hlat").alias("new_lat"), F.col("hlon").alias("new_lon"), F.lit("mtr-rtt").alias("new_source"),
        F.lit(None).cast("bigint").alias("obs_count"), F.col("conf").alias("confidence"), notes.alias("notes"),
    )
    corr = found.select("ip", F.struct(F.col("hlat").alias("lat"), F.col("hlon").alias("lon"), F.lit("mtr-rtt").alias("source"), F.col("conf").alias("conf"), F.col("dst_rtt").alias("rtt"), F.col("hip").alias("anchor")).alias("_c"))
    rows = ip_geo.join(corr, "ip", "left")
    names = {"corr_lat": "lat", "corr_lon": "lon", "corr_source": "source", "corr_conf": "conf", "corr_rtt_ms": "rtt", "corr_anchor_ip": "anchor"}
    healed = F.col("corr_source").eqNullSafe(F.lit("mtr-rtt")) & F.col("_c").isNull()
    new = {c: F.when(F.col("_c").isNotNull(), F.col(f"_c.{f}")).when(~healed, F.col(c)) for c, f in names.items()}
    return rows.withColumns(new).select(*ip_geo.columns), decisions


def bogon_audit(ip_geo: DataFrame, decisions: DataFrame) -> DataFrame:
    """C4: one decision for each reserved address in the state that has none yet."""
    audited = decisions.where(F.col("reason").startswith("reserved-range")).select("ip").distinct()
    rows = ip_geo.withColumn("class", bogon_class(F.col("ip"))).where("class is not null").join(audited, "ip", "left_anti")
    return rows.select("ip", F.concat(F.lit("reserved-range("), "class", F.lit(")")).alias("reason"), F.lit("reserved address seen as a public endpoint").alias("notes"))


def ip_app_pass(sni_log: DataFrame, ip_app: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(state, decisions) from the names of the last day. Manual rows stay, but are audited while they disagree."""
    day = sni_log.where(F.col("ts_us") > now - 24 * 3600 * SECOND)
    agg = day.groupBy(F.col("dst_addr").alias("ip")).agg(
        mode_of("app").alias("app"), mode_of("category").alias("category"), mode_of("sni").alias("sni"), F.count("*").alias("obs_count"), F.count_distinct("sni").alias("distinct_sni"),
        F.greatest(F.count_distinct("app"), F.lit(1)).alias("distinct_app"), F.min("ts_us").alias("first_seen"), F.max("ts_us").alias("last_seen"),
    )
    computed = agg.withColumn("confidence", app_confidence(F.col("obs_count"), F.col("distinct_app"))).withColumn("source", F.lit("sni")).drop("distinct_app")
    prev = ip_app.select("ip", F.col("app").alias("_app"), F.lit(True).alias("_known"))
    changed = computed.join(prev, "ip", "left").where(F.col("app").isNotNull() & ~F.col("_app").eqNullSafe(F.col("app")))
    decisions = changed.select(
        "ip", "sni", "app", "category", "confidence", F.when(F.col("_known").isNull(), "new").otherwise("changed").alias("reason"),
        F.concat(F.lit("obs="), F.col("obs_count").cast("string"), F.lit(" distinct_sni="), F.col("distinct_sni").cast("string")).alias("notes"),
    )
    return merge(ip_app, computed, keep=("first_seen", "source")), decisions


def trace_candidates(flows: DataFrame, routes: DataFrame, ip_geo: DataFrame, now: int, n: int = 48) -> DataFrame:
    """Addresses to trace next: uncorrected dirty ones first, then the busiest."""
    recent = flows.where((F.col("recv_us") > now - 1800 * SECOND) & is_public(F.col("dst_addr"), "history"))
    traced = routes.where(F.col("traced_us") > now - 6 * 3600 * SECOND).select(F.col("dst_ip").alias("dst_addr")).distinct()
    sums = recent.join(traced, "dst_addr", "left_anti").groupBy(F.col("dst_addr").alias("ip")).agg(F.sum("octets").cast("bigint").alias("bytes"))
    rows = sums.join(ip_geo.select("ip", "dirty", "corr_lat"), "ip", "left")
    urgent = F.coalesce(F.col("dirty"), F.lit(False)) & F.col("corr_lat").isNull()
    return rows.select("ip", urgent.alias("urgent"), "bytes").orderBy(F.desc("urgent"), F.desc_nulls_last("bytes"), "ip").limit(n)


def store_routes(routes: DataFrame, new: DataFrame) -> DataFrame:
    """Routes after an upsert by destination, with hop_count set."""
    return merge(routes, new.withColumn("hop_count", F.size("hops")), key="dst_ip", protect=None)


def pass_summary(ip_geo: DataFrame, decisions: DataFrame) -> DataFrame:
    """Counters of a pass."""
    made = decisions.agg(F.count("*").alias("decisions"))
    state = ip_geo.agg(F.count("*").alias("total"), F.count_if("dirty").alias("dirty"), F.count("corr_lat").alias("relocated"), F.count_if(F.col("dirty") & F.col("corr_lat").isNull()).alias("flagged"))
    return state.join(F.broadcast(made), how="inner")
