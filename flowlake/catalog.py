"""Queries over the derived flow tables, one or more for each operator, and the same meaning as SQL.

Home is 192.168.0.0/16 at lat -45, lon -131; ``now`` is the time of the last flow.
"""

from __future__ import annotations

import re

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.fixtures import fixture, with_fixtures
from flowlake.functions import flow as fl
from flowlake.functions import ip as ips
from flowlake.operators import detect, enrich, stats
from flowlake.plans import graph, passes
from flowlake.plans.lineage import cut
from flowlake.schemas import GEO_DECISIONS, HOPS, IP_APP, IP_GEO

HOME = (-45.0, -131.0)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *tables: str, recursive: bool = False):
    """Registers a query and, given SQL that follows common table expressions, its oracle over the named fixtures."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            body = with_fixtures(sql, *tables)
            ORACLE_SQL[f.__name__] = body.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else body
        return f

    return add


# ---- shared inputs -------------------------------------------------------------------------------------------------


def flows_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "flows")


def now_of(flows: DataFrame, column: str = "recv_us") -> int:
    return flows.agg(F.max(column)).first()[0] or 0


def located_flows(spark: SparkSession, sf_dir: str, flows: DataFrame | None = None) -> DataFrame:
    """Flows (all, or those given) with the places of both ends."""
    return enrich.located(flows_of(spark, sf_dir) if flows is None else flows, fixture(spark, sf_dir, "geo_blocks"), HOME)


def services_of(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES (443, 'tcp', 'https'), (80, 'tcp', 'http'), (53, 'udp', 'domain'), (22, 'tcp', 'ssh'), (123, 'udp', 'ntp'), (8080, 'tcp', 'http-alt') AS t(port, proto, name)")


def marked_flows(spark: SparkSession, sf_dir: str, flows: DataFrame | None = None) -> DataFrame:
    """Flows with home marks, countries and service: what the traffic questions read. Questions about a window cut it from
    the bare flows first, so only its addresses are looked up."""
    rows = enrich.with_service(located_flows(spark, sf_dir, flows), services_of(spark))
    home = lambda g: F.coalesce(F.col(f"{g}.is_home"), F.lit(False))
    return rows.withColumns({"src_home": home("src_geo"), "dst_home": home("dst_geo"), "src_country": F.col("src_geo.country"), "dst_country": F.col("dst_geo.country")})


def recent_marked(spark: SparkSession, sf_dir: str, seconds: float = 60) -> tuple[DataFrame, int]:
    """Marked flows of the last seconds, and now."""
    flows = flows_of(spark, sf_dir)
    now = now_of(flows)
    return marked_flows(spark, sf_dir, stats.trailing(flows, now, seconds)), now


def classified_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.classify_sni(fixture(spark, sf_dir, "sni_log"), fixture(spark, sf_dir, "app_rules"))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def ip_geo_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passes.observed_geo_pass(located_flows(spark, sf_dir), empty(spark, IP_GEO))[0]


def ip_app_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = classified_log(spark, sf_dir)
    return passes.ip_app_pass(log, empty(spark, IP_APP), now_of(log, "ts_us"))[0]


def routes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    traced = traces_of(spark, sf_dir).select("dst_ip", "traced_us", "idx", "lat", "lon", "rtt_ms", "ip")
    hops = fixture(spark, sf_dir, "route_hops").select(traced.columns).unionByName(traced)
    return gathered(hops)


def traces_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops of the traced routes, whose places are those of customers."""
    return fixture(spark, sf_dir, "traces").withColumn("ip", F.concat(F.lit("hop"), F.col("hop").cast("string")))


def gathered(hops: DataFrame) -> DataFrame:
    """Routes (dst_ip, traced_us, hops, hop_count) of hops."""
    hop = F.struct("idx", "ip", "lat", "lon", F.lit(None).cast("string").alias("country"), "rtt_ms")
    return hops.groupBy("dst_ip").agg(F.max("traced_us").alias("traced_us"), F.array_sort(F.collect_list(hop)).cast(HOPS).alias("hops")).withColumn("hop_count", F.size("hops"))


# ---- the same in SQL: m = marked flows, log = classified names, pg = places after a first pass ----------------------

_NUM = "CAST(split_part({0},'.',1) AS BIGINT)*16777216+CAST(split_part({0},'.',2) AS BIGINT)*65536+CAST(split_part({0},'.',3) AS BIGINT)*256+CAST(split_part({0},'.',4) AS BIGINT)"
_MARKED = (
    """, addr AS (SELECT DISTINCT ip FROM (SELECT src_addr AS ip FROM flows UNION ALL SELECT dst_addr FROM flows) q),
num AS (SELECT ip, CASE WHEN ip LIKE '%:%' THEN NULL ELSE """
    + _NUM.format("ip")
    + """ END AS n, CASE WHEN ip LIKE '%::%' THEN concat('26064700', repeat('0', 20), lpad(split_part(ip, '::', 2), 4, '0')) END AS h, ip LIKE '192.168.%' AS home FROM addr),
place AS (SELECT ip, home, CASE WHEN home THEN -45.0::DOUBLE ELSE b.lat END AS lat, CASE WHEN home THEN -131.0::DOUBLE ELSE b.lon END AS lon, CASE WHEN home THEN NULL ELSE b.country END AS country
 FROM num LEFT JOIN geo_blocks b ON n BETWEEN ip_lo AND ip_hi OR h BETWEEN hex_lo AND hex_hi QUALIFY row_number() OVER (PARTITION BY ip ORDER BY hex_hi) = 1),
svc(port, proto, name) AS (VALUES (443, 6, 'https'), (80, 6, 'http'), (53, 17, 'domain'), (22, 6, 'ssh'), (123, 17, 'ntp'), (8080, 6, 'http-alt')),
m AS (SELECT f.*, s.home AS src_home, d.home AS dst_home, s.lat AS src_lat, s.lon AS src_lon, s.country AS src_country, d.lat AS dst_lat, d.lon AS dst_lon, d.country AS dst_country,
 coalesce(v1.name, v2.name) AS service, d.home AND NOT s.home AS incoming,
 CASE WHEN s.home AND d.home THEN 'internal' WHEN s.home THEN 'out' WHEN d.home THEN 'in' ELSE 'transit' END AS way
 FROM flows f JOIN place s ON s.ip = src_addr JOIN place d ON d.ip = dst_addr
 LEFT JOIN svc v1 ON v1.port = dst_port AND v1.proto = protocol LEFT JOIN svc v2 ON v2.port = src_port AND v2.proto = protocol),
t AS (SELECT max(recv_us) AS now FROM flows)
"""
)
HAVERSINE = "2*6371.0*asin(least(1.0, sqrt(power(sin(radians({2}-{0})/2),2)+cos(radians({0}))*cos(radians({2}))*power(sin(radians({3}-{1})/2),2))))"
_LOG = """, hit AS (SELECT obs_id, l.ts_us, l.dst_addr, l.src_addr, l.sni, r.app, r.category, r.suffix,
 row_number() OVER (PARTITION BY obs_id ORDER BY length(r.suffix) DESC) AS rn
 FROM sni_log l LEFT JOIN app_rules r ON l.sni = r.suffix OR l.sni LIKE '%.' || r.suffix),
log AS (SELECT * EXCLUDE (rn) FROM hit WHERE rn = 1)
"""


def _mode(value: str, group: str, rows: str, name: str) -> str:
    return f"{name} AS (SELECT {group}, {value} FROM (SELECT {group}, {value}, row_number() OVER (PARTITION BY {group} ORDER BY count(*) DESC, {value}) AS rn FROM {rows} WHERE {value} IS NOT NULL GROUP BY {group}, {value}) q WHERE rn = 1)"


_PLACES = (
    _MARKED
    + """, obs AS (SELECT src_addr AS ip, src_lat AS lat, src_lon AS lon, src_country AS country, recv_us FROM m WHERE src_lat IS NOT NULL
 UNION ALL SELECT dst_addr, dst_lat, dst_lon, dst_country, recv_us FROM m WHERE dst_lat IS NOT NULL),
pub AS (SELECT * FROM obs WHERE ip NOT LIKE '192.168.%'), """
    + ", ".join(_mode(c, "ip", "pub", f"mode_{c}") for c in ("lat", "lon", "country"))
    + """, per AS (SELECT p.ip, any_value(a.lat) AS lat, any_value(b.lon) AS lon, any_value(c.country) AS country, count(*) AS obs_count, min(recv_us) AS first_seen, max(recv_us) AS last_seen
 FROM pub p LEFT JOIN mode_lat a ON a.ip = p.ip LEFT JOIN mode_lon b ON b.ip = p.ip LEFT JOIN mode_country c ON c.ip = p.ip GROUP BY p.ip),
pg AS (SELECT *, count(*) OVER (PARTITION BY lat, lon) >= 8 AS dirty,
 least(0.99::DOUBLE, 1 - 1/(1 + obs_count::DOUBLE)) * CASE WHEN count(*) OVER (PARTITION BY lat, lon) >= 8 THEN 0.4::DOUBLE ELSE 1 END AS confidence FROM per)
"""
)


# ---- traffic questions ---------------------------------------------------------------------------------------------

_WINDOW = "FROM m, t WHERE recv_us > now - 60000000 AND recv_us <= now AND octets > 0"
_SUMS = """CAST(sum(octets) AS BIGINT) AS bytes, CAST(sum(CASE WHEN incoming THEN octets ELSE 0 END) AS BIGINT) AS bytes_in, CAST(sum(CASE WHEN incoming THEN 0 ELSE octets END) AS BIGINT) AS bytes_out,
 CAST(sum(CASE WHEN incoming THEN packets ELSE 0 END) AS BIGINT) AS pkts_in, CAST(sum(CASE WHEN incoming THEN 0 ELSE packets END) AS BIGINT) AS pkts_out"""
_AXES = (
    _MARKED
    + f""", w AS (SELECT m.* {_WINDOW}),
p AS (SELECT *, CASE WHEN way IN ('out','transit') THEN dst_addr WHEN way = 'in' THEN src_addr END AS peer, CASE WHEN way IN ('out','transit') THEN dst_country WHEN way = 'in' THEN src_country END AS pc,
 CASE WHEN way IN ('out','transit') THEN dst_as WHEN way = 'in' THEN src_as END AS pas FROM w),
x AS (SELECT 'service' AS axis, service AS key, CAST(NULL AS VARCHAR) AS country, p.* FROM p
 UNION ALL SELECT 'lan', CASE WHEN src_home THEN src_addr WHEN dst_home THEN dst_addr END, NULL, p.* FROM p
 UNION ALL SELECT 'peer', peer, pc, p.* FROM p UNION ALL SELECT 'country', pc, NULL, p.* FROM p
 UNION ALL SELECT 'host', CASE WHEN peer IS NOT NULL THEN concat(peer, '|', CASE WHEN pas > 0 THEN CAST(pas AS VARCHAR) ELSE '' END, '|', coalesce(pc, '')) END, pc, p.* FROM p),
roll AS (SELECT axis, key, min(country) AS country, {_SUMS} FROM x WHERE key IS NOT NULL GROUP BY axis, key)
"""
)


@query(_AXES + "SELECT row_number() OVER (ORDER BY bytes DESC, key)::INT AS rank, key AS peer, country, bytes, bytes_in, bytes_out, floor(bytes*8/60.0::DOUBLE+0.5)::BIGINT AS bps FROM roll WHERE axis = 'peer' ORDER BY bytes DESC, key LIMIT 8", "flows", "geo_blocks")
def top_peers_60s(spark, sf_dir):
    """M0: the busiest remote peers of the last minute."""
    rows, now = recent_marked(spark, sf_dir)
    top = stats.top_k(stats.axis_rollup(rows, now, 60, ["peer"]))
    return top.select("rank", F.col("key").alias("peer"), "country", "bytes", "bytes_in", "bytes_out", stats.throughput(F.col("bytes"), 60).alias("bps"))


@query(_AXES + "SELECT * FROM roll", "flows", "geo_blocks")
def axis_rollup(spark, sf_dir):
    """A2 to A7."""
    return stats.axis_rollup(*recent_marked(spark, sf_dir))


@query(
    _AXES + """, r AS (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY bytes DESC, key)::INT AS rank FROM roll)
SELECT axis, rank, key, country, bytes, floor(bytes_in*8/60.0::DOUBLE+0.5)::BIGINT AS bps_in, floor(bytes_out*8/60.0::DOUBLE+0.5)::BIGINT AS bps_out FROM r WHERE rank <= CASE axis WHEN 'peer' THEN 8 WHEN 'service' THEN 8 ELSE 6 END""",
    "flows", "geo_blocks",
)
def live_report(spark, sf_dir):
    """C9, K1, A8."""
    return stats.live_report(*recent_marked(spark, sf_dir))


@query(_MARKED + f"SELECT *, floor(bytes*8/60.0::DOUBLE+0.5)::BIGINT AS bps, floor(bytes_in*8/60.0::DOUBLE+0.5)::BIGINT AS bps_in, floor(bytes_out*8/60.0::DOUBLE+0.5)::BIGINT AS bps_out FROM (SELECT {_SUMS} {_WINDOW}) q", "flows", "geo_blocks")
def directional_totals(spark, sf_dir):
    """A1, A8, F8."""
    return stats.totals(*recent_marked(spark, sf_dir))


@query(
    """, t AS (SELECT max(recv_us) AS now FROM flows), b AS (SELECT least(119, floor((now - recv_us) / 7500000.0::DOUBLE))::INT AS ago, CAST(sum(octets) AS BIGINT) AS bytes FROM flows, t
 WHERE recv_us > now - 900000000 AND recv_us <= now GROUP BY 1)
SELECT (119 - r.ago)::INT AS i, trunc(coalesce(bytes, 0) * 8 / 7.5::DOUBLE)::BIGINT AS bps FROM (SELECT unnest(range(120))::INT AS ago) r LEFT JOIN b ON b.ago = r.ago""",
    "flows",
)
def timeline_120(spark, sf_dir):
    """A16."""
    rows = flows_of(spark, sf_dir)
    return stats.timeline(rows, now_of(rows))


_PROTO = "CASE protocol WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' WHEN 1 THEN 'icmp' WHEN 58 THEN 'icmp6' WHEN 2 THEN 'igmp' WHEN 47 THEN 'gre' WHEN 50 THEN 'esp' WHEN 51 THEN 'esp' WHEN 132 THEN 'sctp' WHEN 89 THEN 'ospf' ELSE 'other' END"
_SERVICE = "CASE WHEN src_port = 443 OR dst_port = 443 THEN CASE WHEN protocol = 17 THEN 'quic' ELSE 'https' END WHEN src_port IN (80, 8080) OR dst_port IN (80, 8080) THEN 'http' WHEN src_port = 53 OR dst_port = 53 THEN 'dns' WHEN src_port = 22 OR dst_port = 22 THEN 'ssh' ELSE 'svc' END"


@query(f", s AS (SELECT {_PROTO} AS proto, CAST(sum(octets) AS BIGINT) AS bytes FROM flows GROUP BY 1) SELECT proto, bytes, bytes / sum(bytes) OVER ()::DOUBLE AS share FROM s WHERE bytes > 0", "flows")
def protocol_share(spark, sf_dir):
    """A17, E13."""
    return stats.protocol_share(flows_of(spark, sf_dir))


@query(
    _MARKED + """, r AS (SELECT * FROM m, t WHERE recv_us > now - 60000000 AND src_lat IS NOT NULL AND dst_lat IS NOT NULL), e AS (SELECT src_lon AS lon, src_lat AS lat FROM r UNION ALL SELECT dst_lon, dst_lat FROM r)
SELECT floor(lon/3+0.5)::BIGINT AS x, floor(lat/3+0.5)::BIGINT AS y, count(*) AS n FROM e GROUP BY 1, 2""",
    "flows", "geo_blocks",
)
def active_cells(spark, sf_dir):
    """A18, E17."""
    flows = flows_of(spark, sf_dir)
    now = now_of(flows)
    return stats.active_cells(located_flows(spark, sf_dir, stats.trailing(flows, now, 60)), now)


@query(_MARKED + "SELECT count(*) FILTER (recv_us > now - 1000000) AS last_second, count(*) AS total, count(*) FILTER (way = 'in') AS \"in\", count(*) FILTER (way = 'out') AS out, count(*) FILTER (way = 'internal') AS internal, count(*) FILTER (way = 'transit') AS transit FROM m, t", "flows", "geo_blocks")
def traffic_counters(spark, sf_dir):
    """A21, E15."""
    flows = flows_of(spark, sf_dir)
    return stats.counters(marked_flows(spark, sf_dir, flows), now_of(flows))


@query(", t AS (SELECT max(recv_us) AS now FROM flows) SELECT floor(recv_us/1000000.0::DOUBLE)::BIGINT AS sec, CAST(sum(octets) AS BIGINT) AS bytes, count(*) AS flows FROM flows, t WHERE recv_us > now - 60000000 GROUP BY 1", "flows")
def throughput_history(spark, sf_dir):
    """A21's history."""
    rows = flows_of(spark, sf_dir)
    return stats.throughput_history(rows, now_of(rows))


@query("SELECT flow_id, recv_us, src_addr, dst_addr, octets FROM flows ORDER BY recv_us DESC, flow_id DESC LIMIT 500", "flows")
def recent_flows(spark, sf_dir):
    """K2."""
    return stats.recent(flows_of(spark, sf_dir)).select("flow_id", "recv_us", "src_addr", "dst_addr", "octets")


@query(
    _MARKED + "SELECT flow_id, recv_us, src_addr, dst_addr, octets, src_lat, src_lon, dst_lat, dst_lon, dst_country, src_home, dst_home FROM m, t WHERE recv_us > now - 300000000 AND recv_us <= now + 60000000 AND src_lat IS NOT NULL AND dst_lat IS NOT NULL ORDER BY recv_us DESC, flow_id DESC LIMIT 6000",
    "flows", "geo_blocks",
)
def history_window(spark, sf_dir):
    """Home marks come from the address ranges, not from the stored place."""
    flows = flows_of(spark, sf_dir)
    now = now_of(flows)
    past = stats.history(located_flows(spark, sf_dir, stats.between(flows, now, None, None)), now)
    return past.select(
        "flow_id", "recv_us", "src_addr", "dst_addr", "octets", F.col("src_geo.lat").alias("src_lat"), F.col("src_geo.lon").alias("src_lon"), F.col("dst_geo.lat").alias("dst_lat"), F.col("dst_geo.lon").alias("dst_lon"), F.col("dst_geo.country").alias("dst_country"),
        (~ips.is_public(F.col("src_addr"), "history")).alias("src_home"), (~ips.is_public(F.col("dst_addr"), "history")).alias("dst_home"),
    )


@query(", t AS (SELECT max(recv_us) AS now FROM flows) SELECT flow_id, recv_us, octets FROM flows, t WHERE recv_us > now - 600000000 AND recv_us <= now - 300000000", "flows")
def absolute_window(spark, sf_dir):
    """F2 with both ends given."""
    rows = flows_of(spark, sf_dir)
    now = now_of(rows)
    return stats.between(rows, now, now - 600_000_000, now - 300_000_000).select("flow_id", "recv_us", "octets")


@query(_MARKED + f"SELECT flow_id, way AS direction, {_PROTO} AS proto_key, {_SERVICE} AS service_key, octets FROM m WHERE way = 'out' AND octets >= 100000 AND {_SERVICE} IN ('https','http','dns') AND {_PROTO} IN ('tcp','udp')", "flows", "geo_blocks")
def visible_flows(spark, sf_dir):
    """F5, E13, E14, E15."""
    rows = marked_flows(spark, sf_dir)
    c = F.col
    rows = rows.withColumns({"direction": fl.direction(c("src_home"), c("dst_home")), "proto_key": fl.proto_key(c("protocol")), "service_key": fl.service_key(c("src_port"), c("dst_port"), c("protocol"))})
    return stats.visible(rows, "out", 100_000, ["https", "http", "dns"], ["tcp", "udp"]).select("flow_id", "direction", "proto_key", "service_key", "octets")


@query(
    _MARKED + """SELECT flow_id, src_addr, dst_addr, octets FROM m WHERE protocol = 6 AND (contains(src_addr, '443') OR contains(dst_addr, '443') OR contains(CAST(src_port AS VARCHAR), '443') OR contains(CAST(dst_port AS VARCHAR), '443')
 OR contains(lower(coalesce(service, '')), '443') OR contains(lower(coalesce(dst_country, '')), '443')) ORDER BY octets DESC, flow_id LIMIT 300""",
    "flows", "geo_blocks",
)
def inspect_flows(spark, sf_dir):
    """F6, E21."""
    return stats.inspect(marked_flows(spark, sf_dir), "443", "tcp").select("flow_id", "src_addr", "dst_addr", "octets")


@query(", s AS (SELECT min(recv_us) AS lo, max(recv_us) AS hi FROM flows) SELECT flow_id, (recv_us - lo) / greatest(1, hi - lo)::DOUBLE * 15000 AS delay_ms FROM flows, s", "flows")
def replay_schedule(spark, sf_dir):
    """T8."""
    return stats.replay_schedule(flows_of(spark, sf_dir)).select("flow_id", "delay_ms")


# ---- enrichment ----------------------------------------------------------------------------------------------------


@query(_MARKED + "SELECT ip, home AS is_home, lat, lon, country FROM place WHERE lat IS NOT NULL", "flows", "geo_blocks")
def cidr_geo(spark, sf_dir):
    """E5, E6, J5."""
    flows = flows_of(spark, sf_dir)
    addresses = flows.select(F.explode(F.array("src_addr", "dst_addr")).alias("ip")).distinct()
    rows = enrich.geo_lookup(addresses, "ip", fixture(spark, sf_dir, "geo_blocks"), HOME, "geo").where("geo is not null")
    return rows.select("ip", F.col("geo.is_home").alias("is_home"), F.col("geo.lat").alias("lat"), F.col("geo.lon").alias("lon"), F.col("geo.country").alias("country"))


@query(_MARKED + "SELECT service, count(*) AS n FROM m GROUP BY service", "flows", "geo_blocks")
def service_join(spark, sf_dir):
    """E8."""
    return enrich.with_service(flows_of(spark, sf_dir), services_of(spark)).groupBy("service").agg(F.count("*").alias("n"))


@query(", a AS (SELECT DISTINCT src_addr AS ip FROM flows UNION SELECT DISTINCT dst_addr FROM flows) SELECT ip, CASE WHEN ip LIKE '192.168.%' THEN 'private-use' WHEN ip LIKE '203.0.113.%' THEN 'TEST-NET-3' END AS class, ip LIKE '192.168.%' AS local FROM a", "flows")
def bogon_classes(spark, sf_dir):
    """E5, E7."""
    rows = flows_of(spark, sf_dir).select(F.explode(F.array("src_addr", "dst_addr")).alias("ip")).distinct()
    return rows.select("ip", ips.bogon_class(F.col("ip")).alias("class"), ips.is_local(F.col("ip")).alias("local"))


@query(
    ", a AS (SELECT *, floor(recv_us/1000000.0::DOUBLE)::BIGINT*1000000 - (uptime_ms - flow_finish_ms)*1000 AS e FROM flows) SELECT flow_id, CASE WHEN e >= 0 THEN e END AS end_us, CASE WHEN e - (flow_finish_ms - flow_start_ms)*1000 >= 0 THEN e - (flow_finish_ms - flow_start_ms)*1000 END AS start_us FROM a",
    "flows",
)
def wall_clock_times(spark, sf_dir):
    """E1, E2, E3."""
    rows = flows_of(spark, sf_dir).withColumn("recv_sec", F.floor(F.col("recv_us") / 1_000_000)).withColumn("recv_usec", F.pmod("recv_us", F.lit(1_000_000)))
    rows = rows.withColumnsRenamed({"uptime_ms": "sys_uptime_ms", "flow_start_ms": "flow_start", "flow_finish_ms": "flow_finish"}).drop("recv_us")
    return enrich.with_times(enrich.usable(rows)).select("flow_id", F.col("flow_end_us").alias("end_us"), F.col("flow_start_us").alias("start_us"))


_CORR = ", corr AS (SELECT DISTINCT ip, 1.5::DOUBLE AS lat, 2.5::DOUBLE AS lon, 'XX' AS country FROM (SELECT src_addr AS ip FROM flows WHERE flow_id % 50 = 7) q)"


@query(
    _MARKED + _CORR + "SELECT flow_id, coalesce(a.lat, src_lat) AS src_lat, coalesce(a.country, src_country) AS src_country, coalesce(b.lon, dst_lon) AS dst_lon, a.ip IS NOT NULL AS src_fixed FROM m LEFT JOIN corr a ON a.ip = src_addr LEFT JOIN corr b ON b.ip = dst_addr",
    "flows", "geo_blocks",
)
def override_apply(spark, sf_dir):
    """E11."""
    flows = located_flows(spark, sf_dir)
    fixes = flows.where("flow_id % 50 = 7").select(F.col("src_addr").alias("ip"), F.lit(1.5).alias("lat"), F.lit(2.5).alias("lon"), F.lit("XX").alias("country")).distinct()
    rows = enrich.apply_overrides(flows, fixes)
    return rows.select("flow_id", F.col("src_geo.lat").alias("src_lat"), F.col("src_geo.country").alias("src_country"), F.col("dst_geo.lon").alias("dst_lon"), F.coalesce("src_geo.corrected", F.lit(False)).alias("src_fixed"))


_APPS = _LOG + ", " + ", ".join(_mode(c, "dst_addr", "log", f"mode_{c}") for c in ("app", "category", "sni")) + """, agg AS (SELECT l.dst_addr AS ip, any_value(a.app) AS app, any_value(c.category) AS category, any_value(s.sni) AS sni, count(*) AS obs_count, count(DISTINCT l.sni) AS distinct_sni,
 greatest(count(DISTINCT l.app), 1) AS distinct_app, min(ts_us) AS first_seen, max(ts_us) AS last_seen FROM (SELECT * FROM log WHERE ts_us > (SELECT max(ts_us) FROM log) - 86400000000) l
 LEFT JOIN mode_app a USING (dst_addr) LEFT JOIN mode_category c USING (dst_addr) LEFT JOIN mode_sni s USING (dst_addr) GROUP BY l.dst_addr),
ip_app AS (SELECT *, least(0.95::DOUBLE, 1 - 1/(1 + obs_count::DOUBLE)) / distinct_app AS confidence FROM agg)
"""
# the modes of the last day only
_APPS = _APPS.replace("FROM log WHERE app IS", "FROM day WHERE app IS").replace("FROM log WHERE category IS", "FROM day WHERE category IS").replace("FROM log WHERE sni IS", "FROM day WHERE sni IS").replace(", mode_app AS", ", day AS (SELECT * FROM log WHERE ts_us > (SELECT max(ts_us) FROM log) - 86400000000), mode_app AS", 1)


@query(_LOG + "SELECT obs_id, sni, app, category, suffix FROM log", "sni_log", "app_rules")
def classify_sni(spark, sf_dir):
    """E10, J6."""
    return classified_log(spark, sf_dir).select("obs_id", "sni", "app", "category", "suffix")


@query(_LOG + "SELECT sni, count(*) AS n FROM log WHERE app IS NULL AND ts_us > (SELECT max(ts_us) FROM log) - 21600000000 GROUP BY sni ORDER BY n DESC, sni LIMIT 15", "sni_log", "app_rules")
def unmatched_sni(spark, sf_dir):
    """A15."""
    log = classified_log(spark, sf_dir)
    return stats.unmatched_sni(log, now_of(log, "ts_us"))


@query(_APPS + "SELECT f.flow_id, coalesce(d.app, s.app) AS app, CASE WHEN d.app IS NOT NULL THEN d.category ELSE s.category END AS category FROM flows f LEFT JOIN (SELECT * FROM ip_app WHERE app IS NOT NULL) d ON d.ip = dst_addr LEFT JOIN (SELECT * FROM ip_app WHERE app IS NOT NULL) s ON s.ip = src_addr", "flows", "sni_log", "app_rules")
def app_labels(spark, sf_dir):
    """E12."""
    return enrich.apply_apps(flows_of(spark, sf_dir), ip_app_of(spark, sf_dir)).select("flow_id", "app", "category")


@query(
    _APPS + """, a AS (SELECT app, category, octets FROM flows JOIN ip_app ON ip = dst_addr WHERE app IS NOT NULL AND recv_us > (SELECT max(recv_us) FROM flows) - 3600000000), """ + _mode("category", "app", "a", "mc")
    + " SELECT app, any_value(mc.category) AS category, CAST(sum(octets) AS BIGINT) AS bytes, count(*) AS flows FROM a LEFT JOIN mc USING (app) GROUP BY app ORDER BY bytes DESC, app LIMIT 15",
    "flows", "sni_log", "app_rules",
)
def app_bytes(spark, sf_dir):
    """A14, J1."""
    rows = flows_of(spark, sf_dir)
    return stats.app_bytes(rows, ip_app_of(spark, sf_dir), now_of(rows), 3600)


# ---- passes --------------------------------------------------------------------------------------------------------


@query(_APPS + "SELECT ip, app, category, sni, obs_count, distinct_sni, round(confidence, 6) AS confidence, first_seen, last_seen FROM ip_app", "sni_log", "app_rules")
def ip_app_pass_state(spark, sf_dir):
    """C5, A9, A10, A11, A13."""
    return ip_app_of(spark, sf_dir).drop("source").withColumn("confidence", F.round("confidence", 6))


@query(_APPS + "SELECT ip, sni, app, round(confidence, 6) AS confidence, 'new' AS reason, concat('obs=', obs_count, ' distinct_sni=', distinct_sni) AS notes FROM ip_app WHERE app IS NOT NULL", "sni_log", "app_rules")
def ip_app_pass_decisions(spark, sf_dir):
    """C5's audit."""
    log = classified_log(spark, sf_dir)
    made = passes.ip_app_pass(log, empty(spark, IP_APP), now_of(log, "ts_us"))[1]
    return made.select("ip", "sni", "app", F.round("confidence", 6).alias("confidence"), "reason", "notes")


@query(_PLACES + "SELECT ip, lat, lon, country, obs_count, round(confidence, 6) AS confidence, dirty, first_seen, last_seen FROM pg", "flows", "geo_blocks")
def geo_pass_state(spark, sf_dir):
    """C1, U1, A9, A11, A12, A13, F4b, S11."""
    return ip_geo_of(spark, sf_dir).select("ip", "lat", "lon", "country", "obs_count", F.round("confidence", 6).alias("confidence"), "dirty", "first_seen", "last_seen")


_MOVED = "CASE WHEN {0}_country = 'ZZ' THEN NULL WHEN {0}_country IN (SELECT country FROM geo_blocks WHERE block_id % 3 = 0) THEN {0}_lat + 1 ELSE {0}_lat END AS {0}_lat"
_HALF = _PLACES.replace("FROM m WHERE", "FROM mh WHERE").replace(", obs AS", f", mh AS (SELECT * REPLACE ({_MOVED.format('src')}, {_MOVED.format('dst')}) FROM m WHERE flow_id < (SELECT max(flow_id) / 2 FROM flows)), obs AS", 1)
# the same steps over the first flows, under other names
_HALF_ONLY = re.sub(r"\b(obs|pub|mode_lat|mode_lon|mode_country|per|pg)\b", r"\g<1>0", _HALF[len(_MARKED) :])


@query(
    _PLACES + _HALF_ONLY + """SELECT c.ip, CASE WHEN g.lat IS NULL THEN 'new' WHEN c.dirty THEN 'flag-dirty(shared-coord)' ELSE 'update' END AS reason, g.lat AS old_lat, g.lon AS old_lon, c.lat AS new_lat, c.lon AS new_lon, c.obs_count, round(c.confidence, 6) AS confidence
 FROM pg c LEFT JOIN pg0 g ON g.ip = c.ip WHERE g.ip IS NULL OR g.lat IS DISTINCT FROM c.lat OR g.lon IS DISTINCT FROM c.lon OR g.dirty IS DISTINCT FROM c.dirty""",
    "flows", "geo_blocks",
)
def geo_pass_decisions(spark, sf_dir):
    """C1's audit, from the state that the first half of the flows left under older blocks: some a degree off, one missing."""
    blocks = fixture(spark, sf_dir, "geo_blocks")
    older = blocks.where("country <> 'ZZ'").withColumn("lat", F.col("lat") + F.when(F.col("block_id") % 3 == 0, 1.0).otherwise(0.0))
    flows = flows_of(spark, sf_dir)
    half = flows.agg(F.max("flow_id")).first()[0] / 2
    before = cut(passes.observed_geo_pass(enrich.located(flows.where(F.col("flow_id") < half), older, HOME), empty(spark, IP_GEO))[0])
    made = passes.observed_geo_pass(enrich.located(flows, blocks, HOME), before)[1]
    return made.select("ip", "reason", "old_lat", "old_lon", "new_lat", "new_lon", "obs_count", F.round("confidence", 6).alias("confidence"))


_FAR = HAVERSINE.format("(-45.0)", "(-131.0)", "{0}.lat", "{0}.lon")
#: moved: one aggregate over an address's measured hops: its longest time, and of the hops that their own times allow the deepest
#: (of several with one index the lowest address). n counts all hops of its route.
_DEEPEST = "arg_min({0}, (-h.idx, h.ip, h.lat, h.lon, h.rtt_ms)) FILTER (fits)"
_RELOCATE = _PLACES + f""", moved AS (SELECT p.ip, max(h.rtt_ms) AS dst_rtt, max(h.n) AS n, max(h.idx) FILTER (fits) AS idx, {_DEEPEST.format("h.lat")} AS hlat, {_DEEPEST.format("h.lon")} AS hlon, {_DEEPEST.format("h.ip")} AS hip
 FROM pg p JOIN (SELECT *, {_FAR.format("r")} <= rtt_ms * 100 + 50 AS fits FROM (SELECT *, count(*) OVER (PARTITION BY dst_ip) AS n FROM route_hops) r WHERE rtt_ms IS NOT NULL) h ON h.dst_ip = p.ip WHERE p.dirty GROUP BY p.ip, p.lat, p.lon
 HAVING {_FAR.format("p")} > max(h.rtt_ms) * 100 AND bool_or(fits))
"""


@query(_RELOCATE + "SELECT ip, hlat AS corr_lat, hlon AS corr_lon, hip AS corr_anchor_ip, dst_rtt AS corr_rtt_ms, round(least(0.85::DOUBLE, 0.55::DOUBLE + 0.30::DOUBLE * (idx / n::DOUBLE)), 6) AS corr_conf FROM moved", "flows", "geo_blocks", "route_hops")
def relocate(spark, sf_dir):
    """C2, J3, J4, J7, J8, W1, E16."""
    state, _ = passes.relocate(cut(ip_geo_of(spark, sf_dir)), routes_of(spark, sf_dir), HOME)
    return state.where("corr_lat is not null").select("ip", "corr_lat", "corr_lon", "corr_anchor_ip", "corr_rtt_ms", F.round("corr_conf", 6).alias("corr_conf"))


@query(_RELOCATE + "SELECT ip, 'relocate(mtr-rtt)' AS reason, 'observed' AS old_source, hlat AS new_lat, hlon AS new_lon, 'mtr-rtt' AS new_source FROM moved", "flows", "geo_blocks", "route_hops")
def relocate_decisions(spark, sf_dir):
    """C2's audit."""
    _, made = passes.relocate(cut(ip_geo_of(spark, sf_dir)), routes_of(spark, sf_dir), HOME)
    return made.select("ip", "reason", "old_source", "new_lat", "new_lon", "new_source")


@query(_RELOCATE + "SELECT ip, ip IN (SELECT ip FROM moved WHERE ip IN (SELECT dst_ip FROM route_hops WHERE CAST(split_part(dst_ip, '.', 4) AS INT) % 2 = 0)) AS corrected FROM pg WHERE dirty", "flows", "geo_blocks", "route_hops")
def self_heal(spark, sf_dir):
    """Routes of odd addresses are gone in the second pass, and so are their corrections."""
    routes = routes_of(spark, sf_dir)
    first, _ = passes.relocate(cut(ip_geo_of(spark, sf_dir)), routes, HOME)
    second, _ = passes.relocate(cut(first), routes.where("try_cast(split_part(dst_ip, '.', 4) as int) % 2 = 0"), HOME)
    return second.where("dirty").select("ip", F.col("corr_lat").isNotNull().alias("corrected"))


@query(_PLACES + "SELECT ip, 'reserved-range(TEST-NET-3)' AS reason FROM pg WHERE ip LIKE '203.0.113.%'", "flows", "geo_blocks")
def bogon_audit(spark, sf_dir):
    """C4."""
    return passes.bogon_audit(ip_geo_of(spark, sf_dir), empty(spark, GEO_DECISIONS)).select("ip", "reason")


@query(
    _PLACES + """, r AS (SELECT dst_addr AS ip, CAST(sum(octets) AS BIGINT) AS bytes FROM m, t WHERE recv_us > now - 1800000000 AND dst_addr NOT LIKE '192.168.%' AND dst_addr NOT IN (SELECT dst_ip FROM route_hops, t WHERE traced_us > now - 21600000000 AND traced_us < 1704067200000000 + 50000000) GROUP BY 1)
SELECT r.ip, coalesce(dirty, false) AS urgent, bytes FROM r LEFT JOIN pg ON pg.ip = r.ip ORDER BY urgent DESC, bytes DESC NULLS LAST, r.ip LIMIT 48""",
    "flows", "geo_blocks", "route_hops",
)
def trace_candidates(spark, sf_dir):
    """C6, K5, F4c; only routes traced in the first 50 seconds count."""
    flows = flows_of(spark, sf_dir)
    routes = routes_of(spark, sf_dir).where("traced_us < 1704067200000000 + 50000000")
    return passes.trace_candidates(flows, routes, ip_geo_of(spark, sf_dir), now_of(flows))


@query(_PLACES + "SELECT count(*) AS total, count(*) FILTER (dirty) AS dirty, CAST(0 AS BIGINT) AS relocated, count(*) FILTER (dirty) AS flagged, count(*) AS decisions FROM pg", "flows", "geo_blocks")
def pass_summary(spark, sf_dir):
    """A20."""
    state, made = passes.observed_geo_pass(located_flows(spark, sf_dir), empty(spark, IP_GEO))
    return passes.pass_summary(state, made)


@query("SELECT dst_ip, max(traced_us) AS traced_us, count(*)::INT AS hop_count FROM (SELECT dst_ip, traced_us FROM route_hops UNION ALL SELECT dst_ip, traced_us FROM traces) q GROUP BY dst_ip ORDER BY traced_us DESC, dst_ip LIMIT 400", "route_hops", "traces")
def recent_routes(spark, sf_dir):
    """C7, K4."""
    new = routes_of(spark, sf_dir)
    stored = passes.store_routes(empty(spark, f"dst_ip string, traced_us long, hops {HOPS}, hop_count int"), new)
    return stats.recent_routes(stored).select("dst_ip", "traced_us", "hop_count")


# ---- detection -----------------------------------------------------------------------------------------------------

_FAN = ", fan AS (SELECT a.flow_id, count(DISTINCT b.src_addr) AS distinct_sources FROM flows a JOIN flows b ON b.dst_addr = a.dst_addr AND b.recv_us BETWEEN a.recv_us - 60000000 AND a.recv_us GROUP BY a.flow_id)"


@query(_FAN + " SELECT flow_id, distinct_sources, distinct_sources > 30 AS flag FROM fan", "flows")
def fan_in_flags(spark, sf_dir):
    """W2."""
    return detect.fan_in(flows_of(spark, sf_dir)).select("flow_id", "distinct_sources", "flag")


@query(_FAN + " SELECT flow_id, recv_us, CASE WHEN distinct_sources > 30 THEN 'ddos' ELSE 'big' END AS kind FROM flows JOIN fan USING (flow_id) WHERE distinct_sources > 30 OR octets >= 5000000 ORDER BY recv_us DESC, flow_id DESC LIMIT 100", "flows")
def alerts(spark, sf_dir):
    """K6, C11."""
    return detect.alerts(detect.fan_in(flows_of(spark, sf_dir))).select("flow_id", "recv_us", "kind")


# ---- graphs over flows: the rest of the geometry and graph queries is in catalog_geo.py ------------------------------


@query(
    """, large AS (SELECT DISTINCT src_addr AS a, dst_addr AS b FROM flows WHERE octets >= 5000000),
n AS (SELECT a AS u, b AS v FROM large UNION SELECT b, a FROM large UNION SELECT a, a FROM large UNION SELECT b, b FROM large),
r1 AS (SELECT DISTINCT x.u, y.v FROM n x JOIN n y ON x.v = y.u), r2 AS (SELECT DISTINCT x.u, y.v FROM r1 x JOIN r1 y ON x.v = y.u), r3 AS (SELECT DISTINCT x.u, y.v FROM r2 x JOIN r2 y ON x.v = y.u),
r4 AS (SELECT DISTINCT x.u, y.v FROM r3 x JOIN r3 y ON x.v = y.u), r5 AS (SELECT DISTINCT x.u, y.v FROM r4 x JOIN r4 y ON x.v = y.u)
SELECT u AS id, min(v) AS component FROM r5 GROUP BY u""",
    "flows",
)
def components(spark, sf_dir):
    """Hosts that large flows join."""
    edges = flows_of(spark, sf_dir).where("octets >= 5000000").select(F.col("src_addr").alias("a"), F.col("dst_addr").alias("b"))
    return graph.components(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct(), edges)
