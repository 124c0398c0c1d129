"""Queries of sources, sinks and streams: each writes its input from the tables, reads it back through the operator, and
is compared with the tables themselves. Files lie in the shared folder that Spark is given for checkpoints."""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake import catalog
from flowlake.catalog import HOME, flows_of, query
from flowlake.fixtures import fixture
from flowlake.operators import detect, enrich, stats
from flowlake.plans.lineage import cut, shared_folder
from flowlake.plans.state import BucketedTable, Table, merge, seed_if_absent
from flowlake.schemas import APP_DECISIONS, GEO_DECISIONS, HOPS, IP_APP, IP_GEO
from flowlake.sources import flowd, flowd_source, pcap, sinks, text
from flowlake.sources.app_rules import SEEDS
from flowlake.streaming import capped
from flowlake.streaming import flows as streaming


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def number_hex(value: Column, digits: int) -> Column:
    return F.lpad(F.hex(value.cast("bigint")), digits, "0")


def address_hex(ip: Column) -> Column:
    return F.concat(*(number_hex(F.split_part(ip, F.lit("."), F.lit(i)), 2) for i in range(1, 5)))


# ---- sources -------------------------------------------------------------------------------------------------------


_LOGGED = "SELECT flow_id AS flow_sequence, src_addr, dst_addr, src_port, dst_port, protocol, octets, packets, recv_us FROM flows WHERE src_addr NOT LIKE '%:%' AND dst_addr NOT LIKE '%:%'"


def log_files(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    """file, content: the IPv4 flows as binary logs of at most ``most`` records."""
    c = F.col
    rows = flows_of(spark, sf_dir).where("not contains(src_addr, ':') and not contains(dst_addr, ':')")
    mask = sum(1 << b for b in (1, 2, 5, 7, 11, 12, 13, 18))
    body = F.concat(
        number_hex(F.floor(c("recv_us") / 1_000_000), 8), number_hex(F.pmod("recv_us", F.lit(1_000_000)), 8), F.lit("00"), number_hex(c("protocol"), 2), F.lit("0000"), address_hex(c("src_addr")), address_hex(c("dst_addr")),
        number_hex(c("src_port"), 4), number_hex(c("dst_port"), 4), number_hex(c("packets"), 16), number_hex(c("octets"), 16), F.lit("00000000"), number_hex(c("flow_id"), 8), F.lit("00000000"),
    )
    record = F.concat(F.lit("60"), number_hex(F.length(body) / 8, 2), F.lit(f"0000{mask:08x}"), body)
    return rows.select((F.floor(c("flow_id") / most)).alias("file"), record.alias("r")).groupBy("file").agg(F.unhex(F.array_join(F.collect_list("r"), "")).alias("content"))


def log_columns(out: DataFrame) -> DataFrame:
    c = F.col
    at = enrich.recv_us(c("recv_sec"), c("recv_usec"))
    return out.select("flow_sequence", "src_addr", "dst_addr", "src_port", "dst_port", "protocol", c("octets").cast("bigint").alias("octets"), c("packets").cast("bigint").alias("packets"), at.alias("recv_us"))


@query(_LOGGED, "flows")
def flowd_log(spark, sf_dir):
    """The IPv4 flows as binary log files of a few thousand records, decoded again."""
    files = log_files(spark, sf_dir, 2000)
    out = flowd.decode_files(files.select(F.col("file").cast("string").alias("path"), F.length("content").cast("bigint").alias("length"), "content"))
    return log_columns(out)


@query(_LOGGED, "flows")
def flowd_pieces(spark, sf_dir):
    """The same flows as log files of a few megabytes, read in pieces that begin and end at record borders."""
    path = folder(spark, "logs")
    flowd_source.write_logs(log_files(spark, sf_dir, 50_000).select(F.concat(F.lit("log-"), "file").alias("name"), "content"), path)
    return log_columns(flowd_source.read_flowd_pieces(spark, path, "FAILFAST", 256 << 10))


@query(_LOGGED, "flows")
def flowd_tail(spark, sf_dir):
    """Logs that are tailed as a stream: half of the files, and after a restart the others."""
    path, out, checkpoint = folder(spark, "logs"), folder(spark, "tailed"), folder(spark, "checkpoint")
    files = cut(log_files(spark, sf_dir, 2000))
    flowd_source.register(spark)
    for half in (0, 1):
        flowd_source.write_logs(files.where(F.col("file") % 2 == half).select(F.concat(F.lit("log-"), "file").alias("name"), "content"), path)
        stream = spark.readStream.format("flowd").load(path)
        streaming.run(stream, [lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch={i}")], checkpoint).awaitTermination()
    return log_columns(spark.read.schema(flowd_source.SCHEMA).parquet(out))


@query("SELECT CAST(floor(recv_us/1000.0::DOUBLE) AS BIGINT)*1000 AS recv_us, src_addr, dst_addr, src_port, dst_port, protocol, octets, packets, src_as, dst_as FROM flows UNION ALL SELECT NULL, 'rejected', NULL, NULL, NULL, NULL, count(*), NULL, NULL, NULL FROM flows WHERE protocol = 1", "flows")
def netflow_json(spark, sf_dir):
    """Flows as JSON lines, a damaged line for each ICMP flow; and how many lines were rejected."""
    c = F.col
    flows = flows_of(spark, sf_dir)
    fields = F.struct(
        c("src_addr").alias("src"), c("dst_addr").alias("dst"), "src_port", "dst_port", c("protocol").cast("string").alias("protocol"), c("octets").alias("in_bytes"), c("octets").alias("out_bytes"), c("packets").alias("in_packets"),
        c("src_as").alias("bgp_src_as"), c("dst_as").alias("bgp_dst_as"),
    )
    lines = flows.select(F.to_json(F.struct(fields.alias("fields"), F.floor(c("recv_us") / 1000).alias("timestamp"))).alias("value"))
    lines = lines.unionByName(flows.where("protocol = 1").select(F.lit('{"fields": ').alias("value"))).unionByName(flows.where("protocol = 17").select(F.lit("  ").alias("value")))
    path = folder(spark, "netflow")
    lines.write.text(path)
    good, bad = text.read_netflow_json(spark, path)
    at = enrich.recv_us(c("recv_sec"), c("recv_usec"))
    rows = good.select(at.alias("recv_us"), "src_addr", "dst_addr", "src_port", "dst_port", "protocol", "octets", "packets", "src_as", "dst_as")
    rejected = bad.agg(F.count("*").alias("octets")).select(F.lit("rejected").alias("src_addr"), "octets")
    return rows.unionByName(rejected, allowMissingColumns=True)


def _hello_hex(name: Column) -> Column:
    """A TLS record with a ClientHello for the name, as hexadecimal digits."""
    n = F.length(name)
    sni = F.concat(number_hex(n + 3, 4), F.lit("00"), number_hex(n, 4), F.hex(F.encode(name, "UTF-8")))
    ext = F.concat(F.lit("0000"), number_hex(n + 5, 4), sni)
    body = F.concat(F.lit("0303" + "00" * 32 + "00" + "0002" + "1301" + "0100"), number_hex(n + 9, 4), ext)
    shake = F.concat(F.lit("01"), number_hex(F.length(body) / 2, 6), body)
    return F.concat(F.lit("160301"), number_hex(F.length(shake) / 2, 4), shake)


@query("SELECT ts_us, src_addr, CAST(1000 + obs_id % 60000 AS INT) AS src_port, dst_addr, 443 AS dst_port, sni FROM sni_log WHERE length(sni) > 0", "sni_log")
def captured_names(spark, sf_dir):
    """S3: names as packet captures of a few hundred hellos, decoded again."""
    c = F.col
    log = fixture(spark, sf_dir, "sni_log").where("length(sni) > 0")
    tcp = F.concat(number_hex(F.lit(1000) + c("obs_id") % 60000, 4), F.lit("01bb" + "00" * 8 + "5000" + "00" * 6), _hello_hex(c("sni")))
    ip = F.concat(F.lit("45" + "00" * 8 + "06" + "0000"), address_hex(c("src_addr")), address_hex(c("dst_addr")), tcp)
    frame = F.concat(F.lit("00" * 12 + "0800"), ip)
    packet = F.concat(number_hex(F.floor(c("ts_us") / 1_000_000), 8), number_hex(F.pmod("ts_us", F.lit(1_000_000)), 8), number_hex(F.length(frame) / 2, 8), number_hex(F.length(frame) / 2, 8), frame)
    files = log.select(F.floor(c("obs_id") / 200).alias("file"), packet.alias("p")).groupBy("file").agg(F.array_join(F.collect_list("p"), "").alias("p"))
    captures = files.select(F.unhex(F.concat(F.lit("a1b2c3d4" + "00020004" + "00" * 12 + "00000001"), "p")).alias("content"))
    return pcap.packets_to_sni(captures)


@query("SELECT dst_ip, traced_us, idx, CASE WHEN hop % 7 = 0 THEN '2606:4700::1' ELSE '93.' || (hop % 25) || '.0.' || (hop % 200) END AS ip, rtt_ms, CASE WHEN hop % 7 = 0 THEN 'XY' ELSE (SELECT min(country) FROM geo_blocks b WHERE b.o1 = 93 AND b.o2 = hop % 25) END AS country FROM traces WHERE hop % 11 > 0", "traces", "geo_blocks")
def trace_reports(spark, sf_dir):
    """Traced routes as the tracer's JSON reports, hops without an address among them."""
    c = F.col
    t = fixture(spark, sf_dir, "traces")
    host = F.when(c("hop") % 11 == 0, "???").when(c("hop") % 7 == 0, "2606:4700:0::1").otherwise(F.concat(F.lit("93."), c("hop") % 25, F.lit(".0."), c("hop") % 200))
    hubs = t.groupBy("dst_ip", "traced_us").agg(F.collect_list(F.struct(c("idx").alias("count"), host.alias("host"), c("rtt_ms").alias("Avg"))).alias("hubs"))
    reports = hubs.select("dst_ip", "traced_us", F.to_json(F.struct(F.struct("hubs").alias("report"))).alias("json"))
    routes = text.parse_trace_reports(reports, fixture(spark, sf_dir, "geo_blocks"), HOME)
    return routes.select("dst_ip", "traced_us", F.explode("hops").alias("h")).select("dst_ip", "traced_us", "h.idx", "h.ip", "h.rtt_ms", "h.country")


@query("SELECT round(lon, 4) AS lon, round(lat, 4) AS lat, name, 'landing' AS role, trim(split_part(name, ',', 2)) AS country FROM (SELECT lon, lat, name || ', ' || landmass AS name FROM places) q", "places")
def map_features(spark, sf_dir):
    """Places as map files of a few hundred points each."""
    c = F.col
    p = fixture(spark, sf_dir, "places").withColumn("name", F.concat("name", F.lit(", "), "landmass"))
    point = F.struct(F.struct(F.array("lon", "lat").alias("coordinates")).alias("geometry"), F.struct("name").alias("properties"))
    files = p.groupBy(F.floor(c("id") / 300).alias("file")).agg(F.collect_list(point).alias("features")).select(F.to_json(F.struct("features")).alias("value"))
    path = folder(spark, "features")
    files.write.option("maxRecordsPerFile", 1).text(path)
    return text.read_features(spark, path, "landing")


_PORTS = "SELECT CAST(p_partkey % 70000 AS INT) AS port, CASE WHEN p_size % 3 = 0 THEN 'udp' WHEN p_size = 50 THEN 'icmp' ELSE 'tcp' END AS proto, 's' || p_partkey || CASE WHEN p_size = 49 THEN '?' ELSE '' END AS name FROM part"


def port_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    key, size = F.col("p_partkey"), F.col("p_size")
    proto = F.when(size % 3 == 0, "UDP").when(size == 50, "icmp").otherwise("tcp")
    return part.select(F.concat(F.lit("s"), key, F.when(size == 49, "?").otherwise(""), F.lit("\t"), key % 70000, F.lit("/"), proto).alias("value"))


@query(f", s AS ({_PORTS}) SELECT * FROM s".replace(", s AS", "s AS", 1))
def port_table(spark, sf_dir):
    """S6."""
    path = folder(spark, "ports")
    port_lines(spark, sf_dir).unionByName(spark.range(1).select(F.lit("# name, port and protocol").alias("value"))).write.text(path)
    return text.read_services(spark, path)


@query(f"""s AS ({_PORTS}) SELECT 'name_is_plain_ascii' AS rule, count(*) FILTER (contains(name, '?')) AS violations FROM s UNION ALL SELECT 'proto_is_tcp_or_udp', count(*) FILTER (proto = 'icmp') FROM s
UNION ALL SELECT 'port_is_16_bit', count(*) FILTER (port > 65535) FROM s UNION ALL SELECT 'key_is_unique', count(*) - count(DISTINCT (port, proto)) FROM s UNION ALL SELECT 'row_count', abs(count(*) - 1000) FROM s""")
def port_table_rules(spark, sf_dir):
    """Q1."""
    path = folder(spark, "ports")
    port_lines(spark, sf_dir).write.text(path)
    return text.check_services(text.read_services(spark, path), 1000)


@query(
    """SELECT CASE WHEN id % 2 = 0 THEN 1577058304 + (id % 60000) * 256 END AS ip_lo, CASE WHEN id % 2 = 0 THEN 1577058304 + (id % 60000) * 256 + 255 END AS ip_hi,
 CASE WHEN id % 2 = 1 THEN rpad(concat('20010db8', lpad(lower(hex(id)), 8, '0')), 32, '0') END AS hex_lo, CASE WHEN id % 2 = 1 THEN rpad(concat('20010db8', lpad(lower(hex(id)), 8, '0')), 32, 'f') END AS hex_hi,
 CASE WHEN id % 2 = 0 THEN 24 ELSE 64 END::INT AS prefix_len, lat, lon, 'L' || landmass AS country, coalesce(CASE WHEN id % 3 = 0 THEN 'city' || id END, name) AS city FROM places""",
    "places",
)
def block_file(spark, sf_dir):
    """Places as networks of both families in CSV files."""
    c = F.col
    p = fixture(spark, sf_dir, "places")
    n = F.lit(1577058304) + c("id") % 60000 * 256
    v4 = F.concat(F.shiftright(n, 24), F.lit("."), F.shiftright(n, 16) % 256, F.lit("."), F.shiftright(n, 8) % 256, F.lit(".7/24"))
    v6 = F.concat(F.lit("2001:db8:"), F.lower(F.hex(F.shiftright(c("id"), 16))), F.lit(":"), F.lower(F.hex(c("id") % 65536)), F.lit("::/64"))
    city = F.when(c("id") % 3 == 0, F.concat(F.lit("city"), "id"))
    rows = p.select(F.when(c("id") % 2 == 0, v4).otherwise(v6).alias("network"), c("lat").alias("latitude"), c("lon").alias("longitude"), F.concat(F.lit("L"), "landmass").alias("country"), city.alias("city_en"), c("name").alias("city_any"))
    path = folder(spark, "blocks")
    rows.write.option("header", True).csv(path)
    return text.read_geo_blocks(spark, path)


# ---- sinks, state --------------------------------------------------------------------------------------------------


@query("SELECT flow_id, recv_us, octets FROM flows, (SELECT max(recv_us) AS now FROM flows) t WHERE recv_us > now - 600000000 AND recv_us <= now - 60000000", "flows")
def stored_flows(spark, sf_dir):
    """Flows appended by hour of receipt, and a window read back from its partitions only."""
    path, flows = folder(spark, "flows"), flows_of(spark, sf_dir)
    sinks.append_flows(flows, path)
    now = catalog.now_of(flows)
    return sinks.read_window(spark, path, now - 600_000_000, now - 60_000_000).select("flow_id", "recv_us", "octets")


@query("SELECT obs_id, ts_us, sni FROM sni_log WHERE ts_us > 1704067200000000 + 3600000000", "sni_log")
def stored_names(spark, sf_dir):
    """Six-hour partitions."""
    path, log = folder(spark, "sni"), fixture(spark, sf_dir, "sni_log")
    sinks.append_sni(log, path)
    return sinks.read_window(spark, path, 1704067200000000 + 3600_000_000, catalog.now_of(log, "ts_us"), 6, "ts_us").select("obs_id", "ts_us", "sni")


@query("SELECT count(*) AS n, CAST(sum(octets) AS BIGINT) AS octets FROM flows, (SELECT max(recv_us) AS now FROM flows) t WHERE recv_us >= CAST(floor((now - 600000000) / 3600000000.0::DOUBLE) AS BIGINT) * 3600000000", "flows")
def expired_flows(spark, sf_dir):
    """What is left once the hours that ended ten minutes before now are dropped."""
    path, flows = folder(spark, "flows"), flows_of(spark, sf_dir)
    sinks.append_flows(flows, path)
    sinks.expire(spark, path, catalog.now_of(flows) - 600_000_000)
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.sum("octets").cast("bigint").alias("octets"))


@query("SELECT suffix, app, category FROM app_rules WHERE app LIKE 'app%'", "app_rules")
def seeded_rules(spark, sf_dir):
    """Rules of the pages kept where the seed has the same suffix; the rest is the fixed seed, left out here."""
    rules = fixture(spark, sf_dir, "app_rules")
    seeds = spark.createDataFrame([(s[0], s[1], s[2]) for s in SEEDS], "suffix string, app string, category string")
    state = seed_if_absent(rules.select("suffix", "app", "category"), seeds.unionByName(rules.select("suffix", F.lit("seed").alias("app"), F.lit("seed").alias("category"))), "suffix")
    return state.where("app like 'app%'")


@query(catalog._PLACES + "SELECT ip, 'new' AS reason, obs_count FROM pg", "flows", "geo_blocks")
def stored_decisions(spark, sf_dir):
    """Decisions and state of a pass published under one id and read back; a repeated attempt changes nothing."""
    from flowlake.plans import passes

    root = folder(spark, "state")
    decisions, state = Table(spark, root, "geo_decisions", GEO_DECISIONS), Table(spark, root, "ip_geo", IP_GEO)
    new, made = passes.observed_geo_pass(catalog.located_flows(spark, sf_dir), state.read())
    for _ in range(2):
        decisions.append(made, 1)
    state.publish(merge(state.read(), new))
    return decisions.log(state.version()).select("ip", "reason", "obs_count")


@query(
    """SELECT 'a' || id AS ip, CASE WHEN id % 10 = 0 THEN lat WHEN id % 7 = 0 THEN lat + 1 ELSE lat END AS lat, CASE WHEN id % 10 = 0 THEN 'manual' WHEN id % 7 = 0 THEN 'second' ELSE 'first' END AS source, CASE WHEN id % 10 <> 0 AND id % 7 = 0 THEN 2 ELSE 1 END AS obs_count FROM places
UNION ALL SELECT 'b' || id, lat, 'second', 2 FROM sites""",
    "places", "sites",
)
def bucketed_state(spark, sf_dir):
    """A table in buckets after a second upsert of some rows and new ones; manual rows stay."""
    table = BucketedTable(spark, folder(spark, "buckets"), "ip_geo", "ip string, lat double, source string, obs_count int", buckets=16)
    places, sites = fixture(spark, sf_dir, "places"), fixture(spark, sf_dir, "sites")
    kind = F.when(F.col("id") % 10 == 0, "manual").otherwise("first")
    table.upsert(places.select(F.concat(F.lit("a"), "id").alias("ip"), "lat", kind.alias("source"), F.lit(1).alias("obs_count")))
    again = places.where("id % 7 = 0").select(F.concat(F.lit("a"), "id").alias("ip"), (F.col("lat") + 1).alias("lat"))
    table.upsert(again.unionByName(sites.select(F.concat(F.lit("b"), "id").alias("ip"), "lat")).withColumns({"source": F.lit("second"), "obs_count": F.lit(2)}))
    return table.read()


@query(catalog._MARKED + "SELECT flow_id, dst_addr AS dst, dst_lat, dst_country, service FROM m", "flows", "geo_blocks")
def enriched_json(spark, sf_dir):
    """Fields of the nested JSON of every flow."""
    rows = enrich.enriched(catalog.marked_flows(spark, sf_dir).drop("src_home", "dst_home", "src_country", "dst_country"))
    shape = "flow_id bigint, dst_addr string, dst_geo struct<lat: double, country: string>, service string"
    j = rows.select(F.from_json("json", shape).alias("j"))
    return j.select("j.flow_id", F.col("j.dst_addr").alias("dst"), F.col("j.dst_geo.lat").alias("dst_lat"), F.col("j.dst_geo.country").alias("dst_country"), "j.service")


@query("SELECT flow_id, octets FROM flows WHERE recv_us >= 1704067200000000 + 100 * 1000000", "flows")
def flows_since(spark, sf_dir):
    """F7."""
    return stats.since(flows_of(spark, sf_dir), 1704067200 + 100).select("flow_id", "octets")


# ---- streams: the same answers as in batch --------------------------------------------------------------------------


def stream_of(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """The rows as files that a stream reads in order of time."""
    path = folder(spark, name)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def ended(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """What a stream over all there is leaves in files, a folder for each micro-batch."""
    path = folder(spark, name)
    streaming.run(stream, [lambda batch, i: batch.write.mode("overwrite").parquet(f"{path}/batch={i}")], folder(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(path).drop("batch")


#: Micro-batches of the stream queries; the stream is started anew for each.
PARTS = 4


def in_parts(spark: SparkSession, rows: DataFrame, part: Column, name: str, build) -> DataFrame:
    """What ``build(stream, out)`` makes of rows that arrive in PARTS parts, one micro-batch each, with a restart before each:
    ``build`` gives the stream to run and its sink, which hands each result to ``out(batch, id)``."""
    source, path, checkpoint = folder(spark, name), folder(spark, f"{name}-out"), folder(spark, f"{name}-checkpoint")
    kept = cut(rows.withColumn("_part", part))
    for k in range(PARTS):
        kept.where(F.col("_part") == k).drop("_part").write.mode("append").parquet(source)
        stream, sink = build(spark.readStream.schema(rows.schema).parquet(source), lambda batch, i: batch.write.mode("overwrite").parquet(f"{path}/batch={i}"))
        streaming.run(stream, [sink], checkpoint).awaitTermination()
    return spark.read.parquet(path).drop("batch")


def both(*of):
    """A sink that hands a batch to several."""
    return lambda batch, i: [sink(batch, i) for sink in of] and None


def time_part(rows: DataFrame) -> Column:
    """Parts of equal time."""
    first, last = rows.agg(F.min("recv_us"), F.max("recv_us")).first()
    first, last = first or 0, last or 0
    return F.least(F.lit(PARTS - 1), F.floor((F.col("recv_us") - first) * PARTS / (last - first + 1))).cast("int")


def rocks(f):
    """Runs a stream on the RocksDB state store, and leaves the session's settings as they were."""
    key, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

    @wraps(f)
    def run(spark, sf_dir):
        before = spark.conf.get(key, None)
        spark.conf.set(key, provider)
        try:
            return f(spark, sf_dir)
        finally:
            spark.conf.unset(key) if before is None else spark.conf.set(key, before)

    return run


@query("SELECT flow_id, octets FROM flows", "flows")
def resumed_flows(spark, sf_dir):
    """Every flow once, though the input holds each again in the next micro-batch, and the stream starts anew for each."""
    flows = flows_of(spark, sf_dir).select("flow_id", "recv_us", "octets")
    part = time_part(flows)
    again = flows.withColumn("_again", part).where(F.col("_again") < PARTS - 1).drop("_again").withColumn("copy", F.lit(1))
    rows = flows.withColumn("copy", F.lit(0)).unionByName(again)
    build = lambda stream, out: (streaming.resume(stream, "3650 days").select("flow_id", "octets"), out)
    return in_parts(spark, rows, part + F.col("copy"), "twice", build)


@query("SELECT flow_id, recv_us, octets FROM flows WHERE recv_us IS NOT NULL ORDER BY recv_us DESC, flow_id DESC LIMIT 1500", "flows")
def hot_flows(spark, sf_dir):
    """The newest rows of a table that a stream appends to in micro-batches, one of which is made twice, after older
    partitions were dropped."""
    path = folder(spark, "hot")
    flows = flows_of(spark, sf_dir).select("flow_id", "recv_us", "octets")
    kept = cut(flows.withColumn("_part", time_part(flows)))
    for k in (0, 1, 2, 2, 3):
        sinks.append_flows(kept.where(F.col("_part") == k).drop("_part"), path, batch_id=k)
    sinks.keep_newest(spark, path, 1500)
    return sinks.newest(spark, path, 1500)


@query(
    catalog._MARKED + f""", w AS (SELECT m.* FROM m WHERE octets > 0), x AS (SELECT recv_us - recv_us % 1000000 AS second_us, 'service' AS axis, service AS key, * FROM w)
SELECT second_us, axis, key, {catalog._SUMS} FROM x WHERE key IS NOT NULL GROUP BY second_us, axis, key""",
    "flows", "geo_blocks",
)
def second_partials(spark, sf_dir):
    """One-second sums of the service axis, from a stream that ran to its end."""
    flows = flows_of(spark, sf_dir)
    # a row far in the future lets all windows close; it is looked up alone
    late = cut(flows.orderBy(F.desc("recv_us")).limit(1).withColumn("recv_us", F.col("recv_us") + 10**12).withColumn("flow_id", F.lit(-1).cast("bigint")))
    marked = catalog.marked_flows(spark, sf_dir, flows.unionByName(late)).select("recv_us", "octets", "packets", *(f"{e}_{c}" for e in ("src", "dst") for c in ("addr", "as", "home", "country")), "service")
    stream = streaming.second_partials(stream_of(spark, marked, "marked"), "0 seconds", ["service"])
    rows = ended(spark, stream, "partials")
    return rows.select("second_us", "axis", "key", "bytes", "bytes_in", "bytes_out", "pkts_in", "pkts_out")


@query(
    catalog._AXES.replace("recv_us > now - 60000000 AND recv_us <= now", "recv_us >= (now // 1000000 - 59) * 1000000 AND recv_us < (now // 1000000 + 1) * 1000000") + "SELECT axis, key, bytes, bytes_in, bytes_out FROM roll",
    "flows", "geo_blocks",
)
def partials_rollup(spark, sf_dir):
    """T3's read, T4: the last sixty seconds from one-second sums; the cap is above the keys there are."""
    flows = flows_of(spark, sf_dir)
    now = catalog.now_of(flows)
    second = F.floor(F.col("recv_us") / 1_000_000) * 1_000_000
    marked = catalog.marked_flows(spark, sf_dir, stats.trailing(flows, now, 120))
    rows = stats.axis_rows(stats.nonzero(marked)).groupBy(second.alias("second_us"), "axis", "key").agg(F.min("axis_country").alias("country"), *stats._amounts())
    return streaming.rollup_partials(streaming.cap_keys(rows, 4000), now // 1_000_000 * 1_000_000, 60).select("axis", "key", "bytes", "bytes_in", "bytes_out")


@query(catalog._FAN + " SELECT flow_id, distinct_sources, distinct_sources > 30 AS flag FROM fan", "flows")
@rocks
def fan_in_stream(spark, sf_dir):
    """T5: the batch answer from state by destination and source and sums over time, in micro-batches with restarts."""
    fan = streaming.FanIn(folder(spark, "fan-state"))
    flows = flows_of(spark, sf_dir).select("flow_id", "dst_addr", "src_addr", "recv_us")
    out = in_parts(spark, flows, time_part(flows), "fan", lambda stream, out: (fan.changes(stream), fan.sink(out)))
    return out.select("flow_id", "distinct_sources", "flag")


#: Keys of a second and axis that capped_partials keeps: far fewer than there are.
FEW = 12


@query(
    catalog._AXES.replace("recv_us > now - 60000000 AND recv_us <= now", "recv_us >= (now // 1000000 - 59) * 1000000 AND recv_us < (now // 1000000 + 1) * 1000000")
    + """SELECT axis, key, bytes, total, true AS within, true AS counted FROM (SELECT *, CAST(sum(bytes) OVER (PARTITION BY axis) AS BIGINT) AS total FROM roll) q WHERE bytes * 13 > total""",
    "flows", "geo_blocks",
)
def capped_partials(spark, sf_dir):
    """The keys that a summary of twelve must hold, from one-second summaries of micro-batches, with their true bytes
    within its bound, and the number of distinct keys within its sketch's."""
    flows = flows_of(spark, sf_dir)
    now = catalog.now_of(flows)
    marked = cut(catalog.marked_flows(spark, sf_dir, stats.trailing(flows, now, 120)))
    partials = capped.CappedPartials(spark, folder(spark, "capped"), FEW)
    # parts that share seconds: summaries of one second merge
    in_parts(spark, marked, F.pmod("flow_id", F.lit(PARTS)).cast("int"), "capped-in", lambda stream, out: (stream, both(partials.sink(), out)))
    last = now // 1_000_000 * 1_000_000
    found = partials.rollup(last - 59_000_000, last)
    rows = stats.axis_rows(stats.nonzero(marked)).where(F.col("recv_us").between(last - 59_000_000, last + 999_999))
    exact = rows.groupBy("axis", "key").agg(F.sum("octets").cast("bigint").alias("exact"))
    true_keys = exact.groupBy("axis").agg(F.count("*").alias("n"))
    within = (F.col("bytes") <= F.col("exact")) & (F.col("exact") <= F.col("bytes") + F.col("lost")) & (F.col("lost") * (FEW + 1) <= F.col("total"))
    # four sigmas of a sketch of 2^12 bins
    counted = F.abs(F.col("keys") - F.col("n")) <= 1 + F.col("n") * 4 * 1.04 / 64
    out = found.join(exact, ["axis", "key"]).join(true_keys, "axis").where(F.col("exact") * (FEW + 1) > F.col("total"))
    return out.select("axis", "key", F.col("exact").alias("bytes"), "total", within.alias("within"), counted.alias("counted"))


@query(
    catalog._MARKED + catalog._CORR + catalog._APPS + "SELECT flow_id, coalesce(x.lat, src_lat) AS src_lat, coalesce(y.lon, dst_lon) AS dst_lon, coalesce(d.app, s.app) AS app FROM m LEFT JOIN corr x ON x.ip = src_addr LEFT JOIN corr y ON y.ip = dst_addr LEFT JOIN (SELECT * FROM ip_app WHERE app IS NOT NULL) d ON d.ip = dst_addr LEFT JOIN (SELECT * FROM ip_app WHERE app IS NOT NULL) s ON s.ip = src_addr",
    "flows", "geo_blocks", "sni_log", "app_rules",
)
def enriched_stream(spark, sf_dir):
    """Corrections and applications applied to every micro-batch."""
    located = catalog.located_flows(spark, sf_dir)
    fixes = located.where("flow_id % 50 = 7").select(F.col("src_addr").alias("ip"), F.lit(1.5).alias("lat"), F.lit(2.5).alias("lon"), F.lit("XX").alias("country")).distinct()
    dims = {"corrections": fixes, "ip_app": catalog.ip_app_of(spark, sf_dir)}
    path = folder(spark, "enriched")
    sink = streaming.enriching_sink(lambda: dims, lambda batch, i: batch.select("flow_id", F.col("src_geo.lat").alias("src_lat"), F.col("dst_geo.lon").alias("dst_lon"), "app").write.mode("overwrite").parquet(f"{path}/batch={i}"))
    streaming.run(stream_of(spark, located, "located"), [sink], folder(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(path).drop("batch")


def pass_tables(spark: SparkSession, root: str) -> dict[str, Table]:
    schemas = {"ip_geo": IP_GEO, "geo_decisions": GEO_DECISIONS, "ip_app": IP_APP, "app_decisions": APP_DECISIONS, "routes": f"dst_ip string, traced_us long, hops {HOPS}, hop_count int"}
    return {n: Table(spark, root, n, s) for n, s in schemas.items()}


@query(catalog._PLACES + "SELECT ip, obs_count, dirty FROM pg", "flows", "geo_blocks")
def pass_round(spark, sf_dir):
    """The canonical places after two rounds of all passes; the second finds nothing new."""
    tables = pass_tables(spark, folder(spark, "tables"))
    tables["routes"].publish(catalog.routes_of(spark, sf_dir))
    flows, log = catalog.located_flows(spark, sf_dir), catalog.classified_log(spark, sf_dir)
    now = catalog.now_of(log, "ts_us")
    for _ in range(2):
        streaming.run_passes(spark, now, tables, flows, log, HOME)
    return tables["ip_geo"].read().select("ip", "obs_count", "dirty")


@query(catalog._PLACES + "SELECT ip, obs_count, dirty FROM pg UNION ALL SELECT * FROM (VALUES ('pass:apps', 5, false), ('pass:places', 3, false), ('pass:traces', 9, false)) v WHERE (SELECT count(*) FROM flows) > 0", "flows", "geo_blocks")
def scheduled_passes(spark, sf_dir):
    """The canonical places after passes with intervals of their own, driven by a stream in micro-batches with restarts, and
    the last slot that each pass has finished, in tenths and less of the flows' time."""
    root, store = folder(spark, "scheduled"), folder(spark, "scheduled-flows")
    located, log = cut(catalog.located_flows(spark, sf_dir)), cut(catalog.classified_log(spark, sf_dir))
    first, last = located.agg(F.min("recv_us"), F.max("recv_us")).first()
    tables = pass_tables(spark, root)
    routes = catalog.routes_of(spark, sf_dir)
    measure = lambda wanted: routes.join(wanted.select(F.col("ip").alias("dst_ip")), "dst_ip", "left_semi").select("dst_ip", "traced_us", "hops")
    # flows so far; times begin at 0, so that slots count from there
    so_far = lambda: spark.read.schema(located.schema).parquet(store)
    tenth = max(1, (last - first) // 10_000_000 + 1)
    periodic = [
        streaming.Periodic("places", 3 * tenth, lambda now: streaming.geo_pass(tables, so_far(), HOME)),
        streaming.Periodic("apps", 2 * tenth - tenth // 10, lambda now: streaming.app_pass(tables, log, now)),
        streaming.Periodic("traces", tenth + 1, lambda now: streaming.trace_pass(tables, so_far(), now, measure)),
    ]
    schedule = streaming.PassScheduler(Table(spark, root, "ledger", streaming.PassScheduler.LEDGER), periodic)
    keep = lambda batch, i: batch.write.mode("overwrite").parquet(f"{store}/batch={i}")
    clock = lambda batch, i: schedule.sink("clock")(batch.withColumn("clock", F.col("recv_us") - first), i)
    in_parts(spark, located, time_part(located), "scheduled-in", lambda stream, out: (stream, both(keep, clock, lambda b, i: out(b.select("flow_id"), i))))
    done = schedule.ledger.read().select(F.concat(F.lit("pass:"), "pass").alias("ip"), F.col("slot").alias("obs_count"), F.lit(False).alias("dirty"))
    return tables["ip_geo"].read().select("ip", "obs_count", "dirty").unionByName(done)


@query(catalog._FAN + " SELECT flow_id, octets >= 5000000 OR distinct_sources > 30 AS told FROM flows JOIN fan USING (flow_id)", "flows")
def told_flows(spark, sf_dir):
    """W2 and K6's conditions on every flow."""
    rows = detect.fan_in(flows_of(spark, sf_dir))
    return rows.select("flow_id", (F.col("flag") | (F.coalesce("octets", F.lit(0)) >= 5_000_000)).alias("told"))
