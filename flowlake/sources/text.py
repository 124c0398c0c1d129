"""Text sources: NetFlow JSON lines, traceroute reports, infrastructure features, port table, address blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.functions.ip import canonical_ip, ip6_hex, ip_number
from flowlake.operators.enrich import normalise_netflow, places_of
from flowlake.schemas import HOPS

NETFLOW_ITEM = (
    "struct<fields: struct<src: string, dst: string, src_port: int, dst_port: int, protocol: string, in_bytes: bigint, out_bytes: bigint, "
    "in_packets: bigint, out_packets: bigint, bgp_src_as: bigint, bgp_dst_as: bigint, first_switched: bigint, last_switched: bigint, "
    "in_snmp: bigint, out_snmp: bigint, next_hop: string, src_mask: int, dst_mask: int>, tags: struct<source: string>, timestamp: bigint>"
)
REPORT = "struct<report: struct<hubs: array<struct<count: int, host: string, Avg: double>>>>"


def parse_netflow_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(flow records, rejected lines) of lines(value): an object or an array of objects each, batch or stream.
    Blank lines are nothing; items without fields are dropped."""
    trimmed = F.trim("value")
    rows = lines.where(trimmed != "").select("value", F.when(trimmed.startswith("["), trimmed).otherwise(F.concat(F.lit("["), trimmed, F.lit("]"))).alias("_v"))
    parsed = rows.withColumn("_i", F.from_json("_v", f"array<{NETFLOW_ITEM}>", {"mode": "PERMISSIVE"})).withColumn("_ok", F.try_parse_json("_v").isNotNull() & F.col("_i").isNotNull())
    items = parsed.where("_ok").select(F.explode("_i").alias("_i")).where("_i is not null").select("_i.*")
    return normalise_netflow(items), parsed.where("not _ok").select("value")


def read_netflow_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_netflow_lines(spark.read.text(path))


def stream_netflow_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_netflow_lines(spark.readStream.text(path))


def parse_trace_reports(reports: DataFrame, blocks: DataFrame, home: tuple[float, float]) -> DataFrame:
    """Routes (dst_ip, traced_us, hops, hop_count) of reports(dst_ip, traced_us, json). Hops whose host is no address
    are skipped; a report without hops gives no route."""
    parsed = reports.select("dst_ip", "traced_us", F.from_json("json", REPORT).alias("r"))
    hubs = parsed.select("dst_ip", "traced_us", F.explode("r.report.hubs").alias("h"))
    hops = hubs.select("dst_ip", "traced_us", F.col("h.count").alias("idx"), canonical_ip(F.col("h.host")).alias("ip"), F.col("h.Avg").alias("rtt_ms")).where("ip is not null")
    rows = hops.join(places_of(hops, "ip", blocks, home), "ip", "left")
    hop = F.struct("idx", "ip", F.col("place.lat").alias("lat"), F.col("place.lon").alias("lon"), F.col("place.country").alias("country"), "rtt_ms")
    return rows.groupBy("dst_ip", "traced_us").agg(F.array_sort(F.collect_list(hop)).cast(HOPS).alias("hops")).withColumn("hop_count", F.size("hops"))


def read_features(spark: SparkSession, path: str, role: str) -> DataFrame:
    """Lon, lat (four places), name, role, country of a GeoJSON file's point features; a landing's country is the
    text after its name's last comma."""
    schema = "features array<struct<geometry: struct<coordinates: array<double>>, properties: struct<name: string, country: string>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    at = lambda i: F.round(F.get("f.geometry.coordinates", F.lit(i)), 4)
    name = F.col("f.properties.name")
    after = F.trim(F.element_at(F.split(name, ","), -1))
    country = F.when(F.lit(role == "landing"), F.when(name.contains(","), after)).otherwise(F.trim("f.properties.country"))
    out = rows.select(at(0).alias("lon"), at(1).alias("lat"), name.alias("name"), F.lit(role).alias("role"), F.when(country != "", country).alias("country"))
    return out.where("lon is not null and lat is not null")


def read_services(spark: SparkSession, path: str) -> DataFrame:
    """Port, proto, name of ``name<tab>port/proto`` lines; ``#`` begins a comment."""
    rows = spark.read.schema("name string, key string").csv(path, sep="\t", comment="#")
    return rows.select(F.split_part("key", F.lit("/"), F.lit(1)).try_cast("int").alias("port"), F.lower(F.trim(F.split_part("key", F.lit("/"), F.lit(2)))).alias("proto"), F.trim("name").alias("name"))


def check_services(services: DataFrame, expected: int | None = None) -> DataFrame:
    """Q1: rule and violations of each rule of the port table."""
    bad = lambda c: F.count_if(F.coalesce(c, F.lit(True)))
    counts = services.agg(
        bad(~F.col("name").rlike("^[!-~]+$") | F.col("name").contains("?")).alias("name_is_plain_ascii"),
        bad(~F.col("proto").isin("tcp", "udp")).alias("proto_is_tcp_or_udp"),
        bad(~F.col("port").between(0, 65535)).alias("port_is_16_bit"),
        (F.count("*") - F.count_distinct(F.struct("port", "proto"))).alias("key_is_unique"),
        (F.abs(F.count("*") - expected) if expected is not None else F.lit(0)).cast("bigint").alias("row_count"),
    )
    return counts.unpivot([], ["name_is_plain_ascii", "proto_is_tcp_or_udp", "port_is_16_bit", "key_is_unique", "row_count"], "rule", "violations")


def _network_bounds(network: Column) -> tuple[Column, Column, Column]:
    """ip_lo, ip_hi of an IPv4 network, and its prefix length."""
    bits = F.split_part(network, F.lit("/"), F.lit(2)).try_cast("int")
    size = F.pow(F.lit(2.0), F.lit(32) - bits).cast("bigint")
    first = ip_number(F.split_part(network, F.lit("/"), F.lit(1)))
    low = first - F.pmod(first, size)
    return low, low + size - 1, bits


def _network_bounds_v6(network: Column) -> tuple[Column, Column]:
    """hex_lo, hex_hi of an IPv6 network in canonical text: digits within the prefix, then zeros or f's."""
    bits = F.split_part(network, F.lit("/"), F.lit(2)).try_cast("int")
    digits = ip6_hex(F.split_part(network, F.lit("/"), F.lit(1)))
    whole, rest = F.floor(bits / 4).cast("int"), bits % 4
    free = F.lit(16) / F.pow(F.lit(2.0), rest)  # values of the digit that the prefix cuts
    digit = F.conv(F.substr(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    low = digit - F.pmod(digit, free.cast("int"))
    one = lambda d: F.when(rest > 0, F.lower(F.hex(d))).otherwise(F.lit(""))
    end = lambda d, fill: F.rpad(F.concat(F.substr(digits, F.lit(1), whole), one(d)), 32, fill)
    ok = digits.isNotNull() & bits.between(0, 128)
    return F.when(ok, end(low.cast("bigint"), "0")), F.when(ok, end((low + free - 1).cast("bigint"), "f"))


def geo_blocks(rows: DataFrame) -> DataFrame:
    """ip_lo, ip_hi (IPv4) or hex_lo, hex_hi (IPv6), prefix_len, lat, lon, country, city of rows(network, latitude,
    longitude, country, city_en, city_any); rows without both coordinates or of no network are dropped, English city
    names preferred."""
    low, high, bits = _network_bounds(F.col("network"))
    low6, high6 = _network_bounds_v6(F.col("network"))
    out = rows.select(low.alias("ip_lo"), high.alias("ip_hi"), low6.alias("hex_lo"), high6.alias("hex_hi"), bits.alias("prefix_len"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "country", F.coalesce("city_en", "city_any").alias("city"))
    return out.where("ip_lo is not null or hex_lo is not null").dropna(subset=["lat", "lon"])


def read_geo_blocks(spark: SparkSession, path: str) -> DataFrame:
    """S7 from CSV files with a header."""
    return geo_blocks(spark.read.schema("network string, latitude double, longitude double, country string, city_en string, city_any string").csv(path, header=True))
