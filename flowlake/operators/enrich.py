"""Enrichment of flows: usable rows, counters, places, services, applications, corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.functions.flow import flow_end_us, flow_start_us, protocol_number, recv_us
from flowlake.functions.ip import bogon_class, ip6_hex, ip_number, is_local
from flowlake.plans.lineage import cut

#: A dimension of up to this many bytes is sent to all tasks; a larger one is joined as Spark sees fit.
BROADCAST_BYTES = 32 << 20


def dimension(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, computed once, and marked for broadcast if its rows measure at most ``most`` bytes."""
    held = cut(df)
    size = held.agg(F.sum(F.octet_length(F.to_json(F.struct(*held.columns))) + 16)).first()[0] or 0
    return F.broadcast(held) if size <= most else held


def usable(flows: DataFrame) -> DataFrame:
    """Flows that have a time of receipt, both addresses and both counters."""
    return flows.dropna(subset=["recv_sec", "src_addr", "dst_addr", "packets", "octets"])


def with_times(flows: DataFrame) -> DataFrame:
    """recv_us, flow_start_us and flow_end_us of flow records."""
    args = [F.col(c) for c in ("recv_sec", "sys_uptime_ms", "flow_start", "flow_finish")]
    return flows.withColumns({"recv_us": recv_us(F.col("recv_sec"), F.col("recv_usec")), "flow_start_us": flow_start_us(*args), "flow_end_us": flow_end_us(*args)})


def normalise_netflow(items: DataFrame) -> DataFrame:
    """Flow records from NetFlow items (struct ``fields``, ``timestamp`` in ms)."""
    f = lambda name: F.col(f"fields.{name}")
    either = lambda a, b: F.when(f(a) > 0, f(a)).otherwise(f(b))
    return items.where("fields is not null").select(
        F.floor(F.col("timestamp") / 1000).cast("long").alias("recv_sec"),
        (F.pmod(F.col("timestamp"), F.lit(1000)) * 1000).cast("long").alias("recv_usec"),
        protocol_number(f("protocol")).alias("protocol"),
        f("src").alias("src_addr"),
        f("dst").alias("dst_addr"),
        f("next_hop").alias("gateway_addr"),
        f("src_port").alias("src_port"),
        f("dst_port").alias("dst_port"),
        either("in_packets", "out_packets").alias("packets"),
        either("in_bytes", "out_bytes").alias("octets"),
        f("in_snmp").alias("if_index_in"),
        f("out_snmp").alias("if_index_out"),
        f("last_switched").alias("sys_uptime_ms"),
        F.lit(9).alias("netflow_version"),
        f("first_switched").alias("flow_start"),
        f("last_switched").alias("flow_finish"),
        f("bgp_src_as").alias("src_as"),
        f("bgp_dst_as").alias("dst_as"),
        f("src_mask").alias("src_mask"),
        f("dst_mask").alias("dst_mask"),
    )


#: Hexadecimal digits of the cells of IPv6 blocks: a block lies in cells of the longest of these not beyond its prefix.
CELLS_V6 = (4, 8, 12, 16)


def _hits_v4(named: DataFrame, blocks: DataFrame) -> DataFrame:
    """Addresses with the IPv4 blocks that hold them. Blocks are laid out in /16 cells; a block wider than /8 would need
    more than 256 of them, so such blocks are laid out in /8 cells and joined apart."""
    found = None
    rows = named.withColumn("n", ip_number(F.col("ip"))).where("n is not null")
    for shift, wide in ((16, False), (24, True)):
        width = F.col("ip_hi") - F.col("ip_lo")
        part = blocks.where(width >= 1 << 24 if wide else width < 1 << 24)
        cells = part.withColumn("cell", F.explode(F.sequence(F.shiftright("ip_lo", shift), F.shiftright("ip_hi", shift))))
        hits = rows.withColumn("cell", F.shiftright("n", shift)).join(cells, "cell").where("n between ip_lo and ip_hi")
        hits = hits.select("ip", F.lpad(F.hex(F.col("ip_hi") - F.col("ip_lo")), 8, "0").alias("_first"), F.lpad(F.hex("ip_lo"), 8, "0").alias("_then"), F.struct(*blocks.columns).alias("block"))
        found = hits if found is None else found.unionByName(hits)
    return found


def _hits_v6(named: DataFrame, blocks: DataFrame) -> DataFrame:
    """The same for IPv6 blocks, whose bounds hex_lo and hex_hi are 32 hexadecimal digits. A block of a prefix of 16 bits or
    more lies in one cell; a shorter prefix lies in one 16-bit cell for each of its values."""
    same = F.length(F.regexp_extract(F.concat_ws(",", "hex_lo", "hex_hi"), r"^([0-9a-f]*)[0-9a-f]*,\1", 1))
    digits = F.lit(CELLS_V6[0])
    for n in CELLS_V6[1:]:
        digits = F.when(same >= n, n).otherwise(digits)
    first = lambda c: F.conv(F.substring(c, 1, 4), 16, 10).cast("int")
    wide = F.transform(F.sequence(first("hex_lo"), first("hex_hi")), lambda i: F.lpad(F.lower(F.hex(i)), 4, "0"))
    cells = blocks.where("hex_lo is not null").withColumn("_digits", digits)
    cells = cells.withColumn("cell", F.explode(F.when(same < CELLS_V6[0], wide).otherwise(F.array(F.expr("substring(hex_lo, 1, _digits)"))))).drop("_digits")
    rows = named.where(F.col("ip").contains(":")).withColumn("h", ip6_hex(F.col("ip"))).where("h is not null")
    rows = rows.withColumn("cell", F.explode(F.array(*(F.substring("h", 1, n) for n in CELLS_V6))))
    hits = rows.join(cells, "cell").where("h between hex_lo and hex_hi")
    # of nested blocks the inner one ends first, or else begins last
    inverse = F.translate("hex_lo", "0123456789abcdef", "fedcba9876543210")
    return hits.select("ip", F.col("hex_hi").alias("_first"), inverse.alias("_then"), F.struct(*blocks.columns).alias("block"))


def cidr_join(addresses: DataFrame, ip_col: str, blocks: DataFrame) -> DataFrame:
    """Each distinct address with the narrowest block that holds it (ties: lowest bound), as struct ``block``.

    Blocks have ip_lo and ip_hi (IPv4 numbers) or hex_lo and hex_hi (IPv6, 32 hexadecimal digits); the join is on equality
    of cells with the range as a residual.
    """
    named = addresses.select(F.col(ip_col).alias("ip")).where("ip is not null").distinct()
    return _narrowest(named if named.isStreaming else cut(named), blocks)


def _narrowest(named: DataFrame, blocks: DataFrame) -> DataFrame:
    """cidr_join of distinct addresses."""
    found = _hits_v4(named, blocks)
    if "hex_lo" in blocks.columns:
        found = found.unionByName(_hits_v6(named, blocks))
    return found.groupBy("ip").agg(F.min_by("block", F.struct("_first", "_then")).alias("block"))


def places_of(addresses: DataFrame, ip_col: str, blocks: DataFrame, home: tuple[float, float]) -> DataFrame:
    """Ip and struct ``place`` (lat, lon, country, city, is_home) of each distinct address that has one: home for
    local addresses, else the block's place."""
    bounds = [c for c in ("ip_lo", "ip_hi", "hex_lo", "hex_hi") if c in blocks.columns]
    blocks = blocks.select(*bounds, *(F.col(c) if c in blocks.columns else F.lit(None).cast("string").alias(c) for c in ("lat", "lon", "country", "city"))).dropna(subset=["lat", "lon"])
    named = addresses.select(F.col(ip_col).alias("ip")).where("ip is not null").distinct()
    # looked up in several layouts of blocks: the addresses are gathered once
    named = named if named.isStreaming else cut(named)
    rows = named.join(_narrowest(named, blocks), "ip", "left")
    point = lambda lat, lon, country, city, home_: F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"), country.cast("string").alias("country"), city.cast("string").alias("city"), F.lit(home_).alias("is_home"))
    null = F.lit(None)
    here = point(F.lit(home[0]), F.lit(home[1]), null, null, True)
    there = point(F.col("block.lat"), F.col("block.lon"), F.col("block.country"), F.col("block.city"), False)
    return rows.select("ip", F.when(is_local(F.col("ip")), here).when(F.col("block").isNotNull(), there).alias("place")).where("place is not null")


def geo_lookup(flows: DataFrame, ip_col: str, blocks: DataFrame, home: tuple[float, float], out: str) -> DataFrame:
    """Flows plus the place of one address column; null where it has none. Addresses are looked up once each."""
    places = places_of(flows, ip_col, blocks, home).select(F.col("ip").alias(ip_col), F.col("place").alias(out))
    return flows.join(places, ip_col, "left").select(*flows.columns, out)


def located(flows: DataFrame, blocks: DataFrame, home: tuple[float, float]) -> DataFrame:
    """Flows with src_geo and dst_geo; the addresses of both ends are looked up together."""
    ends = flows.select(F.explode(F.array("src_addr", "dst_addr")).alias("ip"))
    places = places_of(ends, "ip", blocks, home)
    side = lambda addr, out: places.select(F.col("ip").alias(addr), F.col("place").alias(out))
    rows = flows.join(side("src_addr", "src_geo"), "src_addr", "left").join(side("dst_addr", "dst_geo"), "dst_addr", "left")
    return rows.select(*flows.columns, "src_geo", "dst_geo")


def with_bogon_class(df: DataFrame, ip_col: str, out: str = "class") -> DataFrame:
    return df.withColumn(out, bogon_class(F.col(ip_col)))


def with_service(flows: DataFrame, services: DataFrame) -> DataFrame:
    """Flows plus service, by destination port, else source port, over tcp and udp only. services: port, proto, name."""
    proto = F.when(F.col("protocol") == 6, "tcp").when(F.col("protocol") == 17, "udp")
    named = dimension(services.groupBy("port", "proto").agg(F.min("name").alias("name")))
    side = lambda port, out: named.select(F.col("port").alias(port), F.col("proto").alias("_proto"), F.col("name").alias(out))
    rows = flows.withColumn("_proto", proto)
    rows = rows.join(side("dst_port", "_by_dst"), ["dst_port", "_proto"], "left").join(side("src_port", "_by_src"), ["src_port", "_proto"], "left")
    return rows.select(*flows.columns, F.coalesce("_by_dst", "_by_src").alias("service"))


def enriched(flows: DataFrame) -> DataFrame:
    """One struct ``flow`` of all fields with nested places and service, and its JSON."""
    rows = flows.select(F.struct(*flows.columns).alias("flow"))
    return rows.withColumn("json", F.to_json("flow"))


def classify_sni(names: DataFrame, rules: DataFrame, sni_col: str = "sni") -> DataFrame:
    """Names plus app, category, suffix by the longest suffix on a label border; null without one.

    Each distinct name is cut into its suffixes, these meet the rules by equality, and the earliest cut wins.
    """
    bare = F.regexp_replace(F.col(sni_col), r"\.+$", "")
    distinct = names.select(F.col(sni_col)).where(F.col(sni_col).isNotNull()).distinct()
    labels = distinct.withColumn("_l", F.split(bare, r"\."))
    cuts = labels.select(sni_col, F.posexplode(F.transform(F.sequence(F.lit(1), F.size("_l")), lambda i: F.array_join(F.slice("_l", i, F.size("_l")), "."))).alias("_at", "suffix"))
    hits = cuts.join(dimension(rules.select("suffix", "app", "category")), "suffix")
    best = hits.groupBy(sni_col).agg(F.min_by(F.struct("app", "category", "suffix"), "_at").alias("_r"))
    return names.join(best, sni_col, "left").select(*names.columns, "_r.app", "_r.category", "_r.suffix")


def apply_overrides(flows: DataFrame, corrections: DataFrame) -> DataFrame:
    """src_geo and dst_geo with the corrected place of each end; corrections: ip, lat, lon, country (optional value).

    A corrected end gets ``corrected``; where it had no place, is_home stays null.
    """
    out = flows
    fixes = dimension(corrections.select("ip", F.struct("lat", "lon", "country").alias("_fix")))
    for addr, geo in (("src_addr", "src_geo"), ("dst_addr", "dst_geo")):
        g, x = F.col(geo), F.col("_fix")
        new = F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"), F.coalesce(x["country"], g["country"]).alias("country"), g["city"].alias("city"), g["is_home"].alias("is_home"), F.lit(True).alias("corrected"))
        old = F.struct(*(g[k].alias(k) for k in ("lat", "lon", "country", "city", "is_home")), F.lit(False).alias("corrected"))
        out = out.join(fixes, out[addr] == fixes["ip"], "left").withColumn(geo, F.when(x.isNotNull(), new).when(g.isNotNull(), old)).drop("ip", "_fix")
    return out


def apply_apps(flows: DataFrame, ip_app: DataFrame) -> DataFrame:
    """App and category of the destination, else of the source, both from the same end."""
    apps = dimension(ip_app.where("app is not null").select("ip", F.struct("app", "category").alias("_a")))
    side = lambda addr, out: apps.select(F.col("ip").alias(addr), F.col("_a").alias(out))
    rows = flows.join(side("dst_addr", "_d"), "dst_addr", "left").join(side("src_addr", "_s"), "src_addr", "left")
    own = F.coalesce("_d", "_s")
    return rows.select(*flows.columns, own["app"].alias("app"), own["category"].alias("category"))
