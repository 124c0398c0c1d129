import ipaddress
import math
import random

import pytest
from pyspark.sql import functions as F

from flowlake import catalog
from flowlake.functions import flow as fl
from flowlake.functions import geo
from flowlake.functions import ip as ips
from flowlake.operators import detect, enrich, spatial, stats
from flowlake.plans import graph, passes
from flowlake.plans.components import component_labels
from flowlake.schemas import GEO_DECISIONS, HOPS, IP_APP, IP_GEO
from flowlake.sources import text

LOCAL = "10.0.0.1 172.16.5.4 192.168.1.1 127.0.0.1 169.254.1.1 100.64.0.1 224.0.0.1 0.0.0.0 ::1 fe80::1 fc00::1 fd12::1 ff02::1".split()
PUBLIC = "8.8.8.8 203.0.113.10 1.1.1.1 2606:4700:4700::1111".split()


def test_address_classes(spark):
    rows = spark.createDataFrame([(a,) for a in LOCAL + PUBLIC], "ip string").select("ip", ips.is_local(F.col("ip")).alias("l")).collect()
    assert {r["ip"] for r in rows if r["l"]} == set(LOCAL)
    cases = {"10.1.2.3": "private-use", "172.22.2.3": "private-use", "100.99.2.1": "carrier-grade NAT", "192.0.2.5": "TEST-NET-1", "224.0.0.1": "multicast", "fdff::": "ULA", "2001:db8::1": "documentation prefix", "8.8.8.8": None, "::": "node-scope unspecified", "::1": "node-scope loopback", "::ffff:1.2.3.4": "IPv4-mapped", "::2": "IPv4-compatible", "2001:1f::": "ORCHID", "3fff:f::": "documentation prefix", "x": None, None: None}
    got = spark.createDataFrame([(a,) for a in cases], "ip string").select("ip", ips.bogon_class(F.col("ip")).alias("c")).collect()
    assert {r["ip"]: r["c"] for r in got} == cases
    texts = spark.createDataFrame([(" 2606:4700:0:0::1 ",), ("999.1.1.1",), (None,)], "t string").select(ips.canonical_ip("t").alias("c"))
    assert [r["c"] for r in texts.collect()] == ["2606:4700::1", None, None]
    variants = spark.createDataFrame([("0.1.2.3",), ("255.255.255.255",), ("::1",), ("::",)], "ip string")
    out = variants.select(*(ips.is_public(F.col("ip"), v).alias(v) for v in ("local", "observed", "history"))).collect()
    assert [tuple(r) for r in out] == [(False, True, True), (False, False, True), (False, False, True), (False, True, True)]


def test_labels(spark):
    df = spark.createDataFrame([(443, 5000, 17), (5000, 443, 6), (1, 8080, 6), (53, 22, 17), (1, 22, 6), (1, 2, 99)], "sp int, dp int, p int")
    rows = df.select(fl.service_key(F.col("sp"), F.col("dp"), F.col("p")).alias("s"), fl.proto_key(F.col("p")).alias("k")).collect()
    assert [r["s"] for r in rows] == ["quic", "https", "http", "dns", "ssh", "svc"] and rows[-1]["k"] == "other"
    names = spark.createDataFrame([("TCP",), ("ipv6-icmp",), ("132",), ("what",)], "n string").select(fl.protocol_number(F.col("n")).alias("x"))
    assert [r["x"] for r in names.collect()] == [6, 58, 132, None]
    way = spark.createDataFrame([(True, True), (True, None), (None, True), (False, False)], "s boolean, d boolean").select(fl.direction(F.col("s"), F.col("d")).alias("w"))
    assert [r["w"] for r in way.collect()] == ["internal", "out", "in", "transit"]


def test_longest_suffix(spark):
    rules = spark.createDataFrame([("qq.com", "Tencent", "social"), ("weixin.qq.com", "WeChat", "chat"), ("meituan.com", "Meituan", "food")], "suffix string, app string, category string")
    names = spark.createDataFrame([("szminorshort.weixin.qq.com",), ("api.qq.com",), ("apimobile.meituan.com.",), ("unknown.example.org",), ("notqq.com",), (None,)], "sni string")
    assert [r["app"] for r in enrich.classify_sni(names, rules).orderBy("sni").collect()] == [None, "Tencent", "Meituan", None, "WeChat", None]


def test_services_prefer_destination(spark):
    services = spark.createDataFrame([(443, "tcp", "https"), (80, "tcp", "http"), (53, "udp", "domain")], "port int, proto string, name string")
    flows = spark.createDataFrame([(80, 443, 6), (443, 9, 6), (443, 9, 17), (443, 9, None), (0, 0, 6)], "src_port int, dst_port int, protocol int")
    got = enrich.with_service(flows, services).collect()
    assert sorted(str(r["service"]) for r in got) == ["None", "None", "None", "https", "https"]


def test_narrowest_block_wins(spark):
    blocks = spark.createDataFrame([(0, 2**32 - 1, 0.0, 0.0, "all"), (93 << 24, (93 << 24) + 65535, 1.0, 1.0, "wide"), ((93 << 24) + 256, (93 << 24) + 511, 2.0, 2.0, "slim")], "ip_lo long, ip_hi long, lat double, lon double, country string")
    ip = spark.createDataFrame([("93.0.1.7",), ("93.0.2.7",), ("5.5.5.5",), ("2606::1",), ("10.0.0.1",), (None,)], "ip string")
    rows = enrich.geo_lookup(ip, "ip", blocks, (-45.0, -131.0), "g").collect()
    assert {r["ip"]: (r["g"]["country"], r["g"]["is_home"]) if r["g"] else None for r in rows} == {"93.0.1.7": ("slim", False), "93.0.2.7": ("wide", False), "5.5.5.5": ("all", False), "2606::1": None, "10.0.0.1": (None, True), None: None}


def test_narrowest_block_of_either_family(spark):
    nets = "::/0 2000::/3 2606:4700::/32 2606:4700::/33 2606:4700:8000::/34 2606:4700:0:1::/64 2606:4700:0:1::5/128 2a00:10:20:30:40::/76 93.0.0.0/16 93.0.1.0/24 bad/10 93.0.0.0/x".split()
    rows = [(n, 1.0, 2.0, n, None, "any") for n in nets] + [("94.0.0.0/8", None, 2.0, "no place", None, None)]
    blocks = text.geo_blocks(spark.createDataFrame(rows, "network string, latitude double, longitude double, country string, city_en string, city_any string"))
    assert blocks.count() == 10
    ips = "2606:4700::1 2606:4700:8000::1 2606:4700:c000::1 2606:4700:0:1::5 2606:4700:0:1::6 2a00:10:20:30:4f:: 2a00:10:20:30:50:: 2400::1 f000::1 93.0.1.7 93.0.2.7 94.1.1.1 ::ffff:93.0.1.7".split()
    want = {}
    for ip in ips:
        a = ipaddress.ip_address(ip)
        fits = [n for n in map(ipaddress.ip_network, nets[:10]) if n.version == a.version and a in n]
        want[ip] = str(max(fits, key=lambda n: n.prefixlen)) if fits else None
    found = enrich.cidr_join(spark.createDataFrame([(i,) for i in ips], "ip string"), "ip", blocks).collect()
    assert {r["ip"]: r["block"]["country"] for r in found} == {i: n for i, n in want.items() if n}


def agg_flows(spark):
    rows = [(1, 10**8, "192.0.2.10", "8.8.8.8", 1000, 1, True, False, None, "US"), (2, 10**8, "1.1.1.1", "192.0.2.10", 5000, 5, False, True, "AU", None), (3, 10, "1.1.1.1", "192.0.2.10", 7, 1, False, True, "AU", None), (4, 10**8, "1.1.1.1", "192.0.2.10", 0, 1, False, True, "AU", None)]
    return spark.createDataFrame([(*r, "https", 0, 15169, 443, 40000, 6) for r in rows], "flow_id long, recv_us long, src_addr string, dst_addr string, octets long, packets long, src_home boolean, dst_home boolean, src_country string, dst_country string, service string, src_as long, dst_as long, src_port int, dst_port int, protocol int")


def test_axes(spark):
    flows, now = agg_flows(spark), 10**8
    t = stats.totals(flows, now).first()
    assert (t["bytes_in"], t["bytes_out"], t["bps_in"], t["pkts_in"]) == (5000, 1000, 667, 5)
    rows = {(r["axis"], r["key"]): r for r in stats.axis_rollup(flows, now).collect()}
    assert rows["peer", "8.8.8.8"]["bytes_out"] == 1000 and rows["peer", "1.1.1.1"]["bytes_in"] == 5000 and rows["lan", "192.0.2.10"]["bytes"] == 6000
    assert ("host", "8.8.8.8|15169|US") in rows and ("country", "AU") in rows
    empty = stats.totals(flows, now + 10**9).first()
    assert empty["bytes"] == 0 and stats.axis_rollup(flows, now + 10**9).count() == 0
    assert [r["bps"] for r in stats.timeline(flows, now, 60, 10).orderBy("i").collect()] == [0] * 9 + [8000]


def test_fan_in_sweep_equals_sets(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(400) * 1_000_000, f"d{rng.randrange(3)}", f"s{rng.randrange(40)}") for i in range(2000)]
    flows = spark.createDataFrame(rows, "flow_id long, recv_us long, dst_addr string, src_addr string")
    a, b = (sorted(tuple(r) for r in detect.fan_in(flows, 60, 20, m).select("flow_id", "distinct_sources", "flag").collect()) for m in ("sweep", "sets"))
    assert a == b and any(r[2] for r in a) and not all(r[2] for r in a)


def test_fan_in_keeps_rows_without_ends(spark):
    rows = [(1, 10, "d", "s"), (2, 20, "d", None), (3, 30, None, "s"), (4, None, "d", "t"), (5, 30, "d", "u"), (6, 30, "d", "u"), (7, 30 + 61_000_000, "d", "s")]
    flows = spark.createDataFrame(rows, "flow_id long, recv_us long, dst_addr string, src_addr string")
    for method in ("sweep", "sets"):
        got = {r["flow_id"]: r["distinct_sources"] for r in detect.fan_in(flows, 60, 30, method).collect()}
        assert got == {1: 1, 2: 1, 3: 0, 4: 0, 5: 2, 6: 2, 7: 1}, method


def test_windows_are_clamped_for_rates_too(spark):
    flows, now = agg_flows(spark), 10**8
    long, most = (sorted(tuple(r) for r in stats.live_report(flows, now, s).collect()) for s in (1200, 600))
    assert long == most and long


def test_dimensions_are_sent_by_their_size(spark):
    df = spark.range(1000).withColumn("text", F.repeat(F.lit("x"), 100))
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(enrich.dimension(df)) and not hinted(enrich.dimension(df, 50_000))
    assert enrich.dimension(df).count() == 1000


def test_sql_functions(spark):
    from flowlake.functions.register import register_functions

    register_functions(spark)
    r = spark.sql("SELECT geo_haversine_km(0, 0, 0, 180) AS km, direction(true, null) AS d, in_cidr('93.0.1.7', '93.0.0.0/16') AS a, in_cidr('::1', '93.0.0.0/16') AS b, in_cidr(null, '::/0') AS c, bogon_class('10.1.1.1') AS x, bogon_class('8.8.8.8') AS y").first()
    assert r["km"] == pytest.approx(math.pi * 6371) and tuple(r)[1:] == ("out", True, False, None, "private-use", None)


def test_geometry(spark):
    one = spark.range(1)
    km = one.select(geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("k"), geo.wrap_lon(F.lit(190.0)).alias("w"), geo.grid_cell(F.lit(-4.5), 3).alias("c")).first()
    assert km["k"] == pytest.approx(math.pi * 6371) and km["w"] == -170 and km["c"] == -1
    p = lambda lon, lat: F.struct(F.lit(float(lon)).alias("lon"), F.lit(float(lat)).alias("lat"))
    line = one.select(geo.unwrap(F.array(p(170, 0), p(-170, 1), p(-160, 2), p(170, 3))).alias("u"), geo.densify(p(0, 0), p(90, 0), F.lit(3)).alias("d"), geo.densify(p(1, 1), p(1, 1), F.lit(24)).alias("s"), geo.crosses_polar(F.array(p(0, 65))).alias("near"), geo.crosses_polar(F.array(p(-100, 65))).alias("far")).first()
    assert [x["lon"] for x in line["u"]] == [170, 190, 200, 170]
    assert [round(x["lon"], 6) for x in line["d"]] == [0, 30, 60, 90] and len(line["s"]) == 2
    assert not line["near"] and line["far"]


def test_spatial_joins_equal_all_pairs(spark):
    rng = random.Random(3)
    pts = [(i, rng.uniform(-180, 180), rng.uniform(-85, 85), i % 2) for i in range(80)] + [(90, 179.9, 10.0, 0), (91, -179.9, 10.1, 0), (92, 5.0, 89.5, 1), (93, -170.0, 89.4, 1)]
    df = spark.createDataFrame(pts, "id long, lon double, lat double, landmass int")

    def km(a, b):
        (_, x1, y1, _), (_, x2, y2, _) = a, b
        la, lb = math.radians(y1), math.radians(y2)
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(x2 - x1) / 2) ** 2
        return 2 * 6371 * math.asin(min(1, math.sqrt(h)))

    got = {(r["a"], r["b"]) for r in spatial.within_km(df, df, 900).collect()}
    assert got == {(a[0], b[0]) for a in pts for b in pts if km(a, b) <= 900} and (90, 91) in got and (92, 93) in got
    near = {(r["id"], r["rank"]): r["target"] for r in spatial.knn(df, df, 3, "landmass").collect()}
    for a in pts:
        best = sorted((km(a, b), b[0]) for b in pts if b[0] != a[0] and b[3] == a[3])[:3]
        assert [near[a[0], k] for k in (1, 2, 3)] == [t for _, t in best]


def test_polygons_and_edges(spark):
    square = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    land = spark.createDataFrame([(1, 10, square(0.0, 0.0, 10.0, 10.0)), (2, 20, square(20.0, 0.0, 30.0, 10.0))], "id long, grp long, ring array<struct<lon: double, lat: double>>")
    wall = spark.createDataFrame([(3, 1, square(4.0, -1.0, 5.0, 11.0))], land.schema)
    pts = spark.createDataFrame([(1, 5.0, 5.0), (2, 15.0, 5.0), (3, 25.5, 9.5)], "id long, lon double, lat double")
    assert [(r["grp"], r["on_land"]) for r in spatial.locate(pts, land).orderBy("id").collect()] == [(10, True), (None, False), (20, True)]
    hubs = spark.createDataFrame([(1, 1.0, 1.0, 1), (2, 1.0, 9.0, 1), (3, 9.0, 1.0, 1), (4, 25.0, 5.0, 1)], "id long, lon double, lat double, landmass int")
    edges = {(r["a"], r["b"]) for r in graph.backbone_edges(hubs, land, wall, k=3).collect()}
    assert edges == {(1, 2)}  # 1-3 and 2-3 cross the wall, 4 lies over water
    declared = spark.createDataFrame([(4, 3)], "a long, b long")
    assert {(r["a"], r["b"]) for r in graph.backbone_edges(hubs, land, wall, declared, 3).collect()} == {(1, 2), (3, 4)}


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 60)] + [(1, 1), (200, 201), (201, 200)]
    got = {r["id"]: r["component"] for r in component_labels(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[i] == 7 for i in range(7, 60)) and got[201] == 200 and got[1] == 1


def test_shortest_paths(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(20), rng.randrange(20), float(rng.randrange(1, 30))) for _ in range(50)]
    df = spark.createDataFrame([e for e in edges if e[0] != e[1]], "a long, b long, km double")
    dist = {0: 0.0}
    for _ in range(30):
        for a, b, w in edges:
            for x, y in ((a, b), (b, a)):
                if x in dist and dist[x] + w < dist.get(y, 1e9):
                    dist[y] = dist[x] + w
    tree = graph.shortest(df, spark.createDataFrame([(0,)], "id long"))
    assert {r["id"]: r["dist"] for r in tree.collect()} == dist
    far = max(dist, key=dist.get)
    (path,) = graph.paths(tree, spark.createDataFrame([(0, far)], "source long, id long")).collect()
    cheapest = {}
    for a, b, w in edges:
        for k in ((a, b), (b, a)):
            cheapest[k] = min(w, cheapest.get(k, 1e9))
    assert sum(cheapest[p] for p in zip(path["ids"], path["ids"][1:])) == dist[far]


def test_pass_laws(spark):
    blocks = spark.createDataFrame([((93 << 24) + (i << 8), (93 << 24) + (i << 8) + 255, 38.0 if i < 9 else 50.0, -97.0 if i < 9 else 8.0, "XX") for i in range(12)], "ip_lo long, ip_hi long, lat double, lon double, country string")
    flows = spark.createDataFrame([(k, k * 1000, "192.168.0.1", f"93.0.{k % 12}.5", 10) for k in range(60)], "flow_id long, recv_us long, src_addr string, dst_addr string, octets long")
    located = enrich.located(flows, blocks, (-45.0, -131.0))
    empty = spark.createDataFrame([], IP_GEO)
    state, made = passes.observed_geo_pass(located, empty)
    assert made.count() == 12 and state.where("dirty").count() == 9
    manual = state.withColumn("source", F.when(F.col("ip") == "93.0.0.5", "manual").otherwise(F.col("source"))).withColumn("lat", F.when(F.col("ip") == "93.0.0.5", 1.0).otherwise(F.col("lat")))
    again, more = passes.observed_geo_pass(located, manual)
    assert more.count() == 0  # nothing new, and manual rows are not argued with
    assert again.where("ip = '93.0.0.5'").first()["lat"] == 1.0
    hops = spark.createDataFrame([("93.0.1.5", 0, [(1, "a", -45.0, -131.0, None, 5.0), (2, "b", -44.0, -130.0, None, 6.0)])], f"dst_ip string, traced_us long, hops {HOPS}").withColumn("hop_count", F.size("hops"))
    moved, why = passes.relocate(state, hops, (-45.0, -131.0))
    row = moved.where("corr_lat is not null").collect()
    assert [(r["ip"], r["corr_lat"], r["corr_anchor_ip"]) for r in row] == [("93.0.1.5", -44.0, "b")] and why.count() == 1
    assert passes.relocate(moved, hops, (-45.0, -131.0))[1].count() == 0
    healed, _ = passes.relocate(moved, hops.limit(0), (-45.0, -131.0))
    assert healed.where("corr_lat is not null").count() == 0
    reserved = state.limit(1).withColumn("ip", F.lit("192.0.2.9"))
    told = passes.bogon_audit(reserved, spark.createDataFrame([], GEO_DECISIONS))
    assert [r["reason"] for r in told.collect()] == ["reserved-range(TEST-NET-1)"]
    assert passes.bogon_audit(reserved, told).count() == 0
    log = spark.createDataFrame([(10**12 + k, "93.0.0.5", f"n{k % 2}.example", "A" if k else None, "c") for k in range(4)], "ts_us long, dst_addr string, sni string, app string, category string")
    apps, first = passes.ip_app_pass(log, spark.createDataFrame([], IP_APP), 10**12 + 10)
    assert first.count() == 1 and passes.ip_app_pass(log, apps, 10**12 + 10)[1].count() == 0
    kept = apps.withColumn("source", F.lit("manual")).withColumn("app", F.lit("B"))
    state2, audited = passes.ip_app_pass(log, kept, 10**12 + 10)
    assert state2.first()["app"] == "B" and audited.count() == 1  # kept, but told every time


def test_every_query_is_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(catalog.QUERIES) <= names and set(__spark_entry__.oracle_sql()) <= names


def test_bridges_of_chains_landings_and_zones(spark):
    # islands half a degree apart: each joins once its neighbour has
    chain = [(i, 0.45 * i, 0.0) for i in range(5)]
    hubs = spark.createDataFrame(chain + [(10, 100.0, 10.0), (20, 120.0, 10.0)], "id long, lon double, lat double")
    edges = spark.createDataFrame([(0, 1, 50.0)], "a long, b long, km double")
    built = lambda **kw: {(r["a"], r["b"]) for r in graph.bridge(hubs, edges, **kw).collect()}
    near = {(i, i + 1) for i in range(4)}
    assert built() == near
    landings = spark.createDataFrame([(1, 100.1, 10.0)], "id long, lon double, lat double")
    # pieces without a landing have no other link and are joined at once; 10 is served by its own
    assert built(landings=landings) == {(0, 1), (1, 2), (1, 3), (1, 4), (1, 20)}
    wall = spark.createDataFrame([(1, 1, [(0.6, -1.0), (0.8, -1.0), (0.8, 1.0), (0.6, 1.0)])], "id long, grp long, ring array<struct<lon: double, lat: double>>")
    assert (1, 2) not in built(zones=wall)


def test_legs_go_by_land_cable_or_circle(spark):
    square = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    land = spark.createDataFrame([(1, 10, square(0.0, 0.0, 10.0, 10.0)), (2, 20, square(20.0, 0.0, 30.0, 10.0))], "id long, grp long, ring array<struct<lon: double, lat: double>>")
    hubs = spark.createDataFrame([(1, 1.0, 1.0), (2, 9.0, 1.0), (3, 21.0, 1.0), (4, 29.0, 9.0), (5, 5.0, 9.0)], "id long, lon double, lat double")
    edge = lambda rows: spark.createDataFrame(rows, "a long, b long, km double")
    network = {"land": edge([(1, 2, 900.0)]), "cable": edge([(2, 3, 1300.0)]), "joint": edge([(1, 2, 900.0), (2, 3, 1300.0)])}
    p = lambda lon, lat: (lon, lat)
    legs = spark.createDataFrame([(1, p(1.04, 1.0), p(9.0, 1.0)), (2, p(1.0, 1.0), p(21.0, 1.0)), (3, p(1.0, 1.0), p(29.0, 9.0)), (4, p(5.0, 9.0), p(1.0, 1.0)), (5, p(1.01, 1.0), p(9.01, 1.0))], "i long, a struct<lon: double, lat: double>, b struct<lon: double, lat: double>")
    routed = legs.withColumn("key", graph.od_key(F.col("a"), F.col("b"))).join(graph.leg_routes(legs, network, hubs, land), "key").collect()
    assert {r["i"]: (r["rule"], [x["lon"] for x in r["via"]]) for r in routed} == {1: ("land", [1.0, 9.0]), 2: ("joint", [1.0, 9.0, 21.0]), 3: ("circle", []), 4: ("circle", []), 5: ("land", [1.0, 9.0])}
    hops = spark.createDataFrame([("x", [(1, "a", 1.0, 1.0, None, 1.0), (2, "b", 1.0, 21.0, None, 2.0)])], f"dst_ip string, hops {HOPS}")
    (line,) = graph.route_polylines(hops, network, hubs, land).collect()
    lons = [round(x["lon"], 3) for x in line["points"]]
    assert lons[0] == 1.0 and 9.0 in lons and lons[-1] == 21.0 and lons == sorted(lons) and len(lons) == 1 + 4 + 5


def test_bridges_that_do_not_settle_are_an_error(spark):
    islands = spark.createDataFrame([(i, 0.45 * i, 0.0) for i in range(4)], "id long, lon double, lat double")
    with pytest.raises(RuntimeError):
        graph.bridge(islands, spark.createDataFrame([(0, 1, 50.0)], "a long, b long, km double"), max_rounds=1)
