"""Steps whose work must not outgrow their input."""

import time

from pyspark.sql import functions as F

from flowlake import catalog, catalog_geo
from flowlake.functions import geo
from flowlake.operators import detect, spatial
from flowlake.plans import graph, passes
from flowlake.schemas import IP_GEO
from flowlake.streaming import flows as streaming


def test_a_long_line_is_unwrapped_in_proportion(spark):
    """each point was added to a copy of the line so far."""
    line = F.transform(F.sequence(F.lit(0), F.lit(299_999)), lambda i: F.struct((((i * 0.25 + 180) % 360) - 180).alias("lon"), F.lit(1.0).alias("lat")))
    began = time.time()
    (row,) = spark.range(1).select(line.alias("points")).select(F.element_at(geo.unwrap(F.col("points")), -1)["lon"].alias("lon")).collect()
    assert row["lon"] == 299_999 * 0.25
    assert time.time() - began < 30
    (row,) = spark.range(1).select(geo.unwrap(F.array(*(F.struct(F.lit(x).alias("lon"), F.lit(0.0).alias("lat")) for x in (170.0, -170.0, 175.0, -10.0, -179.0, 179.0)))).alias("p")).collect()
    assert [p["lon"] for p in row["p"]] == [170.0, 190.0, 175.0, 350.0, 181.0, 179.0]


def test_quality_is_measured_within_the_row(spark):
    """a line's points were dealt out again by key, one row each."""
    lines = spark.createDataFrame([("a", [(0.0, 0.0), (0.0, 1.0), (0.0, 3.0)]), ("b", [(5.0, 5.0), (5.0, 5.0)]), ("c", [(1.0, 1.0)])], "pair string, points array<struct<lon: double, lat: double>>")
    out = graph.route_quality(lines)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    rows = {r["pair"]: r for r in out.collect()}
    assert sorted(rows) == ["a", "b"] and rows["b"]["detour"] is None and rows["b"]["length_km"] == 0.0
    assert abs(rows["a"]["length_km"] - 3 * spatial.KM_PER_DEGREE) < 1e-6 and abs(rows["a"]["max_hop_km"] - 2 * spatial.KM_PER_DEGREE) < 1e-6
    assert abs(rows["a"]["detour"] - 1) < 1e-9 and (rows["a"]["min_lat"], rows["a"]["max_lat"], rows["a"]["n_points"]) == (0.0, 3.0, 3)


def test_samples_on_a_border_lie_on_it(spark):
    """F8: an edge's end on a border fell to either side by the last digit of a sine."""
    edges = spark.range(4000).select(F.col("id").alias("a"), F.lit(-1).cast("long").alias("b"), F.lit(120.0).alias("alon"), F.lit(15.0).alias("alat"), (120 + (F.col("id") % 97 - 48) / 10 + 0.01).alias("blon"), (15.01 + F.col("id") / 1000).alias("blat"))
    first = spatial._samples(edges, F.lit(40)).where("lon = 120.0 and lat = 15.0").select("a").distinct().count()
    assert first == 4000


def test_relocation_sql_counts_the_hops_of_each_route(spark):
    """the SQL took every route for four hops long; of addresses with many routes that is wrong."""
    import duckdb

    rows = [("93.0.0.1", 0, i, 10.0 * i, 5.0, 40.0 + 10 * i, f"h{i}") for i in range(1, 9)] + [("93.0.0.1", 0, 8, 80.0, 5.0, 500.0, "h0"), ("93.0.0.2", 0, 1, -45.0, -131.0, 5.0, "g1")]
    hops = "VALUES " + ", ".join(f"('{d}', {t}, {i}, {a}::DOUBLE, {o}::DOUBLE, {r}::DOUBLE, '{ip}')" for d, t, i, a, o, r, ip in rows)
    tail = catalog._RELOCATE[len(catalog._PLACES) :]
    sql = f"WITH pg AS (SELECT * FROM (VALUES ('93.0.0.1', 80::DOUBLE, 60::DOUBLE, true), ('93.0.0.2', 80::DOUBLE, 60::DOUBLE, true)) t(ip, lat, lon, dirty)), route_hops AS (SELECT * FROM ({hops}) t(dst_ip, traced_us, idx, lat, lon, rtt_ms, ip)){tail} SELECT ip, hlat, hip, idx, round(least(0.85::DOUBLE, 0.55::DOUBLE + 0.30::DOUBLE * (idx / n::DOUBLE)), 6) FROM moved ORDER BY ip"
    state = catalog.empty(spark, IP_GEO).select("ip", "lat", "lon", "dirty", "source").unionByName(spark.createDataFrame([("93.0.0.1", 80.0, 60.0, True, "observed"), ("93.0.0.2", 80.0, 60.0, True, "observed")], "ip string, lat double, lon double, dirty boolean, source string"))
    frame = spark.createDataFrame(rows, "dst_ip string, traced_us long, idx int, lat double, lon double, rtt_ms double, ip string")
    found = passes.relocations(state.withColumn("country", F.lit("x")), catalog.gathered(frame), catalog.HOME).orderBy("ip")
    got = [(r["ip"], r["hlat"], r["hip"], r["idx"], round(r["conf"], 6)) for r in found.collect()]
    assert duckdb.sql(sql).fetchall() == got and len(got) == 1


def test_near_links_join_what_all_pairs_join(spark):
    """pieces of the near places were found from all their pairs."""
    points = spark.range(260).select(F.col("id"), F.round((F.rand(7) * 360 - 180), 1).alias("lon"), F.round(F.rand(8) * 170 - 85, 1).alias("lat"))
    points = points.unionByName(spark.range(260, 300).select("id", F.lit(179.9).alias("lon"), (F.col("id") % 3).cast("double").alias("lat"))).localCheckpoint()
    for km in (100, 700, 1100, 1600):
        links, pairs = spatial.near_links(points, km).localCheckpoint(), spatial.within_km(points, points, km).where("a < b").localCheckpoint()
        assert links.where("km > %d or a >= b" % km).count() == 0
        of = lambda e: {(r["id"], r["component"]) for r in graph.components(points, e).collect()}
        assert of(links) == of(pairs)


def test_near_links_of_a_crowd_are_few(spark):
    crowd = spark.range(3000).select("id", (F.col("id") % 50 / 10).alias("lon"), (F.col("id") % 60 / 10).alias("lat"))
    assert spatial.near_links(crowd, 800).count() < 2 * 3000


def test_points_at_one_spot_are_not_paired(spark, tmp_path):
    """copies of a place were expanded into all pairs."""
    spark.range(300).select(F.col("id").alias("c_custkey"), F.lit(1).alias("c_nationkey")).select((F.col("c_custkey") * 180_000).alias("c_custkey"), "c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    rows = catalog_geo.points_within(spark, str(tmp_path)).collect()
    assert len(rows) == 300 and sum(r["same"] for r in rows) == 299 and {r["b"] for r in rows} == {0}


def test_pairs_of_copies_are_all_told(spark, tmp_path, monkeypatch):
    """places at one spot were no longer paired with each other, nor with what is near the spot's first place."""
    import duckdb

    monkeypatch.setattr(spatial, "SPOT_IDS", 7)
    keys = F.when(F.col("id") < 20, F.col("id") * 180_000).when(F.col("id") < 30, F.col("id") * 180_000 + 76937).otherwise(F.col("id"))
    spark.range(600).select(keys.alias("c_custkey"), F.lit(1).alias("c_nationkey")).write.parquet(f"{tmp_path}/customer.parquet")
    found = catalog_geo.points_within(spark, str(tmp_path))
    assert found.columns == ["a", "b", "dist"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = con.sql(catalog.ORACLE_SQL["points_within"]).fetchall()
    assert len(want) == 570 + 30 * 30 and sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_fan_in_over_batches_calls_no_python(spark, tmp_path):
    """each pair of destination and source was a call into a Python worker."""
    flows = spark.range(4000).select(F.col("id").alias("flow_id"), F.concat(F.lit("d"), F.col("id") % 3).alias("dst_addr"), F.when(F.col("id") % 11 > 0, F.concat(F.lit("s"), F.col("id") * F.col("id") % 97)).alias("src_addr"), (F.col("id") * 370_000).alias("recv_us"))
    fan, told = streaming.FanIn(str(tmp_path / "state"), 60, 5), []
    sink = fan.sink(lambda batch, i: told.append([tuple(r) for r in batch.collect()]))
    for i, (a, b) in enumerate([(0, 1000), (1000, 1100), (1100, 3000), (3000, 3000), (3000, 4000)]):
        batch = fan.changes(flows.where((F.col("flow_id") >= a) & (F.col("flow_id") < b)))
        assert "Python" not in batch._jdf.queryExecution().executedPlan().toString()
        sink(batch, i)
        if i == 2:  # made again
            before = sorted(told.pop())
            sink(batch, i)
            assert sorted(told[-1]) == before
    want = detect.fan_in(flows, 60, 5).select("flow_id", "dst_addr", "recv_us", "distinct_sources", "flag")
    assert sorted(r for part in told for r in part) == sorted(tuple(r) for r in want.collect())


def test_hubs_of_a_backbone_do_not_go_through_the_driver(spark):
    """what cells unfold to, and the hubs, were taken for small and broadcast; samples were dealt out one by one."""
    hubs = spark.range(400).select("id", (F.col("id") * 7919 % 900 / 100).alias("lon"), (F.col("id") * 104729 % 700 / 100).alias("lat"), F.lit(None).cast("long").alias("landmass"))
    plan = graph.neighbour_candidates(hubs, 3, "landmass")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan
    at = {r["id"]: r for r in hubs.collect()}
    edges = spark.range(399).select(F.col("id").alias("a"), (F.col("id") + F.when(F.col("id") % 9 == 0, 0).otherwise(1)).alias("b"))
    edges = spark.createDataFrame([(r["a"], r["b"], at[r["a"]]["lon"], at[r["a"]]["lat"], at[r["b"]]["lon"], at[r["b"]]["lat"]) for r in edges.collect()], "a long, b long, alon double, alat double, blon double, blat double")
    line = geo.densify(F.struct(F.col("alon").alias("lon"), F.col("alat").alias("lat")), F.struct(F.col("blon").alias("lon"), F.col("blat").alias("lat")), F.lit(40))
    grid = lambda c: geo.half_up(F.col(c) * spatial.SAMPLE_GRID) / spatial.SAMPLE_GRID
    plain = edges.select("a", "b", F.explode(line).alias("p")).select("a", "b", grid("p.lon").alias("lon"), grid("p.lat").alias("lat"))
    found = spatial._samples(edges, F.lit(40))
    assert found.exceptAll(plain).isEmpty() and plain.exceptAll(found).isEmpty()
    # two overlapping areas and a ring with a notch
    rings = [(1, 1, [(1.0, 1.0), (5.0, 1.0), (5.0, 5.0), (3.0, 2.0), (1.0, 5.0)]), (2, 2, [(4.0, 0.5), (8.0, 0.5), (8.0, 4.0), (4.0, 4.0)])]
    land = spark.createDataFrame(rings, "id long, grp long, ring array<struct<lon: double, lat: double>>")
    shares = lambda rows: {(r["a"], r["b"]): r["land"] for r in rows.collect()}
    told = shares(spatial.locate(plain, land).groupBy("a", "b").agg(F.avg(F.col("on_land").cast("double")).alias("land")))
    assert shares(spatial.edge_land_fraction(edges, land)) == told
    enough = {e for e, share in told.items() if share >= 0.85}
    assert enough and enough == {e for e, share in shares(spatial.edge_land_fraction(edges, land, 0.85)).items() if share >= 0.85}
    assert "hashpartitioning(lon" not in spatial.edge_land_fraction(edges, land)._jdf.queryExecution().executedPlan().toString()
