"""Ways over graphs that join all near places, against the same graphs written out."""

import random

import pytest

from flowlake.plans import graph, near


def _brute(spark, hubs, km, lines):
    """Distances and ways of the whole graph, by relaxation over all its edges."""
    from flowlake.operators import spatial
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(hubs, "id long, lon double, lat double, grp long")
    grp = lambda e: rows.select(F.col("id").alias(e), F.col("grp").alias(f"g{e}"))
    edges = spatial.within_km(rows, rows, km).where("a < b").join(grp("a"), "a").join(grp("b"), "b").where("ga = gb").select("a", "b", F.round("dist", 3).alias("km"))
    cables = spark.createDataFrame(lines, "a long, b long, km double")
    return rows, cables, edges


@pytest.mark.parametrize("task", [250_000, 1])
def test_ways_among_near_places_equal_those_over_all_edges(spark, monkeypatch, task):
    """all edges between near places of a rectangle were written out."""
    monkeypatch.setattr(near._nearest_ways, "__defaults__", (task,))
    monkeypatch.setattr(near.search, "__defaults__", (task,))
    rng = random.Random(4)
    hubs = [(i, rng.uniform(-12, 12), rng.uniform(-10, 10), None) for i in range(120)]
    hubs = [(i, lon, lat, None if i % 11 == 0 else (1 if lon < -3 else 2)) for i, lon, lat, _ in hubs]
    place = {i: (lon, lat) for i, lon, lat, _ in hubs}
    from tests.test_cables import km as far

    lines = [(a, b, far(place[a], place[b]) + 1) for a, b in (rng.sample(range(120), 2) for _ in range(15))]
    rows, cables, edges = _brute(spark, hubs, 600, lines)
    pairs = [(a, b) for a in (1, 11) for b in (5, 60, 22)] + [(7, 7), (500, 1)]
    # the rounds over written edges take long, so they get fewer pairs, and no lines
    for g in (1, 2) if task > 1 else ():
        own = sorted((lat, i) for i, _, lat, grp in hubs if grp == g)
        pairs += [(own[0][1], own[-1][1]), (own[-2][1], own[1][1])]
    asked = spark.createDataFrame(pairs, "source long, id long")
    for got, whole in ((near.Near(rows, 600), edges), (near.Near(rows, 600, cables), edges.unionByName(cables)))[: 2 if task > 1 else 1]:
        want = {(r["source"], r["id"]): r["ids"] for r in near.ways(whole, asked.where("source < 500")).collect()}
        found = {(r["source"], r["id"]): r["ids"] for r in near.ways(got, asked).collect()}
        assert found == want and len(want) >= (3 if task > 1 else 2)


def test_hubs_at_one_place_are_one_vertex(spark):
    """edges of no length between copies of a hub led ways round in circles."""
    hubs = [(10 * k + i, lon, 0.0, 1) for i, lon in enumerate((0.0, 4.0, 8.0)) for k in range(3)] + [(99, 4.0, 0.0, None)]
    rows = spark.createDataFrame(hubs, "id long, lon double, lat double, grp long")
    asked = spark.createDataFrame([(20, 22), (0, 10), (0, 99), (22, 20)], "source long, id long")
    found = {(r["source"], r["id"]): r["ids"] for r in near.ways(near.Near(rows, 600), asked).collect()}
    assert found == {(20, 22): [20, 1, 22], (0, 10): [0, 10], (22, 20): [22, 1, 20]}
    vertices = rows.select("id", "lon", "lat")
    pairs = spark.createDataFrame([(1, 20, 22), (2, 0, 99)], "pair long, a long, b long")
    lines = {"land": near.Near(rows, 600), "joint": near.Near(rows, 600), "cable": spark.createDataFrame([], "a long, b long, km double")}
    got = {r["pair"]: (r["rule"], len(r["points"])) for r in graph.route_legs(pairs, lines, vertices).collect()}
    assert got[1] == ("land", 3) and got[2][0] == "circle"


def _graph(spark, rng, n=90):
    from tests.test_cables import km as far

    hubs = [(i, rng.uniform(-9, 9), rng.uniform(-8, 8), None if i % 4 == 0 else (1 if i % 2 else 2)) for i in range(n)]
    place = {i: (lon, lat) for i, lon, lat, _ in hubs}
    drawn = [(a, b, far(place[a], place[b]) + 1) for a, b in (rng.sample(range(n), 2) for _ in range(n))]
    return hubs, place, drawn


def test_ways_a_little_longer_than_the_least_need_no_bound_first(spark, monkeypatch):
    """some way was found first for every pair, over a graph of all lines, before the shortest was searched for."""
    monkeypatch.setattr(near, "_coarse", lambda *_: pytest.fail("all lines were looked at"))
    monkeypatch.setattr(near, "FEW_PLACES", 0)
    hubs, _, drawn = _graph(spark, random.Random(3))
    rows, cables, edges = _brute(spark, hubs, 300, drawn)
    lined = {x for a, b, _ in drawn for x in (a, b)}
    sea = [i for i, *_, g in hubs if g is None]
    ends = [i for i in sea if i in lined][:3] + [i for i in sea if i not in lined][:1] + [1, 2]
    asked = spark.createDataFrame([(a, b) for a in ends[:4] for b in ends[2:]], "source long, id long")
    want = {(r["source"], r["id"]): r["ids"] for r in near.ways(edges.unionByName(cables).coalesce(1), asked).collect()}
    found = {(r["source"], r["id"]): r["ids"] for r in near.ways(near.Near(rows, 300, cables), asked).collect()}
    assert found == want and len(want) > 8


def test_joint_routes_do_not_write_land_edges_out(spark):
    """all edges between near hubs were written out; lines may be shorter than great circles between their ends."""
    from pyspark.sql import functions as F

    from flowlake.plans import cables

    rng = random.Random(6)
    hubs, place, drawn = _graph(spark, rng, 60)
    rows, _, land = _brute(spark, hubs, 300, drawn)
    nodes = [(i, rng.uniform(-9, 9), rng.uniform(-8, 8)) for i in range(20)]
    from tests.test_cables import km as far

    edges = [(f"line:{i}", a, b, far(nodes[a][1:], nodes[b][1:]) * rng.uniform(0.5, 1.2)) for i, (a, b) in enumerate(rng.sample(range(20), 2) for _ in range(30))]
    frame = spark.createDataFrame(edges, "edge string, a long, b long, km double").withColumn("points", F.lit(None).cast("array<struct<lon: double, lat: double>>"))
    net = cables.Network(spark.createDataFrame(nodes, "id long, lon double, lat double"), frame)
    point = "struct<lon: double, lat: double>"
    asked = spark.createDataFrame([(k, (rng.uniform(-9, 9), rng.uniform(-8, 8)), (rng.uniform(-9, 9), rng.uniform(-8, 8))) for k in range(12)], f"key long, a {point}, b {point}")
    whole, joint = cables.joint_graph(rows, land, net), cables.joint_graph(rows, near.Near(rows, 300), net)
    assert joint.near.least < 0.9 and joint.edges.count() < 60
    want, found = ({r["key"]: (round(r["km"], 6), r["ids"], len(r["points"])) for r in cables.network_routes(asked, g).collect()} for g in (whole, joint))
    assert found == want and len(want) > 3
