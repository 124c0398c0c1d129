"""The cable graph, the joint graph and routes over both, against plain readings of the rules."""

import heapq
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from flowlake.operators import spatial
from flowlake.plans import cables, components, graph

LINES = "line long, system long, points array<struct<lon: double, lat: double>>"
PAIRS = "key long, a struct<lon: double, lat: double>, b struct<lon: double, lat: double>"


def km(p, q):
    a = math.sin(math.radians(q[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(q[0] - p[0]) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(a)))


def random_lines(seed, n):
    rng = random.Random(seed)
    ports = [(rng.uniform(-179, 179), rng.uniform(-55, 55)) for _ in range(14)]
    rows = []
    for i in range(n):
        a, b = rng.sample(ports, 2)
        jitter = lambda p: (p[0] + rng.uniform(-0.2, 0.2), p[1] + rng.uniform(-0.2, 0.2))
        rows.append((i, i // 3, [jitter(a), ((a[0] + b[0]) / 2, (a[1] + b[1]) / 2 + 3), jitter(b)]))
    return rows


def brute_graph(lines):
    """Nodes and edges by union-find in one pass, as the docstring of cable_graph reads (no dateline, no polar lines)."""
    ends = [(i * 2 + k, s, p[0 if k == 0 else -1]) for i, s, p in lines for k in (0, 1)]
    up = {i: i for i, _, _ in ends}

    def top(u, x):
        while u[x] != x:
            x = u[x]
        return x

    for (i, _, p), (j, _, q) in itertools.combinations(ends, 2):
        if km(p, q) <= 60:
            a, b = top(up, i), top(up, j)
            up[max(a, b)] = min(a, b)
    node = {i: top(up, i) for i, _, _ in ends}
    place = {i: p for i, _, p in ends if node[i] == i}
    edges, piece = {}, {i: i for i in place}
    join = lambda a, b: piece.__setitem__(top(piece, a), top(piece, b))
    for s in sorted({s for _, s, _ in lines}):
        own = sorted(x for x in lines if x[1] == s)
        landings = []
        for i, _, p in own:
            a, b = node[i * 2], node[i * 2 + 1]
            landings += [a, b]
            if a != b:
                edges[f"line:{i}"] = (a, b, sum(km(x, y) for x, y in zip(p, p[1:])), p)
                join(a, b)
        firsts = list(dict.fromkeys(landings))
        order = {n: min(i for i, t, _ in ends if t == s and node[i] == n) for n in firsts}
        for n in firsts:
            if top(piece, n) != top(piece, firsts[0]):
                edges[f"chord:{s}:{order[n]}"] = (firsts[0], n, km(place[firsts[0]], place[n]), None)
                join(firsts[0], n)
    groups = {}
    for n in place:
        groups.setdefault(top(piece, n), []).append(n)
    main = max(groups.values(), key=lambda g: (len(g), -min(g)))
    for g in groups.values():
        if g is not main:
            d, a, b = min((km(place[x], place[y]), x, y) for x in g for y in main)
            edges[f"bridge:{min(a, b)}:{max(a, b)}"] = (min(a, b), max(a, b), d, None)
    return place, edges


def points(rows):
    return [(p["lon"], p["lat"]) for p in rows]


@pytest.fixture(scope="module")
def built(spark):
    lines = random_lines(7, 18)
    return lines, cables.cable_graph(spark.createDataFrame(lines, LINES).repartition(3))


def test_cable_graph_equals_a_plain_reading(built):
    lines, net = built
    place, edges = brute_graph(lines)
    assert {r["id"]: pytest.approx((r["lon"], r["lat"])) for r in net.vertices.collect()} == place
    got = {r["edge"]: (r["a"], r["b"], r["km"], r["points"] and points(r["points"])) for r in net.edges.collect()}
    assert got.keys() == edges.keys()
    for name, (a, b, d, p) in edges.items():
        assert got[name][:2] == (a, b) and got[name][2] == pytest.approx(d) and (got[name][3] or None) == p


def dijkstra(place, edges, start):
    near = {}
    for a, b, d, *_ in edges:
        near.setdefault(a, []).append((b, d))
        near.setdefault(b, []).append((a, d))
    dist, heap = {}, [(d, v) for v, d in start.items()]
    while heap:
        d, v = heapq.heappop(heap)
        if v not in dist:
            dist[v] = d
            for w, e in near.get(v, []):
                heapq.heappush(heap, (d + e, w))
    return dist


def test_joint_and_cable_routes_are_shortest_and_follow_their_lines(spark, built):
    lines, net = built
    place, edges = brute_graph(lines)
    rng = random.Random(9)
    hubs = {i: (rng.uniform(-170, 170), rng.uniform(-55, 55)) for i in range(25)}
    land = [(a, b, km(hubs[a], hubs[b])) for a, b in itertools.combinations(hubs, 2) if km(hubs[a], hubs[b]) < 2500]
    pairs = [(k, (rng.uniform(-170, 170), rng.uniform(-55, 55)), (rng.uniform(-170, 170), rng.uniform(-55, 55))) for k in range(8)]
    frame = spark.createDataFrame(pairs, PAIRS)
    joint = cables.joint_graph(spark.createDataFrame([(i, *p) for i, p in hubs.items()], "id long, lon double, lat double"), spark.createDataFrame(land, "a long, b long, km double"), net)
    every = {f"hub:{i}": p for i, p in hubs.items()} | {f"cable:{i}": p for i, p in place.items()}
    all_edges = [(f"hub:{a}", f"hub:{b}", d) for a, b, d in land] + [(f"cable:{a}", f"cable:{b}", d) for a, b, d, _ in edges.values()]
    for i, p in place.items():
        d, h = min((km(p, q), f"hub:{j}") for j, q in hubs.items())
        all_edges.append((f"cable:{i}", h, d))
    nearest = lambda p, of: min((km(p, q), i) for i, q in of.items())[1]
    got = {r["key"]: r for r in cables.network_routes(frame, joint).collect()}
    for k, a, b in pairs:
        dist = dijkstra(every, all_edges, {nearest(a, every): 0.0})
        want = dist.get(nearest(b, every))
        assert (k in got) == (want is not None)
        if want is not None:
            r, p = got[k], points(got[k]["points"])
            assert r["km"] == pytest.approx(want) and p[0] == a and p[-1] == b
            # the line between the ends is as long as the way
            assert sum(km(x, y) for x, y in zip(p[1:], p[2:-1])) == pytest.approx(want, rel=0.02, abs=60 * 2 * len(r["ids"]))
    assert any("cable" in i for r in got.values() for i in r["ids"]) and any("hub" in i for r in got.values() for i in r["ids"])
    access = lambda p: {i: d for i, q in place.items() if (d := km(p, q)) <= 800} or {nearest(p, place): km(p, place[nearest(p, place)])}
    got = {r["key"]: r["km"] for r in cables.cable_routes(frame, net).collect()}
    for k, a, b in pairs:
        dist = dijkstra(place, list(edges.values()), access(a))
        assert got[k] == pytest.approx(min(dist[i] + d for i, d in access(b).items() if i in dist))


def test_lines_are_stitched_at_the_dateline(spark):
    rows = [
        (0, 1, [(170.0, 10.0), (179.9, 12.0)]),
        (1, 1, [(-170.0, 20.0), (-179.9, 12.5)]),  # ends at the dateline: turned round
        (2, 1, [(179.7, 13.0), (160.0, 5.0)]),  # begins there: turned round
        (3, 1, [(-179.6, 14.2), (-150.0, 0.0)]),
        (4, 1, [(175.0, 40.0), (179.9, 45.0)]),  # no other side
        (5, 2, [(-179.9, 12.0), (-160.0, 1.0)]),  # of another system
    ]
    got = {r["line"]: points(r["points"]) for r in cables.stitch(spark.createDataFrame(rows, LINES)).collect()}
    assert got == {0: [(170.0, 10.0), (179.9, 12.0), (190.0, 20.0)], 2: [(160.0, 5.0), (179.7, 13.0), (210.0, 0.0)], 4: rows[4][2], 5: rows[5][2]}


def test_cable_graph_leaves_out_what_is_no_line(spark):
    rows = [(0, 1, [(0.0, 0.0)]), (1, 1, []), (2, 1, None), (3, 1, [(-170.0, 64.0), (-160.0, 50.0)]), (4, 1, [(0.0, 0.0), (0.1, 0.1)]), (5, 1, [(0.0, 0.0), (5.0, 5.0)]), (6, 1, [(0.0, 0.0), (5.0, 5.0)])]
    net = cables.cable_graph(spark.createDataFrame(rows, LINES))
    assert sorted((r["edge"], r["a"], r["b"]) for r in net.edges.collect()) == [("line:5", 8, 11), ("line:6", 8, 11)]
    both = {(r["a"], r["b"]): points(r["points"]) for r in cables.directed(net.edges).collect()}
    assert both == {(8, 11): [(0.0, 0.0), (5.0, 5.0)], (11, 8): [(5.0, 5.0), (0.0, 0.0)]}
    none = cables.cable_graph(spark.createDataFrame([], LINES))
    assert none.vertices.isEmpty() and none.edges.isEmpty()


@pytest.mark.parametrize("task_edges", [250_000, 1])
def test_spanning_forest_equals_taking_edges_in_order(spark, monkeypatch, task_edges):
    monkeypatch.setattr(components, "TASK_EDGES", task_edges)
    rng = random.Random(1)
    edges = [(rng.randrange(40), rng.randrange(40), k) for k in rng.sample(range(1000), 90)]
    up, want = list(range(40)), set()

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b, k in sorted(edges, key=lambda e: e[2]):
        if top(a) != top(b):
            up[top(a)] = top(b)
            want.add(k)
    got = [r["key"] for r in cables.spanning_forest(spark.createDataFrame(edges, "a long, b long, key long")).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("width", [None, 0.5, 40.0])
def test_distances_by_buckets_and_from_several_starts(spark, width):
    rng = random.Random(6)
    edges = [(rng.randrange(30), rng.randrange(30), rng.choice([0.5, 1.0, 7.0, 30.0])) for _ in range(90)]
    frame = spark.createDataFrame(edges, "a long, b long, km double")
    got = {(r["source"], r["id"]): r["dist"] for r in graph.shortest(frame, spark.createDataFrame([(0,), (7,)], "id long"), width=width).collect()}
    want = {(s, v): d for s in (0, 7) for v, d in dijkstra({}, edges, {s: 0.0}).items()}
    assert got == want
    seeds = [(-1, 3, 2.0), (-1, 4, 0.25), (-1, 4, 9.0), (-2, 5, 1.0)]
    tree = graph.shortest(frame, spark.createDataFrame(seeds, "source long, id long, dist double"), width=width)
    got = {(r["source"], r["id"]): r["dist"] for r in tree.collect()}
    assert got == {(-1, v): d for v, d in dijkstra({}, edges, {3: 2.0, 4: 0.25}).items()} | {(-2, v): d for v, d in dijkstra({}, edges, {5: 1.0}).items()}
    far = max(v for s, v in got if s == -1)
    (path,) = graph.paths(tree, spark.createDataFrame([(-1, far)], "source long, id long")).collect()
    assert path["ids"][0] in (3, 4) and path["ids"][-1] == far


@pytest.mark.parametrize("km_", [3.0, 60.0, 170.0])
def test_near_components_equal_all_pairs(spark, km_):
    rng = random.Random(3)
    places = {i: (rng.uniform(-3, 3) * km_ / 60 + 179.9, rng.uniform(-4, 4) * km_ / 60 + 50) for i in rng.sample(range(1000), 150)}
    places = {i: ((x + 180) % 360 - 180, y) for i, (x, y) in places.items()} | {2000: (10.0, 10.0), 2001: (10.0, 10.0), 2002: (0.0, 90.0)}
    up = {i: i for i in places}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(places, 2):
        if km(places[i], places[j]) <= km_:
            up[max(top(i), top(j))] = min(top(i), top(j))
    got = spatial.near_components(spark.createDataFrame([(i, *p) for i, p in places.items()], "id long, lon double, lat double"), km_)
    assert {r["id"]: r["component"] for r in got.collect()} == {i: top(i) for i in places}
    assert 5 < len({top(i) for i in places}) < 140


def test_shared_nodes_are_found_without_all_pairs_and_without_edges(spark, monkeypatch, built):
    lines, net = built
    monkeypatch.setattr(cables, "within_km", None)
    monkeypatch.setattr(cables, "bridge", None)
    _, _, nodes = cables.cable_nodes(spark.createDataFrame(lines, LINES))
    assert sorted(nodes.collect()) == sorted(net.vertices.collect())
