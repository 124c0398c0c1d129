"""G4 on graphs that join all near places of a group: shortest ways between given pairs, without writing all edges out."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.functions.geo import EARTH_KM, haversine_km
from flowlake.operators.spatial import KM_PER_DEGREE, near_links, within_km
from flowlake.plans.components import TASK_EDGES, component_labels
from flowlake.plans.lineage import cut
from flowlake.plans.shortest import paths, shortest

#: Kilometres by which a way may be shorter than the great circles between its places: edges are whole metres, so an edge may be
#: half a metre short (2,000 edges a way).
SLACK_KM = 1.0
#: How much longer than the least it can be a way is searched for at first: a share and kilometres, one after the other.
REACHES = ((0.03, 200.0), (0.25, 1500.0), (1.0, 8000.0))
#: Of so few places all are searched at once.
FEW_PLACES = 20_000
#: Places that one task searches at most, and degrees of the cells by which they are dealt to pairs (a divisor of 180).
TASK_PLACES, CELL = 500_000, 3
#: Rounds in which an end that no group holds is followed along its lines, and places these may lead over, and to, at most.
ENTRY_ROUNDS, ENTRIES = 6, 64
#: How much longer than the great circle the first ways are looked for; None: anywhere.
STRETCHES = (1.05, 1.5, None)
_SIZES = (1, 2, 3, 5, 6, 9, 10, 15, 18, 30, 45, 90)


@dataclass
class Near:
    """Edges between all hubs(id, lon, lat, grp) of one known grp that are at most ``km`` apart, of their distance to a metre;
    and lines(a, b, km), none shorter than ``least`` (1 at most) of the great circle between its ends."""

    hubs: DataFrame
    km: float
    lines: DataFrame | None = None
    least: float = 1.0


def _far(lon: str, lat: str, to: str) -> Column:
    return haversine_km(F.col(lat), F.col(lon), F.col(f"{to}lat"), F.col(f"{to}lon"))


def _metres(x: str) -> Column:
    return F.round(x, 3)


def _coarse(spots: DataFrame, near: Near, lines: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """id, node, hang (km) of every spot, and edges(a, b, km, alon, alat, blon, blat) between nodes, each of them a way that the
    graph has; nodes are joined where their spots are. The first spot of a small cell is its node, and others hang on it."""
    size = near.km / (2.5 * KM_PER_DEGREE)
    land = cut(spots.where("grp is not null").withColumns({"cx": F.floor(F.col("lon") / size), "cy": F.floor(F.col("lat") / size)}))
    nodes = cut(land.groupBy("grp", "cx", "cy").agg(F.min(F.struct("id", "lon", "lat")).alias("f")).select("grp", "cx", "cy", "f.*"))
    hung = land.join(nodes.select("grp", "cx", "cy", F.col("id").alias("node"), F.col("lon").alias("nlon"), F.col("lat").alias("nlat")), ["grp", "cx", "cy"])
    hung = hung.select("id", "node", _far("lon", "lat", "n").alias("hang"), "nlon", "nlat").withColumn("hang", _metres("hang"))
    sea = spots.where("grp is null").select("id", F.col("id").alias("node"), F.lit(0.0).alias("hang"), F.col("lon").alias("nlon"), F.col("lat").alias("nlat"))
    hung = cut(hung.unionByName(sea))
    direct = within_km(nodes, nodes, near.km, ("grp",)).where("a < b").select("a", "b", _metres("dist").alias("km"))
    # what joins the pieces, and the lines, from node to node
    more = near_links(land.select("id", "lon", "lat", "grp"), near.km, ("grp",)).select("a", "b", _metres("km").alias("km"))
    more = more if lines is None else more.unionByName(lines)
    end = lambda e: hung.select(F.col("id").alias(e), F.col("node").alias(f"n{e}"), F.col("hang").alias(f"h{e}"))
    more = more.join(end("a"), "a").join(end("b"), "b").where("na <> nb").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"), (F.col("km") + F.col("ha") + F.col("hb")).alias("km"))
    edges = direct.unionByName(more).groupBy("a", "b").agg(F.min("km").alias("km"))
    place = hung.where("id = node").select("node", "nlon", "nlat")
    at = lambda e: place.select(F.col("node").alias(e), F.col("nlon").alias(f"{e}lon"), F.col("nlat").alias(f"{e}lat"))
    return hung, cut(edges.join(at("a"), "a").join(at("b"), "b"))


def _of(key: str, id_: str) -> Column:
    """A vertex of one pair's own graph."""
    return F.struct(F.col(key).alias("k"), F.col(id_).alias("id"))


def _in_task(edges: DataFrame) -> DataFrame:
    """k, dist, ids over edges(k, s, t, a, b, km) of small graphs, each in one task, by taking the nearest vertex next."""
    kind = dict(edges.dtypes)["a"]

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        start, goal = rows["s"].iloc[0], rows["t"].iloc[0]
        beside: dict = {}
        for a, b, km in zip(rows["a"].tolist(), rows["b"].tolist(), rows["km"].tolist()):
            beside.setdefault(a, []).append((b, km))
            beside.setdefault(b, []).append((a, km))
        best, heap, done = {start: (0.0, start)}, [(0.0, start)], set()
        while heap:
            dist, at = heapq.heappop(heap)
            if at in done:
                continue
            if at == goal:
                break
            done.add(at)
            for to, km in beside.get(at, ()):
                new, old = (dist + km, at), best.get(to)
                if to not in done and (old is None or new < old):
                    best[to] = new
                    heapq.heappush(heap, (new[0], to))
        if goal not in best:
            return pd.DataFrame({"k": [], "dist": [], "ids": []}, dtype=object)
        ids = [goal]
        while ids[-1] != start:
            ids.append(best[ids[-1]][1])
        return pd.DataFrame({"k": [rows["k"].iloc[0]], "dist": [best[goal][0]], "ids": [ids[::-1]]})

    return edges.groupBy("k").applyInPandas(search, f"k long, dist double, ids array<{kind}>")


def search(edges: DataFrame, ends: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """k, dist, ids: for each of ends(k, s, t) the shortest way from s to another vertex t over its own edges(k, a, b, km), if
    there is one. Graphs of at most ``task_edges`` edges are searched in a task each, others by rounds over all of them."""
    edges = cut(edges)
    sizes = cut(edges.groupBy("k").count())
    small, large = sizes.where(F.col("count") <= task_edges).select("k"), sizes.where(F.col("count") > task_edges).select("k")
    found = _in_task(edges.join(small, "k").join(ends.select("k", "s", "t"), "k"))
    if large.isEmpty():
        return found
    own = edges.join(large, "k").select(_of("k", "a").alias("a"), _of("k", "b").alias("b"), "km")
    ends = ends.join(large, "k").select(_of("k", "s").alias("source"), _of("k", "t").alias("id"))
    tree = shortest(own, ends.select(F.col("source").alias("id")))
    far = paths(tree, ends).join(tree.select("source", "id", "dist"), ["source", "id"])
    return found.unionByName(far.select("source.k", "dist", F.transform("ids", lambda v: v["id"]).alias("ids")))


def _upper(asked: DataFrame, hung: DataFrame, edges: DataFrame, km: float) -> DataFrame:
    """asked(k, a, b, places) plus most: the length of some way from a to b; pairs that nothing joins are left out."""
    label = component_labels(edges)
    named = hung.join(label.withColumnRenamed("id", "node"), "node", "left").select("id", "node", "hang", F.coalesce("component", "node").alias("piece"))
    side = lambda e: named.select(F.col("id").alias(e), F.col("node").alias(f"n{e}"), F.col("hang").alias(f"h{e}"), F.col("piece").alias(f"p{e}"))
    left = cut(asked.join(side("a"), "a").join(side("b"), "b").where("pa = pb").drop("pa", "pb"))
    both = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "km", F.col("blon").alias("alon"), F.col("blat").alias("alat"), F.col("alon").alias("blon"), F.col("alat").alias("blat"))))
    nodes = hung.where("id = node").select(F.col("node").alias("id"), "nlon", "nlat")
    done = cut(left.where("na = nb").withColumn("most", F.col("ha") + F.col("hb")))
    left = cut(left.where("na <> nb"))
    for stretch in STRETCHES:
        if left.isEmpty():
            break
        within = left.select("k", F.col("alon").alias("slon"), F.col("alat").alias("slat"), F.col("blon").alias("tlon"), F.col("blat").alias("tlat"))
        within = within.withColumn("limit", F.lit(None).cast("double") if stretch is None else _far("slon", "slat", "t") * stretch + 2 * km)
        inside = lambda lon, lat: F.col("limit").isNull() | (_far(lon, lat, "s") + _far(lon, lat, "t") <= F.col("limit"))
        near = nodes.crossJoin(F.broadcast(within)).where(inside("nlon", "nlat")).drop("nlon", "nlat")
        own = near.withColumnRenamed("id", "a").join(both, "a").where(inside("blon", "blat")).where("a < b").select("k", "a", "b", "km")
        ways_ = search(own, left.select("k", F.col("na").alias("s"), F.col("nb").alias("t")))
        hit = cut(left.join(ways_.select("k", "dist"), "k").withColumn("most", F.col("dist") + F.col("ha") + F.col("hb")).drop("dist"))
        done = done.unionByName(hit)
        left = cut(left.join(hit.select("k"), "k", "left_anti"))
    return done.select(*asked.columns, "most")


#: What a row of a pair's places is: a place, an entry of its start or its goal, these two, or a place within their entries.
_PLACE, _FROM, _TO, _START, _GOAL, _BY_START, _BY_GOAL = range(7)


def _over_places(km: float, least: float):
    """The way of one pair over the places that it may lead over, whose near ones are looked up as they are reached; places first
    that lie best on the way to the goal. A way is told if no other can be shorter that leaves these places."""

    def gc(lat, lon, at_lat, at_lon):
        la, lb = np.radians(at_lat), np.radians(lat)
        h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin(np.radians(lon - at_lon) / 2) ** 2
        return 2 * EARTH_KM * np.arcsin(np.minimum(1.0, np.sqrt(h)))

    def run(rows: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"k": [], "dist": [], "ids": []}, dtype=object)
        if not len(rows):
            return none
        k, kind = rows["k"].iloc[0], rows["kind"].to_numpy()
        one = {what: rows[kind == what].iloc[0] for what in (_START, _GOAL)}
        limit = float(one[_START]["w"])
        places = rows[(kind != _FROM) & (kind != _TO)].drop_duplicates("id")
        lat, lon = places["lat"].to_numpy(), places["lon"].to_numpy()

        def bound(entries: int, end: int, within: int):
            own = rows[kind == entries]
            far = np.full(len(places), np.inf)
            for w, x, y in zip(own["w"], own["lon"], own["lat"]):
                far = np.minimum(far, w + least * gc(lat, lon, y, x))
            inner = places["id"].isin(rows["id"][(kind == within) | (kind == end)]).to_numpy()
            return np.where(inner, least * gc(lat, lon, one[end]["lat"], one[end]["lon"]), far), inner

        (fs, by_start), (ft, by_goal) = bound(_FROM, _START, _BY_START), bound(_TO, _GOAL, _BY_GOAL)
        kept = (fs + ft <= limit) | by_start | by_goal
        places = places[kept].assign(fs=fs[kept], ft=ft[kept]).sort_values(["grp", "lat"], na_position="last", ignore_index=True)
        ids, grp, fs, ft = pd.Index(places["id"]), places["grp"].to_numpy(dtype="float64", na_value=np.nan), places["fs"].to_numpy(), places["ft"].to_numpy()
        lat, lon, n = places["lat"].to_numpy(), places["lon"].to_numpy(), len(places)
        order = np.argsort(np.argsort(ids.to_numpy()))
        start, goal = ids.get_indexer([one[_START]["id"], one[_GOAL]["id"]])
        # lines from each place, one after the other
        a, b, w = ids.get_indexer(lines["a"]), ids.get_indexer(lines["b"]), lines["km"].to_numpy(dtype="float64")
        both = (a >= 0) & (b >= 0)
        a, b, w = a[both], b[both], w[both]
        both = np.minimum(fs[a] + ft[b], fs[b] + ft[a]) + w <= limit
        a, b, w = np.concatenate([a[both], b[both]]), np.concatenate([b[both], a[both]]), np.tile(w[both], 2)
        by = np.argsort(a, kind="stable")
        beside, length, begin = b[by], w[by], np.searchsorted(a[by], np.arange(n + 1))
        known = int(np.isfinite(grp).sum())
        first, last = np.searchsorted(grp[:known], grp[:known], "left"), np.searchsorted(grp[:known], grp[:known], "right")
        la, lo = np.radians(lat), np.radians(lon)
        unit = np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], axis=1)
        reach, cosine = km / KM_PER_DEGREE + 1e-6, np.cos(min(np.pi, km / EARTH_KM)) - 1e-9
        best, prev, most = np.full(n, np.inf), np.full(n, -1), limit
        best[start], prev[start] = 0.0, start
        heap = [(float(ft[start]), 0.0, int(start))]
        while heap:
            f, dist, u = heapq.heappop(heap)
            if f > most:
                break
            if dist > best[u]:
                continue
            to, w = beside[begin[u] : begin[u + 1]], length[begin[u] : begin[u + 1]]
            if u < known:
                low, high = first[u] + np.searchsorted(lat[first[u] : last[u]], [lat[u] - reach, lat[u] + reach])
                close = low + np.flatnonzero(unit[low:high] @ unit[u] >= cosine)
                # what is known better already needs no exact distance
                close = close[(close != u) & (best[close] >= dist)]
                d = gc(lat[close], lon[close], lat[u], lon[u])
                close, d = close[d <= km], d[d <= km]
                to, w = np.concatenate([to, close]), np.concatenate([w, np.floor(d * 1000 + 0.5) / 1000])
            new = dist + w
            better = ((new < best[to]) | ((new == best[to]) & (w > 0) & (order[u] < order[prev[to]]))) & (new + ft[to] <= most)
            for v, x in zip(to[better].tolist(), new[better].tolist()):
                if x < best[v]:
                    heapq.heappush(heap, (x + ft[v], x, v))
                if x <= best[v]:
                    best[v], prev[v] = x, u
            most = min(most, best[goal] + SLACK_KM)
        if np.isinf(best[goal]) or best[goal] > limit - SLACK_KM:
            return none
        way = [int(goal)]
        while way[-1] != start:
            way.append(int(prev[way[-1]]))
        return pd.DataFrame({"k": [k], "dist": [float(best[goal])], "ids": [[ids[v] for v in reversed(way)]]})

    return run


def _entries(ends: DataFrame, spots: DataFrame, lines: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """id, seeds(id, lon, lat, w), inner(id, lon, lat) of ends(id, lon, lat, grp): places one of which each way from the end comes
    over, with their distance from it, and those before them, the end left out; and the lines(e, a, b, km) of those before.
    An end of a group is its own; others are followed along their lines. Ends that lines lead nowhere from have no seeds."""
    point = F.struct("id", "lon", "lat", F.lit(0.0).alias("w"))
    own = lambda rows: rows.select("id", F.array(point).alias("seeds"), F.array().cast(f"array<struct<id: {dict(ends.dtypes)['id']}, lon: double, lat: double>>").alias("inner"))
    if lines is None:
        return own(ends), None
    both = lines.select("a", "b", "km").unionByName(lines.select(F.col("b").alias("a"), F.col("a").alias("b"), "km"))
    sea = spots.where("grp is null").select(F.col("id").alias("a"))
    inner = fresh = cut(ends.where("grp is null").select(F.col("id").alias("e"), F.col("id").alias("a")))
    beside = None
    for i in range(ENTRY_ROUNDS):
        step = cut(fresh.join(both, "a").select("e", "a", "b", "km"))
        beside = step if beside is None else beside.unionByName(step)
        if i + 1 < ENTRY_ROUNDS:
            many = inner.groupBy("e").count().where(F.col("count") > ENTRIES).select("e")
            fresh = step.select("e", F.col("b").alias("a")).distinct().join(sea, "a", "left_semi").join(inner, ["e", "a"], "left_anti").join(many, "e", "left_anti")
            fresh = cut(fresh.select("e", "a"))
            if fresh.isEmpty():
                break
            inner = inner.unionByName(fresh)
    kind = dict(ends.dtypes)["id"]

    def tell(rows: pd.DataFrame) -> pd.DataFrame:
        e, of = rows["e"].iloc[0], {}
        for a, b, km in zip(rows["a"].tolist(), rows["b"].tolist(), rows["km"].tolist()):
            of.setdefault(a, []).append((b, km))
        best, heap = {e: 0.0}, [(0.0, e)]
        while heap:
            dist, at = heapq.heappop(heap)
            if dist > best[at]:
                continue
            for to, km in of.get(at, ()):
                if dist + km < best.get(to, np.inf):
                    best[to] = dist + km
                    heapq.heappush(heap, (dist + km, to))
        told = [(e, v, w, v in of) for v, w in best.items() if v != e]
        if sum(not within for *_, within in told) > ENTRIES:
            told = [(e, e, 0.0, False)]
        return pd.DataFrame(told, columns=["e", "id", "w", "within"])

    told = beside.groupBy("e").applyInPandas(tell, f"e {kind}, id {kind}, w double, within boolean").join(spots.select("id", "lon", "lat"), "id")
    named = told.groupBy("e").agg(F.collect_list(F.when(~F.col("within"), F.struct("id", "lon", "lat", "w"))).alias("seeds"), F.collect_list(F.when(F.col("within"), F.struct("id", "lon", "lat"))).alias("inner"))
    at_sea = ends.where("grp is null").select("id").join(named.withColumnRenamed("e", "id"), "id", "left")
    empty = own(ends).select(F.filter("seeds", lambda _: F.lit(False)).alias("seeds"), "inner").schema
    at_sea = at_sea.select("id", *(F.coalesce(c, F.array().cast(empty[c].dataType)).alias(c) for c in ("seeds", "inner")))
    return cut(own(ends.where("grp is not null")).unionByName(at_sea)), beside


@dataclass
class _Field:
    """What the ways of pairs are searched over: spots and lines with their cells, the lines at ends that no group holds."""

    spots: DataFrame
    cells: DataFrame
    lines: DataFrame | None
    beside: DataFrame | None
    km: float
    least: float
    same: list[str]


def _field(spots: DataFrame, lines: DataFrame | None, beside: DataFrame | None, near: Near) -> _Field:
    cell = lambda df, lon, lat, x, y: df.withColumns({x: F.floor((F.col(lon) + 180) / CELL), y: F.floor((F.col(lat) + 90) / CELL)})
    same = ["grp"] if lines is None else []
    placed = spots.where("grp is not null")
    if lines is not None:
        # a way comes by a line and leaves by another where no group holds the place
        ends = lines.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").count().where("count > 1").select("id")
        placed = placed.unionByName(spots.where("grp is null").join(ends, "id", "left_semi"))
    placed = cut(cell(placed, "lon", "lat", "cx", "cy").select("id", "lon", "lat", "grp", "cx", "cy"))
    cells = cut(placed.groupBy(*same, "cx", "cy").agg(F.count("*").alias("n")))
    if lines is not None:
        at = lambda e: placed.select(F.col("id").alias(e), F.col("cx").alias(f"x{e}"), F.col("cy").alias(f"y{e}"))
        lines = cut(lines.join(at("a"), "a").join(at("b"), "b").select("a", "b", "km", "xa", "ya", "xb", "yb"))
    return _Field(placed, cells, lines, beside, near.km, near.least, same)


def _nearest_ways(asked: DataFrame, field: _Field, task_rows: int = TASK_PLACES) -> tuple[DataFrame, DataFrame]:
    """k, dist, ids of the shortest way of each of asked(k, a, b, places, seeds, limit) that is shorter than its limit; and k of the
    pairs that were not looked at, as more than ``task_rows`` places may lie on such a way. The others are searched in a task
    each."""
    kind, least = dict(field.spots.dtypes)["id"], field.least
    # no place of a cell is further from its middle
    lon, lat, radius = (F.col("cx") + 0.5) * CELL - 180, (F.col("cy") + 0.5) * CELL - 90, CELL * KM_PER_DEGREE * 0.5**0.5 + 1e-6
    bound = lambda seeds: F.array_min(F.transform(seeds, lambda s: s["w"] + least * F.greatest(F.lit(0.0), haversine_km(lat, lon, s["lat"], s["lon"]) - radius)))
    ask = asked.select("k", "sa", "sb", "limit", *([F.col("agrp").alias("_grp")] if field.same else []))
    tasks = 2 * field.spots.sparkSession.sparkContext.defaultParallelism
    met = field.cells.repartition(tasks).crossJoin(F.broadcast(ask))
    met = met.where("grp = _grp") if field.same else met
    met = met.withColumns({"ls": bound("sa"), "lt": bound("sb")}).where(F.col("ls") + F.col("lt") <= F.col("limit"))
    met = cut(met.select("k", *field.same, "cx", "cy", "n", "ls", "lt", "limit"))
    sizes = cut(asked.select("k").join(met.groupBy("k").agg(F.sum("n").alias("n")), "k", "left"))
    small, large = cut(sizes.where(F.coalesce("n", F.lit(0)) <= task_rows).select("k")), sizes.where(F.col("n") > task_rows).select("k")
    met, own = met.join(small, "k", "left_semi"), asked.join(small, "k", "left_semi")
    none, far = F.lit(None).cast("double"), F.lit(None).cast("long")
    row = lambda df, what, p, w=none, grp=far: df.select("k", p["id"].alias("id"), p["lon"].alias("lon"), p["lat"].alias("lat"), grp.alias("grp"), F.lit(what).alias("kind"), w.alias("w"))
    end = lambda e: F.struct(F.col(e).alias("id"), F.col(f"{e}lon").alias("lon"), F.col(f"{e}lat").alias("lat"))
    # ends come first, as their places are told again below
    rows = row(own, _START, end("a"), F.col("limit"), F.col("agrp").cast("long")).unionByName(row(own, _GOAL, end("b"), none, F.col("bgrp").cast("long")))
    for what, of in ((_FROM, "sa"), (_TO, "sb"), (_BY_START, "ia"), (_BY_GOAL, "ib")):
        each = own.select("k", F.explode(of).alias("p"))
        rows = rows.unionByName(row(each, what, F.col("p"), F.col("p.w") if what in (_FROM, _TO) else none))
    rows = rows.unionByName(met.select("k", *field.same, "cx", "cy").join(field.spots, [*field.same, "cx", "cy"]).select("k", "id", "lon", "lat", F.col("grp").cast("long").alias("grp"), F.lit(_PLACE).alias("kind"), none.alias("w")))
    if field.lines is None:
        drawn = own.select(F.col("k").alias("of"), "a", "b", none.alias("km")).limit(0)
    else:
        side = lambda e: met.select("k", F.col("cx").alias(f"x{e}"), F.col("cy").alias(f"y{e}"), F.col("ls").alias(f"s{e}"), F.col("lt").alias(f"t{e}"), *(["limit"] if e == "a" else []))
        drawn = field.lines.join(side("a"), ["xa", "ya"]).join(side("b"), ["k", "xb", "yb"])
        drawn = drawn.where(F.least(F.col("sa") + F.col("tb"), F.col("sb") + F.col("ta")) + F.col("km") <= F.col("limit")).select(F.col("k").alias("of"), "a", "b", "km")
        by = own.select("k", F.explode(F.array("a", "b")).alias("e"))
        drawn = drawn.unionByName(by.join(field.beside, "e").select(F.col("k").alias("of"), "a", "b", "km"))
    found = rows.groupBy("k").cogroup(drawn.groupBy("of")).applyInPandas(_over_places(field.km, least), f"k long, dist double, ids array<{kind}>")
    return cut(found), large


def _written_ways(kept: DataFrame, lines: DataFrame | None, ends: DataFrame, km: float) -> DataFrame:
    """k, dist, ids of the shortest way of each of ends(k, s, t) over its places kept(k, id, lon, lat, grp, fs, ft, limit), with all
    edges written out."""
    size = next(n for n in _SIZES if n >= min(90, km / KM_PER_DEGREE / 2))
    # both ends bring what is needed to tell whether the edge can be on the way
    point = kept.where("grp is not null").select(F.struct("id", "fs", "ft", "limit").alias("id"), "lon", "lat", "k", "grp")
    edges = within_km(point, point, km, ("k", "grp"), size).where("a.id < b.id").withColumn("km", _metres("dist"))
    edges = edges.where(F.least(F.col("a.fs") + F.col("b.ft"), F.col("b.fs") + F.col("a.ft")) + F.col("km") <= F.col("a.limit"))
    edges = edges.select("k", "a.id", F.col("b.id").alias("b"), "km").withColumnRenamed("id", "a")
    if lines is not None:
        end = lambda e: kept.select("k", F.col("id").alias(e), F.struct("fs", "ft", "limit").alias(f"_{e}"))
        drawn = end("a").join(lines, "a").join(end("b"), ["k", "b"])
        edges = edges.unionByName(drawn.where(F.least(F.col("_a.fs") + F.col("_b.ft"), F.col("_b.fs") + F.col("_a.ft")) + F.col("km") <= F.col("_a.limit")).select("k", "a", "b", "km"))
    return search(edges, ends)


def near_ways(pairs: DataFrame, near: Near) -> DataFrame:
    """source, id, dist, ids: the shortest way of each of pairs(source, id) of hubs; pairs that nothing joins are left out.

    No way is shorter than the great circles between its places, or ``near.least`` of these. So a pair is searched for over those
    places alone that a way little longer than the least can lead over, then over more; a way so found is the shortest. For
    pairs that this leaves, some way through few chosen places is found, and with it the places that a shorter one can lead
    over. Hubs of a group at one place are one vertex, as they are joined by nothing. Ties go to the smallest predecessor, as in
    shortest().
    """
    first = near.hubs.where("grp is not null").groupBy("lon", "lat", "grp").agg(F.min("id").alias("spot"))
    named = cut(near.hubs.select("id", "lon", "lat", "grp").join(first, ["lon", "lat", "grp"], "left").select("id", "lon", "lat", "grp", F.coalesce("spot", "id").alias("spot")))
    spots = cut(named.where("id = spot").select("id", "lon", "lat", "grp"))
    at = lambda e: named.select(F.col("id").alias(f"_{e}"), F.col("spot").alias(e), F.col("lon").alias(f"{e}lon"), F.col("lat").alias(f"{e}lat"), F.col("grp").alias(f"{e}grp"))
    rows = cut(pairs.select(F.col("source").alias("_a"), F.col("id").alias("_b")).distinct().join(at("a"), "_a").join(at("b"), "_b"))
    same = rows.where("a = b").select(F.col("_a").alias("source"), F.col("_b").alias("id"), F.lit(0.0).alias("dist"), F.array_distinct(F.array("_a", "_b")).alias("ids"))
    asked = rows.where("a <> b").select("a", "b", "alon", "alat", "blon", "blat", "agrp", "bgrp").distinct()
    if near.lines is None:
        asked = asked.where("agrp = bgrp")
    asked = cut(asked.withColumn("k", F.monotonically_increasing_id()))
    if asked.isEmpty():
        return same
    lines, spot = None, lambda e: named.select(F.col("id").alias(e), F.col("spot").alias(f"_{e}"))
    if near.lines is not None:
        lines = near.lines.select("a", "b", "km").join(spot("a"), "a").join(spot("b"), "b").where("_a <> _b")
        lines = cut(lines.groupBy(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).agg(F.min("km").alias("km")))
    ends = asked.select(F.col("a").alias("id"), F.col("alon").alias("lon"), F.col("alat").alias("lat"), F.col("agrp").alias("grp")).unionByName(asked.select(F.col("b").alias("id"), F.col("blon").alias("lon"), F.col("blat").alias("lat"), F.col("bgrp").alias("grp"))).distinct()
    entries, beside = _entries(cut(ends), spots, lines)
    side = lambda e: entries.select(F.col("id").alias(e), F.col("seeds").alias(f"s{e}"), F.col("inner").alias(f"i{e}"))
    left = asked.join(side("a"), "a").join(side("b"), "b")
    # an end that lines lead nowhere from is joined with those on these lines alone
    for e, to in (("a", "b"), ("b", "a")):
        left = left.where((F.size(f"s{e}") > 0) | F.exists(f"i{e}", lambda p: p["id"] == F.col(to)))  # noqa: B023 (called at once)
        left = left.withColumn(f"i{e}", F.when(F.size(f"s{e}") > 0, F.col(f"i{e}")).otherwise(F.filter(f"i{e}", lambda _: F.lit(False))))
        left = left.withColumn(f"s{e}", F.when(F.size(f"s{e}") > 0, F.col(f"s{e}")).otherwise(F.array(F.struct(F.col(e).alias("id"), F.col(f"{e}lon").alias("lon"), F.col(f"{e}lat").alias("lat"), F.lit(0.0).alias("w")))))
    sums = F.flatten(F.transform("sa", lambda p: F.transform("sb", lambda q: p["w"] + q["w"] + near.least * haversine_km(p["lat"], p["lon"], q["lat"], q["lon"]))))
    left = cut(left.withColumn("_low", F.array_min(sums)))
    field, found = _field(spots, lines, beside, near), None
    if (field.cells.agg(F.sum("n")).first()[0] or 0) <= FEW_PLACES:
        # nothing joins the pairs that were looked at and not found
        found, large = _nearest_ways(left.withColumn("limit", F.lit(float("inf"))), field)
        left = cut(left.join(large, "k", "left_semi"))
    for share, more in REACHES:
        if left.isEmpty():
            break
        hit, _ = _nearest_ways(left.withColumn("limit", F.col("_low") * (1 + share) + more), field)
        found = hit if found is None else found.unionByName(hit)
        left = cut(left.join(hit.select("k"), "k", "left_anti"))
    if not left.isEmpty():
        bounds = cut(_upper(left, *_coarse(spots, near, lines), near.km).withColumn("limit", F.col("most") + 2 * SLACK_KM))
        hit, large = _nearest_ways(bounds, field)
        found, bounds = found.unionByName(hit), cut(bounds.join(large, "k", "left_semi"))
        if not bounds.isEmpty():
            goal = bounds.select("k", F.col("alon").alias("slon"), F.col("alat").alias("slat"), F.col("blon").alias("tlon"), F.col("blat").alias("tlat"), "limit", *([F.col("agrp").alias("_grp")] if lines is None else []))
            kept = spots.crossJoin(F.broadcast(goal)).withColumns({"fs": near.least * _far("lon", "lat", "s"), "ft": near.least * _far("lon", "lat", "t")}).where(F.col("fs") + F.col("ft") <= F.col("limit"))
            kept = cut((kept.where("grp = _grp") if lines is None else kept).select("k", "id", "lon", "lat", "grp", "fs", "ft", "limit"))
            found = found.unionByName(_written_ways(kept, lines, bounds.select("k", F.col("a").alias("s"), F.col("b").alias("t")), near.km).select("k", "dist", "ids"))
    found = found.join(asked.select("k", "a", "b"), "k").drop("k")
    # the hubs asked for, at the ends
    whole = rows.join(found, ["a", "b"]).select(F.col("_a").alias("source"), F.col("_b").alias("id"), "dist", F.concat(F.array("_a"), F.slice("ids", 2, F.size("ids") - 2), F.array("_b")).alias("ids"))
    return whole.unionByName(same)


def ways(graph: DataFrame | Near, pairs: DataFrame) -> DataFrame:
    """source, id, ids of pairs(source, id) that edges(a, b, km) or near hubs join."""
    if isinstance(graph, Near):
        return near_ways(pairs, graph).drop("dist")
    # pairs of which an end has no edge need no look at the whole graph
    same = pairs.where("source = id").select("source", "id", F.array("id").alias("ids")).distinct()
    pairs = cut(pairs.where("source <> id").select("source", "id").distinct())
    ends = pairs.select(F.explode(F.array("source", "id")).alias("at")).distinct()
    met = cut(graph.select(F.explode(F.array("a", "b")).alias("at")).join(ends, "at", "left_semi").distinct())
    pairs = cut(pairs.join(met.withColumnRenamed("at", "source"), "source", "left_semi").join(met.withColumnRenamed("at", "id"), "id", "left_semi").select("source", "id"))
    if pairs.isEmpty():
        return same
    # only sources of pairs that edges join at all are sent out
    label = cut(component_labels(graph))
    of = lambda e: label.select(F.col("id").alias(e), F.col("component").alias(f"_{e}"))
    pairs = cut(pairs.join(of("source"), "source").join(of("id"), "id").where("_source = _id").select("source", "id"))
    return same.unionByName(paths(shortest(graph, pairs.select(F.col("source").alias("id")).distinct()), pairs))
