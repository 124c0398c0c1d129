"""The cable graph out of lines, its joint graph with land edges and backhaul, and routes drawn over both.

A network is vertices(id, lon, lat) and undirected edges(edge, a, b, km, points): ``points`` is the edge's line from a to b,
null where it is a straight hop. Ids are strings ("cable:7", "hub:12") where networks are joined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.functions.geo import crosses_polar, haversine_km, wrap_lon
from flowlake.operators.spatial import knn, near_components, within_km
from flowlake.plans.components import component_labels
from flowlake.plans.graph import bridge, paths, shortest
from flowlake.plans.lineage import cut
from flowlake.plans.near import Near, near_ways

#: Ends of lines nearer than this share a node; ends of a leg may board a cable at any node so near.
NODE_KM, BOARD_KM = 60.0, 800.0
#: Ends of lines beyond this longitude may go on at the other side, at a latitude less than this apart.
DATELINE, DATELINE_LAT = 179.5, 2.0
_POINT = "struct<lon: double, lat: double>"


@dataclass
class Network:
    """``near``: edges between vertices of one grp, which are not written out."""

    vertices: DataFrame
    edges: DataFrame
    near: Near | None = None


def line_km(points: Column) -> Column:
    """Length of a line."""
    leg = lambda i: haversine_km(F.get(points, i)["lat"], F.get(points, i)["lon"], F.get(points, i + 1)["lat"], F.get(points, i + 1)["lon"])
    return F.when(F.size(points) < 2, 0.0).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(points) - 2), F.lit(0.0), lambda s, i: s + leg(i)))


def stitch(lines: DataFrame, max_rounds: int = 50) -> DataFrame:
    """lines(line, system, points) with lines of one system that end on both sides of the dateline joined into one, whose
    longitudes go on beyond 180 and which keeps the western line's id; the eastern line's own end at the dateline is left
    out. The nearest latitudes are joined first; a line is joined once at most."""
    ends = lines.select("system", "line", F.explode(F.array(F.struct(F.lit(True).alias("head"), F.element_at("points", 1).alias("p")), F.struct(F.lit(False).alias("head"), F.element_at("points", -1).alias("p")))).alias("e"))
    ends = ends.select("system", "line", "e.head", "e.p.lon", "e.p.lat").withColumn("cell", F.floor(F.col("lat") / DATELINE_LAT))
    west = ends.where(F.col("lon") >= DATELINE).select("system", F.col("line").alias("p"), F.col("head").alias("p_head"), F.col("lat").alias("p_lat"), F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    east = ends.where(F.col("lon") <= -DATELINE).select("system", F.col("line").alias("n"), F.col("head").alias("n_head"), F.col("lat").alias("n_lat"), "cell")
    pairs = west.join(east, ["system", "cell"]).withColumn("gap", F.abs(F.col("p_lat") - F.col("n_lat"))).where((F.col("gap") < DATELINE_LAT) & (F.col("p") != F.col("n")))
    left, chosen = cut(pairs.select(F.struct("gap", "p", "n", "p_head", "n_head").alias("k"))), None
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        # pairs that are the first of both of their lines
        first = left.select("k", F.explode(F.array("k.p", "k.n")).alias("line")).groupBy("line").agg(F.min("k").alias("k"))
        now = cut(first.groupBy("k").count().where("count = 2").select("k"))
        chosen = now if chosen is None else chosen.unionByName(now)
        used = now.select(F.explode(F.array("k.p", "k.n")).alias("used"))
        left = left.join(used, F.col("k.p") == F.col("used"), "left_anti").join(used, F.col("k.n") == F.col("used"), "left_anti")
        left = cut(left)
    else:
        raise RuntimeError("lines at the dateline did not settle")
    if chosen is None:
        return lines.select("line", "system", "points")
    chosen = cut(chosen.select("k.*"))
    whole = chosen.join(lines.select(F.col("line").alias("p"), "system", F.col("points").alias("p_points")), "p").join(lines.select(F.col("line").alias("n"), F.col("points").alias("n_points")), "n")
    beyond = F.transform("n_points", lambda q: F.struct((q["lon"] + 360.0).alias("lon"), q["lat"].alias("lat")))
    a = F.when(F.col("p_head"), F.reverse("p_points")).otherwise(F.col("p_points"))
    b = F.when(F.col("n_head"), beyond).otherwise(F.reverse(beyond))
    joined = whole.select(F.col("p").alias("line"), "system", F.concat(a, F.slice(b, 2, F.size(b))).alias("points"))
    used = chosen.select(F.explode(F.array("p", "n")).alias("line"))
    return lines.select("line", "system", "points").join(used, "line", "left_anti").unionByName(joined)


def spanning_forest(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """The keys of those edges(a, b, key) that join two pieces when edges are taken in ascending order of their keys, which
    must differ: in each round every piece takes its first edge to another piece, and the pieces so joined become one."""
    left, forest = cut(edges.select("a", "b", "key").where("a <> b")), None
    for _ in range(max_rounds):
        if left.isEmpty():
            return forest if forest is not None else left.select("key")
        both = left.select(F.col("a").alias("piece"), "key").unionByName(left.select(F.col("b").alias("piece"), "key"))
        taken = cut(left.join(both.groupBy("piece").agg(F.min("key").alias("key")).select("key").distinct(), "key"))
        forest = taken.select("key") if forest is None else forest.unionByName(taken.select("key"))
        label = component_labels(taken)
        for end in ("a", "b"):
            names = label.select(F.col("id").alias(end), "component")
            left = left.join(names, end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
        left = cut(left.where("a <> b"))
    raise RuntimeError("the forest did not settle")


def cable_nodes(lines: DataFrame, km: float = NODE_KM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines as cable_graph() takes them, stitched and without those left out; their ends(id, line, system, lon, lat, node); and
    the nodes(id, lon, lat) that these share."""
    good = cut(stitch(lines.where(F.size("points") >= 2)).where(~crosses_polar(F.col("points"))))
    end = lambda k, at: good.select((F.col("line") * 2 + k).alias("id"), "line", "system", wrap_lon(F.element_at("points", at)["lon"]).alias("lon"), F.element_at("points", at)["lat"].alias("lat"))
    ends = cut(end(0, 1).unionByName(end(1, -1)))
    # equal places are one point before distances are looked at
    place = cut(ends.groupBy("lon", "lat").agg(F.min("id").alias("id")))
    named = place.join(near_components(place, km).withColumnRenamed("component", "node"), "id").select("lon", "lat", "node")
    ends = cut(ends.join(named, ["lon", "lat"]))
    return good, ends, cut(ends.where("id = node").select("id", "lon", "lat"))


def cable_graph(lines: DataFrame, km: float = NODE_KM) -> Network:
    """The network of lines(line, system, points): ids of lines are whole numbers and give their order in a system.

    Lines are stitched at the dateline; those that cross the polar band or have fewer than two points are left out. Ends
    within ``km`` share a node (the components of the distance join; a node lies at its first end). A line is an edge of
    its real length. Where a system's own and earlier lines leave it in pieces, straight chords go from its first node to the
    first node of each other piece; pieces of the whole network are then bridged by their nearest pair to the largest.
    Lines of which both ends share a node are no edges.
    """
    good, ends, nodes = cable_nodes(lines, km)
    side = lambda k, name: ends.where(F.col("id") % 2 == k).select("line", F.col("node").alias(name))
    drawn = good.join(side(0, "a"), "line").join(side(1, "b"), "line").withColumn("km", line_km(F.col("points"))).where("a <> b and km > 0")
    drawn = cut(drawn.select(F.concat(F.lit("line:"), "line").alias("edge"), "a", "b", "km", "points", "system", "line"))
    landing = ends.groupBy("system", "node").agg(F.min("id").alias("first"))
    start = landing.groupBy("system").agg(F.min_by("node", "first").alias("a"))
    chord = landing.join(start, "system").where("node <> a").select("a", F.col("node").alias("b"), F.struct("system", F.lit(1).alias("kind"), F.col("first").alias("at")).alias("key"))
    real = drawn.select("a", "b", F.struct("system", F.lit(0).alias("kind"), F.col("line").alias("at")).alias("key"))
    chord = cut(chord)
    chord = chord.join(spanning_forest(real.unionByName(chord)), "key").select(F.concat(F.lit("chord:"), "key.system", F.lit(":"), "key.at").alias("edge"), "a", "b")
    at = lambda p: nodes.select(F.col("id").alias(p), F.col("lon").alias(f"{p}lon"), F.col("lat").alias(f"{p}lat"))
    hop = haversine_km(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon"))
    chord = chord.join(at("a"), "a").join(at("b"), "b").select("edge", "a", "b", hop.alias("km"))
    straight = lambda df: df.withColumn("points", F.lit(None).cast(f"array<{_POINT}>"))
    edges = cut(drawn.select("edge", "a", "b", "km", "points").unionByName(straight(chord)))
    joined = bridge(nodes, edges.select("a", "b", "km"), always=True)
    new = joined.join(edges.select("a", "b"), ["a", "b"], "left_anti").select(F.concat_ws(":", F.lit("bridge"), "a", "b").alias("edge"), "a", "b", "km")
    return Network(nodes, edges.unionByName(straight(new)))


def joint_graph(hubs: DataFrame, land: DataFrame | Near, cables: Network) -> Network:
    """Hubs(id, lon, lat) with land edges(a, b, km), the cable network, and for each cable node one straight edge to its nearest
    hub (backhaul). Ids become "hub:..." and "cable:...". Land edges between near hubs need not be written out."""
    hub, cable = (lambda c: F.concat(F.lit("hub:"), c)), (lambda c: F.concat(F.lit("cable:"), c))
    spots = cables.vertices.select(cable("id").alias("id"), "lon", "lat")
    places = hubs.select(hub("id").alias("id"), "lon", "lat")
    straight = lambda df: df.withColumn("points", F.lit(None).cast(f"array<{_POINT}>"))
    under_sea = cables.edges.select("edge", cable("a").alias("a"), cable("b").alias("b"), "km", "points")
    backhaul = knn(spots, places, 1).select(F.concat(F.lit("backhaul:"), "id").alias("edge"), F.col("id").alias("a"), F.col("target").alias("b"), F.col("dist").alias("km"))
    if not isinstance(land, Near):
        over_land = straight(land.select(F.concat_ws(":", F.lit("land"), "a", "b").alias("edge"), hub("a").alias("a"), hub("b").alias("b"), "km"))
        return Network(places.unionByName(spots), cut(over_land.unionByName(under_sea).unionByName(straight(backhaul))))
    edges, vertices = cut(under_sea.unionByName(straight(backhaul))), places.unionByName(spots)
    grp = land.hubs.select(hub("id").alias("id"), "lon", "lat", "grp")
    # ends of a line may lie beside its nodes, so it may be shorter than the great circle between these
    at = lambda e: vertices.select(F.col("id").alias(e), F.col("lon").alias(f"{e}lon"), F.col("lat").alias(f"{e}lat"))
    circle = haversine_km(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon"))
    least = edges.join(at("a"), "a").join(at("b"), "b").select(F.min(F.when(circle > 0, F.col("km") / circle)).alias("least")).first()["least"]
    lines = edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("km").alias("km"))
    hubs_ = grp.unionByName(spots.withColumn("grp", F.lit(None).cast(dict(grp.dtypes)["grp"])))
    return Network(vertices, edges, Near(cut(hubs_), land.km, lines, min(1.0, least if least is not None else 1.0)))


def directed(edges: DataFrame) -> DataFrame:
    """a, b, km, points of the shortest edge each way (the smallest edge id where two are as short), lines turned round
    for the way back."""
    row = lambda a, b, points: edges.select(F.col(a).alias("a"), F.col(b).alias("b"), F.struct("km", "edge", points.alias("points")).alias("e"))
    both = row("a", "b", F.col("points")).unionByName(row("b", "a", F.reverse("points")))
    return both.groupBy("a", "b").agg(F.min_by("e", F.struct("e.km", "e.edge")).alias("e")).select("a", "b", "e.km", "e.points")


def _drawn(found: DataFrame, network: Network) -> DataFrame:
    """key, points: places of found(key, ids), with every edge's own line between; a hop without an edge is straight."""
    steps = found.select("key", F.posexplode(F.arrays_zip(F.slice("ids", 1, F.size("ids") - 1).alias("a"), F.slice("ids", 2, F.size("ids") - 1).alias("b"))).alias("i", "s")).select("key", "i", "s.a", "s.b")
    place = network.vertices.select(F.col("id").alias("b"), F.struct("lon", "lat").alias("p"))
    rows = steps.join(directed(network.edges).select("a", "b", "points"), ["a", "b"], "left").join(place, "b")
    # each edge gives its points but the first, which ends the edge before
    piece = F.when(F.col("points").isNull(), F.array("p")).otherwise(F.slice("points", 2, F.size("points")))
    lines = rows.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", piece.alias("piece")))), lambda s: s["piece"])).alias("rest"))
    start = found.select("key", F.col("ids")[0].alias("id")).join(network.vertices.select("id", F.struct("lon", "lat").alias("p")), "id")
    return start.join(lines, "key", "left").select("key", F.concat(F.array("p"), F.coalesce("rest", F.array().cast(f"array<{_POINT}>"))).alias("points"))


def network_routes(pairs: DataFrame, network: Network) -> DataFrame:
    """key, km, ids, points of pairs(key, a, b) of places: from the vertex nearest to a to the one nearest to b, with the places
    themselves at the ends of the line. Pairs that the network does not join are left out."""
    rows = cut(pairs.select("key", "a", "b"))
    spots = cut(rows.select(F.explode(F.array("a", "b")).alias("p")).distinct().select(F.concat_ws(",", "p.lon", "p.lat").alias("id"), "p.lon", "p.lat"))
    near = cut(knn(spots, network.vertices, 1).select("id", F.col("target")))
    side = lambda p: near.select(F.col("id").alias(f"{p}_at"), F.col("target").alias(f"{p}_id"))
    at = lambda p: F.concat_ws(",", F.col(p)["lon"], F.col(p)["lat"])
    rows = cut(rows.withColumns({"a_at": at("a"), "b_at": at("b")}).join(side("a"), "a_at").join(side("b"), "b_at").select("key", "a", "b", "a_id", "b_id"))
    asked = rows.select(F.col("a_id").alias("source"), F.col("b_id").alias("id"))
    if network.near is not None:
        ways = near_ways(asked, network.near)
    else:
        tree = shortest(network.edges, asked.select(F.col("source").alias("id")).distinct())
        ways = paths(tree, asked).join(tree.select("source", "id", "dist"), ["source", "id"])
    found = cut(rows.join(ways.select(F.col("source").alias("a_id"), F.col("id").alias("b_id"), F.col("dist").alias("km"), "ids"), ["a_id", "b_id"]))
    lines = _drawn(found.select("key", "ids"), network)
    return found.join(lines, "key").select("key", "km", "ids", F.concat(F.array("a"), "points", F.array("b")).alias("points"))


def _boards(spots: DataFrame, nodes: DataFrame, km: float) -> DataFrame:
    """id, node, access of all nodes within ``km`` of each spot, or its nearest where there is none."""
    close = within_km(spots, nodes, km).select(F.col("a").alias("id"), F.col("b").alias("node"), F.col("dist").alias("access"))
    close = cut(close)
    alone = spots.join(close.select("id"), "id", "left_anti")
    return close.unionByName(knn(alone, nodes, 1).select("id", F.col("target").alias("node"), F.col("dist").alias("access")))


def cable_routes(pairs: DataFrame, cables: Network, km: float = BOARD_KM) -> DataFrame:
    """key, km, ids, points of pairs(key, a, b) of places over cables alone. A way may board and leave at any node within
    ``km`` of its ends (else at the nearest), and the ways to and from the nodes count: the least sum is taken."""
    rows = cut(pairs.select("key", "a", "b", F.concat_ws(",", F.col("a.lon"), F.col("a.lat")).alias("a_at"), F.concat_ws(",", F.col("b.lon"), F.col("b.lat")).alias("b_at")))
    spots = cut(rows.select(F.explode(F.array("a", "b")).alias("p")).distinct().select(F.concat_ws(",", "p.lon", "p.lat").alias("id"), "p.lon", "p.lat"))
    nodes = cables.vertices.select(F.col("id").cast("string").alias("id"), "lon", "lat")
    edges = cables.edges.select("edge", F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "km", "points")
    boards = cut(_boards(spots, nodes, km))
    seeds = boards.join(rows.select(F.col("a_at").alias("id")).distinct(), "id", "left_semi").select(F.concat(F.lit("from:"), "id").alias("source"), F.col("node").alias("id"), F.col("access").alias("dist"))
    tree = shortest(edges, seeds)
    leaves = boards.select(F.col("id").alias("b_at"), F.col("node").alias("id"), "access")
    total = rows.withColumn("source", F.concat(F.lit("from:"), "a_at")).join(leaves, "b_at").join(tree.select("source", "id", "dist"), ["source", "id"])
    best = cut(total.groupBy("key", "source").agg(F.min(F.struct((F.col("dist") + F.col("access")).alias("km"), "id")).alias("best")).select("key", "source", "best.km", "best.id"))
    ways = paths(tree, best.select("source", "id"))
    found = cut(best.join(ways, ["source", "id"]).select("key", "km", "ids"))
    lines = _drawn(found, Network(nodes, edges))
    return found.join(lines, "key").join(rows.select("key", "a", "b"), "key").select("key", "km", "ids", F.concat(F.array("a"), "points", F.array("b")).alias("points"))
