"""Geometry on the sphere; points are (lon, lat) in degrees, lines are arrays of struct(lon, lat)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """E16; the root is clamped at 1."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def half_up(x: Column) -> Column:
    """Rounding that takes halves up, below zero too."""
    return F.floor(x + 0.5)


def grid_cell(x: Column, degrees: float) -> Column:
    """Cell number of a coordinate."""
    return half_up(x / degrees)


def wrap_lon(lon: Column) -> Column:
    """Into -180 to 180."""
    return F.pmod(lon + 540.0, F.lit(360.0)) - 180.0


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row: lambdas are interpreted, and would compute it again wherever it stands."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unwrap(points: Column) -> Column:
    """Each longitude moved by whole turns next to the one before."""

    def moved(line: Column) -> Column:
        turn = lambda p, i: F.when(i > 0, F.floor((F.get(line, i - 1)["lon"] - p["lon"] + 180.0) / 360.0))
        # few points cross the dateline; a point is moved by all turns up to it
        crossings = F.filter(F.transform(line, lambda p, i: F.struct(i.alias("i"), turn(p, i).alias("n"))), lambda c: c["n"] != 0)
        turns = lambda all_, i: F.aggregate(all_, F.lit(0).cast("long"), lambda s, c: s + F.when(c["i"] <= i, c["n"]).otherwise(F.lit(0).cast("long")))
        return _let(crossings, lambda all_: F.transform(line, lambda p, i: F.struct((p["lon"] + 360.0 * turns(all_, i)).alias("lon"), p["lat"].alias("lat"))))

    return _let(points, moved)


def leg_steps(km: Column, step_km: float = 250.0) -> Column:
    """Steps of a leg: one each step_km, 1 to 48."""
    return F.greatest(F.lit(1), F.least(F.lit(48), half_up(km / step_km))).cast("int")


def densify(a: Column, b: Column, steps: Column) -> Column:
    """Points on the great circle from a to b, steps + 1 of them; the ends alone if they nearly coincide."""
    la, lb = F.radians(a["lat"]), F.radians(b["lat"])
    oa, ob = F.radians(a["lon"]), F.radians(b["lon"])
    angle = haversine_km(a["lat"], a["lon"], b["lat"], b["lon"]) / EARTH_KM
    ends = F.array(F.struct(a["lon"].alias("lon"), a["lat"].alias("lat")), F.struct(b["lon"].alias("lon"), b["lat"].alias("lat")))
    # what all points of a line share
    trig = {f"{f}{n}": g(x) for n, x in (("la", la), ("lb", lb), ("oa", oa), ("ob", ob)) for f, g in (("sin_", F.sin), ("cos_", F.cos))}
    shared = F.struct(angle.alias("angle"), F.sin(angle).alias("sine"), steps.alias("steps"), *(c.alias(n) for n, c in trig.items()))

    def line(k: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), k["steps"]), lambda i: F.struct((F.sin((1 - i / k["steps"]) * k["angle"]) / k["sine"]).alias("p"), (F.sin(i / k["steps"] * k["angle"]) / k["sine"]).alias("q")))
        x = lambda s: s["p"] * k["cos_la"] * k["cos_oa"] + s["q"] * k["cos_lb"] * k["cos_ob"]
        y = lambda s: s["p"] * k["cos_la"] * k["sin_oa"] + s["q"] * k["cos_lb"] * k["sin_ob"]
        z = lambda s: s["p"] * k["sin_la"] + s["q"] * k["sin_lb"]
        spots = F.transform(parts, lambda s: F.struct(x(s).alias("x"), y(s).alias("y"), z(s).alias("z")))
        at = lambda v: F.struct(F.degrees(F.atan2(v["y"], v["x"])).alias("lon"), F.degrees(F.atan2(v["z"], F.sqrt(v["x"] * v["x"] + v["y"] * v["y"]))).alias("lat"))
        return F.when(k["angle"] < 1e-6, ends).otherwise(F.transform(spots, at))

    return _let(shared, line)


def crosses_polar(points: Column) -> Column:
    """Whether any vertex is in the polar band."""
    lon = lambda p: wrap_lon(p["lon"])
    return F.exists(points, lambda p: (p["lat"] > 69) | ((p["lat"] > 60) & ((lon(p) < -60) | (lon(p) > 30))))


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Ray cast on a ring of struct(lon, lat) whose last point joins the first."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        p, q = F.get(ring, i), F.get(ring, F.pmod(i + 1, n))
        return ((p["lat"] > lat) != (q["lat"] > lat)) & (lon < (q["lon"] - p["lon"]) * (lat - p["lat"]) / F.nullif(q["lat"] - p["lat"], F.lit(0.0)) + p["lon"])

    hits = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(crosses(i), F.lit(False)))
    return F.size(hits) % 2 == 1
