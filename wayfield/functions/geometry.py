"""Planar geometry as Columns. A line or ring is array<struct<x: double, y: double>>; WKT at the edges."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

POINTS = "array<struct<x:double,y:double>>"


def points_of(wkt: Column) -> Column:
    """Vertices of a POINT, LINESTRING or one-ring POLYGON text."""
    inner = F.regexp_replace(wkt, r"^[^(]*\(+|\)+\s*$", "")
    pair = lambda p: F.struct(F.split(F.trim(p), r"\s+")[0].cast("double").alias("x"), F.split(F.trim(p), r"\s+")[1].cast("double").alias("y"))
    return F.transform(F.split(inner, ","), pair)


def linestring(points: Column) -> Column:
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(points, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")"))


def segments(points: Column) -> Column:
    n = F.size(points)
    return F.zip_with(F.slice(points, 1, n - 1), F.slice(points, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def _norm(a: Column, b: Column) -> Column:
    return F.hypot(b["x"] - a["x"], b["y"] - a["y"])


def length(points: Column) -> Column:
    return _sum(F.transform(segments(points), lambda s: _norm(s["a"], s["b"])))


def signed_area(ring: Column) -> Column:
    """Shoelace area; positive for rings that run counter-clockwise. The ring is closed (first point = last)."""
    return _sum(F.transform(segments(ring), lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])) / 2


def centroid(ring: Column) -> Column:
    cross = lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]
    axis = lambda k: _sum(F.transform(segments(ring), lambda s: (s["a"][k] + s["b"][k]) * cross(s))) / (6 * signed_area(ring))
    return F.struct(axis("x").alias("x"), axis("y").alias("y"))


def bbox(points: Column) -> Column:
    axis = lambda k: F.transform(points, lambda p: p[k])
    return F.struct(F.array_min(axis("x")).alias("xmin"), F.array_min(axis("y")).alias("ymin"), F.array_max(axis("x")).alias("xmax"), F.array_max(axis("y")).alias("ymax"))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a closed ring holds a point: an odd number of edges lies to its right."""
    crossing = lambda s: ((s["a"]["y"] > y) != (s["b"]["y"] > y)) & (x < (s["b"]["x"] - s["a"]["x"]) * (y - s["a"]["y"]) / (s["b"]["y"] - s["a"]["y"]) + s["a"]["x"])
    return F.size(F.filter(segments(ring), crossing)) % 2 == 1


def segments_cross(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether segments ab and cd meet in a point that is inside both."""
    side = lambda p, q, r: (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])
    return (side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)


def interpolate(points: Column, distance: Column) -> Column:
    """The point at that distance along a line, clamped to its ends."""
    start = F.struct(F.lit(0.0).alias("run"), F.lit(None).cast("struct<x:double,y:double>").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        n = _norm(s["a"], s["b"])
        share = F.when(n > 0, F.least(F.greatest((distance - acc["run"]) / n, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        spot = F.struct((s["a"]["x"] + share * (s["b"]["x"] - s["a"]["x"])).alias("x"), (s["a"]["y"] + share * (s["b"]["y"] - s["a"]["y"])).alias("y"))
        return F.struct((acc["run"] + n).alias("run"), F.when(acc["at"].isNull() | (distance > acc["run"]), spot).otherwise(acc["at"]).alias("at"))

    return F.aggregate(segments(points), start, step)["at"]


def substring(points: Column, start: Column, stop: Column) -> Column:
    """The part of a line between two distances along it, clamped to its ends."""
    at = F.struct(F.lit(0.0).alias("run"), F.array().cast(POINTS).alias("inner"))

    def step(acc: Column, s: Column) -> Column:
        run = acc["run"] + _norm(s["a"], s["b"])
        return F.struct(run.alias("run"), F.when((run > start) & (run < stop), F.concat(acc["inner"], F.array(s["b"]))).otherwise(acc["inner"]).alias("inner"))

    inner = F.aggregate(segments(points), at, step)["inner"]
    return F.concat(F.array(interpolate(points, start)), inner, F.array(interpolate(points, stop)))


def project(points: Column, x: Column, y: Column) -> Column:
    """struct(d2, along): squared distance from a point to a line, and how far along it the nearest place lies."""
    start = F.struct(F.lit(0.0).alias("run"), F.lit(float("inf")).alias("d2"), F.lit(0.0).alias("along"))

    def step(acc: Column, s: Column) -> Column:
        n = _norm(s["a"], s["b"])
        dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        share = F.when(n > 0, F.least(F.greatest(((x - s["a"]["x"]) * dx + (y - s["a"]["y"]) * dy) / (n * n), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        ex, ey = s["a"]["x"] + share * dx - x, s["a"]["y"] + share * dy - y
        d2 = ex * ex + ey * ey
        return F.struct((acc["run"] + n).alias("run"), F.least(acc["d2"], d2).alias("d2"), F.when(d2 < acc["d2"], acc["run"] + share * n).otherwise(acc["along"]).alias("along"))

    out = F.aggregate(segments(points), start, step)
    return F.struct(out["d2"].alias("d2"), out["along"].alias("along"))


def circle(x: Column, y: Column, radius: float, quadrant: int = 4) -> Column:
    """Closed ring around a point, with so many segments a quadrant."""
    step = 3.141592653589793 / 2 / quadrant
    return F.transform(F.sequence(F.lit(0), F.lit(4 * quadrant)), lambda i: F.struct((x + radius * F.cos(i * step)).alias("x"), (y + radius * F.sin(i * step)).alias("y")))


def capsule(a: Column, b: Column, radius: float, quadrant: int = 4) -> Column:
    """Closed ring of what lies within ``radius`` of the segment ab, with so many segments a quarter turn."""
    step = 3.141592653589793 / 2 / quadrant
    toward = F.when((a["x"] == b["x"]) & (a["y"] == b["y"]), F.lit(0.0)).otherwise(F.atan2(b["y"] - a["y"], b["x"] - a["x"]))
    turn = lambda p, start: F.transform(F.sequence(F.lit(0), F.lit(2 * quadrant)), lambda i: F.struct((p["x"] + radius * F.cos(toward + start + i * step)).alias("x"), (p["y"] + radius * F.sin(toward + start + i * step)).alias("y")))
    ring = F.concat(turn(b, -3.141592653589793 / 2), turn(a, 3.141592653589793 / 2))
    return F.concat(ring, F.slice(ring, 1, 1))


def vertices(df, key: str, line: str):
    """(key, seq from 1, x, y, run: length so far) of every vertex of a line column."""
    w = Window.partitionBy(key).orderBy("seq")
    out = df.select(key, F.posexplode(line).alias("seq", "p")).select(key, (F.col("seq") + 1).alias("seq"), "p.x", "p.y")
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    return out.withColumn("step", step).withColumn("run", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("step")


def with_first(points: Column, x: Column, y: Column) -> Column:
    """A line that begins at x, y instead."""
    return F.concat(F.array(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))), F.slice(points, 2, F.size(points) - 1))


def with_last(points: Column, x: Column, y: Column) -> Column:
    return F.concat(F.slice(points, 1, F.size(points) - 1), F.array(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))))


def reversed_line(points: Column) -> Column:
    return F.reverse(points)


def midpoint(points: Column) -> Column:
    return interpolate(points, length(points) / 2)


def is_valid(ring: Column) -> Column:
    """A closed ring of four points or more, of some area, whose edges do not cross."""
    sides = segments(ring)
    crossing = F.exists(sides, lambda s: F.exists(sides, lambda t: segments_cross(s["a"], s["b"], t["a"], t["b"])))
    return (F.size(ring) >= 4) & (ring[0] == F.element_at(ring, -1)) & (signed_area(ring) != 0) & ~crossing


def simplified(points: Column, tolerance: float) -> Column:
    """A line without the inner vertices that are at most ``tolerance`` from the straight line between their neighbours."""
    n = F.size(points)

    def off(i: Column) -> Column:
        a, p, b = F.get(points, i - 1), F.get(points, i), F.get(points, i + 1)
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        m = F.hypot(dx, dy)
        return F.when(m > 0, F.abs(dx * (p["y"] - a["y"]) - dy * (p["x"] - a["x"])) / m).otherwise(F.hypot(p["x"] - a["x"], p["y"] - a["y"]))

    return F.filter(points, lambda p, i: (i == 0) | (i == n - 1) | (off(i) > tolerance))
