"""Areas of several parts with holes as Columns: array<array<array<struct<x: double, y: double>>>>, that is parts, their rings (the outer one
first) and closed points. A point is inside when an odd number of sides lies to its right, so the direction of rings is of no matter.

A null shape has null measures and holds nothing; a shape without parts has area 0 and holds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfield.functions import geometry

SHAPE = "array<array<array<struct<x:double,y:double>>>>"


def of_ring(ring: Column) -> Column:
    """One part without holes."""
    return F.when(ring.isNotNull(), F.array(F.array(ring)))


def of(df: DataFrame, name: str = "shape") -> Column:
    """The shape of a table's rows: the column of that name, or the closed ``ring`` of a table that has only that."""
    return F.col(name) if name in df.columns else of_ring(F.col("ring"))


def rings(shape: Column) -> Column:
    return F.flatten(shape)


def holes(shape: Column) -> Column:
    return F.flatten(F.transform(shape, lambda p: F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0)))))


def points(shape: Column) -> Column:
    return F.flatten(rings(shape))


def sides(shape: Column) -> Column:
    """All sides, struct(a, b)."""
    return F.flatten(F.transform(F.filter(rings(shape), lambda r: F.size(r) > 1), geometry.segments))


def bbox(shape: Column) -> Column:
    return geometry.bbox(points(shape))


def crossings(shape: Column, y: Column) -> Column:
    """Where the sides cross a height: ``contains`` for all points on it is ``right_of`` these."""
    at = F.filter(sides(shape), lambda s: (s["a"]["y"] > y) != (s["b"]["y"] > y))
    return F.transform(at, lambda s: (s["b"]["x"] - s["a"]["x"]) * (y - s["a"]["y"]) / (s["b"]["y"] - s["a"]["y"]) + s["a"]["x"])


def right_of(crossed: Column, x: Column) -> Column:
    return F.size(F.filter(crossed, lambda c: x < c)) % 2 == 1


def _holds(its_sides: Column, x: Column, y: Column) -> Column:
    crossing = lambda s: ((s["a"]["y"] > y) != (s["b"]["y"] > y)) & (x < (s["b"]["x"] - s["a"]["x"]) * (y - s["a"]["y"]) / (s["b"]["y"] - s["a"]["y"]) + s["a"]["x"])
    return F.size(F.filter(its_sides, crossing)) % 2 == 1


def contains(shape: Column, x: Column, y: Column) -> Column:
    return _holds(sides(shape), x, y)


def _signed(part: Column) -> Column:
    """(sign, ring) of a part's rings: the outer one counts, holes are taken off."""
    return F.transform(part, lambda r, i: F.struct(F.when(i == 0, F.lit(1.0)).otherwise(F.lit(-1.0)).alias("sign"), r.alias("ring")))


def area(shape: Column) -> Column:
    """Outer rings less their holes."""
    each = F.transform(F.flatten(F.transform(shape, _signed)), lambda s: s["sign"] * F.abs(geometry.signed_area(s["ring"])))
    return F.aggregate(each, F.lit(0.0), lambda a, v: a + v)


def perimeter(shape: Column) -> Column:
    return F.aggregate(F.transform(rings(shape), geometry.length), F.lit(0.0), lambda a, v: a + v)


def centroid(shape: Column) -> Column:
    """The centre of mass; null where there is no area."""

    def weighted(s: Column) -> Column:
        weight, at = s["sign"] * F.abs(geometry.signed_area(s["ring"])), geometry.centroid(s["ring"])
        return F.struct(weight.alias("w"), at["x"].alias("x"), at["y"].alias("y"))

    each = F.filter(F.transform(F.flatten(F.transform(shape, _signed)), weighted), lambda s: s["w"] != 0)
    start = F.struct(*(F.lit(0.0).alias(c) for c in ("w", "x", "y")))
    total = F.aggregate(each, start, lambda a, s: F.struct((a["w"] + s["w"]).alias("w"), (a["x"] + s["w"] * s["x"]).alias("x"), (a["y"] + s["w"] * s["y"]).alias("y")))
    of = lambda t: F.when(t["w"] != 0, F.struct((t["x"] / t["w"]).alias("x"), (t["y"] / t["w"]).alias("y")))
    return F.transform(F.array(total), of)[0]  # the sums are bound, not made again for each use


def _cross(a: Column, b: Column) -> Column:
    return _sides_cross(sides(a), sides(b))


def _sides_cross(a: Column, b: Column) -> Column:
    return F.exists(a, lambda s: F.exists(b, lambda t: geometry.segments_cross(s["a"], s["b"], t["a"], t["b"])))


def meets(a: Column, b: Column) -> Column:
    """Whether two shapes have a point in common; one that lies in a hole of the other does not."""

    def met(s: Column) -> Column:
        vertex = F.exists(s["pa"], lambda p: _holds(s["b"], p["x"], p["y"])) | F.exists(s["pb"], lambda p: _holds(s["a"], p["x"], p["y"]))
        return vertex | _sides_cross(s["a"], s["b"])

    # Points and sides are bound once for a pair, not made again for every point of the other shape.
    bound = F.struct(points(a).alias("pa"), sides(a).alias("a"), points(b).alias("pb"), sides(b).alias("b"))
    return F.transform(F.array(bound), met)[0]


def inside(a: Column, b: Column) -> Column:
    """Whether ``b`` lies in ``a``: its points do, no sides cross, and no hole of ``a`` lies in ``b``."""
    holed = F.exists(F.flatten(holes(a)), lambda p: contains(b, p["x"], p["y"]))
    return F.forall(points(b), lambda p: contains(a, p["x"], p["y"])) & ~_cross(a, b) & ~holed


def is_valid(shape: Column) -> Column:
    """Rings are closed, have area and do not cross themselves or each other, and every hole lies in the outer ring of its part."""
    closed = F.forall(rings(shape), geometry.is_valid)
    crossing = F.exists(rings(shape), lambda r: F.exists(rings(shape), lambda q: (r != q) & F.exists(geometry.segments(r), lambda s: F.exists(geometry.segments(q), lambda t: geometry.segments_cross(s["a"], s["b"], t["a"], t["b"])))))
    placed = F.forall(shape, lambda p: F.forall(p, lambda r: (r == p[0]) | F.exists(r, lambda q: geometry.contains(p[0], q["x"], q["y"]))))
    return closed & ~crossing & placed


def from_wkt(wkt: Column) -> Column:
    """POLYGON and MULTIPOLYGON texts, EMPTY ones too; a third coordinate is left out; null for other kinds."""
    text = F.regexp_replace(F.upper(F.trim(wkt)), r"\s*([(),])\s*", "$1")
    text = F.regexp_replace(text, r"^(SRID=\d+;)?\s*", "")
    many = text.rlike(r"^MULTIPOLYGON\s*(Z|M|ZM)?\(")
    body = F.regexp_replace(text, r"^[A-Z ]*\(+|\)+$", "")
    pair = lambda p: F.struct(F.split(p, " +")[0].cast("double").alias("x"), F.split(p, " +")[1].cast("double").alias("y"))
    ring = lambda r: F.transform(F.split(r, ","), pair)
    part = lambda p: F.transform(F.split(p, r"\),\("), ring)
    parts = F.transform(F.when(many, F.split(body, r"\)\),\(\(")).otherwise(F.array(body)), part)
    empty = text.rlike(r"^(MULTI)?POLYGON\s*(Z|M|ZM)?\s*EMPTY$")
    return F.when(empty, F.array().cast(SHAPE)).when(text.rlike(r"^(MULTI)?POLYGON\s*(Z|M|ZM)?\("), parts)


def to_wkt(shape: Column) -> Column:
    """POLYGON for one part, else MULTIPOLYGON."""
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")"))
    part = lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, ring), ", "), F.lit(")"))
    many = F.concat(F.lit("MULTIPOLYGON ("), F.array_join(F.transform(shape, part), ", "), F.lit(")"))
    return F.when(F.size(shape) == 0, F.lit("POLYGON EMPTY")).when(F.size(shape) == 1, F.concat(F.lit("POLYGON "), part(shape[0]))).otherwise(many)


def from_geojson(kind: Column, coordinates: Column) -> Column:
    """Polygon and MultiPolygon geometries from their type and the JSON text of their coordinates; null for other kinds."""
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    part = lambda p: F.transform(p, lambda r: F.transform(r, point))
    one = F.from_json(coordinates, "array<array<array<double>>>")
    many = F.from_json(coordinates, "array<array<array<array<double>>>>")
    return F.when(kind == "Polygon", F.array(part(one))).when(kind == "MultiPolygon", F.transform(many, part))


def to_geojson(shape: Column) -> Column:
    """The geometry as JSON text."""
    coordinates = F.transform(shape, lambda p: F.transform(p, lambda r: F.transform(r, lambda q: F.array(q["x"], q["y"]))))
    return F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), coordinates.alias("coordinates")))


def touches_box(shape: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether a shape and a box have a point in common."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    corners = F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))
    vertex = F.exists(points(shape), lambda p: (p["x"] >= x0) & (p["x"] <= x1) & (p["y"] >= y0) & (p["y"] <= y1))
    return vertex | F.exists(corners, lambda p: contains(shape, p["x"], p["y"])) | _cross(shape, of_ring(corners))
