"""Queries on areas with holes and parts, and on their overlay: each calls the library's operator; the oracle spells the same out."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from wayfield.facade import AreaOfInterest
from wayfield.functions import shapes
from wayfield.operators import hexcells, overlay, raster, spatial
from wayfield.plans.core import _people, _pois
from wayfield.plans.layers import NODES, PEOPLE, POIS, SIDE, layer, with_layers
from wayfield.plans.registry import query
from wayfield.plans.surfaces import GRID_CELLS, HEXES, SIZE, _homes, _pop, _squares
from wayfield.session import dealt

OUTER, HOLE, ISLAND, AWAY = 230.25, 90.25, 60.25, 400


def _square(dx: float, half: float) -> str:
    """A closed square as WKT, in Spark SQL over x and y."""
    at = lambda sx, sy: f"cast(x + {dx + sx * half}D as string), ' ', cast(y + {dx + sy * half}D as string)"
    corners = [(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)]
    return "concat('(', " + ", ', ', ".join(at(*c) for c in corners) + ", ')')"


def _holed(spark, d):
    """(poi, quality, nation, shape): a square with a square hole around each place, and a small square apart from it."""
    wkt = f"concat('MULTIPOLYGON ((', {_square(0, OUTER)}, ', ', {_square(0, HOLE)}, '), (', {_square(AWAY, ISLAND)}, '))')"
    return dealt(_pois(spark, d)).select("poi", "quality", "nation", "x", "y", shapes.from_wkt(F.expr(wkt)).alias("shape"))


def _in(x: str, y: str, half: float, dx: float = 0, px: str = "p.x", py: str = "p.y") -> str:
    """The same in SQL: whether a point is in a square about a place."""
    part = lambda v, p: f"{v} >= {p} + CAST({dx - half} AS DOUBLE) AND {v} < {p} + CAST({dx + half} AS DOUBLE)"
    return f"({part(x, px)} AND {part(y, py)})"


def _inside_sql(x: str, y: str) -> str:
    return f"(({_in(x, y, OUTER)} AND NOT {_in(x, y, HOLE)}) OR {_in(x, y, ISLAND, AWAY)})"


_A, _B = 4 * OUTER**2 - 4 * HOLE**2, 4 * ISLAND**2


@query("x10_shape_measures", with_layers(SIDE, POIS, body=f"SELECT poi, round(CAST({_A + _B!r} AS DOUBLE), 2) AS area, round(CAST({8 * (OUTER + HOLE + ISLAND)!r} AS DOUBLE), 4) AS around, round(x + CAST({AWAY * _B / (_A + _B)!r} AS DOUBLE), 3) AS cx, round(y + CAST({AWAY * _B / (_A + _B)!r} AS DOUBLE), 3) AS cy FROM pois"))
def x10_shape_measures(spark, d):
    """Area, length of all rings and centre of shapes with a hole and two parts."""
    s = F.col("shape")
    at = shapes.centroid(s)
    return _holed(spark, d).select("poi", F.round(shapes.area(s), 2).alias("area"), F.round(shapes.perimeter(s), 4).alias("around"), F.round(at["x"], 3).alias("cx"), F.round(at["y"], 3).alias("cy"))


@query("h1_shape_fill", with_layers(SIDE, POIS, HEXES, body=f"SELECT poi, q, r FROM pois p JOIN hexes ON {_inside_sql('hx', 'hy')}"))
def h1_shape_fill(spark, d):
    """Hexagons whose centre lies in the shape: not in its hole, and in either part."""
    return hexcells.fill(_holed(spark, d), "poi", SIZE, "center")


@query("j14_points_in_shapes", with_layers(SIDE, POIS, PEOPLE, body=f"SELECT poi AS aid, person AS pid FROM pois p JOIN people q ON {_inside_sql('q.x', 'q.y')}"))
def j14_points_in_shapes(spark, d):
    return spatial.points_in_rings(_holed(spark, d).select(F.col("poi").alias("aid"), "shape"), _people(spark, d).select(F.col("person").alias("pid"), "x", "y"), 460.0)


def _near(half: float, dx: float = 0) -> str:
    return f"(abs(q.x - p.x - {dx}) < CAST({half} AS DOUBLE) AND abs(q.y - p.y - {dx}) < CAST({half} AS DOUBLE))"


@query("j12_shape_overlap", with_layers(SIDE, POIS, PEOPLE, body=f"SELECT poi AS tid, person AS sid FROM pois p JOIN people q ON ({_near(OUTER + 10)} AND NOT {_near(HOLE - 10)}) OR {_near(ISLAND + 10, AWAY)}"))
def j12_shape_overlap(spark, d):
    """Homes that meet a shape; one that lies in its hole does not."""
    return hexcells.matches(_homes(spark, d), _holed(spark, d).select(F.col("poi").alias("tid"), "shape"), 500.0, "overlap")


@query("j12_shape_full", with_layers(SIDE, POIS, PEOPLE, body=f"SELECT poi AS tid, person AS sid FROM pois p JOIN people q ON ({_near(OUTER - 10)} AND NOT {_near(HOLE + 10)}) OR {_near(ISLAND - 10, AWAY)}"))
def j12_shape_full(spark, d):
    """Homes that lie in a shape wholly."""
    return hexcells.matches(_homes(spark, d), _holed(spark, d).select(F.col("poi").alias("tid"), "shape"), 500.0, "full")


@query("r2_shape_rasterize", with_layers(SIDE, POIS, GRID_CELLS, body=f"SELECT row_no, col, max(quality) AS value FROM cells JOIN pois p ON {_inside_sql('cx', 'cy')} GROUP BY 1, 2"))
def r2_shape_rasterize(spark, d):
    return raster.rasterize(_holed(spark, d), _pop(spark, d)[1], "quality", [1000, 750, 500])


#: An area of two parts; the first is concave, has slanted sides and a triangular hole.
_PARTS = [
    [[(120.5, 100.5), (1180.5, 140.5), (1010.5, 1060.5), (640.5, 520.5), (160.5, 900.5), (120.5, 100.5)], [(300.5, 250.5), (700.5, 300.5), (420.5, 480.5), (300.5, 250.5)]],
    [[(40.5, 1000.5), (500.5, 1110.5), (90.5, 1320.5), (40.5, 1000.5)]],
]
_TEXT = "MULTIPOLYGON (" + ", ".join("(" + ", ".join("(" + ", ".join(f"{x} {y}" for x, y in ring) + ")" for ring in part) + ")" for part in _PARTS) + ")"
_SIDES = [(a, b) for part in _PARTS for ring in part for a, b in zip(ring, ring[1:], strict=False)]
_ODD = " + ".join(f"CASE WHEN ({ay} > y) != ({by} > y) AND x < CAST({bx - ax} AS DOUBLE) * (y - {ay}) / {by - ay} + {ax} THEN 1 ELSE 0 END" for (ax, ay), (bx, by) in _SIDES)


@query("f1_area_clip", with_layers(SIDE, NODES, body=f"SELECT id FROM nodes WHERE ({_ODD}) % 2 = 1"))
def f1_area_clip(spark, d):
    """Street nodes in an area of two parts, one of them concave with a hole."""
    return AreaOfInterest(_TEXT).clip(layer(spark, d, SIDE, NODES, name="nodes")).select("id")


# Overlay. The oracles cut the plane at all sides of the squares (for each key) and add up the cells by what covers them.


def _cells(key: str, value: str, half: float, body: str) -> str:
    """Areas of the cells between the sides of squares about places, by the sum over ``value`` that covers them."""
    squares = f"squares AS (SELECT {key} AS key, {value} AS cls, x - CAST({half} AS DOUBLE) AS x0, x + CAST({half} AS DOUBLE) AS x1, y - CAST({half} AS DOUBLE) AS y0, y + CAST({half} AS DOUBLE) AS y1 FROM pois)"
    cut = lambda v: f"c{v} AS (SELECT key, v AS lo, lead(v) OVER (PARTITION BY key ORDER BY v) AS hi FROM (SELECT key, {v}0 AS v FROM squares UNION SELECT key, {v}1 FROM squares))"
    cells = "covered AS (SELECT key, cx.lo AS cx0, cy.lo AS cy0, (cx.hi - cx.lo) * (cy.hi - cy.lo) AS area, min(cls) AS cls, max(cls) AS top FROM cx JOIN cy USING (key) JOIN squares USING (key) WHERE x0 <= cx.lo AND x1 >= cx.hi AND y0 <= cy.lo AND y1 >= cy.hi GROUP BY ALL)"
    return with_layers(SIDE, POIS, squares, cut("x"), cut("y"), cells, body=body)


def _total(parts, *by: str):
    return parts.groupBy(*by).agg(F.round(F.sum("area"), 2).alias("area"))


@query("x9_union", _cells("CAST(nation AS VARCHAR)", "0", 230.25, "SELECT key, round(sum(area), 2) AS area FROM covered GROUP BY key"))
def x9_union(spark, d):
    """Area of the union of the squares around the places of each nation."""
    return _total(overlay.union(_squares(spark, d, 230.25).select(F.col("nation").alias("key"), "ring")), "key")


_CLASS = "CASE quality WHEN 1000 THEN 0 WHEN 750 THEN 1 ELSE 2 END"


@query("x9_overlay", _cells("''", _CLASS, 230.25, "SELECT cls, round(sum(area), 2) AS area FROM covered GROUP BY cls"))
def x9_overlay(spark, d):
    """Squares around all places, each spot given to the best quality that covers it."""
    cls = F.expr(_CLASS)
    return _total(overlay.overlay(_squares(spark, d, 230.25).select(F.lit("").alias("key"), cls.alias("cls"), "ring"), 3), "cls")


@query("x9_difference", _cells("''", "CASE WHEN nation < 12 THEN 0 ELSE 1 END", 230.25, "SELECT round(sum(area), 2) AS area FROM covered WHERE top = 0"))
def x9_difference(spark, d):
    """What the squares of some nations cover and those of the others do not."""
    squares = _squares(spark, d, 230.25).select(F.lit("").alias("key"), "nation", "ring")
    return _total(overlay.difference(squares.filter("nation < 12"), squares.filter("nation >= 12")))


@query("x9_intersection", _cells("''", "CASE WHEN nation < 12 THEN 0 ELSE 1 END", 230.25, "SELECT round(sum(area), 2) AS area FROM covered WHERE cls = 0 AND top = 1"))
def x9_intersection(spark, d):
    squares = _squares(spark, d, 230.25).select(F.lit("").alias("key"), "nation", "ring")
    return _total(overlay.intersection(squares.filter("nation < 12"), squares.filter("nation >= 12")))


_NEAR = [250.5, 500.5, 1000.5]
_LEVEL = "CASE " + " ".join(f"WHEN m < CAST({r} AS DOUBLE) THEN {k}" for k, r in enumerate(_NEAR)) + " END"


@query("t6_rings", with_layers(SIDE, POIS, PEOPLE, body=f"SELECT person AS pid, {_LEVEL} AS rank_no FROM (SELECT person, min(abs(p.x - q.x) + abs(p.y - q.y)) AS m FROM people q CROSS JOIN pois p GROUP BY person) WHERE m < CAST({_NEAR[-1]} AS DOUBLE)"))
def t6_rings(spark, d):
    """People in the rings around places, each ring without the better ones; with one segment a quarter turn a buffer is a square on its corner."""
    matrix = spark.createDataFrame([(q, r, k) for k, r in enumerate(_NEAR) for q in (500, 750, 1000)], "quality int, distance double, rank_no int")
    rings = overlay.rings_by_level(_pois(spark, d).select("quality", "x", "y"), matrix, quadrant=1)
    aid = F.concat_ws(" ", "rank_no", F.xxhash64(F.to_json("shape")))
    people = _people(spark, d).select(F.col("person").alias("pid"), "x", "y")
    return spatial.points_in_rings(rings.select(aid.alias("aid"), "shape"), people, 500.0).select("pid", F.split("aid", " ")[0].cast("int").alias("rank_no"))


_ARC = 8 * math.sin(math.pi / 8)  # the area of the polygon of 16 sides in a circle of radius 1


def _wide(half: float, by: float) -> float:
    return 4 * half**2 + 8 * half * by + _ARC * by**2 if by > 0 else 4 * (half + by) ** 2


def _buffered(by: float) -> str:
    return with_layers(SIDE, POIS, body=f"SELECT CAST(poi AS VARCHAR) AS key, round(CAST({_wide(OUTER, by) - _wide(HOLE, -by) + _wide(ISLAND, by)!r} AS DOUBLE), 1) AS area FROM pois")


def _buffer(spark, d, by):
    holed = _holed(spark, d).select(F.col("poi").alias("key"), "shape")
    return overlay.buffer(holed, by, unit=1e-6).groupBy("key").agg(F.round(F.sum("area"), 1).alias("area"))


@query("x8_widened", _buffered(20.0))
def x8_widened(spark, d):
    """Each place's shape widened by 20 m: its hole gets smaller."""
    return _buffer(spark, d, 20.0)


@query("x8_eroded", _buffered(-20.0))
def x8_eroded(spark, d):
    return _buffer(spark, d, -20.0)
