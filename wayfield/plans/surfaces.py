"""Raster, population, hexagon and polygon queries: each calls the library's operator; the oracle spells the same out."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from wayfield.functions import hexgrid
from wayfield.operators import hexcells, population, raster, snapping, spatial
from wayfield.plans.core import _edges, _nodes, _people, _pois
from wayfield.plans.layers import EDGES, NODES, PEOPLE, POIS, SIDE, layer, with_layers
from wayfield.plans.registry import query
from wayfield.session import scratch_dir
from wayfield.sources import tiff

CELL = 100
POP = f"pop AS (SELECT CAST(floor(y / {CELL}) AS BIGINT) AS row_no, CAST(floor(x / {CELL}) AS BIGINT) AS col, CAST(sum(population) AS BIGINT) AS value FROM people GROUP BY 1, 2)"


def _side(spark, d) -> int:
    """Nodes a side of the street grid, from the count of parts."""
    return layer(spark, d, SIDE, name="side").first()["n"]


def _pop(spark, d):
    n = _side(spark, d)
    return layer(spark, d, SIDE, PEOPLE, POP, name="pop"), raster.Grid(0.0, 0.0, float(CELL), float(CELL), n, n)


def _squares(spark, d, half: float):
    """Squares around places, as closed rings."""
    ring = hexcells.box(F.col("x") - half, F.col("y") - half, F.col("x") + half, F.col("y") + half)
    return _pois(spark, d).select(F.col("poi"), "quality", "nation", ring.alias("ring"))


GRID_CELLS = "cells AS (SELECT r AS row_no, c AS col, CAST(r * 100 + 50 AS DOUBLE) AS cy, CAST(c * 100 + 50 AS DOUBLE) AS cx FROM side, range(0, n) a(r), range(0, n) b(c))"


@query("r1_vectorize", with_layers(SIDE, PEOPLE, POP, body="SELECT row_no * n + col AS id, CAST(col * 100 AS DOUBLE) AS xmin, CAST(row_no * 100 AS DOUBLE) AS ymin, CAST(col * 100 + 100 AS DOUBLE) AS xmax, CAST(row_no * 100 + 100 AS DOUBLE) AS ymax, value FROM pop CROSS JOIN side"))
def r1_vectorize(spark, d):
    return raster.vectorize(*_pop(spark, d))


_OFFER = """offered AS (SELECT row_no, col, min(CASE quality WHEN 1000 THEN 0 WHEN 750 THEN 1 ELSE 2 END) AS k FROM cells JOIN pois ON cx >= x - 230 AND cx < x + 230 AND cy >= y - 230 AND cy < y + 230 GROUP BY 1, 2)"""


@query("r2_rasterize", with_layers(SIDE, POIS, GRID_CELLS, _OFFER, body="SELECT row_no, col, CASE k WHEN 0 THEN 1000 WHEN 1 THEN 750 ELSE 500 END AS value FROM offered"))
def r2_rasterize(spark, d):
    """Squares around places burnt into the cells whose centre they hold; the first listed value wins."""
    return raster.rasterize(_squares(spark, d, 230), _pop(spark, d)[1], "quality", [1000, 750, 500])


@query("r3_reproject_nearest", with_layers(SIDE, PEOPLE, POP, "target AS (SELECT r AS row_no, c AS col FROM side, range(0, CAST(ceil(n / CAST(1.6 AS DOUBLE)) AS BIGINT)) a(r), range(0, CAST(ceil(n / CAST(1.6 AS DOUBLE)) AS BIGINT)) b(c))",
                                           body="SELECT t.row_no, t.col, value FROM target t LEFT JOIN pop s ON s.row_no = CAST(floor((t.row_no + CAST(0.5 AS DOUBLE)) * 160 / 100) AS BIGINT) AND s.col = CAST(floor((t.col + CAST(0.5 AS DOUBLE)) * 160 / 100) AS BIGINT)"))
def r3_reproject_nearest(spark, d):
    """Each cell of a grid of 160 m takes the source cell under its centre."""
    cells, grid = _pop(spark, d)
    n = -(-grid.n_rows * 10 // 16)
    return raster.reproject(cells, grid, raster.Grid(0.0, 0.0, 160.0, 160.0, n, n))


@query("r4_global_grid", with_layers(SIDE, PEOPLE, POP, "g AS (SELECT CAST(ceil(n * 100 / CAST(250 AS DOUBLE)) AS BIGINT) AS k FROM side)", "target AS (SELECT r AS row_no, c AS col, (k - r) * 250 - 125 AS y, c * 250 + 125 AS x FROM g, range(0, k) a(r), range(0, k) b(c))",
                                     body="SELECT t.row_no, t.col, value FROM target t LEFT JOIN pop s ON s.row_no = CAST(floor(y / 100) AS BIGINT) AND s.col = CAST(floor(x / 100) AS BIGINT)"))
def r4_global_grid(spark, d):
    """The raster on the grid of 250 m that is anchored at 0, 0, rows running down."""
    cells, grid = _pop(spark, d)
    return raster.reproject(cells, grid, raster.global_grid(grid, 250.0))


def _focal(condition: str, count: int) -> str:
    offsets = f"offsets AS (SELECT dr, dc FROM range(-2, 3) a(dr) CROSS JOIN range(-2, 3) b(dc) WHERE {condition})"
    body = f"SELECT row_no, col, round(coalesce(s, 0) / ({count} * CAST(0.01 AS DOUBLE)), 4) AS value FROM cells LEFT JOIN (SELECT row_no + dr AS row_no, col + dc AS col, sum(value) AS s FROM pop CROSS JOIN offsets GROUP BY 1, 2) USING (row_no, col)"
    return with_layers(SIDE, PEOPLE, POP, GRID_CELLS, offsets, body=body)


@query("r5_focal_density", _focal("dr * dr + dc * dc <= 4", 13))
def r5_focal_density(spark, d):
    """Focal sum over a disk of 200 m, per km2."""
    return raster.density(*_pop(spark, d), 200).withColumn("value", F.round("value", 4))


@query("r5_focal_square", _focal("true", 25))
def r5_focal_square(spark, d):
    return raster.density(*_pop(spark, d), 200, "square").withColumn("value", F.round("value", 4))


@query("u9_mosaic", with_layers(SIDE, PEOPLE, POP, body="SELECT row_no, col, max(value) AS value FROM (SELECT * FROM pop UNION ALL SELECT row_no, col + 3, value FROM pop) GROUP BY 1, 2"))
def u9_mosaic(spark, d):
    cells, _ = _pop(spark, d)
    return raster.mosaic([cells, cells.withColumn("col", F.col("col") + 3)])


_RING = [(150.5, 120.5), (1020.5, 240.5), (860.5, 910.5), (500.5, 420.5), (130.5, 760.5), (150.5, 120.5)]
_CROSSED = " + ".join(f"CASE WHEN ({ay} > cy) != ({by} > cy) AND cx < CAST({bx - ax} AS DOUBLE) * (cy - {ay}) / {by - ay} + {ax} THEN 1 ELSE 0 END" for (ax, ay), (bx, by) in zip(_RING, _RING[1:], strict=False))


@query("s3_raster_crop", with_layers(SIDE, PEOPLE, POP, f"kept AS (SELECT * FROM (SELECT *, CAST(row_no * 100 + 50 AS DOUBLE) AS cy, CAST(col * 100 + 50 AS DOUBLE) AS cx FROM pop) WHERE ({_CROSSED}) % 2 = 1)",
                                     body="SELECT row_no - min(row_no) OVER () AS row_no, col - min(col) OVER () AS col, value FROM kept"))
def s3_raster_crop(spark, d):
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in _RING))
    return raster.crop(*_pop(spark, d), ring)[0]


def _to_segment(x: str, y: str) -> str:
    t = f"CASE WHEN nn > 0 THEN least(greatest((({x} - ax) * dx + ({y} - ay) * dy) / nn, 0), 1) ELSE 0 END"
    return f"power(ax + ({t}) * dx - ({x}), 2) + power(ay + ({t}) * dy - ({y}), 2)"


_TO_BOX = [f"power(greatest(x0 - {p}x, {p}x - x1, 0), 2) + power(greatest(y0 - {p}y, {p}y - y1, 0), 2)" for p in "ab"]
_TURN = [f"(dx * ({y} - ay) - dy * ({x} - ax))" for x in ("x0", "x1") for y in ("y0", "y1")]
STREETS = "streets AS (SELECT u, v, len, CAST(a.x AS DOUBLE) AS ax, CAST(a.y AS DOUBLE) AS ay, CAST(b.x AS DOUBLE) AS bx, CAST(b.y AS DOUBLE) AS by_, CAST(b.x - a.x AS DOUBLE) AS dx, CAST(b.y - a.y AS DOUBLE) AS dy, CAST((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) AS DOUBLE) AS nn FROM edges JOIN nodes a ON a.id = u JOIN nodes b ON b.id = v)"
TOUCHED = f"""near AS (SELECT row_no, col, s.*, cx - 50 AS x0, cx + 50 AS x1, cy - 50 AS y0, cy + 50 AS y1 FROM cells JOIN (SELECT *, by_ AS "by" FROM streets) s
  ON cx - 50 <= greatest(ax, bx) + 30 AND cx + 50 >= least(ax, bx) - 30 AND cy - 50 <= greatest(ay, by_) + 30 AND cy + 50 >= least(ay, by_) - 30),
touched AS (SELECT DISTINCT row_no, col FROM near WHERE CASE WHEN greatest(ax, bx) >= x0 AND least(ax, bx) <= x1 AND greatest(ay, "by") >= y0 AND least(ay, "by") <= y1
  AND NOT (greatest({", ".join(_TURN)}) < 0 OR least({", ".join(_TURN)}) > 0) THEN 0
  ELSE least({", ".join(_to_segment(x, y) for x in ("x0", "x1") for y in ("y0", "y1"))}, {", ".join(_TO_BOX).replace("by", '"by"')}) END <= 100)"""


@query("n1_filter_by_streets", with_layers(SIDE, NODES, EDGES, PEOPLE, POP, GRID_CELLS, STREETS, TOUCHED,
                                           body="SELECT row_no, col, round(value * (SELECT sum(value) FROM pop) / CAST(sum(value) OVER () AS DOUBLE), 4) AS value FROM pop JOIN touched USING (row_no, col) WHERE value > 50000"))
def n1_filter_by_streets(spark, d):
    """Cells over 50,000 that streets widened by 10 m touch, scaled to the total of all."""
    cells, grid = _pop(spark, d)
    ends = snapping.with_ends(_edges(spark, d), _nodes(spark, d))
    return population.filter_by_streets(cells, grid, ends, 10.0, 50000).withColumn("value", F.round("value", 4))


@query("n2_area_density", with_layers(SIDE, PEOPLE, body="SELECT nation, round(sum(population) / CAST(nation + 1 AS DOUBLE), 4) AS density FROM people GROUP BY nation"))
def n2_area_density(spark, d):
    areas = _people(spark, d).groupBy("nation").agg(F.sum("population").cast("string").alias("population")).withColumn("km2", (F.col("nation") + 1).cast("double"))
    return population.area_density(areas, "population", "km2").select("nation", F.round("density", 4).alias("density"))


LABELS = ["A", "B", "C"]
_WIDE = """wide AS (SELECT DISTINCT CAST((nation % 4 + 1) * 5000 AS DOUBLE) AS density, CASE nation % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'B' ELSE 'A' END AS l0,
  CASE nation % 4 WHEN 1 THEN 'C' WHEN 2 THEN 'B' WHEN 3 THEN 'A' END AS l1, CASE nation % 4 WHEN 2 THEN 'C' WHEN 3 THEN 'B' END AS l2 FROM people)"""


@query("n3_processing_order", with_layers(SIDE, PEOPLE, _WIDE, body="""SELECT density, CAST(b AS DOUBLE) AS distance, l AS label, CASE l WHEN 'A' THEN 0 WHEN 'B' THEN 1 ELSE 2 END AS importance
FROM (SELECT density, 0 AS b, l0 AS l FROM wide UNION ALL SELECT density, 100, l1 FROM wide UNION ALL SELECT density, 200, l2 FROM wide) WHERE l IS NOT NULL"""))
def n3_processing_order(spark, d):
    """A wide matrix of labels by density and distance, from people's nations, as rows in the order in which they are looked at."""
    k = F.col("nation") % 4
    pick = lambda **labels: reduce(lambda a, v: a.when(k == int(v[0][1:]), v[1]), list(labels.items())[1:], F.when(k == int(next(iter(labels))[1:]), next(iter(labels.values()))))
    columns = {"0": pick(k0="C", k1="B", k2="A", k3="A"), "100": pick(k1="C", k2="B", k3="A"), "200": pick(k2="C", k3="B")}
    wide = _people(spark, d).select(((k + 1) * 5000).cast("double").alias("density"), *(v.alias(c) for c, v in columns.items())).distinct()
    return population.processing_order(wide, LABELS)


_THRESHOLDS = [(0.0, 60_000_000.0, "A"), (100.0, 40_000_000.0, "A"), (0.0, 20_000_000.0, "B"), (200.0, 10_000_000.0, "C")]


def _density_sql(name: str, radius: int) -> str:
    n = raster.kernel_size(radius)
    return f"{name} AS (SELECT row_no, col, coalesce(s, 0) / ({n} * CAST(0.01 AS DOUBLE)) AS v FROM cells LEFT JOIN (SELECT row_no + dr AS row_no, col + dc AS col, sum(value) AS s FROM pop CROSS JOIN (SELECT dr, dc FROM range(-2, 3) a(dr) CROSS JOIN range(-2, 3) b(dc) WHERE dr * dr + dc * dc <= {radius * radius}) GROUP BY 1, 2) USING (row_no, col))"


_LEVELS = (
    SIDE, PEOPLE, POIS, POP, GRID_CELLS, _OFFER, _density_sql("b0", 0), _density_sql("b1", 1), _density_sql("b2", 2),
    """levels AS (SELECT row_no, col, CASE WHEN d0 > 60000000 OR least(d0, d1) > 40000000 THEN 0 WHEN d0 > 20000000 THEN 1 WHEN least(d0, d1, d2) > 10000000 THEN 2 ELSE 3 END AS demand, coalesce(k, 3) AS offer FROM
  (SELECT row_no, col, b0.v AS d0, b1.v AS d1, b2.v AS d2 FROM b0 JOIN b1 USING (row_no, col) JOIN b2 USING (row_no, col)) LEFT JOIN offered USING (row_no, col))""",
)


def _levels(spark, d):
    cells, grid = _pop(spark, d)
    named = _squares(spark, d, 230).withColumn("label", F.when(F.col("quality") == 1000, "A").when(F.col("quality") == 750, "B").otherwise("C"))
    offer = raster.rasterize(named, grid, "label", LABELS)
    return population.level_of_service(cells, grid, offer, _THRESHOLDS, LABELS), cells


@query("n4_level_of_service", with_layers(*_LEVELS, body="SELECT row_no, col, demand, offer, demand - offer AS difference FROM levels"))
def n4_level_of_service(spark, d):
    """Demand from densities over three buffers, offer from squares around places, and their difference."""
    return _levels(spark, d)[0].select("row_no", "col", "demand", "offer", "difference")


@query("a15_service_statistics", with_layers(*_LEVELS, body="""SELECT 'under-served %' AS level, round(sum(CASE WHEN demand < offer THEN value ELSE 0 END) * CAST(100 AS DOUBLE) / sum(value), 4) AS value FROM levels JOIN pop USING (row_no, col)
UNION ALL SELECT CASE offer WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'No Service' END, CAST(sum(value) AS DOUBLE) FROM levels JOIN pop USING (row_no, col) GROUP BY 1"""))
def a15_service_statistics(spark, d):
    under, by_level = population.service_statistics(*_levels(spark, d), LABELS)
    first = under.select(F.lit("under-served %").alias("level"), F.round("percent", 4).alias("value"))
    return first.union(by_level.select("level", F.col("population").cast("double")))


SIZE = 264.0
HEXES = f"hexes AS (SELECT q, r, CAST({SIZE} AS DOUBLE) * (CAST({hexgrid.ROOT3!r} AS DOUBLE) * q + CAST({hexgrid.ROOT3 / 2!r} AS DOUBLE) * r) AS hx, CAST({SIZE * 1.5} AS DOUBLE) * r AS hy FROM side, range(-4, CAST(n * 100 / 396 + 4 AS BIGINT)) a(r), range(-CAST(n AS BIGINT) - 8, CAST(n AS BIGINT) + 8) b(q))"
FILLED = "filled AS (SELECT poi, quality, nation, q, r FROM pois JOIN hexes ON hx >= x - 400 AND hx < x + 400 AND hy >= y - 400 AND hy < y + 400)"


@query("h1_hex_fill", with_layers(SIDE, POIS, HEXES, FILLED, body="SELECT poi, q, r FROM filled"))
def h1_hex_fill(spark, d):
    """Hexagons whose centre lies in the square around a place."""
    return hexcells.fill(_squares(spark, d, 400), "poi", SIZE, "center")


@query("h2_hex_centroid", with_layers(SIDE, POIS, body="SELECT poi, {0} AS q, {1} AS r FROM pois".format(*hexgrid.cell_sql("x", "y", SIZE))))
def h2_hex_centroid(spark, d):
    return hexcells.fill(_squares(spark, d, 37), "poi", SIZE, "centroid")


def _listed(spark, d):
    squares = _squares(spark, d, 400).withColumn("segment", F.when(F.col("nation") < 8, "low").when(F.col("nation") < 16, "middle"))
    lists = hexcells.fill(squares, "poi", SIZE, "center").groupBy("poi").agg(F.collect_list(hexcells.cell_id(F.col("q"), F.col("r"))).alias("cells"))
    return squares.join(lists, "poi")


@query("a1_hex_aggregate", with_layers(SIDE, POIS, HEXES, FILLED, "shared AS (SELECT *, CASE WHEN nation < 8 THEN 0 WHEN nation < 16 THEN 1 END AS seg, quality / CAST(count(*) OVER (PARTITION BY poi) AS DOUBLE) AS share FROM filled)",
                                       body="SELECT q, r, round(sum(share), 6) AS quality, max(nation) AS nation, CASE min(seg) WHEN 0 THEN 'low' WHEN 1 THEN 'middle' END AS segment, arg_min(poi, poi) AS poi FROM shared GROUP BY q, r"))
def a1_hex_aggregate(spark, d):
    """Shares that keep the total, a maximum, the first of ordered labels and the first place per hexagon."""
    rows = _listed(spark, d).withColumn("place", F.col("poi"))
    out = hexcells.aggregate(rows, "cells", {"quality": "distribute", "nation": "max", "segment": "min", "poi": "first"}, {"segment": ["low", "middle"]}, "place")
    q, r = hexcells.from_cell_id(F.col("cell"))
    return out.select(q.alias("q"), r.alias("r"), F.round("quality", 6).alias("quality"), "nation", "segment", "poi")


@query("a1_hex_density", with_layers(SIDE, POIS, HEXES, FILLED, f"m AS (SELECT q, r, avg(quality / CAST(0.64 AS DOUBLE)) * CAST({hexcells.hex_area_km2(SIZE)!r} AS DOUBLE) AS v FROM filled GROUP BY q, r)",
                                     body="SELECT q, r, round(v * (SELECT sum(quality) FROM (SELECT DISTINCT poi, quality FROM filled)) / sum(v) OVER (), 4) AS quality FROM m"))
def a1_hex_density(spark, d):
    """Mean density times the hexagon's area, scaled so that the total of all places stays."""
    rows = _listed(spark, d).withColumn("km2", F.lit(0.64))
    out = hexcells.aggregate(rows, "cells", {"quality": "density"}, cell_area=hexcells.hex_area_km2(SIZE), area="km2")
    q, r = hexcells.from_cell_id(F.col("cell"))
    return out.select(q.alias("q"), r.alias("r"), F.round("quality", 4).alias("quality"))


@query("h4_hex_from_raster", with_layers(SIDE, PEOPLE, POP, HEXES, "s AS (SELECT row_no, col, value / CAST(count(*) OVER (PARTITION BY row_no, col) AS DOUBLE) AS share, q, r FROM pop JOIN hexes ON hx >= col * 100 - 300 AND hx < col * 100 + 400 AND hy >= row_no * 100 - 300 AND hy < row_no * 100 + 400)",
                                         body="SELECT q, r, round(sum(share), 4) AS value FROM s GROUP BY q, r"))
def h4_hex_from_raster(spark, d):
    """Raster cells widened to 700 m, shared among the hexagons whose centre they hold."""
    boxes = raster.vectorize(*_pop(spark, d))
    wide = boxes.withColumns({c: F.col(c) + (300 if c.endswith("max") else -300) for c in ("xmin", "ymin", "xmax", "ymax")})
    return hexcells.from_raster(wide, SIZE, contain="center").withColumn("value", F.round("value", 4))


@query("j2_hex_outer_join", with_layers(SIDE, PEOPLE, POIS, "a AS (SELECT {0} AS q, {1} AS r, CAST(sum(population) AS BIGINT) AS population FROM people GROUP BY 1, 2)".format(*hexgrid.cell_sql("x", "y", SIZE)), "b AS (SELECT {0} AS q, {1} AS r, count(*) AS n_pois FROM pois GROUP BY 1, 2)".format(*hexgrid.cell_sql("x", "y", SIZE)),
                                        body="SELECT q, r, population, n_pois FROM a FULL JOIN b USING (q, r)"))
def j2_hex_outer_join(spark, d):
    """Population and places per hexagon, hexagons of either kept."""
    cell = hexgrid.cell(F.col("x"), F.col("y"), SIZE)
    people = _people(spark, d).groupBy(cell.alias("c")).agg(F.sum("population").alias("population"))
    places = _pois(spark, d).groupBy(cell.alias("c")).agg(F.count("*").alias("n_pois"))
    return people.join(places, "c", "full").select("c.q", "c.r", "population", "n_pois")


def _blocks(spark, d):
    """Squares of 500 m whose borders no whole number meets."""
    n = _side(spark, d)
    k = n * 100 // 500 + 1
    cells = spark.range(k * k).select(F.col("id").alias("tid"), (F.floor(F.col("id") / k) * 500 - 0.5).alias("y"), ((F.col("id") % k) * 500 - 0.5).alias("x"))
    return cells.select("tid", hexcells.box(F.col("x"), F.col("y"), F.col("x") + 500, F.col("y") + 500).alias("ring"))


_TID = "CAST(floor(y / 500) AS BIGINT) * (SELECT n * 100 // 500 + 1 FROM side) + CAST(floor(x / 500) AS BIGINT)"


def _homes(spark, d):
    ring = hexcells.box(F.col("x") - 10, F.col("y") - 10, F.col("x") + 10, F.col("y") + 10)
    return _people(spark, d).select(F.col("person").alias("sid"), "population", "segment", ring.alias("ring"))


@query("a3_polygon_resample", with_layers(SIDE, PEOPLE, "blocks AS (SELECT unnest(range(0, (n * 100 // 500 + 1) * (n * 100 // 500 + 1))) AS tid FROM side)", f"s AS (SELECT {_TID} AS tid, CAST(sum(population) AS BIGINT) AS population, count(segment) AS segment FROM people GROUP BY 1)",
                                          body="SELECT CAST(tid AS BIGINT) AS tid, population, segment FROM blocks LEFT JOIN s USING (tid)"))
def a3_polygon_resample(spark, d):
    """People's homes into blocks by their centroids; blocks without any stay."""
    return hexcells.resample(_homes(spark, d), _blocks(spark, d), 500.0, {"population": "sum", "segment": "count"})


@query("j12_overlap", with_layers(SIDE, PEOPLE, "blocks AS (SELECT r * (n * 100 // 500 + 1) + c AS tid, r * 500 - CAST(0.5 AS DOUBLE) AS y0, c * 500 - CAST(0.5 AS DOUBLE) AS x0 FROM side, range(0, n * 100 // 500 + 1) a(r), range(0, n * 100 // 500 + 1) b(c))",
                                  body="SELECT tid, person AS sid FROM people JOIN blocks ON x + 10 > x0 AND x - 10 < x0 + 500 AND y + 10 > y0 AND y - 10 < y0 + 500"))
def j12_overlap(spark, d):
    return hexcells.matches(_homes(spark, d), _blocks(spark, d), 500.0, "overlap")


@query("j15_parents", with_layers(SIDE, PEOPLE, f"s AS (SELECT person AS sid, {_TID} AS tid FROM people)", body="SELECT sid, tid, count(*) OVER (PARTITION BY tid) AS n_children FROM s"))
def j15_parents(spark, d):
    return hexcells.parents(_homes(spark, d), _blocks(spark, d), 500.0).select("sid", "tid", "n_children")


@query("j13_rings_that_meet", with_layers(SIDE, POIS, body="SELECT a.poi AS aid, b.poi AS bid FROM pois a JOIN pois b ON abs(a.x - b.x) < CAST(300.5 AS DOUBLE) AND abs(a.y - b.y) < CAST(300.5 AS DOUBLE)"))
def j13_rings_that_meet(spark, d):
    a, b = _squares(spark, d, 200.25), _squares(spark, d, 100.25)
    return spatial.pairs_that_meet(a.select(F.col("poi").alias("aid"), "ring"), b.select(F.col("poi").alias("bid"), "ring"), 400.0)


@query("j14_points_in_rings", with_layers(SIDE, POIS, PEOPLE, body="SELECT poi AS aid, person AS pid FROM pois p JOIN people q ON q.x >= p.x - 230 AND q.x < p.x + 230 AND q.y >= p.y - 230 AND q.y < p.y + 230"))
def j14_points_in_rings(spark, d):
    return spatial.points_in_rings(_squares(spark, d, 230).select(F.col("poi").alias("aid"), "ring"), _people(spark, d).select(F.col("person").alias("pid"), "x", "y"), 460.0)


@query("s2_tiled_raster", with_layers(SIDE, PEOPLE, POP, body="SELECT row_no, col, CAST(value AS DOUBLE) AS value FROM pop"))
def s2_tiled_raster(spark, d):
    """Population as four TIFF files side by side, written in tiles, read back as one raster."""
    cells, grid = _pop(spark, d)
    half = -(-grid.n_rows // 2)
    folder = f"{scratch_dir(spark)}/tiff-{uuid.uuid4().hex}"
    for i, j in ((0, 0), (0, 1), (1, 0), (1, 1)):
        rows, cols = min(half, grid.n_rows - i * half), min(half, grid.n_cols - j * half)
        mine = cells.select((F.lit(grid.n_rows - 1) - F.col("row_no") - i * half).alias("row_no"), (F.col("col") - j * half).alias("col"), "value")
        where = raster.Grid(j * half * float(CELL), (grid.n_rows - i * half) * float(CELL), float(CELL), -float(CELL), rows, cols)
        tiff.write_tiff(mine, where, f"{folder}/{i}{j}.tif", tile=32)
    got, whole = tiff.read_tiff(spark, folder)
    return got.select((F.lit(whole.n_rows - 1) - F.col("row_no")).alias("row_no"), "col", "value")
