"""The whole runs as queries: levels from a matrix, population by level, and levels by census area."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfield.facade import HexGrid, PointsOfInterest, PopulationLayer, StreetNetwork
from wayfield.functions import hexgrid
from wayfield.operators import hexcells
from wayfield.operators.raster import Grid
from wayfield.plans import workflows
from wayfield.plans.core import ARCS, SNAP_POIS, _edges, _nodes, _people, _pois, _snap, reach_sql
from wayfield.plans.layers import EDGES, NODES, PEOPLE, POIS, SIDE, with_layers
from wayfield.plans.registry import query
from wayfield.plans.surfaces import _TID, HEXES, POP, SIZE, _blocks, _pop, _side

#: (quality, distance, rank_no)
_MATRIX = [(1000, 500, 0), (1000, 1000, 1), (1000, 1500, 2), (750, 500, 1), (750, 1000, 2), (500, 500, 2)]
_MATRIX_SQL = "matrix(grp, distance, rank_no) AS (VALUES " + ", ".join(map(str, _MATRIX)) + ")"


@query("c2_levels_by_matrix", with_layers(
    SIDE, NODES, EDGES, POIS, SNAP_POIS, ARCS, _MATRIX_SQL,
    reach_sql("SELECT DISTINCT CAST(quality AS BIGINT) AS grp, node FROM pois JOIN poi_nodes USING (poi)", 1500),
    body="SELECT node, CAST(min(rank_no) AS INT) AS rank_no FROM reach JOIN matrix USING (grp) WHERE dist < distance GROUP BY node", recursive=True))
def c2_levels_by_matrix(spark, d):
    """The first run: places at corners of streets, the street network and a matrix of levels; the best level of each corner."""
    nodes = _nodes(spark, d)
    at = _snap(spark, d, _pois(spark, d), "poi").join(_pois(spark, d).select("poi", "quality"), "poi").join(nodes.select(F.col("id").alias("node"), "x", "y"), "node")
    places = at.select(F.col("poi").alias("pid"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "quality")
    matrix = spark.createDataFrame(_MATRIX, "quality long, distance long, rank_no int")
    run = workflows.levels_by_matrix(StreetNetwork(nodes, _edges(spark, d)), PointsOfInterest(places), matrix)
    return run.result["nodes"].join(nodes.select(F.col("id").alias("node")), "node", "left_semi")


_RANK = "CASE quality WHEN 1000 THEN 0 WHEN 750 THEN 1 ELSE 2 END"
_RANKED = "ranked AS (SELECT {0} AS q, {1} AS r, min({2}) AS rank_no FROM pois GROUP BY 1, 2)".format(*hexgrid.cell_sql("x", "y", SIZE), _RANK)
_LABELS = ["good", "fair", "poor"]
_OFF = 0.25  # so that no pixel's border goes through a corner of a hexagon


def _levels(spark, d) -> HexGrid:
    """The best of the places in each hexagon."""
    return HexGrid.from_points(_pois(spark, d).withColumn("rank_no", F.expr(_RANK)), {"rank_no": "min"}, SIZE, 0)


def _meets(dx: str, dy: str) -> str:
    """Whether a pixel of 100 m and a hexagon, dx and dy between their centres, overlap: no side of either parts them."""
    deep = hexgrid.ROOT3 / 2 * SIZE
    slant = 25 + 50 * hexgrid.ROOT3 / 2
    half = f"CAST({hexgrid.ROOT3 / 2!r} AS DOUBLE)"
    return f"abs({dx}) < {deep + 50!r} AND abs({dy}) < {SIZE + 50!r} AND abs(({dx}) / 2 + ({dy}) * {half}) < {deep + slant!r} AND abs(({dx}) / 2 - ({dy}) * {half}) < {deep + slant!r}"


@query("c3_population_by_level", with_layers(
    SIDE, PEOPLE, POP, POIS, HEXES, _RANKED,
    f"met AS (SELECT value / CAST(count(*) OVER (PARTITION BY row_no, col) AS DOUBLE) AS share, q, r FROM pop JOIN hexes ON {_meets(f'col * 100 + {50 + _OFF} - hx', f'row_no * 100 + {50 + _OFF} - hy')})",
    "cells AS (SELECT q, r, sum(share) AS population FROM met GROUP BY q, r)",
    "named AS (SELECT CASE rank_no WHEN 0 THEN 'good' WHEN 1 THEN 'fair' WHEN 2 THEN 'poor' ELSE 'none' END AS accessibility, coalesce(population, 0) AS population FROM cells FULL JOIN ranked USING (q, r))",
    body="""SELECT coalesce(accessibility, 'total population') AS accessibility, CAST(round(population) AS BIGINT) AS population, round(100.0 * population / max(population) OVER (), 2) AS percent
  FROM (SELECT accessibility, sum(population) AS population FROM named GROUP BY ROLLUP (accessibility))"""))  # fmt: skip
def c3_population_by_level(spark, d):
    """The second run: a population raster and levels on hexagons, people by level with their shares."""
    cells, grid = _pop(spark, d)
    people = PopulationLayer.of(cells, Grid(grid.x0 + _OFF, grid.y0 + _OFF, grid.dx, grid.dy, grid.n_rows, grid.n_cols))
    return workflows.population_by_level(_levels(spark, d), people, _LABELS)[1]


@query("c4_levels_by_area", with_layers(
    SIDE, PEOPLE, POIS, HEXES, _RANKED, "k AS (SELECT n * 100 // 500 + 1 AS k FROM side)",
    "lev AS (SELECT CAST(floor((hy + 0.5) / 500) AS BIGINT) AS br, CAST(floor((hx + 0.5) / 500) AS BIGINT) AS bc, avg(rank_no) AS level FROM ranked JOIN hexes USING (q, r) GROUP BY 1, 2)",
    f"ppl AS (SELECT {_TID} AS tid, sum(population) AS p FROM people GROUP BY 1)",
    "blk AS (SELECT a.r * k + b.c AS id, a.r // 4 * ((k + 3) // 4) + b.c // 4 AS tract, CAST(coalesce(p, 0) + 1 AS DOUBLE) AS population, level FROM k, range(0, k) a(r), range(0, k) b(c) LEFT JOIN ppl ON tid = a.r * k + b.c LEFT JOIN lev ON br = a.r AND bc = b.c)",
    body="""SELECT 'block' AS kind, CAST(id AS BIGINT) AS id, population, round(level, 6) AS level FROM blk
  UNION ALL SELECT 'tract', CAST(tract AS BIGINT), sum(population) FILTER (level IS NOT NULL), round(sum(level * population) / sum(population) FILTER (level IS NOT NULL), 6) FROM blk GROUP BY tract"""))  # fmt: skip
def c4_levels_by_area(spark, d):
    """The third run: levels on hexagons to blocks, and weighted by their people to tracts of up to 16 blocks."""
    people = _people(spark, d).groupBy(F.expr(f"CAST(floor(y / 500) AS BIGINT) * {_side(spark, d) * 100 // 500 + 1} + CAST(floor(x / 500) AS BIGINT)").alias("tid")).agg(F.sum("population").alias("p"))
    blocks = _blocks(spark, d).join(people, "tid", "left").select(F.col("tid").alias("sid"), "ring", (F.coalesce("p", F.lit(0)) + 1).cast("double").alias("population"))
    k = (_side(spark, d) * 100 // 500 + 4) // 4
    at = spark.range(k * k).select(F.col("id").alias("tid"), ((F.col("id") % k) * 2000 - 0.5).alias("x"), (F.floor(F.col("id") / k) * 2000 - 0.5).alias("y"))
    tracts = at.select("tid", hexcells.box(F.col("x"), F.col("y"), F.col("x") + 2000, F.col("y") + 2000).alias("ring"))
    out = workflows.levels_by_area(spark, _levels(spark, d), blocks, "population", {"tract": tracts})
    rows = lambda kind, key, df: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "population", F.round("level", 6).alias("level"))
    return rows("block", "sid", out["blocks"]).union(rows("tract", "tid", out["tract"]))
