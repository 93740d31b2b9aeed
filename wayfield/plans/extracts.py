"""Queries on OpenStreetMap elements made of the layers: areas stitched from ways, extracts of a PBF file."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wayfield.facade import AreaOfInterest
from wayfield.functions import shapes
from wayfield.plans.areas import _ODD, _TEXT
from wayfield.plans.layers import EDGES, NODES, POIS, SIDE, layer, with_layers
from wayfield.plans.core import _pois
from wayfield.plans.registry import query
from wayfield.session import scratch_dir
from wayfield.sources import osm, pbf

#: Squares about a place, by half their side and their shift: an outer ring, its hole, an island in the hole, and a part apart.
OUTER, HOLE, ISLAND, AWAY, SHIFT = 230, 90, 40, 60, 400
_RINGS = [(OUTER, 0), (HOLE, 0), (ISLAND, 0), (AWAY, SHIFT)]
#: Ways by the corners (ring, corner) that they name; some run against the others.
_WAYS = [
    [(0, 0), (0, 1), (0, 2)], [(0, 0), (0, 3)], [(0, 2), (0, 3)],
    [(1, 0), (1, 1)], [(1, 0), (1, 3), (1, 2)], [(1, 1), (1, 2)],
    [(2, 0), (2, 1), (2, 2), (2, 3), (2, 0)], [(3, 0), (3, 1), (3, 2), (3, 3), (3, 0)],
]
_CORNERS = [(-1, -1), (1, -1), (1, 1), (-1, 1)]
_MISSING = "poi % 5 = 0"  # these relations lack a side of their outer ring


def _elements(spark, d):
    """Nodes, ways and relations: each place is a park of several ways; what it lacks is a way that nobody mapped."""
    pois = _pois(spark, d)
    corner = [(r * 4 + c, F.col("x") + dx + sx * half, F.col("y") + sy * half) for r, (half, dx) in enumerate(_RINGS) for c, (sx, sy) in enumerate(_CORNERS)]
    no_tags = F.create_map().cast("map<string,string>")
    at = F.array(*(F.struct((F.col("poi") * 16 + k).alias("id"), x.cast("double").alias("x"), y.cast("double").alias("y"), no_tags.alias("tags")) for k, x, y in corner))
    way = [F.struct((F.col("poi") * 8 + k).alias("way"), F.array(*(F.col("poi") * 16 + r * 4 + c for r, c in named)).alias("nodes"), no_tags.alias("tags")) for k, named in enumerate(_WAYS)]
    ways = pois.select("poi", F.inline(F.array(*way))).filter(f"NOT ({_MISSING} AND way % 8 = 2)").drop("poi")
    member = F.array(*(F.struct(F.lit("way").alias("kind"), (F.col("poi") * 8 + k).alias("ref"), F.lit("outer").alias("role")) for k in range(len(_WAYS))))
    tags = F.create_map(F.lit("type"), F.lit("multipolygon"), F.lit("leisure"), F.when(F.col("nation") < 12, "park").otherwise("pitch"))
    return pois.select(F.inline(at)), ways, pois.select(F.col("poi").alias("relation"), member.alias("members"), tags.alias("tags"))


def _area(*halves: int) -> int:
    return sum(4 * h * abs(h) for h in halves)


@query("s4_stitched_parks", with_layers(SIDE, POIS, body=f"""SELECT poi AS id, 'multipolygon' AS geometry_type, 'park' AS leisure,
  CASE WHEN {_MISSING} THEN 2 ELSE 3 END AS n_parts, 1 AS n_holes,
  CAST(CASE WHEN {_MISSING} THEN {_area(HOLE, -ISLAND, AWAY)} ELSE {_area(OUTER, -HOLE, ISLAND, AWAY)} END AS DOUBLE) AS area,
  CAST(CASE WHEN {_MISSING} THEN {8 * (HOLE + ISLAND + AWAY)} ELSE {8 * (OUTER + HOLE + ISLAND + AWAY)} END AS DOUBLE) AS around,
  CAST(CASE WHEN {_MISSING} THEN 3 ELSE 0 END AS BIGINT) AS open_ways FROM pois WHERE nation < 12"""))
def s4_stitched_parks(spark, d):
    """Parks of several ways each: parts, holes and islands; where a side lacks, its ring stays open and the hole is a part."""
    s = F.col("shape")
    found = osm.expanded(osm.areas(_elements(spark, d), "green_areas"), ["type", "leisure"])
    return found.select("id", "geometry_type", "leisure", F.size(s).alias("n_parts"), F.size(shapes.holes(s)).alias("n_holes"), F.round(shapes.area(s), 3).alias("area"), F.round(shapes.perimeter(s), 3).alias("around"), "open_ways")


_DEGREES = 1e4  # metres of the layers in a degree of the file
_NAMED = f"""walks AS (SELECT u, v, u * 2 + CASE WHEN v = u + 1 THEN 0 ELSE 1 END AS way FROM edges WHERE len % 3 = 0),
inside AS (SELECT id FROM nodes WHERE ({_ODD}) % 2 = 1),
kept AS (SELECT * FROM walks WHERE u IN (SELECT id FROM inside) OR v IN (SELECT id FROM inside))"""


@query("s17_pbf_extract", with_layers(SIDE, NODES, EDGES, _NAMED, body="""SELECT 'node' AS kind, id, x, y FROM nodes WHERE id IN (SELECT u FROM kept UNION SELECT v FROM kept)
UNION ALL SELECT 'way' AS kind, way AS id, u AS x, v AS y FROM kept"""))
def s17_pbf_extract(spark, d):
    """Streets written to a PBF file and read again: ways for walking that have a node in an area of two parts, and their nodes."""
    nodes, edges = (layer(spark, d, SIDE, NODES, *more, name=name) for more, name in (((), "nodes"), ((EDGES,), "edges")))
    no_tags = F.create_map().cast("map<string,string>")
    highway = F.when(F.col("len") % 3 == 0, "path").otherwise("motorway")
    drawn = edges.select((F.col("u") * 2 + F.when(F.col("v") == F.col("u") + 1, 0).otherwise(1)).alias("way"), F.array("u", "v").alias("nodes"), F.create_map(F.lit("highway"), highway).alias("tags"))
    path = f"{scratch_dir(spark)}/extract-{uuid.uuid4().hex}.osm.pbf"
    pbf.write_pbf(nodes.select("id", (F.col("x") / _DEGREES).alias("x"), (F.col("y") / _DEGREES).alias("y"), no_tags.alias("tags")), drawn, None, path)
    at, ways, relations = osm.read_elements(spark, path)
    at = at.select("id", *(F.round(F.col(c) * _DEGREES).alias(c) for c in ("x", "y")))
    at, ways, _ = osm.extract(*osm.with_tags(at, ways, osm.network_filters("walk")), relations, AreaOfInterest(_TEXT).clip)
    long = lambda c: c.cast("long")
    rows = at.select(F.lit("node").alias("kind"), "id", long(F.col("x")).alias("x"), long(F.col("y")).alias("y"))
    return rows.union(ways.select(F.lit("way"), "way", F.col("nodes")[0], F.col("nodes")[1]))
