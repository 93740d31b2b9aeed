"""Street and line queries: snapping, cutting and cropping, boundaries, lines, projections; each calls the library's operator."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from wayfield.functions import crs, geometry
from wayfield.operators import graph, isochrone, snapping
from wayfield.operators.sssp import bounded_distances, both_ways, in_cells
from wayfield.plans.core import ARCS, SNAP_POIS, _edges, _nodes, _people, _pois, _snap, reach_sql
from wayfield.plans.layers import EDGES, NODES, PEOPLE, POIS, SIDE, with_layers
from wayfield.plans.registry import query
from wayfield.plans.surfaces import STREETS, _squares
from wayfield.session import materialize


def _named_edges(spark, d):
    return _edges(spark, d).select((F.col("u") * 1_000_000 + F.col("v")).alias("edge"), "u", "v", "len")


_SHARE = "CASE WHEN nn > 0 THEN least(greatest(((x - ax) * dx + (y - ay) * dy) / nn, 0), 1) ELSE 0 END"
NEAREST_EDGE = f"""near AS (SELECT person AS pid, u * 1000000 + v AS edge, CAST(len AS DOUBLE) AS len, t, (ax + t * dx - x) * (ax + t * dx - x) + (ay + t * dy - y) * (ay + t * dy - y) AS d2
  FROM (SELECT *, {_SHARE} AS t FROM (SELECT person, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM people) CROSS JOIN streets)),
snaps AS (SELECT pid, min(d2) AS d2, arg_min(edge, (d2, edge)) AS edge, arg_min(t, (d2, edge)) AS share, arg_min(len, (d2, edge)) AS len FROM near GROUP BY pid)"""
_SNAPPED = (SIDE, NODES, EDGES, PEOPLE, STREETS, NEAREST_EDGE)


def _snaps(spark, d):
    people = _people(spark, d).select(F.col("person").alias("pid"), "x", "y")
    return snapping.nearest_edges(people, _named_edges(spark, d), _nodes(spark, d), 100.0)


@query("j10_nearest_edge", with_layers(*_SNAPPED, body="SELECT pid, edge, round(d2, 4) AS d2, round(share, 6) AS share FROM snaps"))
def j10_nearest_edge(spark, d):
    """The nearest street of every person, and where along it."""
    return _snaps(spark, d).select("pid", "edge", F.round("d2", 4).alias("d2"), F.round("share", 6).alias("share"))


@query("g5_snap_cuts", with_layers(
    *_SNAPPED, "ins AS (SELECT *, share * len AS pd FROM snaps)", "inner_ AS (SELECT *, round(pd / 10) AS b FROM ins WHERE pd > 0 AND pd < len AND pd >= 10 AND pd <= len - 10)",
    "buckets AS (SELECT edge, b, sum(pd) AS s, count(*) AS n FROM inner_ GROUP BY edge, b)",
    "starts AS (SELECT *, coalesce(s / n - lag(s / n) OVER (PARTITION BY edge ORDER BY b) >= 10, true) AS f FROM buckets)",
    "runs AS (SELECT *, sum(CAST(f AS INT)) OVER (PARTITION BY edge ORDER BY b) AS run FROM starts)",
    "cuts AS (SELECT edge, b, sum(s) OVER (PARTITION BY edge, run) / sum(n) OVER (PARTITION BY edge, run) AS cut FROM runs)",
    body="SELECT ins.pid, ins.edge, round(ins.pd, 4) AS pd, round(cut, 4) AS cut FROM ins LEFT JOIN inner_ i ON i.pid = ins.pid LEFT JOIN cuts ON cuts.edge = i.edge AND cuts.b = i.b",
))
def g5_snap_cuts(spark, d):
    """Where people's snaps cut streets: none within 10 m of an end, near ones at their mean."""
    snaps = _snaps(spark, d).withColumn("pd", F.col("share") * F.col("len"))
    return snapping.snap_cuts(snaps, 10.0).select("pid", "edge", F.round("pd", 4).alias("pd"), F.round("cut", 4).alias("cut"))


@query("g6_added_points", with_layers(
    *_SNAPPED, "ins AS (SELECT *, share * len AS pd FROM snaps WHERE d2 <= 1600)",
    body="SELECT edge, count(DISTINCT CASE WHEN pd > 0 AND pd < len THEN pd END) + 1 AS parts, CAST(max(len) AS BIGINT) AS len, round(max(sqrt(d2)), 4) AS distance, count(*) AS points FROM ins GROUP BY edge",
))
def g6_added_points(spark, d):
    """The street network with a node where each person snaps: parts and length of every street that has one."""
    people = _people(spark, d).select(F.col("person").alias("pid"), "x", "y")
    edges = _named_edges(spark, d)
    _, parts, placed = snapping.add_points(people, _nodes(spark, d), edges, 100.0, 40.0)
    snaps = _snaps(spark, d).filter("d2 <= 1600").join(placed, "pid").filter("node IS NOT NULL")
    per = snaps.groupBy("edge").agg(F.round(F.max("distance"), 4).alias("distance"), F.count("*").alias("points"))
    return parts.groupBy("edge").agg(F.count("*").alias("parts"), F.round(F.sum("len")).cast("long").alias("len")).join(per, "edge")


_ONE = reach_sql("SELECT DISTINCT CAST(1 AS BIGINT) AS grp, node FROM poi_nodes", 700)
_WALKED = (SIDE, NODES, EDGES, POIS, SNAP_POIS, ARCS, _ONE)


@query("g9_isochrone", with_layers(
    *_WALKED, "both_ AS (SELECT u * 1000000 + v AS edge, e.len, a.node IS NOT NULL AND b.node IS NOT NULL AS ends, coalesce(700 - a.dist, 0) AS fu, coalesce(700 - b.dist, 0) AS fv FROM edges e LEFT JOIN reach a ON a.node = u LEFT JOIN reach b ON b.node = v)",
    body="SELECT edge, CASE WHEN fu + fv >= len THEN 1 ELSE CAST(fu > 0 AS INT) + CAST(fv > 0 AS INT) END AS parts, CAST(least(len, fu + fv) AS BIGINT) AS len FROM both_ WHERE fu + fv > 0 AND (ends OR fu + fv < len)",
    recursive=True,
))
def g9_isochrone(spark, d):
    """Streets within 700 m of a place, cut where the reach ends."""
    sources = _snap(spark, d, _pois(spark, d), "poi").select("node")
    _, edges = snapping.isochrone(_named_edges(spark, d), sources, 700, 10_000_000)
    return edges.groupBy("edge").agg(F.count("*").cast("int").alias("parts"), F.sum("len").cast("long").alias("len"))


@query("g11_crop_by_reach", with_layers(
    *_WALKED, "near AS (SELECT node FROM reach WHERE dist <= 600)", "edge_ AS (SELECT node FROM reach WHERE dist > 600)",
    body="SELECT u, v, len FROM edges WHERE (u IN (FROM near) AND v IN (FROM near)) OR (u IN (FROM near) AND v IN (FROM edge_))", recursive=True,
))
def g11_crop_by_reach(spark, d):
    """Directed crop: streets inside, and those that leave to the border."""
    sources = _snap(spark, d, _pois(spark, d), "poi").select(F.lit(1).cast("long").alias("grp"), "node")
    reach = bounded_distances(_edges(spark, d), sources, 700)
    return snapping.crop_by_reach(_edges(spark, d).select("u", "v", "len"), reach.filter("dist <= 600"), reach.filter("dist > 600"), outbound=True, undirected=False)


_SIDES = "sides AS (SELECT poi AS pid, x + sx * 200.25 AS px, y + sy * 200.25 AS py, x + tx * 200.25 AS qx, y + ty * 200.25 AS qy FROM (SELECT poi, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM pois) CROSS JOIN (VALUES (-1, -1, 1, -1), (1, -1, 1, 1), (1, 1, -1, 1), (-1, 1, -1, -1)) t(sx, sy, tx, ty))"


@query("x11_boundary_points", with_layers(
    SIDE, NODES, EDGES, POIS, STREETS, _SIDES,
    "hits AS (SELECT *, ((ax - px) * dy - (ay - py) * dx) / turn AS t, ((ax - px) * (qy - py) - (ay - py) * (qx - px)) / turn AS s FROM (SELECT *, (qx - px) * dy - (qy - py) * dx AS turn FROM sides CROSS JOIN streets) WHERE turn <> 0)",
    body="SELECT pid, u * 1000000 + v AS edge, round(px + t * (qx - px), 4) AS x, round(py + t * (qy - py), 4) AS y FROM hits WHERE t BETWEEN 0 AND 1 AND s BETWEEN 0 AND 1",
))
def x11_boundary_points(spark, d):
    """Where squares around places are entered from streets."""
    areas = _squares(spark, d, 200.25).select(F.col("poi").alias("pid"), "ring")
    got = snapping.boundary_points(areas, _named_edges(spark, d), _nodes(spark, d), 200.0)
    return got.select("pid", "edge", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("t11_served_inside", with_layers(SIDE, NODES, POIS, body="SELECT id AS node, min(CASE quality WHEN 1000 THEN 0 WHEN 750 THEN 1 ELSE 2 END) AS rank_no FROM nodes a JOIN pois p ON a.x >= p.x - 250 AND a.x < p.x + 250 AND a.y >= p.y - 250 AND a.y < p.y + 250 GROUP BY id"))
def t11_served_inside(spark, d):
    """Street nodes inside a place's area take its level."""
    rank = F.when(F.col("quality") == 1000, 0).when(F.col("quality") == 750, 1).otherwise(2)
    return snapping.served_inside(_nodes(spark, d), _squares(spark, d, 250).select(rank.alias("rank_no"), "ring"), 500.0)


_GIVEN = "m AS (SELECT quality AS q, (nation % 5 + 1) * 100 AS d, CASE WHEN quality - nation * 20 > 600 THEN 'A' WHEN quality - nation * 20 > 300 THEN 'B' END AS v FROM pois)"


@query("t2_processing_order", with_layers(SIDE, POIS, _GIVEN, body="""SELECT CASE v WHEN 'A' THEN 0 ELSE 1 END AS rank_no, CAST(d AS INT) AS distance, array_to_string(list_sort(list(q)), ',') AS qualities, v AS value
FROM (SELECT q, v, max(d) AS d FROM m WHERE v IS NOT NULL GROUP BY 1, 2) GROUP BY v, d"""))
def t2_processing_order(spark, d):
    """What places of a quality give at a distance, as levels: farthest distance per quality and value, equal ones together."""
    worth = F.col("quality") - F.col("nation") * 20
    rows = _pois(spark, d).select("quality", ((F.col("nation") % 5 + 1) * 100).cast("int").alias("distance"), F.when(worth > 600, "A").when(worth > 300, "B").alias("value"))
    out = isochrone.processing_order(rows, ["A", "B"])
    return out.select("rank_no", "distance", F.array_join(F.transform("qualities", lambda q: q.cast("string")), ",").alias("qualities"), "value")


@query("x12_nodes_to_points", with_layers(SIDE, NODES, POIS, SNAP_POIS, body="SELECT id, x, y FROM nodes WHERE id IN (SELECT node FROM poi_nodes)"))
def x12_nodes_to_points(spark, d):
    return snapping.nodes_to_points(_snap(spark, d, _pois(spark, d), "poi"), _nodes(spark, d))


_LINES = "lines AS (SELECT a.id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, c.x AS cx, c.y AS cy FROM nodes a JOIN nodes b ON b.id = a.id + 1 JOIN nodes c ON c.id = a.id + 2)"


def _lines(spark, d):
    n = _nodes(spark, d)
    side = lambda s, k: n.select((F.col("id") - k).alias("id"), F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).alias(s))
    return side("a", 0).join(side("b", 1), "id").join(side("c", 2), "id").select("id", F.array("a", "b", "c").alias("line"))




def _step(a: str, b: str) -> str:
    """Length between two vertices of ``lines``."""
    y = {"a": "ay", "b": "by_", "c": "cy"}
    dx, dy = f"({b}x - {a}x)", f"({y[b]} - {y[a]})"
    return f"sqrt(CAST({dx} * {dx} + {dy} * {dy} AS DOUBLE))"


@query("x6_line_vertices", with_layers(SIDE, NODES, _LINES, body=f"""SELECT id, 1 AS seq, CAST(ax AS DOUBLE) AS x, CAST(ay AS DOUBLE) AS y, CAST(0 AS DOUBLE) AS run FROM lines
UNION ALL SELECT id, 2, bx, by_, round({_step('a', 'b')}, 4) FROM lines UNION ALL SELECT id, 3, cx, cy, round({_step('a', 'b')} + {_step('b', 'c')}, 4) FROM lines"""))
def x6_line_vertices(spark, d):
    """Vertices of lines in order, each with the length so far."""
    return geometry.vertices(_lines(spark, d), "id", "line").withColumn("run", F.round("run", 4))


@query("x7_patched_lines", with_layers(SIDE, NODES, _LINES, body="SELECT id, CAST(cx AS DOUBLE) AS first_x, CAST(0 AS DOUBLE) AS last_x, round(sqrt(CAST((bx - cx) * (bx - cx) + (by_ - cy) * (by_ - cy) AS DOUBLE)) + sqrt(CAST(bx * bx + by_ * by_ AS DOUBLE)), 4) AS length FROM lines"))
def x7_patched_lines(spark, d):
    """Lines that begin at the origin instead, turned round."""
    line = geometry.reversed_line(geometry.with_first(F.col("line"), F.lit(0), F.lit(0)))
    out = _lines(spark, d).select("id", line.alias("line"))
    return out.select("id", F.col("line")[0]["x"].alias("first_x"), F.element_at("line", -1)["x"].alias("last_x"), F.round(geometry.length(F.col("line")), 4).alias("length"))


def _beta(lat: str) -> str:
    e2 = crs.FLATTENING * (2 - crs.FLATTENING)
    e = math.sqrt(e2)
    q = f"({1 - e2!r} * (sin(radians({lat})) / (1 - {e2!r} * sin(radians({lat})) * sin(radians({lat}))) + atanh({e!r} * sin(radians({lat}))) / {e!r}))"
    return f"asin({q} / {(1 - e2) * (1 / (1 - e2) + math.atanh(e) / e)!r})"


def _excess(a: str, b: str) -> str:
    return f"2 * atan2(tan(radians({b}x - {a}x) / 2) * (tan({a}b / 2) + tan({b}b / 2)), 1 + tan({a}b / 2) * tan({b}b / 2))"


@query("x2_geodesic_area", with_layers(SIDE, NODES, _LINES, "deg AS (SELECT id, " + ", ".join(f"CAST({c}x AS DOUBLE) / n / 2 AS {c}x, CAST({y} AS DOUBLE) / n / 2 AS {c}lat" for c, y in (("a", "ay"), ("b", "by_"), ("c", "cy"))) + " FROM lines CROSS JOIN side)",
                                       f"flat AS (SELECT id, ax, bx, cx, {_beta('alat')} AS ab, {_beta('blat')} AS bb, {_beta('clat')} AS cb FROM deg)",
                                       body=f"SELECT id, round(abs({_excess('a', 'b')} + {_excess('b', 'c')} + {_excess('c', 'a')}) * {crs.authalic_radius() ** 2!r} / 1e6, 3) AS km2 FROM flat"))
def x2_geodesic_area(spark, d):
    """Ellipsoidal areas of triangles in degrees."""
    n = _nodes(spark, d).agg(F.max("col") + 1).first()[0]
    ring = F.transform(F.concat("line", F.slice("line", 1, 1)), lambda p: F.struct((p["x"] / n / 2).alias("x"), (p["y"] / n / 2).alias("y")))
    return _lines(spark, d).select("id", F.round(crs.geodesic_area(ring) / 1e6, 3).alias("km2"))


def _great(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return f"2 * {crs.EARTH_RADIUS!r} * asin(sqrt(power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2)))"


@query("x3_utm_reasonable", with_layers(SIDE, POIS, "b AS (SELECT poi, CAST(x % 60 AS DOUBLE) - 30 AS x0, CAST(y % 60 AS DOUBLE) AS y0, CAST(x % 60 AS DOUBLE) - 30 + CAST(quality AS DOUBLE) / 100 AS x1, CAST(y % 60 AS DOUBLE) + CAST(poi % 25 AS DOUBLE) AS y1 FROM pois)",
                                        body=f"SELECT poi, {_great('x0', '(y0 + y1) / 2', 'x1', '(y0 + y1) / 2')} <= 750000 AND {_great('x0', 'y0', 'x0', 'y1')} <= 2000000 AS plane FROM b"))
def x3_utm_reasonable(spark, d):
    """Which boxes in degrees one UTM zone can hold."""
    x0, y0 = (F.col("x") % 60).cast("double") - 30, (F.col("y") % 60).cast("double")
    return _pois(spark, d).select("poi", crs.is_utm_reasonable(x0, y0, x0 + F.col("quality").cast("double") / 100, y0 + (F.col("poi") % 25).cast("double")).alias("plane"))


_BESIDE = """three AS (SELECT *, (u * 7 + v) % 60 AS d1, (u * 13 + v) % 45 AS d2 FROM edges),
kept AS (SELECT u, v, len, CASE WHEN d1 <= d2 THEN d1 <= 30 ELSE d2 <= 30 END AS one, d1 <= d2 AS nearer, d1 + d2 <= 30 AS all_one, d1, d2 FROM three)"""


@query("g4_near_parallels", with_layers(SIDE, NODES, EDGES, _BESIDE, body="""SELECT u, v, len, 0 AS key_no FROM kept
UNION ALL SELECT u, v, len + 3, 1 FROM kept WHERE NOT (nearer AND one) AND NOT (one AND all_one) UNION ALL SELECT u, v, len + 7, 2 FROM kept WHERE NOT (NOT nearer AND one) AND NOT (one AND all_one)"""))
def g4_near_parallels(spark, d):
    """Three streets between the same two nodes, two of them beside the first by distances of their own: those whose midpoints are near each other
    are one, by complete linkage."""
    at = _edges(spark, d).withColumns({"d1": (F.col("u") * 7 + F.col("v")) % 60, "d2": (F.col("u") * 13 + F.col("v")) % 45})
    copies = F.array(*(F.struct(F.lit(k).alias("key_no"), (F.col("len") + more).alias("len"), off.cast("double").alias("off")) for k, more, off in ((0, 0, F.lit(0)), (1, 3, F.col("d1")), (2, 7, -F.col("d2")))))
    many = at.select("u", "v", F.explode(copies).alias("c")).select("u", "v", "c.key_no", "c.len", "c.off")
    many = graph.with_midpoints(_nodes(spark, d), many).withColumn("my", F.col("my") + F.col("off")).drop("off")
    return graph.without_near_parallels(many, 30.0).select("u", "v", "len", "key_no")


@query("g6_split_lines", with_layers(SIDE, NODES, _LINES, body=f"""SELECT id AS edge, part, round(CASE part WHEN 0 THEN n * 0.25 ELSE n * 0.75 END, 4) AS len, round(CASE part WHEN 0 THEN n * 0.25 ELSE n * 0.75 END, 4) AS line_length, 'bus' AS highway
FROM (SELECT id, {_step('a', 'b')} + {_step('b', 'c')} AS n FROM lines), (SELECT unnest([0, 1]) AS part)"""))
def g6_split_lines(spark, d):
    """Bent streets cut at a quarter of their length: the parts' lines are as long as they say, and keep the street's tags."""
    lines = _lines(spark, d).select(F.col("id").alias("edge"), F.col("id").alias("u"), (F.col("id") + 2).alias("v"), geometry.length(F.col("line")).alias("len"), "line", F.lit("bus").alias("highway"))
    _, parts = graph.split_edges(lines, lines.select("edge", (F.col("len") / 4).alias("cut")), 1 << 40)
    return parts.select("edge", (F.col("u") != F.col("edge")).cast("int").alias("part"), F.round("len", 4).alias("len"), F.round(geometry.length(F.col("line")), 4).alias("line_length"), "highway")


_CUTS = (
    *_WALKED, "e2 AS (SELECT u * 1000000 + v AS edge, e.len, greatest(coalesce(300 - a.dist, 0), 0) AS u0, greatest(coalesce(300 - b.dist, 0), 0) AS v0, greatest(coalesce(700 - a.dist, 0), 0) AS u1, greatest(coalesce(700 - b.dist, 0), 0) AS v1 FROM edges e LEFT JOIN reach a ON a.node = u LEFT JOIN reach b ON b.node = v)",
    "c0 AS (SELECT *, CASE WHEN u0 > 0 AND u0 <= len AND u0 >= 0 THEN u0 END AS a0, CASE WHEN v0 > 0 AND v0 <= len THEN v0 END AS b0, CASE WHEN u1 > 0 AND u1 <= len AND u1 <= len - v0 AND u1 >= u0 THEN u1 END AS a1, CASE WHEN v1 > 0 AND v1 <= len AND v1 <= len - u0 AND v1 >= v0 THEN v1 END AS b1 FROM e2)",
    "c1 AS (SELECT *, coalesce(a0, 0) + coalesce(b0, 0) <= len AS k0, coalesce(a1, 0) + coalesce(b1, 0) <= len AS k1 FROM c0)",
    "cuts AS (SELECT edge, 0 AS rank_no, a0 AS pos FROM c1 WHERE k0 UNION ALL SELECT edge, 0, len - b0 FROM c1 WHERE k0 UNION ALL SELECT edge, 1, a1 FROM c1 WHERE k1 UNION ALL SELECT edge, 1, len - b1 FROM c1 WHERE k1)",
)


@query("t4_edge_cuts", with_layers(
    *_CUTS,
    body="SELECT c.edge, CASE WHEN u0 + v0 > len THEN 0 WHEN u1 + v1 > len THEN 1 END AS rank_no, coalesce((SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT rank_no || ':' || CAST(pos AS BIGINT) AS k FROM cuts x WHERE x.edge = c.edge AND pos IS NOT NULL)), '') AS cuts FROM c1 c",
    recursive=True,
))
def t4_edge_cuts(spark, d):
    """Per street its own level and where each of two levels' reaches end inside it."""
    pois = _snap(spark, d, _pois(spark, d), "poi").select(F.lit(1).cast("long").alias("quality"), "node")
    edges = _named_edges(spark, d)
    reach = isochrone.reaches(edges, pois, isochrone.list_matrix(spark, [300, 700]))
    judged = isochrone.edge_reaches(edges, reach, 2)
    text = F.transform("cuts", lambda c: F.concat(c["rank_no"].cast("string"), F.lit(":"), c["at"].cast("long").cast("string")))
    return judged.select("edge", "rank_no", F.array_join(F.array_sort(text), ",").alias("cuts"))


def _cut_network(spark, d):
    pois = _snap(spark, d, _pois(spark, d), "poi").select(F.lit(1).cast("long").alias("quality"), "node")
    edges = _named_edges(spark, d)
    reach = materialize(isochrone.reaches(edges, pois, isochrone.list_matrix(spark, [300, 700])), "reach")
    return isochrone.result_network(_nodes(spark, d), edges, reach, 2)


_SPOTS = """spots AS (SELECT edge, pos, min(after) AS rank_no FROM (
  SELECT edge, CAST(pos AS DOUBLE) AS pos, len, after FROM (
    SELECT edge, len, a0 AS pos, CASE WHEN u1 > u0 THEN 1 END AS after FROM c1 WHERE k0 UNION ALL SELECT edge, len, len - b0, CASE WHEN v1 > v0 THEN 1 END FROM c1 WHERE k0
    UNION ALL SELECT edge, len, a1, NULL FROM c1 WHERE k1 UNION ALL SELECT edge, len, len - b1, NULL FROM c1 WHERE k1) WHERE pos > 0 AND pos < len) GROUP BY edge, pos)"""
_MARKED = "marked AS (SELECT n.id, x, y, CASE WHEN dist < 300 THEN 0 WHEN dist < 700 THEN 1 END AS rank_no FROM nodes n LEFT JOIN reach ON node = n.id)"


@query("t7_result_nodes", with_layers(
    *_CUTS, _SPOTS, _MARKED,
    body="""SELECT CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, rank_no FROM marked
UNION ALL SELECT round(a.x + (b.x - a.x) * pos / e.len, 4), round(a.y + (b.y - a.y) * pos / e.len, 4), s.rank_no FROM spots s JOIN edges e ON s.edge = e.u * 1000000 + e.v JOIN nodes a ON a.id = e.u JOIN nodes b ON b.id = e.v""",
    recursive=True,
))
def t7_result_nodes(spark, d):
    """All nodes of the result network, those at cuts too, each with its own label."""
    return _cut_network(spark, d)[0].select(F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "rank_no")


@query("t7_result_network", with_layers(
    *_CUTS, _SPOTS,
    "stops AS (SELECT edge, pos FROM spots UNION ALL SELECT edge, CAST(0 AS DOUBLE) FROM e2 UNION ALL SELECT edge, CAST(len AS DOUBLE) FROM e2)",
    "parts AS (SELECT edge, pos, lead(pos) OVER (PARTITION BY edge ORDER BY pos) AS till FROM stops)",
    "judged AS (SELECT p.edge, till - pos AS len, (pos + till) / 2 AS mid, e2.len AS whole, u0, v0, u1, v1 FROM parts p JOIN e2 USING (edge) WHERE till IS NOT NULL)",
    body="""SELECT edge, CASE WHEN (u0 >= mid AND u0 > 0) OR (v0 >= whole - mid AND v0 > 0) THEN 0 WHEN (u1 >= mid AND u1 > 0) OR (v1 >= whole - mid AND v1 > 0) THEN 1 END AS rank_no, round(len, 4) AS len,
  true AS named FROM judged""",
    recursive=True,
))
def t7_result_network(spark, d):
    """Parts of streets with their labels; every part's ends are nodes of the result."""
    nodes, parts = _cut_network(spark, d)
    nodes = materialize(nodes, "result-nodes")
    there = lambda s: nodes.select(F.col("id").alias(s), F.lit(True).alias(f"{s}_there")).hint("merge")
    out = parts.join(there("u"), "u", "left").join(there("v"), "v", "left")
    return out.select("edge", "rank_no", F.round("len", 4).alias("len"), (F.coalesce("u_there", F.lit(False)) & F.coalesce("v_there", F.lit(False))).alias("named"))


@query("g8_search_in_cells", with_layers(
    SIDE, NODES, EDGES, POIS, SNAP_POIS, ARCS, reach_sql("SELECT DISTINCT CAST(quality AS BIGINT) AS grp, node FROM pois JOIN poi_nodes USING (poi)", 1500),
    body="SELECT grp, node, dist FROM reach",
    recursive=True,
))
def g8_search_in_cells(spark, d):
    """Searches over a graph cut into cells, the way that large graphs go."""
    pois = _pois(spark, d).join(_snap(spark, d, _pois(spark, d), "poi"), "poi")
    arcs = both_ways(_edges(spark, d)).groupBy("u", "v").agg(F.min("len").alias("len"))
    sources = pois.select(F.col("quality").cast("long").alias("grp"), "node", F.lit(0).cast("long").alias("label")).distinct()
    return in_cells(arcs, sources, 1500, _nodes(spark, d)).drop("label")
