"""Graph, geometry, hierarchy and census queries on the derived layers, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfield.functions import crs, geometry
from wayfield.operators import census, graph, isochrone, multires
from wayfield.operators.components import components
from wayfield.plans.core import ARCS, SNAP_POIS, _edges, _nodes, _people, _pois, _snap, reach_sql
from wayfield.plans.layers import EDGES, NODES, PEOPLE, POIS, SIDE, layer, with_layers
from wayfield.plans.registry import query, table
from wayfield.streaming.windows import intensity

_SHORT = "short AS (SELECT u, v FROM edges WHERE len <= 62)"


@query(
    "g2_short_edge_components",
    with_layers(
        SIDE, NODES, EDGES, _SHORT, "both_ways AS (SELECT u, v FROM short UNION SELECT v, u FROM short)",
        """walk(node, comp) USING KEY (node) AS (
  SELECT DISTINCT u, u FROM both_ways
  UNION
  SELECT node, min(comp) FROM (SELECT b.v AS node, w.comp FROM walk w JOIN both_ways b ON b.u = w.node LEFT JOIN recurring.walk k ON k.node = b.v WHERE w.comp < k.comp) GROUP BY node
)""",
        body="SELECT node, comp AS component FROM walk",
        recursive=True,
    ),
)
def g2_short_edge_components(spark, d):
    return components(_edges(spark, d).filter("len <= 62").select("u", "v"))


@query(
    "g4_shortest_parallel",
    with_layers(SIDE, NODES, EDGES, body="SELECT u, v, min(len) AS len FROM (SELECT least(u % 50, v % 50) AS u, greatest(u % 50, v % 50) AS v, len FROM edges) GROUP BY 1, 2"),
)
def g4_shortest_parallel(spark, d):
    """Edges folded onto 50 nodes: of the parallel ones the shortest stays."""
    folded = _edges(spark, d).select((F.col("u") % 50).alias("u"), (F.col("v") % 50).alias("v"), "len")
    kept = graph.shortest_parallel(graph.keyed(folded, "len"))
    return kept.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "len")


@query(
    "t9_nearest_origin",
    with_layers(
        SIDE, NODES, EDGES, POIS, SNAP_POIS, ARCS, reach_sql("SELECT DISTINCT poi AS grp, node FROM poi_nodes", 1200),
        body="SELECT node, arg_min(grp, (dist, grp)) AS poi, min(dist) AS dist FROM reach GROUP BY node", recursive=True,
    ),
)
def t9_nearest_origin(spark, d):
    return isochrone.nearest_origin(_edges(spark, d), _snap(spark, d, _pois(spark, d), "poi"), 1200)


_MATRIX = [(500, 400, 1), (500, 800, 2), (750, 600, 1), (750, 1200, 2), (1000, 500, 0), (1000, 1000, 1), (1000, 1500, 2)]
_MATRIX_SQL = "matrix(quality, distance, rank_no) AS (VALUES " + ", ".join(map(str, _MATRIX)) + ")"


@query(
    "t2_node_reaches",
    with_layers(
        SIDE, NODES, EDGES, POIS, SNAP_POIS, ARCS, reach_sql("SELECT DISTINCT CAST(quality AS BIGINT) AS grp, node FROM pois JOIN poi_nodes USING (poi)", 1500), _MATRIX_SQL,
        body="SELECT node, rank_no, max(distance - dist) AS remaining FROM reach JOIN matrix ON quality = grp WHERE distance >= dist GROUP BY 1, 2", recursive=True,
    ),
)
def t2_node_reaches(spark, d):
    pois = _pois(spark, d).join(_snap(spark, d, _pois(spark, d), "poi"), "poi")
    return isochrone.reaches(_edges(spark, d), pois, spark.createDataFrame(_MATRIX, "quality long, distance long, rank_no int"))


@query("t4_exact_edges")
def t4_exact_edges(spark, d):
    """Edges cut where each level's reach ends; rows only, as the cut nodes' ids are of the engine's making."""
    reach = t2_node_reaches(spark, d)
    edges = _edges(spark, d).select((F.col("u") * 1_000_000 + F.col("v")).alias("edge"), "u", "v", "len")
    _, out = isochrone.exact(edges, reach, 3, 10_000_000)
    return out


#: Places of five nodes along a street by person, and the first node of the group that each falls into within 30 m.
_ALONG = [([0, 10, 19, 40, 65], [0, 0, 0, 3, 3]), ([0, 30, 60, 90, 120], [0, 0, 2, 2, 4]), ([0, 0, 0, 29, 31], [0, 0, 0, 3, 3])]
_FIRST = "CASE person % 3 " + " ".join(f"WHEN {k} THEN CASE j " + " ".join(f"WHEN {j} THEN {t}" for j, t in enumerate(targets)) + " END" for k, (_, targets) in enumerate(_ALONG)) + " END"


@query("g2_linkage_rounds", with_layers(SIDE, PEOPLE, body=f"SELECT person * 8 + j AS id, person * 8 + {_FIRST} AS target FROM people CROSS JOIN unnest([0, 1, 2, 3, 4]) AS t(j)"))
def g2_linkage_rounds(spark, d):
    """Complete linkage by rounds of mutual nearest neighbours: groups of nodes of each person's street at most 30 m wide, with ties and repeated points."""
    people = layer(spark, d, SIDE, PEOPLE, name="people").select("person", "x", "y")
    at = F.element_at(F.create_map(*(v for k, (places, _) in enumerate(_ALONG) for v in (F.lit(k), F.array(*map(F.lit, places))))), (F.col("person") % 3).cast("int"))
    nodes = people.select("person", "x", "y", F.posexplode(at).alias("j", "dx")).select((F.col("person") * 8 + F.col("j")).alias("id"), (F.col("x") + F.col("dx")).cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("person").alias("component"))
    return graph.linked(nodes, 30.0, max_task=0)


@query("g3_contract_short")
def g3_contract_short(spark, d):
    """Nodes after short edges are contracted; rows only (complete linkage)."""
    nodes, _ = graph.simplify(_nodes(spark, d), _edges(spark, d), 55)
    return nodes


_RING = "POLYGON ((150 120, 1020 240, 860 910, 500 420, 130 760, 150 120))"
_POINTS = [(150, 120), (1020, 240), (860, 910), (500, 420), (130, 760), (150, 120)]
_CROSS = " + ".join(f"CASE WHEN ({ay} > y) != ({by} > y) AND x < CAST({bx - ax} AS DOUBLE) * (y - {ay}) / {by - ay} + {ax} THEN 1 ELSE 0 END" for (ax, ay), (bx, by) in zip(_POINTS, _POINTS[1:], strict=False))


@query("x10_points_in_polygon", with_layers(SIDE, PEOPLE, body=f"SELECT person FROM people WHERE ({_CROSS}) % 2 = 1"))
def x10_points_in_polygon(spark, d):
    ring = geometry.points_of(F.lit(_RING))
    box = "x BETWEEN 130 AND 1020 AND y BETWEEN 120 AND 910"
    return _people(spark, d).filter(box).filter(geometry.contains(ring, F.col("x").cast("double"), F.col("y").cast("double"))).select("person")


@query(
    "x1_area_length",
    with_layers(SIDE, NODES, body="""SELECT a.id, round(abs((a.x * b.y - b.x * a.y) + (b.x * c.y - c.x * b.y) + (c.x * a.y - a.x * c.y)) / CAST(2 AS DOUBLE), 4) AS area,
  round(sqrt(CAST((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) AS DOUBLE)) + sqrt(CAST((c.x - b.x) * (c.x - b.x) + (c.y - b.y) * (c.y - b.y) AS DOUBLE)), 4) AS length
FROM nodes a JOIN nodes b ON b.id = a.id + 1 JOIN nodes c ON c.id = a.id + 2"""),
)
def x1_area_length(spark, d):
    """Triangles of consecutive nodes by way of WKT: area of the ring, length of the open line."""
    n = _nodes(spark, d)
    side = lambda s, k: n.select((F.col("id") - k).alias("id"), F.concat_ws(" ", F.col("x"), F.col("y")).alias(s))
    t = side("a", 0).join(side("b", 1), "id").join(side("c", 2), "id")
    ring = geometry.points_of(F.concat(F.lit("POLYGON (("), F.concat_ws(", ", "a", "b", "c", "a"), F.lit("))")))
    line = geometry.points_of(F.concat(F.lit("LINESTRING ("), F.concat_ws(", ", "a", "b", "c"), F.lit(")")))
    return t.select("id", F.round(F.abs(geometry.signed_area(ring)), 4).alias("area"), F.round(geometry.length(line), 4).alias("length"))


@query(
    "x4_web_mercator",
    with_layers(SIDE, PEOPLE, body="""SELECT person, round(radians(x * CAST(1.5 AS DOUBLE) / n) * 6378137, 3) AS mx, round(ln(tan(pi() / 4 + radians(y * CAST(0.8 AS DOUBLE) / n) / 2)) * 6378137, 3) AS my FROM people CROSS JOIN side"""),
)
def x4_web_mercator(spark, d):
    """All people, their coordinates as shares of 150 and 80 degrees."""
    p = _people(spark, d).crossJoin(F.broadcast(layer(spark, d, SIDE, name="side")))  # one row
    m = crs.web_mercator(F.col("x") * F.lit(1.5) / F.col("n"), F.col("y") * F.lit(0.8) / F.col("n"))
    return p.select("person", m.alias("m")).select("person", F.round("m.x", 3).alias("mx"), F.round("m.y", 3).alias("my"))


@query(
    "c1_multires_fill",
    """SELECT n_regionkey, n_nationkey, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS cents, round(max(r) / CAST(max(k) AS DOUBLE), 4) AS suppliers FROM nation JOIN customer ON c_nationkey = n_nationkey
JOIN (SELECT n_regionkey, count(*) AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) USING (n_regionkey)
JOIN (SELECT n_regionkey, count(*) AS k FROM nation GROUP BY 1) USING (n_regionkey) GROUP BY 1, 2""",
)
def c1_multires_fill(spark, d):
    """Region, nation, customer: money goes up from customers, supplier counts come down from regions."""
    nation = table(spark, d, "nation").select("n_regionkey", "n_nationkey")
    per_region = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.count("*").alias("suppliers"))
    money = table(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.round(F.col("c_acctbal") * 100).cast("long").alias("cents"))
    _, filled, _ = multires.fill([per_region, nation, money], ["n_regionkey", "n_nationkey", ""], {"cents": "sum", "suppliers": "sum"})
    return filled.filter("cents IS NOT NULL AND suppliers IS NOT NULL").select("n_regionkey", "n_nationkey", "cents", F.round("suppliers", 4).alias("suppliers"))


@query(
    "j4_census_join",
    """SELECT a.n_nationkey AS GEOID, a.n_name AS NAME, n FROM nation a JOIN (SELECT n_nationkey, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) b
ON a.n_nationkey = b.n_nationkey AND a.n_name = b.n_name""",
)
def j4_census_join(spark, d):
    nation = table(spark, d, "nation")
    shapes = nation.select(F.col("n_nationkey").cast("string").alias("GEOID20"), F.col("n_name").alias("NAME")).withColumnRenamed("GEOID20", "GEOID")
    counts = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_nationkey").alias("GEOID"), F.col("n_name").alias("NAME")).agg(F.count("*").alias("n"))
    return census.join_shapes(shapes, counts).select(F.col("GEOID").cast("int").alias("GEOID"), "NAME", "n")


@query("a11_block_rollup", "SELECT substr(CAST(o_orderkey + 100000 AS VARCHAR), 1, 3) AS GEOID, count(*) AS n FROM orders GROUP BY 1")
def a11_block_rollup(spark, d):
    blocks = table(spark, d, "orders").select((F.col("o_orderkey") + 100000).cast("string").alias("code"), F.lit(1).cast("long").alias("n"))
    return census.roll_up_blocks(blocks, "code", 3, ["n"])


@query("j5_outer_join_sources", """SELECT coalesce(a.k, b.k) AS GEOID, orders, suppliers FROM (SELECT o_custkey AS k, count(*) AS orders FROM orders GROUP BY 1) a
FULL JOIN (SELECT s_suppkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1) b ON a.k = b.k""")
def j5_outer_join_sources(spark, d):
    """Counts of two sources by key, keys of either kept."""
    a = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("GEOID")).agg(F.count("*").alias("orders"))
    b = table(spark, d, "supplier").groupBy(F.col("s_suppkey").alias("GEOID")).agg(F.count("*").alias("suppliers"))
    return census.outer_join([a, b], ["GEOID"])


@query("z1_service_intensity", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def z1_service_intensity(spark, d):
    return intensity(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("w9_partition_mean", "SELECT l_orderkey, l_linenumber, round(l_quantity - avg(l_quantity) OVER (PARTITION BY l_orderkey), 6) AS off, l_quantity - lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS diff FROM lineitem")
def w9_partition_mean(spark, d):
    mean = F.avg("l_quantity").over(Window.partitionBy("l_orderkey"))
    before = F.lag("l_quantity").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") - mean, 6).alias("off"), (F.col("l_quantity") - before).alias("diff"))
