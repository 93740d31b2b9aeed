"""Queries on the derived layers, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfield.functions import hexgrid, scoring
from wayfield.operators import isochrone
from wayfield.operators.spatial import nearest, within
from wayfield.operators.sssp import bounded_distances
from wayfield.plans.layers import EDGES, NODES, PEOPLE, POIS, RASTER, SIDE, STOPS, layer, with_layers
from wayfield.plans.registry import query, table

LEVELS = [(1000, "walk"), (2500, "bike"), (10000, "bus/car")]
GRID = 100


def _nodes(spark, d):
    return layer(spark, d, SIDE, NODES, name="nodes")


def _edges(spark, d):
    return layer(spark, d, SIDE, NODES, EDGES, name="edges")


def _pois(spark, d):
    return layer(spark, d, SIDE, POIS, name="pois")


def _people(spark, d):
    return layer(spark, d, SIDE, PEOPLE, name="people")


def _snap(spark, d, points, key):
    near = nearest(points.select(F.col(key).alias("pid"), "x", "y"), _nodes(spark, d).select(F.col("id").alias("tid"), "x", "y"), GRID)
    return near.select(F.col("pid").alias(key), F.col("tid").alias("node"), "d2")


SNAP = """{out} AS (
  SELECT {key}, arg_min(id, (d2, id)) AS node, min(d2) AS d2 FROM (
    SELECT {key}, id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM {points} a CROSS JOIN nodes b
  ) GROUP BY {key}
)"""
SNAP_POIS = SNAP.format(out="poi_nodes", key="poi", points="pois")
SNAP_PEOPLE = SNAP.format(out="people_nodes", key="person", points="people")
ARCS = "arcs AS (SELECT u, v, len FROM edges UNION ALL SELECT v, u, len FROM edges)"


def reach_sql(sources: str, cutoff: int) -> str:
    return f"""reach(grp, node, dist) USING KEY (grp, node) AS (
  SELECT grp, node, CAST(0 AS BIGINT) FROM ({sources})
  UNION
  SELECT grp, node, min(dist) FROM (
    SELECT r.grp, a.v AS node, r.dist + a.len AS dist FROM reach r JOIN arcs a ON r.node = a.u
    LEFT JOIN recurring.reach k ON k.grp = r.grp AND k.node = a.v
    WHERE r.dist + a.len <= {cutoff} AND (k.dist IS NULL OR r.dist + a.len < k.dist)
  ) GROUP BY grp, node
)"""


def level_of(dist):
    out = F.lit(None).cast("string")
    for cutoff, name in reversed(LEVELS):
        out = F.when(dist <= cutoff, name).otherwise(out)
    return out


LEVEL_SQL = "CASE " + " ".join(f"WHEN dist <= {c} THEN '{n}'" for c, n in LEVELS) + " END"

_WALK = (SIDE, NODES, EDGES, POIS, PEOPLE, SNAP_POIS, SNAP_PEOPLE, ARCS)


@query(
    "m0_iso_stats",
    with_layers(
        *_WALK,
        reach_sql("SELECT DISTINCT CAST(1 AS BIGINT) AS grp, node FROM poi_nodes", 10000),
        f"served AS (SELECT {LEVEL_SQL} AS accessibility, population FROM people JOIN people_nodes USING (person) LEFT JOIN reach USING (node))",
        body="""SELECT coalesce(accessibility, CASE WHEN g = 1 THEN 'total population' ELSE 'none' END) AS accessibility, population,
  round(100.0 * population / max(population) OVER (), 2) AS percent
FROM (SELECT accessibility, CAST(sum(population) AS BIGINT) AS population, grouping(accessibility) AS g FROM served GROUP BY ROLLUP (accessibility))""",
        recursive=True,
    ),
)
def m0_iso_stats(spark, d):
    """Population by the best service level that its street node reaches, and the total."""
    pois = _snap(spark, d, _pois(spark, d), "poi")
    people = _people(spark, d).join(_snap(spark, d, _people(spark, d), "person"), "person")
    reach = bounded_distances(_edges(spark, d), pois.select(F.lit(1).cast("long").alias("grp"), "node"), LEVELS[-1][0])
    served = people.join(reach, "node", "left").select(level_of(F.col("dist")).alias("accessibility"), "population")
    totals = served.rollup("accessibility").agg(F.sum("population").alias("population"), F.grouping("accessibility").alias("g"))
    name = F.coalesce("accessibility", F.when(F.col("g") == 1, "total population").otherwise("none"))
    whole = F.max("population").over(Window.partitionBy())
    return totals.select(name.alias("accessibility"), "population", F.round(100.0 * F.col("population") / whole, 2).alias("percent"))


@query(
    "t3_isochrone_nodes",
    with_layers(
        SIDE, NODES, EDGES, POIS, SNAP_POIS, ARCS,
        reach_sql("SELECT DISTINCT CAST(quality AS BIGINT) AS grp, node FROM pois JOIN poi_nodes USING (poi)", 1500),
        body="""SELECT node, max(least(grp, 1000) - CASE WHEN dist <= 500 THEN 0 WHEN dist <= 1000 THEN 250 ELSE 500 END) AS accessibility,
  max(1500 - dist) AS remaining FROM reach GROUP BY node""",
        recursive=True,
    ),
)
def t3_isochrone_nodes(spark, d):
    """Best value per node over qualities and distance steps: one search per quality, then a join-free maximum."""
    pois = _pois(spark, d).join(_snap(spark, d, _pois(spark, d), "poi"), "poi")
    reach = bounded_distances(_edges(spark, d), pois.select(F.col("quality").cast("long").alias("grp"), "node"), 1500)
    step = F.when(F.col("dist") <= 500, 0).when(F.col("dist") <= 1000, 250).otherwise(500)
    return reach.groupBy("node").agg(F.max(F.least("grp", F.lit(1000).cast("long")) - step).alias("accessibility"), F.max(1500 - F.col("dist")).alias("remaining"))


@query(
    "t5_edge_accessibility",
    with_layers(
        SIDE, NODES, EDGES, POIS, SNAP_POIS, ARCS,
        reach_sql("SELECT DISTINCT CAST(1 AS BIGINT) AS grp, node FROM poi_nodes", 2500),
        f"""ranks AS (SELECT node, CASE WHEN dist < 1000 THEN 0 WHEN dist < 2500 THEN 1 ELSE 2 END AS rank_no,
  1000 - dist AS rem0, 2500 - dist AS rem1 FROM reach)""",
        body="""SELECT e.u, e.v, CAST(least(coalesce(a.rank_no, 2), coalesce(b.rank_no, 2),
  CASE WHEN greatest(coalesce(a.rem0, 0), 0) + greatest(coalesce(b.rem0, 0), 0) > e.len THEN 0
       WHEN greatest(coalesce(a.rem1, 0), 0) + greatest(coalesce(b.rem1, 0), 0) > e.len THEN 1 ELSE 2 END) AS INT) AS rank_no
FROM edges e LEFT JOIN ranks a ON a.node = e.u LEFT JOIN ranks b ON b.node = e.v""",
        recursive=True,
    ),
)
def t5_edge_accessibility(spark, d):
    """Edge label: the best of both ends' labels and of what both ends' reaches cover together."""
    pois = _snap(spark, d, _pois(spark, d), "poi").select(F.lit(1).cast("long").alias("quality"), "node")
    edges = _edges(spark, d).withColumn("edge", F.col("u") * 1_000_000 + F.col("v"))
    reach = isochrone.reaches(edges, pois, isochrone.list_matrix(spark, [1000, 2500]))
    return isochrone.edge_labels(edges, reach, 2).select("u", "v", F.coalesce("rank_no", F.lit(2)).alias("rank_no"))


@query("j9_nearest_node", with_layers(SIDE, NODES, PEOPLE, SNAP_PEOPLE, body="SELECT person, node, d2 FROM people_nodes"))
def j9_nearest_node(spark, d):
    return _snap(spark, d, _people(spark, d), "person")


@query(
    "t6_within_distance",
    with_layers(SIDE, POIS, PEOPLE, body="""SELECT person, min(CASE WHEN d2 <= 62500 THEN 0 WHEN d2 <= 250000 THEN 1 ELSE 2 END) AS rank_no, count(*) AS n_pois FROM (
  SELECT person, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM people a CROSS JOIN pois b) WHERE d2 <= 1000000 GROUP BY person"""),
)
def t6_within_distance(spark, d):
    """Buffers as a predicate: best ring per person, by a grid-cell join."""
    near = within(_people(spark, d), _pois(spark, d).select(F.col("poi").alias("tid"), "x", "y"), 1000)
    ring = F.when(F.col("d2") <= 62500, 0).when(F.col("d2") <= 250000, 1).otherwise(2)
    return near.groupBy("person").agg(F.min(ring).alias("rank_no"), F.count("*").alias("n_pois"))


HEX = hexgrid.edge(700.0, 1)
HEX_PARENT = 700.0
_Q, _R = hexgrid.cell_sql("x", "y", HEX)


@query(
    "h1_hex_population",
    with_layers(SIDE, PEOPLE, body=f"SELECT {_Q} AS q, {_R} AS r, CAST(sum(population) AS BIGINT) AS population, count(*) AS n FROM people GROUP BY 1, 2"),
)
def h1_hex_population(spark, d):
    cell = hexgrid.cell(F.col("x"), F.col("y"), HEX)
    return _people(spark, d).select(cell.alias("c"), "population").groupBy("c").agg(F.sum("population").alias("population"), F.count("*").alias("n")).select("c.q", "c.r", "population", "n")


_PX, _PY = f"(CAST({HEX!r} AS DOUBLE) * (CAST({hexgrid.ROOT3!r} AS DOUBLE) * q + CAST({hexgrid.ROOT3 / 2!r} AS DOUBLE) * r))", f"(CAST({HEX * 1.5!r} AS DOUBLE) * r)"
_PQ, _PR = hexgrid.cell_sql(_PX, _PY, HEX_PARENT)


@query(
    "a5_hex_resample",
    with_layers(SIDE, PEOPLE, f"cells AS (SELECT {_Q} AS q, {_R} AS r, CAST(sum(population) AS BIGINT) AS population FROM people GROUP BY 1, 2)",
                body=f"SELECT {_PQ} AS q, {_PR} AS r, CAST(sum(population) AS BIGINT) AS population FROM cells GROUP BY 1, 2"),
)
def a5_hex_resample(spark, d):
    cells = h1_hex_population(spark, d)
    up = hexgrid.parent(F.col("q"), F.col("r"), HEX, HEX_PARENT)
    return cells.select(up.alias("c"), "population").groupBy("c").agg(F.sum("population").alias("population")).select("c.q", "c.r", "population")


@query("u2_symmetric_closure", with_layers(SIDE, NODES, EDGES, body="SELECT u, v FROM edges UNION SELECT v, u FROM edges"))
def u2_symmetric_closure(spark, d):
    e = _edges(spark, d).select("u", "v")
    return e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


@query(
    "w5_cumulative_length",
    with_layers(SIDE, NODES, EDGES, body="SELECT u, v, CAST(sum(len) OVER (PARTITION BY u ORDER BY v ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM edges"),
)
def w5_cumulative_length(spark, d):
    """Length so far along the streets that leave a node, in the order of their other ends."""
    w = Window.partitionBy("u").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    return _edges(spark, d).select("u", "v", F.sum("len").over(w).alias("run"))


@query(
    "w12_headway",
    with_layers(STOPS, body="""SELECT stop, mode, day, round(avg(gap), 4) AS headway, count(gap) AS n FROM (
  SELECT stop, mode, day, CAST(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY stop, mode, day ORDER BY ts, event_id)) AS DOUBLE) / 60000000 AS gap FROM stops) GROUP BY 1, 2, 3"""),
)
def w12_headway(spark, d):
    """Minutes between successive departures per stop, mode and day."""
    w = Window.partitionBy("stop", "mode", "day").orderBy("ts", "event_id")
    s = layer(spark, d, STOPS, name="stops").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    gaps = s.withColumn("gap", (F.col("us") - F.lag("us").over(w)).cast("double") / 60000000)
    return gaps.groupBy("stop", "mode", "day").agg(F.round(F.avg("gap"), 4).alias("headway"), F.count("gap").alias("n"))


@query(
    "w11_best_per_key",
    "SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) WHERE k = 1",
)
def w11_best_per_key(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, d, "customer").withColumn("k", F.row_number().over(w)).filter("k = 1").select("c_nationkey", "c_custkey", "c_acctbal")


@query("u6_unpivot", "SELECT s_suppkey, 'acctbal' AS name, s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS DOUBLE) FROM supplier")
def u6_unpivot(spark, d):
    wide = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("acctbal"), F.col("s_nationkey").cast("double").alias("nation"))
    return wide.unpivot("s_suppkey", ["acctbal", "nation"], "name", "value")


@query("u7_pivot", "SELECT c_nationkey, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS building, count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS machinery FROM customer GROUP BY 1")
def u7_pivot(spark, d):
    wide = table(spark, d, "customer").groupBy("c_nationkey").pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).count()
    return wide.select("c_nationkey", *(F.coalesce(F.col(s), F.lit(0)).cast("long").alias(s.lower()) for s in ("BUILDING", "MACHINERY")))


@query("t1_distance_matrix", with_layers(
    SIDE, POIS,
    "a AS (SELECT q, row_number() OVER (ORDER BY q DESC) - 1 AS i, count(*) OVER () AS nq FROM (SELECT DISTINCT quality AS q FROM pois))",
    "b AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS j, count(*) OVER () AS nd FROM (SELECT DISTINCT CAST((floor(l_quantity / 10) + 1) * 250 AS INT) AS d FROM lineitem))",
    body="SELECT q / CAST(1000 AS DOUBLE) AS poi_quality, d AS distance, round(greatest(0, 1 - (i + j) / CAST(nq + nd - 1 AS DOUBLE)), 3) AS value FROM a CROSS JOIN b",
))
def t1_distance_matrix(spark, d):
    """The standard matrix over the qualities that places have and the steps that quantities reach."""
    qualities = [r["q"] / 1000 for r in _pois(spark, d).select(F.col("quality").alias("q")).distinct().collect()]
    step = ((F.floor(F.col("l_quantity") / 10) + 1) * 250).cast("int").alias("d")
    return isochrone.default_matrix(spark, qualities, sorted(r["d"] for r in table(spark, d, "lineitem").select(step).distinct().collect()))


@query("q1_elasticity_score", "SELECT l_orderkey, l_linenumber, round(pow(l_quantity / CAST(10 AS DOUBLE), CAST(-0.35 AS DOUBLE)), 6) AS score FROM lineitem")
def q1_elasticity_score(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(scoring.elasticity_score(F.col("l_quantity"), 10, -0.35), 6).alias("score"))


@query("q2_calibrated_score", "SELECT l_orderkey, l_linenumber, round((pow(l_quantity / CAST(10 AS DOUBLE), CAST(-0.35 AS DOUBLE)) - pow(CAST(50 AS DOUBLE) / 10, CAST(-0.35 AS DOUBLE))) / (pow(CAST(1 AS DOUBLE) / 10, CAST(-0.35 AS DOUBLE)) - pow(CAST(50 AS DOUBLE) / 10, CAST(-0.35 AS DOUBLE))), 6) AS score FROM lineitem")
def q2_calibrated_score(spark, d):
    f = scoring.calibrated(lambda v: scoring.elasticity_score(v.cast("double"), 10, -0.35), (50,), (1,))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(f(F.col("l_quantity")), 6).alias("score"))


@query("q6_score_by_values", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN CAST(1.0 AS DOUBLE) WHEN 'MACHINERY' THEN CAST(0.667 AS DOUBLE) WHEN 'HOUSEHOLD' THEN CAST(0.333 AS DOUBLE) END AS score FROM customer")
def q6_score_by_values(spark, d):
    return table(spark, d, "customer").select("c_custkey", scoring.by_values(F.col("c_mktsegment"), ["BUILDING", "MACHINERY", "HOUSEHOLD"]).alias("score"))


@query("j16_grid_snap", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 5 THEN 5 WHEN l_quantity <= 15 THEN 15 WHEN l_quantity <= 40 THEN 40 END::DOUBLE AS grid FROM lineitem")
def j16_grid_snap(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scoring.grid_ceiling(F.col("l_quantity"), [5, 15, 40]).alias("grid"))
