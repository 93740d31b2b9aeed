"""Graph, geometry, projection, source and hierarchy operators on hand-made cases."""

import math

from pyspark.sql import functions as F

from wayfield.functions import crs, geometry, hexgrid, scoring
from wayfield.operators import census, graph, isochrone, multires
from wayfield.operators.components import components
from wayfield.sources import files, osm
from wayfield.streaming.windows import intensity, sessions


def test_short_edges_contract_and_parallel_ones_go(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 4.0, 0.0), (3, 100.0, 0.0), (4, 50.0, 50.0)], "id long, x double, y double")
    edges = spark.createDataFrame([(1, 2, 0, 4.0), (2, 3, 0, 96.0), (1, 3, 0, 100.0), (3, 4, 0, 71.0), (4, 4, 0, 9.0)], "u long, v long, key_no int, len double")
    got_nodes, got_edges = graph.simplify(nodes, edges, 5.0)
    assert {tuple(r) for r in got_nodes.collect()} == {(1, 2.0, 0.0), (3, 100.0, 0.0), (4, 50.0, 50.0)}
    assert {(r.u, r.v, r.len) for r in got_edges.collect()} == {(1, 3, 96.0), (3, 4, 71.0)}


def test_complete_linkage_splits_a_long_chain():
    import pandas as pd

    chain = pd.DataFrame({"id": [1, 2, 3, 4], "x": [0.0, 5.0, 10.0, 15.0], "y": [0.0] * 4, "component": [1] * 4})
    got = graph._complete_linkage(10.0)(chain).set_index("id")["target"].to_dict()
    assert len(set(got.values())) == 2


def test_linkage_by_rounds_equals_that_in_one_task(spark):
    """Clumps, a lattice full of ties, repeated points, a line of ever shorter gaps, and a component of two; ``max_task`` decides the way, never the groups."""
    import random

    rng = random.Random(3)
    clumps = [(k, rng.gauss(40.0 * (k % 7), 6), rng.gauss(0, 9), 1) for k in range(260)]
    lattice = [(1000 + k, 3.0 * (k % 12), 3.0 * (k // 12), 2) for k in range(144)]
    repeated = [(2000 + k, float(k % 5 // 2), 0.0, 3) for k in range(90)]
    line = [(3000 + k, sum((9.0 - 0.5 * j for j in range(k)), 0.0), 0.0, 4) for k in range(16)]
    rng.shuffle(rows := [*clumps, *lattice, *repeated, *line, (4000, 0.0, 0.0, 5), (4001, 500.0, 0.0, 5), (-8, 2.0, 2.0, 6)])
    points = spark.createDataFrame(rows, "id long, x double, y double, component long")
    for limit, bounds in ((10.0, (100, 0)), (0.0, (0,))):
        want, *others = ({r.id: r.target for r in graph.linked(points, limit, n).collect()} for n in (100_000, *bounds))
        assert len(want) == len(rows) and all(o == want for o in others), limit
        assert want[4001] == 4000


def test_ways_become_edges(spark):
    at = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0), (3, 3.0, 10.0), (9, 1.0, 1.0)], "id long, x double, y double")
    ways = spark.createDataFrame([(7, [1, 2, 3])], "way long, nodes array<long>")
    nodes, edges = graph.from_ways(ways, at)
    assert {r.id for r in nodes.collect()} == {1, 2, 3} and {(r.u, r.v, r.len) for r in edges.collect()} == {(1, 2, 5.0), (2, 3, 6.0)}


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(10, 30)] + [(5, 6)], "u long, v long")
    assert {tuple(r) for r in components(edges).collect()} == {(i, 10) for i in range(10, 31)} | {(5, 5), (6, 5)}


def test_exact_cuts_of_one_edge(spark):
    edges = spark.createDataFrame([(1, 1, 2, 100)], "edge long, u long, v long, len long")
    pois = spark.createDataFrame([(1, 1)], "quality long, node long")
    for limits, want in (([30], [(30.0, 0), (70.0, None)]), ([60, 150], [(60.0, 0), (40.0, 1)])):
        reach = isochrone.reaches(edges, pois, isochrone.list_matrix(spark, limits))
        cuts, parts = isochrone.exact(edges, reach, len(limits), 10)
        assert sorted((r.len, r.rank_no) for r in parts.collect()) == sorted(want, key=lambda x: x[0])
        assert cuts.count() == 1 and sum(r.len for r in parts.collect()) == 100


def test_snaps_near_ends_are_dropped_and_near_ones_merge(spark):
    snaps = spark.createDataFrame([(1, 2.0, 100.0), (1, 48.0, 100.0), (1, 52.0, 100.0), (1, 99.0, 100.0)], "edge long, pd double, len double")
    assert sorted(r.cut for r in graph.merge_snaps(snaps, 10.0).collect() if r.cut is not None) == [50.0, 50.0]


def test_geometry(spark):
    one = spark.range(1).select(geometry.points_of(F.lit("POLYGON ((0 0, 4 0, 4 3, 0 3, 0 0))")).alias("p"), geometry.points_of(F.lit("LINESTRING (0 0, 3 4, 3 10)")).alias("l"))
    r = one.select(
        geometry.signed_area(F.col("p")).alias("area"), geometry.centroid(F.col("p")).alias("c"), geometry.length(F.col("l")).alias("len"),
        geometry.interpolate(F.col("l"), F.lit(8.0)).alias("i"), geometry.project(F.col("l"), F.lit(5.0), F.lit(6.0)).alias("pr"),
        geometry.contains(F.col("p"), F.lit(1.0), F.lit(1.0)).alias("in_"), geometry.contains(F.col("p"), F.lit(5.0), F.lit(1.0)).alias("out_"),
        geometry.bbox(F.col("p")).alias("b"), geometry.linestring(F.col("l")).alias("w"),
    ).first()
    assert r.area == 12 and tuple(r.c) == (2, 1.5) and r.len == 11 and tuple(r.i) == (3, 7) and tuple(r.pr) == (4, 7) and r.in_ and not r.out_
    assert tuple(r.b) == (0, 0, 4, 3) and r.w == "LINESTRING (0.0 0.0, 3.0 4.0, 3.0 10.0)"


def test_utm_round_trip_and_a_control_value(spark):
    places = spark.createDataFrame([(-3.7038, 40.4168), (151.2093, -33.8688), (3.0, 0.0), (10.9, 64.0)], "lon double, lat double").withColumn("z", crs.utm_zone(F.col("lon")))
    back = places.withColumn("m", crs.to_utm(F.col("lon"), F.col("lat"), F.col("z"))).withColumn("b", crs.from_utm(F.col("m.x"), F.col("m.y"), F.col("z"), F.col("lat") < 0)).collect()
    assert all(math.isclose(r.b.lon, r.lon, abs_tol=1e-9) and math.isclose(r.b.lat, r.lat, abs_tol=1e-9) for r in back)
    assert math.isclose(back[2].m.x, 500000, abs_tol=1e-3) and math.isclose(back[2].m.y, 0, abs_tol=1e-3)


def test_hexagons_hold_their_centres(spark):
    cells = spark.range(-20, 20).select(F.col("id").alias("q"), (F.col("id") * 3 % 7).alias("r"))
    got = cells.select("q", "r", hexgrid.cell(*hexgrid.centre(F.col("q"), F.col("r"), 100.0), 100.0).alias("c")).collect()
    assert all((r.q, r.r) == tuple(r.c) for r in got)


def test_scores(spark):
    assert [r.value for r in isochrone.default_matrix(spark, [1.0, 0.8, 0.6, 0.4, 0.2], [250, 500, 750, 1000]).orderBy(F.desc("poi_quality"), "distance").collect()] == [1 - (i + j) / 8 for i in range(5) for j in range(4)]
    f = scoring.calibrated(lambda v: scoring.elasticity_score(v.cast("double"), 10, -0.35), (720,), (5,))
    r = spark.range(1).select(scoring.elasticity_score(F.lit(10.0), 10, -0.35).alias("one"), f(F.lit(720)).alias("low"), f(F.lit(5)).alias("high")).first()
    assert (r.one, r.low, r.high) == (1.0, 0.0, 1.0) and scoring.elasticity_from_linear_decay(0.5, 1.0) == -1.0


def test_hierarchy_goes_up_and_down(spark):
    top, mid = spark.createDataFrame([("a", 12.0)], "t string, s double"), spark.createDataFrame([("a", "x"), ("a", "y"), (None, "z")], "t string, m string")
    low = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "m string, v long")
    t, m, leaf = multires.fill([top, mid, low], ["t", "m", ""], {"v": "sum", "s": "sum"})
    assert t.first().v == 6 and {(r.m, r.v, r.s) for r in m.collect()} == {("x", 3, 6.0), ("y", 3, 6.0), ("z", None, None)} and sum(r.s for r in leaf.collect()) == 12


def test_census_names():
    assert census.pick_geoid(["NAME", "GEOID10", "GEOID20"]) == "GEOID20" and census.pick_geoid(["A"]) is None
    assert census.field_name("x_density_log_ratio") == "x"


def test_places_and_networks(spark, tmp_path):
    (tmp_path / "a.osm").write_text(
        '<osm><node id="1" lon="1.5" lat="2.5"><tag k="amenity" v="school"/></node><node id="2" lon="1" lat="2"/>'
        '<way id="7"><nd ref="1"/><nd ref="2"/><tag k="highway" v="footway"/></way><way id="8"><nd ref="2"/><nd ref="1"/><tag k="highway" v="motorway"/></way></osm>'
    )
    nodes, ways = osm.read_xml(spark, str(tmp_path / "a.osm"))
    assert [r.id for r in osm.places(nodes, "schools").collect()] == [1] and osm.places(nodes, "libraries").count() == 0
    assert [r.way for r in osm.network(ways, "walk").collect()] == [7] and [r.way for r in osm.network(ways, "drive").collect()] == [8]
    assert nodes.filter(osm.tag_filter({"amenity": ["school", "library"], "shop": True})).count() == 1


def test_files(spark, tmp_path):
    layer = spark.createDataFrame([(1, 1.0, 2.0), (2, 9.0, 9.0)], "id long, x double, y double")
    files.save(spark, f"file://{tmp_path}/net", "StreetNetwork", {"nodes": layer}, {"srid": 32630})
    tables, attributes = files.load(spark, f"file://{tmp_path}/net", "StreetNetwork")
    assert tables["nodes"].count() == 2 and attributes == {"srid": 32630}
    assert [r.id for r in files.read_box(spark, f"file://{tmp_path}/net/nodes", (0, 0, 5, 5)).collect()] == [1]
    (tmp_path / "g.asc").write_text("ncols 2\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 10\nNODATA_value -9\n1 2\n-9 4\n")
    cells, header = files.read_ascii_grid(spark, str(tmp_path / "g.asc"))
    assert {tuple(r) for r in cells.collect()} == {(0, 0, 1.0), (0, 1, 2.0), (1, 1, 4.0)} and header["cellsize"] == 10


def test_streams(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,10 * id) AS ts, id % 2 AS user_id, 'view' AS event_type FROM range(12)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = intensity(stream, "1 hour").writeStream.format("memory").queryName("seen").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("seen").collect()) == [6, 6]
    assert sorted(r.n for r in sessions(rows, "15 minutes").collect()) == [1] * 12


def test_facade(spark, tmp_path):
    from wayfield.facade import AccessibilityAnalyzer, AreaOfInterest, HexGrid, PointsOfInterest, StreetNetwork

    nodes = spark.createDataFrame([(1, 0, 0), (2, 100, 0), (3, 200, 0)], "id long, x long, y long")
    edges = spark.createDataFrame([(1, 2, 0, 100), (2, 3, 0, 100)], "u long, v long, key_no int, len long")
    net, pois = StreetNetwork(nodes, edges), PointsOfInterest(spark.createDataFrame([(7, 1, 1, "b", 9.0)], "pid long, x long, y long, kind string, area double"))
    out = AccessibilityAnalyzer(net, pois, [150, 250]).run()
    assert {tuple(r) for r in out["nodes"].collect()} == {(1, 0), (2, 0), (3, 1), (4, 0)}  # 4 is where the place meets its street
    assert pois.assign_score_by_values("kind", ["a", "b"]).places.first().score == 0.5 and pois.assign_score_by_area("area", [1, 5]).places.first().score == 1.0
    area = AreaOfInterest("POLYGON ((-5 -5, 150 -5, 150 5, -5 5, -5 -5))")
    assert {r.id for r in area.clip(nodes).collect()} == {1, 2}
    net.save(spark, f"file://{tmp_path}/net")
    assert StreetNetwork.load(spark, f"file://{tmp_path}/net").edges.count() == 2
    grid = HexGrid.from_points(nodes.withColumn("v", F.lit(1)), {"v": "sum"}, 100.0, 1)
    assert grid.resample(0, {"v": "sum"}).cells.agg(F.sum("v")).first()[0] == 3 and "v_right" in grid.join(grid).cells.columns


def test_adaptive_grid():
    grid = scoring.adaptive_grid(lambda x: x * x, 0, 1, 0.1)
    assert all(b * b - a * a <= 0.1 for a, b in zip(grid, grid[1:], strict=False))


def test_short_edges_of_a_large_component_contract(spark):
    n = 5000
    nodes = spark.createDataFrame([(i, 10 * i, 0) for i in range(n)], "id long, x long, y long")
    edges = spark.createDataFrame([(i, i + 1, 0, 10) for i in range(n - 1)], "u long, v long, key_no int, len long")
    merged, kept = graph.contract_short(nodes, edges, 10)
    assert sorted((r.id, r.x) for r in merged.collect()) == [(i, 10 * i + 5) for i in range(0, n, 2)]
    assert kept.count() == n // 2 - 1


def test_linkage_is_that_of_the_whole_matrix():
    import numpy as np
    import pandas as pd

    for seed in range(60):
        rng = np.random.default_rng(seed)
        xy = rng.integers(-12, 13, (rng.integers(1, 60), 2)) if seed % 2 else rng.normal(size=(rng.integers(1, 60), 2)) * 9
        groups, limit = [[i] for i in range(len(xy))], 7.0
        while len(xy) != 2:
            far = lambda g, h: max(np.hypot(*(xy[i] - xy[j])) for i in g for j in h)
            best = min(((far(g, h), g[0], h[0], g, h) for k, g in enumerate(groups) for h in groups[k + 1 :]), default=None, key=lambda t: t[:3])
            if best is None or best[0] > limit:
                break
            groups = sorted([g for g in groups if g is not best[3] and g is not best[4]] + [sorted(best[3] + best[4])])
        want = {i: g[0] for g in groups for i in g} if len(xy) != 2 else {0: 0, 1: 0}
        got = graph._complete_linkage(limit)(pd.DataFrame({"id": range(len(xy)), "x": xy[:, 0], "y": xy[:, 1]}))
        assert dict(zip(got["id"], got["target"], strict=True)) == want


def test_components_that_are_stars_take_no_round(spark, monkeypatch):
    from wayfield.operators import components as module

    rounds, stars = [], module._stars
    monkeypatch.setattr(module, "_stars", lambda edges: rounds.append(1) or stars(edges))
    found = lambda rows: {tuple(r) for r in module.components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert found([(2, 1), (1, 3), (3, 1), (7, 5), (9, 9)]) == {(1, 1), (2, 1), (3, 1), (5, 5), (7, 5)} and not rounds
    assert found([]) == set() and not rounds
    assert found([(3, 2), (2, 1)]) == {(1, 1), (2, 1), (3, 1)} and len(rounds) == 1
    assert found([(3, 1), (3, 2)]) == {(1, 1), (2, 1), (3, 1)}


def test_components_are_linked_in_dealt_streams(spark):
    # Components of three nodes, 30 m apart, and of one; no group of rows of its own for each.
    points = spark.range(6000).selectExpr("id", "id % 4 * 30D AS x", "0D AS y", "id div 4 * 10 + IF(id % 4 = 0, 0, 1) AS component")
    got = graph.linked(points, 35.0)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: r["target"] for r in got.collect()} == {i: i - 1 if i % 4 == 2 else i for i in range(6000)}
