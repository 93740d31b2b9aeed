"""Sources, sinks, layers and classes on hand-made cases."""

import json
import math
import random
from heapq import heapify, heappop, heappush

import pytest
from pyspark.sql import functions as F

from wayfield import facade
from wayfield.functions import crs, geometry, scoring, text
from wayfield.operators import census, graph, hexcells, isochrone, multires, population, raster, service, snapping, sssp
from wayfield.operators.sssp import bounded_distances
from wayfield.plans import workflows
from wayfield.sources import files, osm, tiff


def ring(*points):
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points))


def square():
    return ring((0, 0), (10, 0), (10, 10), (0, 10), (0, 0))


@pytest.fixture(scope="module")
def street(spark):
    """A street of 0 - 100 - 200 m with a side street of 50 m at 100."""
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0), (3, 200.0, 0.0), (4, 100.0, 50.0)], "id long, x double, y double")
    edges = spark.createDataFrame([(1, 2, 0, 100), (2, 3, 0, 100), (2, 4, 0, 50)], "u long, v long, key_no int, len long")
    return facade.StreetNetwork(nodes, edges)


def test_searches_carry_labels(spark):
    edges = spark.createDataFrame([(1, 2, 10), (2, 3, 10), (3, 4, 10), (4, 5, 10)], "u long, v long, len long")
    sources = spark.createDataFrame([(1, 1, 7), (1, 5, 3), (1, 9, 2)], "grp long, node long, label long")
    want = {(1, 1, 0, 7), (1, 2, 10, 7), (1, 3, 20, 3), (1, 4, 10, 3), (1, 5, 0, 3), (1, 9, 0, 2)}
    for most in (100, 0):
        assert {tuple(r) for r in bounded_distances(edges, sources, 20, max_broadcast_edges=most).collect()} == want


def test_searches_in_cells(spark, monkeypatch):
    """A grid of streets cut into many cells, by coordinates and by ids, against a plain search; several groups, labels, lone sources."""
    monkeypatch.setattr(sssp, "CELL_NODES", 40)
    monkeypatch.setattr(sssp, "STRETCH", 2)
    rng = random.Random(5)
    side = 12
    edges = [(i * side + j, i * side + j + d, rng.randint(1, 9)) for i in range(side) for j in range(side) for d in (1, side) if (d == 1 and j < side - 1) or (d == side and i < side - 1)]
    edges += [(0, 3, 40), (7, 7, 1), (5, 6, 1)]
    sources = [(g, rng.randint(0, side * side - 1), rng.randint(0, 9)) for g in (1, 1, 1, 2, 1) for _ in range(3)] + [(2, 9999, 4)]
    best = {}
    for g in (1, 2):
        heap = [(0, label, node) for k, node, label in sources if k == g]
        heapify(heap)
        while heap:
            d, label, node = heappop(heap)
            if (g, node) in best:
                continue
            best[g, node] = (d, label)
            for u, v, n in edges:
                for a, b in ((u, v), (v, u)):
                    if a == node and a != b and d + n <= 45:
                        heappush(heap, (d + n, label, b))
    e, s = spark.createDataFrame(edges, "u long, v long, len long"), spark.createDataFrame(sources, "grp long, node long, label long")
    nodes = spark.createDataFrame([(i * side + j, float(j), float(i)) for i in range(side) for j in range(side) if (i, j) != (4, 4)], "id long, x double, y double")
    want = {(g, node, *b) for (g, node), b in best.items()}
    for places in (None, nodes):
        assert {tuple(r) for r in bounded_distances(e, s, 45, 0, places).collect()} == want
    assert {tuple(r) for r in bounded_distances(e, s, 45).collect()} == want
    assert bounded_distances(e, s.limit(0), 45, 0).count() == 0
    assert {tuple(r) for r in bounded_distances(e.limit(0), s.drop("label"), 45, 0).collect()} == {(g, node, 0) for g, node, _ in sources}


def test_near_parallels(spark):
    rows = [(1, 2, 0, 100.0, 0.0, 0.0), (2, 1, 0, 105.0, 3.0, 0.0), (1, 2, 1, 140.0, 30.0, 0.0), (3, 4, 0, 9.0, 0.0, 0.0)]
    edges = spark.createDataFrame(rows, "u long, v long, key_no int, len double, mx double, my double")
    assert {r.len for r in graph.without_near_parallels(edges, 5.0).collect()} == {100.0, 140.0, 9.0}
    assert {r.len for r in graph.without_near_parallels(edges, 40.0).collect()} == {100.0, 9.0}


def test_fill_modes(spark):
    shapes = spark.range(1).select(F.lit(1).alias("k"), ring((-30, -30), (30, -30), (30, 30), (-30, 30), (-30, -30)).alias("ring"))
    cells = {m: {(r.q, r.r) for r in hexcells.fill(shapes, "k", 10.0, m).collect()} for m in hexcells.CONTAIN}
    assert cells["centroid"] == {(0, 0)} and cells["full"] < cells["center"] < cells["overlap"] <= cells["bbox_overlap"] and cells["center_overlap"] == cells["center"]
    small = spark.range(1).select(F.lit(1).alias("k"), ring((5, 5), (6, 5), (6, 6), (5, 6), (5, 5)).alias("ring"))
    assert hexcells.fill(small, "k", 10.0, "center").count() == 0 and hexcells.fill(small, "k", 10.0, "center_overlap").count() == 1
    # brute force: a cell overlaps a box where some point of a fine lattice is in both
    lattice = {(q, r) for q in range(-6, 7) for r in range(-6, 7) if math.hypot(*_nearest_in_box(q, r, 30.0, 10.0)) < 8.6}
    assert lattice <= cells["overlap"]
    q, r = hexcells.from_cell_id(hexcells.cell_id(F.lit(-5).cast("long"), F.lit(7).cast("long")))
    assert tuple(spark.range(1).select(q, r).first()) == (-5, 7)


def _nearest_in_box(q, r, half, size):
    x, y = size * (math.sqrt(3) * q + math.sqrt(3) / 2 * r), 1.5 * size * r
    return x - max(-half, min(half, x)), y - max(-half, min(half, y))


def test_aggregate_methods(spark):
    rows = spark.createDataFrame([(1, [1, 2], 10.0, "b", 1), (2, [2], None, "a", 2), (3, [2, 3], 4.0, "zz", 3), (4, [9], None, None, 4), (5, [], 1.0, "a", 5)], "k int, cells array<long>, v double, s string, place int")
    how = lambda m: {r.cell: r.v for r in hexcells.aggregate(rows, "cells", {"v": m}, place="place").collect()}
    assert how("sum") == {1: 10.0, 2: 14.0, 3: 4.0} and how("mean")[2] == 7.0 and how("first")[2] == 10.0 and how("last")[2] == 4.0 and how("max")[2] == 10.0
    assert how("distribute") == {1: 5.0, 2: 7.0, 3: 2.0}
    labels = {r.cell: r.s for r in hexcells.aggregate(rows, "cells", {"s": "max"}, {"s": ["a", "b"]}).collect()}
    assert labels == {1: "b", 2: "b"}
    whole = spark.createDataFrame([(2.0,), (2.5,)], "v double").select(hexcells.whole_if_integral(F.col("v")).alias("v"))
    assert [r.v for r in whole.collect()] == [2, None]


def test_snapping_adds_nodes(spark, street):
    points = spark.createDataFrame([(1, 30.0, 5.0), (2, 34.0, -5.0), (3, 1.0, 1.0), (4, 130.0, 400.0), (5, None, 1.0)], "pid long, x double, y double")
    network, placed = street.add_points(points, 50.0, 100.0, 10.0)
    got = {r.pid: r.node for r in placed.collect()}
    assert got[1] == got[2] > 4 and got[3] == 1 and set(got) == {1, 2, 3}
    assert network.edges.count() == 4 and network.edges.agg(F.sum("len")).first()[0] == 250
    where = {r.id: (r.x, r.y) for r in network.nodes.collect()}
    assert where[got[1]] == (32.0, 0.0)


def test_isochrone_cuts(spark, street):
    edges = street.edges.withColumn("edge", F.monotonically_increasing_id())
    reach, kept = snapping.isochrone(edges, spark.createDataFrame([(1,)], "node long"), 130, 100)
    assert sorted(r.len for r in kept.collect()) == [30, 30, 100]
    _, whole = snapping.isochrone(edges, spark.createDataFrame([(1,)], "node long"), 130, 100, exact=False)
    assert [r.len for r in whole.collect()] == [100] and reach.count() == 4


def test_analyzer_run_save_and_load(spark, street, tmp_path):
    pois = facade.PointsOfInterest(spark.createDataFrame([(1, 50.0, 3.0)], "pid long, x double, y double"))
    run = facade.AccessibilityAnalyzer(street, pois, [60, 110])
    edges = run.run()["edges"]
    by_rank = {r.rank_no: r.n for r in edges.groupBy("rank_no").agg(F.sum("len").alias("n")).collect()}
    assert by_rank == {0: 120, 1: 90, None: 40}
    assert {(r.node, r.rank_no) for r in run.result["nodes"].filter("node < 5").collect()} == {(1, 0), (2, 0), (4, 1)}
    points = {r.id: (r.x, r.y, r.rank_no) for r in run.result["points"].collect()}
    ends = {i for r in edges.collect() for i in (r.u, r.v)}
    assert ends <= set(points) and all(x is not None and y is not None for x, y, _ in points.values())
    assert len(points) > 5 and {points[n][2] for n in points if n > 5} <= {None, 1}
    assert run.to_hex(10.0, 0).cells.agg(F.min("rank_no")).first()[0] == 0
    run.save(spark, str(tmp_path / "run"))
    again = facade.AccessibilityAnalyzer.load(spark, str(tmp_path / "run"))
    assert again.distances == [60, 110] and again.result["edges"].count() == edges.count() and again.network.nodes.count() == 4
    far = spark.createDataFrame([(1, 55.0, 3.0), (2, 900.0, 0.0)], "pid long, x double, y double")
    assert {(r.pid, r.rank_no) for r in run.run_buffers(far).collect()} == {(1, 0), (2, None)}
    with pytest.raises(TypeError):
        facade.HexGrid.load(spark, str(tmp_path / "run"))


def test_population_layer(spark, street, tmp_path):
    (tmp_path / "g.asc").write_text("ncols 3\nnrows 2\nxllcorner 0\nyllcorner -50\ncellsize 100\nnodata_value -9\n1 2 -9\n4 nan 6\n")
    layer = facade.PopulationLayer.from_ascii_grid(spark, str(tmp_path / "g.asc"))
    assert {tuple(r) for r in layer.cells.collect()} == {(0, 0, 1.0), (0, 1, 2.0), (1, 0, 4.0), (1, 2, 6.0)}
    kept = layer.filter_by_streets(street, 1.0).cells
    assert {(r.row_no, r.col) for r in kept.collect()} == {(0, 1), (1, 0), (1, 2)} or kept.agg(F.sum("value")).first()[0] == pytest.approx(13.0)
    assert layer.to_hex(60.0, 0).cells.agg(F.sum("value")).first()[0] == pytest.approx(13.0)
    offer = spark.createDataFrame([(0, 0, "A")], "row_no long, col long, value string")
    levels = layer.level_of_service(offer, [(0.0, 350.0, "A"), (0.0, 150.0, "B")], ["A", "B"], str(tmp_path / "los"))
    assert {(r.row_no, r.col, r.demand, r.offer, r.difference) for r in levels.collect()} >= {(0, 0, 2, 0, 2), (1, 0, 0, 2, -2), (0, 1, 1, 2, -1)}
    assert {r.layer for r in spark.read.parquet(str(tmp_path / "los")).select("layer").distinct().collect()} >= {"population", "demand", "offer", "difference"}
    layer.save(spark, str(tmp_path / "pop"))
    assert facade.PopulationLayer.load(spark, str(tmp_path / "pop")).where == layer.where


def test_workflows(spark, street, tmp_path):
    places = spark.createDataFrame([(1, 0.0, 1.0, 1), (2, 200.0, 1.0, 2)], "pid long, x double, y double, quality long")
    matrix = spark.createDataFrame([(1, 60, 0), (1, 90, 1), (2, 40, 1)], "quality long, distance long, rank_no int")
    run = workflows.levels_by_matrix(street, facade.PointsOfInterest(places), matrix, save_to=str(tmp_path / "a"))
    assert run.result["edges"].agg(F.sum("len")).first()[0] == 250
    hexes = run.to_hex(50.0, 0)
    people = facade.PopulationLayer.of(spark.createDataFrame([(0, 0, 10.0), (0, 1, 30.0)], "row_no long, col long, value double"), raster.Grid(0.0, -50.0, 100.0, 100.0, 1, 2))
    both, stats = workflows.population_by_level(hexes, people, ["near", "far"], str(tmp_path / "b"))
    totals = {r.accessibility: r.population for r in stats.collect()}
    assert totals["total population"] == 40 and spark.read.option("header", True).csv(str(tmp_path / "b" / "statistics")).count() == len(totals)
    blocks = spark.range(2).select((F.col("id") + 1).alias("sid"), F.when(F.col("id") == 0, ring((-60, -60), (60, -60), (60, 60), (-60, 60), (-60, -60))).otherwise(ring((60, -60), (260, -60), (260, 60), (60, 60), (60, -60))).alias("ring"), F.lit(5.0).alias("people"))
    tract = spark.range(1).select(F.lit(1).cast("long").alias("tid"), ring((-90, -90), (290, -90), (290, 90), (-90, 90), (-90, -90)).alias("ring"))
    out = workflows.levels_by_area(spark, hexes, blocks, "people", {"tract": tract})
    assert out["blocks"].count() == 2 and out["tract"].first()["people"] == 10.0


def test_layers_of_areas(spark, tmp_path):
    big = spark.range(1).select(F.lit(1).alias("region"), ring((0, 0), (20, 0), (20, 10), (0, 10), (0, 0)).alias("ring"), F.lit(100.0).alias("jobs"))
    small = spark.range(2).select((F.col("id") + 1).alias("town"), F.when(F.col("id") == 0, square()).otherwise(ring((10, 0), (20, 0), (20, 10), (10, 10), (10, 0))).alias("ring"), (F.col("id") + 1).cast("double").alias("people"), (F.col("id") * 4.0).alias("rate"))
    layers = multires.MultiresLayers().add_layer(big, "region", {"jobs": "sum"}).add_layer(small, "town", {"people": "sum", "rate": "density_people"}, block=50.0)
    up, down = layers.filled()
    assert (up.first()["people"], up.first()["rate"]) == (3.0, pytest.approx(8 / 3)) and [r.jobs for r in down.collect()] == [50.0, 50.0]
    more = layers.add_feature(1, spark.createDataFrame([(1, 7.0), (2, 9.0)], "town long, price double"), {"price": "mean"})
    assert more[0].first()["price"] == 8.0
    more.save(spark, str(tmp_path / "m"))
    assert multires.MultiresLayers.load(spark, str(tmp_path / "m")).methods == more.methods


def test_census_catalogue(spark):
    catalogue = {"age": {"source": "acs", "years": [2020], "universe": "total", "fields": {"total": "B1", "old": ["B2", "B3"]}, "fields_universe": {"total": "NO_DENSITY_OR_RATIO"}, "agg_weights": {"old": "total"}}, "jobs": {"source": "lodes", "fields": {"all": ["C"]}}}
    assert list(census.select_fields(catalogue, "age_old_log_ratio")["age"]["fields"]) == ["old"]
    assert set(census.select_fields(catalogue, None)) == {"age", "jobs"} and set(census.select_fields(catalogue, ["age", "jobs_all"])["age"]["fields"]) == {"total", "old"}
    assert census.select_fields(catalogue, {"jobs": "all", "none": None}) == {"jobs": catalogue["jobs"] | {"fields": {"all": ["C"]}, "fields_universe": {"all": "default"}}}
    with pytest.raises(ValueError):
        census.select_fields(catalogue, {"age": 3})
    plain = census.plain_catalogue(catalogue, {"acs": "American survey"}, 2021)
    assert plain["age"]["fields"]["2020_age_old"] == ["B2", "B3"] and plain["age"]["fields_universe"] == {"2020_age_total": "NO_DENSITY_OR_RATIO", "2020_age_old": "2020_age_total"}
    assert plain["age"]["source"] == "American survey" and plain["jobs"]["years"] == [2021] and plain["age"]["agg_weights"] == {"2020_age_old": "2020_age_total"}
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, s string")
    assert census.filtered(df, {"k": 1, "s": ["a", "b"], "x": None}).count() == 1
    targets = spark.range(1).select(F.lit(1).alias("tid"), square().alias("ring"))
    areas = spark.createDataFrame([(1, 2.0, 10.0), (2, 4.0, 30.0)], "sid int, rate double, n double").withColumn("ring", square())
    assert tuple(census.resample_to(areas, targets, 20.0, ["n"], {"rate": "n"}).first()) == (1, 40.0, 3.5)


def test_tags_and_osm_files(spark, tmp_path):
    assert osm.filter_arguments({"highway": ["b", "a"], "foot": "yes", "shop": True}) == ["w/highway=a,b", "w/foot=yes", "w/shop"]
    assert osm.bounded("node({{bbox}});", (1, 2, 3, 4)) == "node(2,1,4,3);"
    with pytest.raises(ValueError):
        osm.network_filters("fly")
    (tmp_path / "m.osm").write_text('<osm><node id="1" lon="0" lat="0"/><node id="2" lon="3" lat="4"/><node id="3" lon="3" lat="9"/><way id="7"><nd ref="1"/><nd ref="2"/><tag k="highway" v="footway"/></way><way id="8"><nd ref="2"/><nd ref="3"/><tag k="highway" v="motorway"/></way></osm>')
    nodes, edges = osm.street_graph(spark, str(tmp_path / "m.osm"), "walk")
    assert [(r.u, r.v, r.len) for r in edges.collect()] == [(1, 2, 5.0)] and nodes.count() == 2
    keys = '<key id="d0" for="node" attr.name="x"/><key id="d1" for="node" attr.name="y"/><key id="d2" for="edge" attr.name="length"/>'
    (tmp_path / "g.graphml").write_text(f'<graphml>{keys}<graph><node id="1"><data key="d0">1.5</data><data key="d1">2</data></node><node id="2"><data key="d0">4</data><data key="d1">6</data></node><edge source="1" target="2" id="0"><data key="d2">5.5</data></edge></graph></graphml>')
    nodes, edges = osm.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert {tuple(r) for r in nodes.collect()} == {(1, 1.5, 2.0), (2, 4.0, 6.0)} and [(r.u, r.v, r.len) for r in edges.collect()] == [(1, 2, 5.5)]
    (tmp_path / "a.json").write_text('{"address": {"city": "B", "state": "S"}}\n{"address": {"city": "A"}}\n')
    assert osm.address_fields(spark, str(tmp_path / "a.json"), ["city", "state"]) == {"city": ["A", "B"], "state": ["S"]}
    osm.write_poly(spark.range(1).select(square().alias("ring"), F.lit(False).alias("hole")), "area", str(tmp_path / "p"))
    written = "\n".join(r.value for r in spark.read.text(str(tmp_path / "p")).collect())
    assert written.startswith("area\n1\n   0.0000000E+00") and written.endswith("END\nEND")
    areas = spark.range(2).select("id", F.when(F.col("id") == 0, ring((0, 0), (30, 0), (30, 30), (0, 30), (0, 0))).otherwise(ring((0, 0), (300, 0), (300, 1), (0, 1), (0, 0))).alias("ring"))
    assert [r.id for r in osm.large_areas(areas).collect()] == [0]


def test_tiff_round_trip(spark, tmp_path):
    import numpy as np

    cells = spark.createDataFrame([(0, 0, 1.5), (1, 2, -3.0), (2, 1, 7.0)], "row_no long, col long, value double")
    grid = raster.Grid(100.0, 50.0, 10.0, -10.0, 3, 4)
    tiff.write_tiff(cells, grid, f"file://{tmp_path}/a.tif")
    got, where = tiff.read_tiff(spark, f"file://{tmp_path}/a.tif")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in cells.collect()} and where == grid
    data = (tmp_path / "a.tif").read_bytes()
    assert tiff.pixels_of(data).shape == (3, 4) and np.isclose(tiff.pixels_of(data)[1, 2], -3.0)
    tiff.write_tiff(cells, raster.Grid(100.0, 20.0, 10.0, 10.0, 3, 4), f"file://{tmp_path}/b.tif")
    turned, where = tiff.read_tiff(spark, f"file://{tmp_path}/b.tif")
    assert (where.y0, where.dy) == (50.0, -10.0) and {(r.row_no, r.value) for r in turned.collect()} == {(2, 1.5), (1, -3.0), (0, 7.0)}
    with pytest.raises(ValueError):
        tiff.tags_of(b"GIF89a..")


def lzw(data):
    """A plain encoder for the test: codes of 9 to 12 bits, high bits first."""
    codes, table, width, word = [(256, 9)], {bytes([i]): i for i in range(256)}, 9, b""
    size = 258
    for byte in data:
        if word + bytes([byte]) in table:
            word += bytes([byte])
            continue
        codes.append((table[word], width))
        table[word + bytes([byte])] = size
        size += 1
        word = bytes([byte])
        if size + 1 > (1 << width) - 1 + 1 and width < 12:
            width += 1
        if size >= 4094:
            codes.append((256, width))
            table, width, size = {bytes([i]): i for i in range(256)}, 9, 258
    codes += [(table[word], width)] if word else []
    codes.append((257, width))
    bits = "".join(format(c, f"0{w}b") for c, w in codes)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def test_tiff_blocks():
    import zlib

    import numpy as np

    rng = np.random.default_rng(2)
    for data in (b"", b"aaaaaaaaaaaaaaaaaaaa", bytes(rng.integers(0, 4, 3000, dtype=np.uint8)), bytes(rng.integers(0, 256, 20000, dtype=np.uint8))):
        assert tiff.unpacked_lzw(lzw(data)) == data
    assert tiff.unpacked_runs(bytes([2, 7, 8, 9, 254, 5, 128, 0, 1])) == bytes([7, 8, 9, 5, 5, 5, 1]) or tiff.unpacked_runs(bytes([2, 7, 8, 9, 254, 5])) == bytes([7, 8, 9, 5, 5, 5])
    whole = rng.integers(-3000, 3000, (6, 5)).astype("<i2")
    stepped = np.concatenate([whole[:, :1], np.diff(whole, axis=1)], axis=1).astype("<i2")
    assert (tiff.block_of(lzw(stepped.tobytes()), 5, 2, np.dtype("<i2"), 5) == whole).all()
    floats = rng.standard_normal((4, 7))
    assert (tiff.block_of(tiff.packed_tile(floats), 8, 3, np.dtype("<f8"), 7) == floats).all()
    assert (tiff.block_of(zlib.compress(whole.astype(">i2").tobytes()), 8, 1, np.dtype(">i2"), 5) == whole).all()


def test_tiff_files_of_one_raster(spark, tmp_path):
    """Four files side by side are one raster on one grid; a box leaves tiles out; files that do not fit are refused."""
    want = {}
    for i, (r, c) in enumerate([(0, 0), (0, 40), (30, 0), (30, 40)]):
        cells = [(k, m, float(1000 * i + 40 * k + m)) for k in range(30) for m in range(40) if (k + m + i) % 3]
        want |= {(r + k, c + m): v for k, m, v in cells}
        tiff.write_tiff(spark.createDataFrame(cells, "row_no long, col long, value double"), raster.Grid(500.0 + 10 * c, 900.0 - 10 * r, 10.0, -10.0, 30, 40), f"file://{tmp_path}/all/{i}.tif", tile=16)
    got, grid = tiff.read_tiff(spark, f"file://{tmp_path}/all")
    assert grid == raster.Grid(500.0, 900.0, 10.0, -10.0, 60, 80)
    assert {(r.row_no, r.col): r.value for r in got.collect()} == want
    some, _ = tiff.read_tiff(spark, f"file://{tmp_path}/all", (700.0, 500.0, 1000.0, 700.0))
    assert {(r.row_no, r.col): r.value for r in some.collect()} == {(k, m): v for (k, m), v in want.items() if 20 <= k < 40 and 20 <= m < 50}
    tiff.write_tiff(spark.createDataFrame([(0, 0, 1.0)], "row_no long, col long, value double"), raster.Grid(503.0, 900.0, 10.0, -10.0, 2, 2), f"file://{tmp_path}/all/off.tif", tile=16)
    with pytest.raises(ValueError):
        tiff.read_tiff(spark, f"file://{tmp_path}/all")


def test_files(spark, tmp_path):
    square = {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]]}
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"n": "1"}, "geometry": square}]}))
    rings = files.geojson_rings(files.read_layer(spark, str(tmp_path / "a.gpkg").replace(".gpkg", "")))
    assert rings.count() == 1 and files.in_box(rings, (3, 3, 9, 9)).count() == 1 and files.in_box(rings, (5, 5, 9, 9)).count() == 0
    files.write_csv(spark.createDataFrame([(1, 2.0, 3.0)], "id int, x double, y double"), str(tmp_path / "b.csv"))
    both = files.load_shapes(spark, [str(tmp_path / "b"), str(tmp_path / "b.csv")], (0, 0, 5, 5))
    assert both.count() == 2
    with pytest.raises(FileNotFoundError):
        files.read_layer(spark, str(tmp_path / "none"))


def test_scores_and_texts(spark):
    with pytest.raises(ValueError):
        scoring.adaptive_grid(lambda v: float(v > 1), 0, 2, 0.5)
    grids = scoring.adaptive_grids(lambda a, b: a * b, {"a": (0.0, 1.0), "b": (0.0, 2.0)}, 0.25)
    assert all(abs(a2 * b2 - a * b) <= 0.25 for a in grids["a"] for b in grids["b"] for a2, b2 in [(min([v for v in grids["a"] if v > a], default=a), b), (a, min([v for v in grids["b"] if v > b], default=b))])
    mixed = scoring.adaptive_grids(lambda a, mode: a * {"bus": 1, "rail": 4}[mode], {"a": (0.0, 1.0), "mode": ["bus", "rail"]}, 0.5)
    assert mixed == {"a": [k / 8 for k in range(9)], "mode": ["bus", "rail"]}
    with pytest.raises(ValueError):
        scoring.adaptive_grids(lambda a: float(a > 0.3), {"a": (0.0, 1.0)}, 0.5, max_rounds=20)
    model = facade.AccessScore()
    stops = spark.createDataFrame([(5.0, "rail", 30.0), (720.0, "bus", 10.0)], "headway double, mode string, speed double")
    assert [r.score for r in model.score_stops(stops).collect()] == pytest.approx([1.0, 0.1])
    assert spark.range(1).select(scoring.TransitScore().access()(*(F.lit(v) for v in (720.0, "bus", 10.0, 2000.0)))).first()[0] == pytest.approx(0.1)
    grid = scoring.grid_ceiling_clipped(F.col("id"), [2, 5])
    assert [r[0] for r in spark.range(0, 9, 4).select(grid).collect()] == [2.0, 5.0, 5.0]
    assert text.folder_of("/a/b.csv") == "/a" and text.folder_of("/a/b") == "/a/b"
    names = spark.createDataFrame([("São Paulo",), ("xyz",)], "name string")
    places = spark.createDataFrame([(1, "paulo sao"), (2, "Sao Paulo"), (3, "Rio")], "k int, place string")
    assert [(r.name, r.match) for r in text.best_matches(names, places, "name", "place", "k").collect()] == [("São Paulo", "Sao Paulo")]
    days = spark.createDataFrame([(i, float(v)) for i, v in enumerate([10, 10, 11, 1, 30, 10])], "day int, v double")
    assert service.representative(days, "v", "day").first()["day"] == 2  # 11 and 30 are as far from their mean: the first
    assert service.modal_band(days.limit(0), "v").count() == 0


def test_projection_and_geometry(spark):
    one = spark.range(1)
    box = ring((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))
    assert one.select(crs.geodesic_area(box)).first()[0] == pytest.approx(12_308_778_361, rel=2e-4)
    assert one.select(geometry.is_valid(square()), geometry.is_valid(ring((0, 0), (2, 2), (2, 0), (0, 2), (0, 0)))).first() == (True, False)
    line = ring((0, 0), (5, 0.1), (10, 0), (10, 10))
    r = one.select(F.size(geometry.simplified(line, 1.0)).alias("n"), geometry.midpoint(ring((0, 0), (4, 0))).alias("m"), geometry.with_last(line, F.lit(1), F.lit(2)).alias("l")).first()
    assert r.n == 3 and tuple(r.m) == (2.0, 0.0) and tuple(r.l[-1]) == (1.0, 2.0)
    with pytest.raises(ValueError):
        raster.Grid.from_affine(1, 0.1, 0, 0, 1, 0, 2, 2)
    assert raster.Grid.from_affine(2, 0, 5, 0, -2, 9, 3, 4).affine() == (2, 0.0, 5, 0.0, -2, 9)
    assert raster.kernel_size(1) == 5 and raster.kernel_size(2) == 13 and raster.kernel_size(1, "square") == 9
    touched = population.touched_by_streets(raster.Grid(0, 0, 10, 10, 3, 3), spark.createDataFrame([(1.0, 1.0, 29.0, 1.0)], "ax double, ay double, bx double, by double"), 0.0)
    assert {tuple(r) for r in touched.collect()} == {(0, 0), (0, 1), (0, 2)}


def test_band_holds_values_exactly_one_deviation_away(spark):
    rows = [(f"n{n}-{at}", d, 8.0 + (d + at) % 2) for n in (4, 6, 8, 12, 20) for at in (0, 1) for d in range(n)]
    days = spark.createDataFrame(rows, "feed string, day int, v double")
    want = sorted((feed, day) for feed, day, _ in rows)
    for parts in (1, 2, 3):
        assert sorted((r.feed, r.day) for r in service.modal_band(days.repartition(parts), "v", "feed").collect()) == want
    assert service.representative(days, "v", "day", "feed").first()["v"] == 9.0


def test_lines_stay_with_edges(spark):
    """Bent streets: snaps lie on the lines, cuts cut them, contraction draws them to the merged nodes and keeps tags."""
    def line(*points):
        return [{"x": float(x), "y": float(y)} for x, y in points]

    schema = "edge long, u long, v long, key_no int, len double, line array<struct<x:double,y:double>>, highway string"
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 100.0), (3, 104.0, 100.0), (4, 104.0, 200.0)], "id long, x double, y double")
    rows = [(10, 1, 2, 0, 200.0, line((0, 0), (100, 0), (100, 100)), "a"), (11, 2, 3, 0, 4.0, line((100, 100), (104, 100)), "b"), (12, 4, 3, 0, 100.0, line((104, 200), (104, 100)), "c")]
    edges = spark.createDataFrame(rows, schema)
    points = spark.createDataFrame([(1, 97.0, 30.0), (2, 50.0, 50.0)], "pid long, x double, y double")
    snaps = {r.pid: r for r in snapping.nearest_edges(points, edges, nodes, 50.0).collect()}
    assert (snaps[1].edge, snaps[1].share, snaps[1].d2) == (10, 0.65, 9.0)
    assert snaps[2].edge == 10 and snaps[2].d2 == 2500.0
    got, parts, placed = snapping.add_points(points.filter("pid = 1"), nodes, edges, 50.0, 20.0)
    new = {r.id: (r.x, r.y) for r in got.collect() if r.id > 4}
    assert list(new.values()) == [(100.0, 30.0)]
    cut = sorted((r.len, r.highway, [(p.x, p.y) for p in r.line]) for r in parts.filter("edge = 10").collect())
    assert cut == [(70.0, "a", [(100, 30), (100, 100)]), (130.0, "a", [(0, 0), (100, 0), (100, 30)])]
    merged, kept = graph.simplify(nodes, edges.drop("edge"), min_edge=5.0)
    assert {(r.id, r.x, r.y) for r in merged.collect()} == {(1, 0.0, 0.0), (2, 102.0, 100.0), (4, 104.0, 200.0)}
    got = {(r.u, r.v): r for r in kept.collect()}
    assert set(got) == {(1, 2), (4, 2)} and got[4, 2].highway == "c"
    assert [(p.x, p.y) for p in got[4, 2].line] == [(104.0, 200.0), (102.0, 100.0)] and math.isclose(got[4, 2].len, math.hypot(2, 100))
    assert [(p.x, p.y) for p in got[1, 2].line] == [(0.0, 0.0), (100.0, 0.0), (102.0, 100.0)]


def test_simplify_parallels(spark):
    schema = "u long, v long, key_no int, len double, line array<struct<x:double,y:double>>, maxspeed int"
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0)], "id long, x double, y double")
    bow = lambda y: [{"x": 0.0, "y": 0.0}, {"x": 50.0, "y": float(y)}, {"x": 100.0, "y": 0.0}]
    rows = [(1, 2, 0, 100.0, bow(0), 50), (2, 1, 0, 100.0, list(reversed(bow(0))), 50), (2, 1, 1, 101.0, list(reversed(bow(6))), 50), (1, 2, 1, 130.0, bow(40), 50), (1, 1, 0, 9.0, bow(1), 50)]
    edges = spark.createDataFrame(rows, schema)
    many = graph.simplify(nodes, edges, multi=True)[1].collect()
    assert sorted((r.u, r.v, r.len) for r in many) == [(1, 2, 100.0), (1, 2, 101.0), (1, 2, 130.0)]
    assert all((r.line[0].x, r.line[-1].x) == (0.0, 100.0) for r in many)
    apart = graph.simplify(nodes, edges, multi=True, separation=10.0)[1]
    assert sorted((r.len, r.key_no) for r in apart.collect()) == [(100.0, 0), (130.0, 1)]
    assert [r.len for r in graph.simplify(nodes, edges)[1].collect()] == [100.0]
    assert graph.simplify(nodes, edges, loops=True)[1].count() == 2


def test_a_street_through_a_corner_crosses_both_sides(spark):
    nodes = spark.createDataFrame([(1, -5.0, 15.0), (2, 5.0, 5.0), (3, 5.0, 25.0)], "id long, x double, y double")
    edges = spark.createDataFrame([(7, 1, 2), (8, 2, 3)], "edge long, u long, v long")
    areas = spark.range(1).select(F.lit(1).alias("pid"), square().alias("ring"))
    for block in (3.0, 10.0, 100.0):
        got = sorted(tuple(r) for r in snapping.boundary_points(areas, edges, nodes, block).collect())
        assert got == [(1, 7, 0.0, 10.0), (1, 7, 0.0, 10.0), (1, 8, 5.0, 10.0)]


def test_a_search_in_cells_broadcasts_no_table(spark, monkeypatch):
    monkeypatch.setattr(sssp, "CELL_NODES", 5)
    plans, kept = [], sssp.materialize

    def noted(df, label, *also):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, label, *also)

    monkeypatch.setattr(sssp, "materialize", noted)
    edges = spark.range(20).selectExpr("id AS u", "id + 1 AS v", "10L AS len")
    sources = spark.createDataFrame([(1, 0)], "grp long, node long")
    reach = bounded_distances(edges, sources, 1000, max_broadcast_edges=0)
    plans.append(reach.join(sources, "node", "left")._jdf.queryExecution().executedPlan().toString())
    assert {(r["node"], r["dist"]) for r in reach.collect()} == {(i, 10 * i) for i in range(21)}
    assert len(plans) > 5 and not any("Broadcast" in p for p in plans)


def test_networks_cut_at_a_reach_broadcast_no_table(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    nodes = spark.range(21).selectExpr("id", "10D * id AS x", "0D AS y")
    edges = spark.range(20).selectExpr("100 + id AS edge", "id AS u", "id + 1 AS v", "10L AS len")
    reach, parts = snapping.isochrone(edges, spark.createDataFrame([(0,)], "node long"), 35, 1000)
    assert sorted((r["edge"], r["len"]) for r in parts.collect()) == [(100, 10), (101, 10), (102, 10), (103, 5)]
    inside = reach.filter("remaining > 0").select("node")
    cropped = snapping.crop_by_reach(edges, inside, inside.limit(0))
    left = spark.createDataFrame([(i, 0, 25 - 10 * i) for i in range(3)], "node long, rank_no int, remaining long")
    fresh, cut = isochrone.result_network(nodes, edges, left, 1)
    assert sorted((r["edge"], r["rank_no"], r["len"]) for r in cut.filter("rank_no IS NOT NULL").collect()) == [(100, 0, 10.0), (101, 0, 5.0), (101, 0, 5.0), (102, 0, 5.0)]
    assert not any("Broadcast" in plan(df) for df in (reach, parts, cropped, fresh, cut))
