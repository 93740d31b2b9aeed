"""Areas with holes and parts against plain even-odd code, on slanted and concave rings."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from wayfield.facade import AreaOfInterest, HexGrid, PointsOfInterest, StreetNetwork
from wayfield.functions import hexgrid, shapes
from wayfield.operators import hexcells, raster, snapping, spatial
from wayfield.sources import files

STAR = [(0, 0), (40, 10), (80, 0), (60, 35), (85, 80), (40, 60), (5, 78), (20, 40), (0, 0)]
HOLE = [(30, 25), (45, 20), (50, 45), (38, 35), (30, 25)]
PART = [(100, 100), (140, 90), (130, 150), (100, 100)]
SHAPE = [[STAR, HOLE], [PART]]


def odd(shape, x, y):
    n = 0
    for ring in [r for p in shape for r in p]:
        for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
            n += (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax
    return n % 2 == 1


def shoelace(ring):
    return abs(sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False))) / 2


def wkt(shape):
    return "MULTIPOLYGON (" + ", ".join("(" + ", ".join("(" + ", ".join(f"{x} {y}" for x, y in r) + ")" for r in p) + ")" for p in shape) + ")"


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(1, wkt(SHAPE)), (2, None), (3, "MULTIPOLYGON EMPTY")], "id long, wkt string").select("id", shapes.from_wkt(F.col("wkt")).alias("shape"))


def plain(shape):
    return [[[(p.x, p.y) for p in r] for r in part] for part in shape]


def test_wkt_and_geojson(spark, table, tmp_path):
    rows = {r.id: r for r in table.withColumn("text", shapes.to_wkt(F.col("shape"))).collect()}
    assert plain(rows[1].shape) == SHAPE
    assert rows[2].shape is None
    assert rows[3].shape == [] and rows[3].text == "POLYGON EMPTY"
    again = table.filter("id = 1").select(shapes.from_wkt(shapes.to_wkt(F.col("shape"))).alias("s")).first().s
    assert plain(again) == SHAPE
    one = spark.range(1).select(shapes.from_wkt(F.lit("polygon z((0 0 5,4 0 5, 4 4 5,0 0 5),(1 1 5, 2 1 5, 2 2 5, 1 1 5))")).alias("s"), shapes.from_wkt(F.lit("POINT (1 2)")).alias("p")).first()
    assert [len(p) for p in one.s] == [2] and one.p is None
    holed = [{"type": "Feature", "properties": {"k": "a"}, "geometry": {"type": "Polygon", "coordinates": SHAPE[0]}}]
    many = [{"type": "Feature", "properties": {"k": "b"}, "geometry": {"type": "MultiPolygon", "coordinates": SHAPE}}, {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": holed + many}))
    (tmp_path / "b.geojsonl").write_text("".join(json.dumps(f) + ",\n" for f in holed + many))
    for name in ("a.geojson", "b.geojsonl"):
        found = files.geojson_shapes(files.read_layer(spark, f"{tmp_path}/{name}")).collect()
        assert sorted((r.properties["k"], [[[tuple(map(int, q)) for q in ring] for ring in p] for p in plain(r.shape)]) for r in found) == [("a", SHAPE[:1]), ("b", SHAPE)]
    files.write_geojson_shapes(table.filter("id = 1").withColumn("k", F.lit("c")), f"{tmp_path}/out")
    back = files.geojson_shapes(files.read_geojson(spark, f"{tmp_path}/out", by_line=True)).collect()
    assert [(r.properties["k"], plain(r.shape)) for r in back] == [("c", SHAPE)]


def test_measures(table):
    s = F.col("shape")
    r = {r.id: r for r in table.select("id", shapes.area(s).alias("a"), shapes.perimeter(s).alias("l"), shapes.centroid(s).alias("c"), shapes.is_valid(s).alias("v")).collect()}
    assert math.isclose(r[1].a, shoelace(STAR) - shoelace(HOLE) + shoelace(PART))
    assert r[2].a is None and r[3].a == 0 and r[3].c is None
    assert r[1].v
    step, inner = 0.25, []
    for i in range(600):
        inner += [(i * step, j * step) for j in range(620) if odd(SHAPE, i * step, j * step)]
    assert abs(r[1].c.x - sum(x for x, _ in inner) / len(inner)) < 0.2
    assert abs(r[1].c.y - sum(y for _, y in inner) / len(inner)) < 0.2


def test_predicates(spark, table):
    shape = table.filter("id = 1")
    rng = random.Random(4)
    points = [(i, rng.uniform(-5, 150), rng.uniform(-5, 155)) for i in range(400)]
    found = spatial.points_in_rings(shape.withColumnRenamed("id", "aid"), spark.createDataFrame(points, "pid long, x double, y double"), 30.0)
    assert {r.pid for r in found.collect()} == {i for i, x, y in points if odd(SHAPE, x, y)}
    squares = [("in the hole", 38, 28, 1), ("in the star", 12, 12, 2), ("over the hole", 40, 33, 30), ("apart", 120, 20, 5), ("in the part", 122, 110, 4), ("over a side", 70, 40, 12)]
    rows = [(k, wkt([[[(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h), (x - h, y - h)]]])) for k, x, y, h in squares]
    boxes = spark.createDataFrame(rows, "sid string, wkt string").select("sid", shapes.from_wkt(F.col("wkt")).alias("shape"))
    targets = shape.withColumnRenamed("id", "tid")
    names = lambda how: {r.sid for r in hexcells.matches(boxes, targets, 40.0, how).collect()}
    assert names("overlap") == {"in the star", "over the hole", "in the part", "over a side"}
    assert names("full") == {"in the star", "in the part"}
    assert spatial.pairs_that_meet(targets.withColumnRenamed("tid", "aid"), boxes.withColumnRenamed("sid", "bid"), 25.0).count() == 4


def test_fill_and_raster(spark, table):
    shape = table.filter("id = 1")
    size = 3.0
    got = {(r.q, r.r) for r in hexcells.fill(shape, "id", size, "center").collect()}
    want = set()
    for r in range(-4, 40):
        for q in range(-30, 40):
            x, y = size * (hexgrid.ROOT3 * q + hexgrid.ROOT3 / 2 * r), size * 1.5 * r
            if odd(SHAPE, x, y):
                want.add((q, r))
    assert got == want
    full = {(r.q, r.r) for r in hexcells.fill(shape, "id", size, "full").collect()}
    over = {(r.q, r.r) for r in hexcells.fill(shape, "id", size, "overlap").collect()}
    assert full < got < over
    corners = lambda q, r: [(size * (hexgrid.ROOT3 * q + hexgrid.ROOT3 / 2 * r) + size * math.cos(math.pi / 180 * a), size * 1.5 * r + size * math.sin(math.pi / 180 * a)) for a in range(-30, 300, 60)]
    assert all(all(odd(SHAPE, x, y) for x, y in corners(*c)) for c in full)
    grid = raster.Grid(0.0, 160.0, 2.0, -2.0, 80, 75)
    burnt = {(r.row_no, r.col) for r in raster.rasterize(shape.withColumn("v", F.lit(1)), grid, "v").collect()}
    centres = {(i, j): (j * 2 + 1, 160 - i * 2 - 1) for i in range(80) for j in range(75)}
    assert burnt == {k for k, (x, y) in centres.items() if odd(SHAPE, x, y)}
    cells = spark.createDataFrame([(i, j, 1.0) for i, j in centres], "row_no long, col long, value double")
    assert raster.crop(cells, grid, shape=shapes.from_wkt(F.lit(wkt(SHAPE))))[0].count() == len(burnt)


def test_facade_takes_holes_and_parts(spark, table):
    area = AreaOfInterest(wkt(SHAPE))
    assert area.bounds(spark) == (0.0, 0.0, 140.0, 150.0)
    points = spark.createDataFrame([(1, 40.0, 15.0), (2, 40.0, 30.0), (3, 120.0, 110.0), (4, 95.0, 5.0)], "pid long, x double, y double")
    assert {r.pid for r in area.clip(points).collect()} == {1, 3}
    grid = HexGrid.from_shapes(table.filter("id = 1").withColumn("v", F.lit(7.0)), "id", {"v": "distribute"}, 3.0, 0)
    assert abs(grid.cells.agg(F.sum("v")).first()[0] - 7.0) < 1e-9
    nodes = spark.createDataFrame([(1, -10.0, 30.0), (2, 160.0, 30.0)], "id long, x double, y double")
    network = StreetNetwork(nodes, spark.createDataFrame([(1, 2, 0, 170.0)], "u long, v long, key_no int, len double"))
    at = PointsOfInterest(table.filter("id = 1").withColumnRenamed("id", "pid")).to_points(network, 50.0)
    crossings = sorted(round(r.x, 3) for r in at.places.collect())
    assert len(crossings) == 4  # into the star, into its hole, out of the hole, out of the star
    ranks = snapping.served_inside(spark.createDataFrame([(1, 40.0, 15.0), (2, 38.0, 30.0)], "id long, x double, y double"), table.filter("id = 1").select(F.lit(2).alias("rank_no"), "shape"), 50.0)
    assert [(r.node, r.rank_no) for r in ranks.collect()] == [(1, 2)]


def below_the_dealing(df):
    """The plan under the first exchange that deals rows to all cores."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan
    return plan[plan.index("Repartition") :]


def test_rasterize_deals_areas_before_it_looks_at_them(spark):
    areas = spark.range(5).select(F.lit(1).alias("value"), hexcells.box(F.col("id"), F.col("id"), F.col("id") + 3, F.col("id") + 3).alias("ring"))
    got = raster.rasterize(areas, raster.Grid(0.0, 0.0, 1.0, 1.0, 8, 8), "value")
    assert "lambda" not in below_the_dealing(got)
    assert got.count() == 9 + 4 * 5


def test_fill_deals_areas_and_looks_at_their_candidates_once(spark):
    areas = spark.createDataFrame([(1, 0.0, 10.0), (2, 60.0, 1.0), (3, 41.0, 2.0)], "id long, x double, w double").select("id", hexcells.box(F.col("x"), F.col("x"), F.col("x") + F.col("w"), F.col("x") + F.col("w")).alias("ring"))
    fill = lambda how: {tuple(r) for r in hexcells.fill(areas, "id", 4.0, how).collect()}
    centre, overlap = fill("center"), fill("overlap")
    got = hexcells.fill(areas, "id", 4.0, "center_overlap")
    assert {tuple(r) for r in got.collect()} == centre | {r for r in overlap if r[0] not in {c[0] for c in centre}}
    assert len(centre) < len(overlap) and {r[0] for r in overlap} == {1, 2, 3}
    assert "lambda" not in below_the_dealing(got)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 2  # 4 before: candidates were made twice


def test_matches_deal_sources_and_make_a_centre_once(spark):
    homes = spark.range(20).select(F.col("id").alias("sid"), hexcells.box(F.col("id") * 7, F.col("id") * 7, F.col("id") * 7 + 4, F.col("id") * 7 + 4).alias("ring"))
    blocks = spark.range(4).select(F.col("id").alias("tid"), hexcells.box(F.col("id") * 40 - 0.5, F.lit(-0.5), F.col("id") * 40 + 39.5, F.lit(200.0)).alias("ring"))
    got = hexcells.matches(homes, blocks, 40.0, "center")
    assert {tuple(r) for r in got.collect()} == {((7 * i + 2) // 40, i) for i in range(20)}
    under = below_the_dealing(got).splitlines()[1:3]
    assert "Range" in under[1] and "lambda" not in "".join(under)  # a centre is not made in the task that reads the homes
