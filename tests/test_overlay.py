"""Overlay against rasters of points: circles, stars with holes, slanted rings, tiles cut again, touching and repeated areas."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_shapes import SHAPE, wkt
from wayfield.facade import AreaOfInterest
from wayfield.functions import geometry, shapes
from wayfield.operators import overlay, spatial
from wayfield.sources import osm


def square(x, y, h):
    return [[[(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h), (x - h, y - h)]]]


def polygon(rng, x, y, r, n):
    ring = [(x + r * rng.uniform(0.4, 1) * math.cos(2 * math.pi * k / n), y + r * rng.uniform(0.4, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    return [[[*ring, ring[0]]]]


def table(spark, rows):
    """rows: (key, cls, shape)"""
    df = spark.createDataFrame([(k, c, wkt(s) if s is not None else None) for k, c, s in rows], "key string, cls int, wkt string")
    return df.select("key", "cls", shapes.from_wkt(F.col("wkt")).alias("shape"))


def inside(shape, x, y):
    n = np.zeros(len(x), int)
    for ring in [r for p in shape for r in p]:
        for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
            if ay != by:
                n += ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return n % 2 == 1


def plain(shape):
    return [[[(p.x, p.y) for p in r] for r in part] for part in shape]


def check(parts, rows, how, box, step):
    """Parts say at every place of a grid what the rows do, do not overlap, are valid and have the area that they claim."""
    gx, gy = (g.ravel() for g in np.meshgrid(np.arange(box[0], box[2], step) + 0.0123, np.arange(box[1], box[3], step) + 0.0321))
    found = parts.withColumns({"valid": shapes.is_valid(F.col("shape")), "measured": shapes.area(F.col("shape"))}).collect()
    for key in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == key and r[2]]
        covers = {c: np.any([inside(s, gx, gy) for _, k, s in mine if k == c], axis=0) for c in sorted({r[1] for r in mine})}
        want = np.full(len(gx), -1)
        if how == "best":
            for c in sorted(covers, reverse=True):
                want = np.where(covers[c], c, want)
        elif how == "difference":
            want = np.where(covers[0] & ~covers.get(1, np.zeros(len(gx), bool)), 0, -1)
        else:
            want = np.where(covers[0] & covers[1], 0, -1)
        got, times = np.full(len(gx), -1), np.zeros(len(gx), int)
        for r in found:
            if r.key == key:
                here = inside(plain(r.shape), gx, gy)
                got, times = np.where(here, r.cls if "cls" in r else 0, got), times + here
        assert (got != want).sum() <= len(gx) // 20_000  # a place within a millimetre of a side
        assert times.max(initial=0) <= 1
    assert all(r.valid for r in found)
    assert all(abs(r.measured - r.area) < 1e-3 for r in found)
    return found


@pytest.mark.parametrize(("tile", "most"), [(500.0, 1500), (60.0, 1500), (300.0, 60)])
def test_best_class(spark, monkeypatch, tile, most):
    monkeypatch.setattr(overlay, "MAX_SIDES", most)
    rng = random.Random(7)
    rows = [(str(i % 2), rng.randint(0, 2), polygon(rng, rng.uniform(-150, 200), rng.uniform(-100, 250), rng.uniform(20, 120), rng.randint(3, 9))) for i in range(24)]
    rows += [("1", 1, SHAPE), ("1", 1, SHAPE), ("1", 2, None), ("0", 0, [])]
    parts = overlay.overlay(table(spark, [r for r in rows if r[2] != []]), 3, "best", tile)
    found = check(parts, rows, "best", (-300, -260, 340, 400), 2.3)
    assert {r.key for r in found} == {"0", "1"}


def test_two_sets(spark):
    rng = random.Random(3)
    rows = [("k", i % 2, polygon(rng, rng.uniform(0, 200), rng.uniform(0, 200), rng.uniform(30, 90), 6)) for i in range(12)] + [("k", 0, SHAPE)]
    df = table(spark, rows)
    a, b = df.filter("cls = 0"), df.filter("cls = 1")
    check(overlay.difference(a, b, 128.0), rows, "difference", (-100, -100, 320, 320), 1.7)
    check(overlay.intersection(a, b, 128.0), rows, "intersection", (-100, -100, 320, 320), 1.7)
    whole = overlay.intersection(a, a, 128.0).agg(F.sum("area")).first()[0]
    assert abs(whole - overlay.union(a, 128.0).agg(F.sum("area")).first()[0]) < 0.01
    assert overlay.difference(a, a, 128.0).count() == 0


def test_neighbours_corners_and_holes(spark):
    rows = [("next", 0, square(10, 10, 10)), ("next", 0, square(30, 10, 10)), ("next", 0, square(30, 10, 10))]
    rows += [("corner", 0, square(10, 10, 10)), ("corner", 0, square(30, 30, 10))]
    rows += [("frame", 0, square(50 + dx, 50 + dy, 10)) for dx in (-20, 0, 20) for dy in (-20, 0, 20) if (dx, dy) != (0, 0)]
    rows += [("pile", 0, square(0, 0, 1000 + i % 3)) for i in range(60)] + [("flat", 0, [[[(0, 0), (5, 5), (0, 0), (0, 0)]]])]
    found = overlay.union(table(spark, rows), 32.0).select("key", "area", F.expr("size(shape[0])").alias("rings"), F.expr("size(shape[0][0])").alias("points")).collect()
    of = {k: sorted((r.area, r.rings, r.points) for r in found if r.key == k) for k in {r.key for r in found}}
    assert of["next"] == [(800.0, 1, 5)]
    assert of["corner"] == [(400.0, 1, 5), (400.0, 1, 5)]
    assert of["frame"] == [(3200.0, 2, 5)]
    assert len(of["pile"]) == 1 and abs(of["pile"][0][0] - 2004.0**2) < 1e-6
    assert "flat" not in of
    assert overlay.union(table(spark, rows).limit(0)).count() == 0


def distance_to(shape, x, y):
    best = np.full(len(x), np.inf)
    for ring in [r for p in shape for r in p]:
        for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
            n = (bx - ax) ** 2 + (by - ay) ** 2
            t = np.clip(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / n, 0, 1)
            best = np.minimum(best, np.hypot(ax + t * (bx - ax) - x, ay + t * (by - ay) - y))
    return best


@pytest.mark.parametrize("by", [6.0, -4.0])
def test_buffers(spark, by):
    part = overlay.buffer(table(spark, [("k", 0, SHAPE)]), by, tile=64.0, quadrant=8).collect()
    gx, gy = (g.ravel() for g in np.meshgrid(np.arange(-12, 160, 0.9) + 0.0123, np.arange(-12, 165, 0.9) + 0.0321))
    near = distance_to(SHAPE, gx, gy)
    want = inside(SHAPE, gx, gy) | (near < by) if by > 0 else inside(SHAPE, gx, gy) & (near > -by)
    got = np.any([inside(plain(r.shape), gx, gy) for r in part], axis=0)
    assert (got != want)[np.abs(near - abs(by)) > 0.12].sum() == 0  # arcs have 8 segments a quarter
    assert overlay.buffer(table(spark, [("k", 0, square(0, 0, 5))]), -6.0).count() == 0


def test_lines_and_green_areas(spark):
    lines = spark.createDataFrame([("k", "LINESTRING (0 0, 100 0)"), ("k", "LINESTRING (50 -50, 50 50)")], "key string, wkt string").select("key", geometry.points_of(F.col("wkt")).alias("line"))
    cross = overlay.along(lines, 2.0, quadrant=1).collect()
    assert len(cross) == 1 and abs(cross[0].area - (2 * (100 * 4 + 8) - 16)) < 0.05
    rows = [("k", 0, square(0, 0, 40)), ("k", 0, square(83, 0, 40)), ("k", 0, [[[(300, 0), (400, 0), (400, 8), (300, 8), (300, 0)]]]), ("k", 0, square(0, 500, 5)), ("k", 0, square(0, 900, 30))]
    parts = osm.green_areas(table(spark, rows)).collect()
    # Two large ones 3 m apart grow together; the strip and the small one go.
    assert sorted(round(r.area / 100) for r in parts) == sorted([round(163 * 80 / 100), 36]) or sorted(r.area > 9000 for r in parts) == [False, True]
    assert len(parts) == 2
    near = table(spark, [("a", 0, square(0, 930, 5))]).select(F.lit(1).alias("bid"), "shape")
    assert osm.green_areas(table(spark, rows), meets=near).count() == 1


def test_rings_of_places_and_union_of_area(spark):
    matrix = spark.createDataFrame([(1, 30.0, 0), (1, 60.0, 1), (2, 30.0, 1)], "quality int, distance double, rank_no int")
    places = table(spark, [("1", 0, square(0, 0, 10)), ("2", 0, square(70, 0, 10))]).select(F.col("key").cast("int").alias("quality"), "shape")
    got = {r.rank_no: r.a for r in overlay.rings_by_level(places, matrix, 64.0, 8).groupBy("rank_no").agg(F.sum("area").alias("a")).collect()}
    first = 400 + 80 * 30 + math.pi * 900
    assert abs(got[0] - first) < 30
    assert got[1] > 400 + 80 * 60 + math.pi * 3600 - first
    area = AreaOfInterest.union_of(table(spark, [("a", 0, square(0, 0, 10)), ("b", 0, square(15, 0, 10)), ("b", 0, square(100, 0, 10))]))
    assert abs(spark.range(1).select(shapes.area(area.shape()).alias("a")).first().a - (35 * 20 + 400)) < 1e-6


def test_an_area_costs_its_sides_and_blocks_and_not_their_product(spark):
    n = 400
    star = [(500 + (450 if k % 2 else 380) * math.cos(2 * math.pi * k / n), 500 + (450 if k % 2 else 380) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    wkt = "POLYGON ((" + ", ".join(f"{x} {y}" for x, y in [*star, star[0]]) + "), (300 300, 300 600, 600 500, 300 300))"
    area = spark.createDataFrame([(1, wkt)], "aid long, wkt string").select("aid", shapes.from_wkt(F.col("wkt")).alias("shape"))
    points = spark.range(2500).selectExpr("id AS pid", "cast(id % 50 * 20 as double) AS x", "cast(id div 50 * 20 as double) AS y")
    whole = {r["pid"] for r in points.crossJoin(area).filter(shapes.contains(F.col("shape"), F.col("x"), F.col("y"))).collect()}
    assert {r["pid"] for r in spatial.points_in_rings(area, points, 40.0).collect()} == whole and len(whole) > 1000
    assert spatial.in_blocks(area, 40.0).agg(F.sum(F.size(shapes.sides(F.col("shape"))))).first()[0] < 5 * n  # 625 blocks of 400 sides before


def test_geometry_is_dealt_to_all_cores_whatever_its_bytes(spark):
    squares = spark.range(40).select(F.lit("").alias("key"), F.expr("transform(array(0, 1, 2, 3, 0), k -> struct(id * 300D + IF(k in (1, 2), 200, 0) AS x, IF(k > 1, 200D, 0D) AS y))").alias("ring"))
    pieces = overlay._cut(squares.select("key", F.lit(0).alias("cls"), F.lit("").alias("area"), F.array(F.array("ring")).alias("shape")), 0.001, 1 << 19)
    assert overlay._faces(pieces, 1, "best", 1 << 19).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_tiles_of_buffers_are_as_wide_as_the_areas(spark):
    areas = table(spark, [("a", 0, square(0, 0, 400)), ("b", 0, square(3000, 100, 500))])
    assert overlay.tile_of(areas) == 900.0
    assert overlay.tile_of(table(spark, [("a", 0, square(0, 0, 4))])) == 500.0 and overlay.tile_of(areas.limit(0)) == 500.0
    assert overlay.tile_of(table(spark, [("a", 0, square(0, 0, 90000))]), 1e-6) == (1 << 30) * 1e-6
    total = lambda tile: {r["key"]: round(r["area"], 1) for r in overlay.buffer(areas, 20.0, tile, unit=1e-6).collect()}
    assert total(None) == total(500.0)
