"""Every registered query against its DuckDB oracle on the smallest tables, and hand-made cases."""

import duckdb
import pytest

from wayfield.operators.spatial import nearest
from wayfield.operators.sssp import bounded_distances
from wayfield.plans import areas, core, extracts, more, names, runs, streets, surfaces  # noqa: F401
from wayfield.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, oracle, name):
    got = QUERIES[name](spark, SF)
    want = oracle.sql(ORACLES[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(c) for c in names]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=key) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key)


def test_distances_of_a_diamond(spark):
    edges = spark.createDataFrame([(1, 2, 10), (1, 3, 10), (2, 4, 5), (3, 4, 5), (4, 5, 100)], "u long, v long, len long")
    sources = spark.createDataFrame([(7, 1), (8, 5), (8, 99)], "grp long, node long")
    want = {(7, 1, 0), (7, 2, 10), (7, 3, 10), (7, 4, 15), (8, 5, 0), (8, 99, 0)}
    assert {tuple(r) for r in bounded_distances(edges, sources, 20).collect()} == want
    assert {tuple(r) for r in bounded_distances(edges, sources, 20, max_broadcast_edges=0).collect()} == want


def test_nearest_takes_the_least_id_among_equals_and_reaches_far(spark):
    points = spark.createDataFrame([(1, 0, 0), (2, 5000, 5000)], "pid long, x long, y long")
    targets = spark.createDataFrame([(5, 3, 4), (4, 4, 3), (9, 100, 100)], "tid long, x long, y long")
    got = {tuple(r) for r in nearest(points, targets, 100).collect()}
    assert got == {(1, 4, 25), (2, 9, 2 * 4900**2)}


def test_nearest_finds_targets_at_any_distance(spark):
    points = spark.createDataFrame([(1, 0, 0), (2, 900_000, 5), (3, 0, -7_000_000), (4, None, 1)], "pid long, x long, y long")
    targets = spark.createDataFrame([(5, 6390, 6390), (6, 0, 6520), (7, 800_000, -90_000), (8, None, None)], "tid long, x long, y long")
    got = {tuple(r) for r in nearest(points, targets, 100).collect()}
    assert got == {(1, 6, 6520**2), (2, 7, 100_000**2 + 90_005**2), (3, 7, 800_000**2 + 6_910_000**2)}
    assert nearest(points, targets.limit(0), 100).count() == 0
