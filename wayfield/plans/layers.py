"""Deterministic spatial layers derived from the star-schema tables, in whole numbers.

The street grid has n = floor(sqrt(count of part)) nodes a side. Each ``*_sql`` is valid in Spark SQL and in
DuckDB alike (``div`` is written as a floor of an exact quotient), so a query and its oracle read the same layer.
"""

from __future__ import annotations

import re

SIDE = "side AS (SELECT CAST(floor(sqrt(CAST(count(*) AS DOUBLE))) AS BIGINT) AS n FROM part)"
NODES = """nodes AS (
  SELECT p_partkey AS id, p_partkey % n AS col, CAST(floor(p_partkey / n) AS BIGINT) AS row_no,
         (p_partkey % n) * 100 + (p_partkey * 37) % 41 AS x,
         CAST(floor(p_partkey / n) AS BIGINT) * 100 + (p_partkey * 53) % 41 AS y
  FROM part CROSS JOIN side WHERE p_partkey < n * n
)"""
EDGES = """edges AS (
  SELECT id AS u, id + 1 AS v, CAST(0 AS INT) AS key_no, 50 + (id * 7919) % 101 AS len FROM nodes CROSS JOIN side WHERE col < n - 1
  UNION ALL
  SELECT id AS u, id + n AS v, CAST(0 AS INT) AS key_no, 50 + (id * 104729) % 97 AS len FROM nodes CROSS JOIN side WHERE row_no < n - 1
)"""
POIS = """pois AS (
  SELECT s_suppkey AS poi, (s_suppkey * 7919) % (100 * n) AS x, (s_suppkey * 104729) % (100 * n) AS y,
         CASE WHEN s_acctbal < 2500 THEN 500 WHEN s_acctbal < 5000 THEN 750 ELSE 1000 END AS quality,
         s_nationkey AS nation
  FROM supplier CROSS JOIN side
)"""
PEOPLE = """people AS (
  SELECT c_custkey AS person, (c_custkey * 7919) % (100 * n) AS x, (c_custkey * 104729) % (100 * n) AS y,
         CAST(round(abs(c_acctbal) * 100) AS BIGINT) AS population, c_nationkey AS nation, c_mktsegment AS segment
  FROM customer CROSS JOIN side
)"""
RASTER = """raster AS (
  SELECT l_orderkey % 64 AS row_no, l_partkey % 64 AS col, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v
  FROM lineitem GROUP BY 1, 2
)"""
STOPS = """stops AS (
  SELECT user_id % 40 AS stop, event_type AS mode, CAST(ts AS DATE) AS day, ts, value, event_id FROM events
)"""


def with_layers(*layers: str, body: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(layers) + "\n" + body


def layer(spark, sf_dir: str, *layers: str, name: str):
    """The last of ``layers`` as a DataFrame, from the tables that it names."""
    tables = ("part", "supplier", "customer", "lineitem", "events", "nation", "region", "orders")
    sql = with_layers(*layers, body=f"SELECT * FROM {name}")
    for t in tables:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 parquet.`{sf_dir}/{t}.parquet`", sql)
    return spark.sql(sql)
