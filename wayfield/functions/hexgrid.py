"""A planar hexagonal grid over projected metres. Cells are axial (q, r); ids are not those of any other library.

The edge of resolution k is ``base / sqrt(7) ** k``, so a parent holds about seven children; a cell's parent is the
cell that holds its centre.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ROOT3 = math.sqrt(3.0)


def edge(base: float, resolution: int) -> float:
    return base / math.sqrt(7.0) ** resolution


def cell(x: Column, y: Column, size: float) -> Column:
    """struct(q, r) of the hexagon of that edge length that holds a point, by rounding in cube coordinates."""
    q, r = (x * (ROOT3 / 3) - y / 3.0) / size, (y * (2.0 / 3)) / size
    a, c, b = F.round(q), F.round(r), F.round(-q - r)
    da, db, dc = F.abs(a - q), F.abs(b + q + r), F.abs(c - r)
    out_q = F.when((da > db) & (da > dc), -b - c).otherwise(a)
    out_r = F.when((da > db) & (da > dc), c).when(db > dc, c).otherwise(-a - b)
    return F.struct(out_q.cast("long").alias("q"), out_r.cast("long").alias("r"))


def centre(q: Column, r: Column, size: float) -> tuple[Column, Column]:
    return size * (ROOT3 * q + ROOT3 / 2 * r), size * 1.5 * r


def parent(q: Column, r: Column, size: float, parent_size: float) -> Column:
    return cell(*centre(q, r, size), parent_size)


def area(size: float) -> float:
    return 1.5 * ROOT3 * size * size


def boundary(q: Column, r: Column, size: float) -> Column:
    """The six corners, from the one to the right of the top on."""
    x, y = centre(q, r, size)
    corners = [(size * math.cos(math.pi / 180 * (60 * i - 30)), size * math.sin(math.pi / 180 * (60 * i - 30))) for i in range(6)]
    return F.array(*(F.struct((x + dx).alias("x"), (y + dy).alias("y")) for dx, dy in corners))


def cell_sql(x: str, y: str, size: float) -> tuple[str, str]:
    """The same as two SQL expressions."""
    q, r = f"(({x} * CAST({ROOT3 / 3!r} AS DOUBLE) - {y} / CAST(3.0 AS DOUBLE)) / CAST({size!r} AS DOUBLE))", f"(({y} * CAST({2.0 / 3!r} AS DOUBLE)) / CAST({size!r} AS DOUBLE))"
    a, c, b = f"round({q})", f"round({r})", f"round(-{q} - {r})"
    da, db, dc = f"abs({a} - {q})", f"abs({b} + {q} + {r})", f"abs({c} - {r})"
    far = f"{da} > {db} AND {da} > {dc}"
    return f"CAST(CASE WHEN {far} THEN -{b} - {c} ELSE {a} END AS BIGINT)", f"CAST(CASE WHEN {far} THEN {c} WHEN {db} > {dc} THEN {c} ELSE -{a} - {b} END AS BIGINT)"
