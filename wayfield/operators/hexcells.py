"""Shapes to hexagons, and values of shapes gathered per hexagon or per polygon."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfield.functions import hexgrid, shapes
from wayfield.operators.raster import label_of, rank_of
from wayfield.session import dealt

CONTAIN = ("center", "centroid", "full", "overlap", "bbox_overlap", "center_overlap")


def _hexagon(size: float) -> Column:
    """Closed boundary of the cell in columns q, r."""
    corners = hexgrid.boundary(F.col("q"), F.col("r"), size)
    return F.concat(corners, F.slice(corners, 1, 1))


def candidates(areas: DataFrame, size: float) -> DataFrame:
    """All columns of ``areas`` (with ``shape``), and q, r of each cell whose hexagon can meet the shape's box."""
    out = areas.withColumn("__b", shapes.bbox(F.col("shape")))
    r0, r1 = F.floor((F.col("__b.ymin") - size) / (1.5 * size)), F.ceil((F.col("__b.ymax") + size) / (1.5 * size))
    out = out.withColumn("r", F.explode(F.sequence(r0.cast("long"), r1.cast("long"))))
    wide = hexgrid.ROOT3 * size
    q0, q1 = F.floor((F.col("__b.xmin") - wide) / wide - F.col("r") / 2.0), F.ceil((F.col("__b.xmax") + wide) / wide - F.col("r") / 2.0)
    return out.withColumn("q", F.explode(F.sequence(q0.cast("long"), q1.cast("long")))).drop("__b")


def fill(areas: DataFrame, key: str, size: float, contain: str = "center") -> DataFrame:
    """(key, q, r) of the cells of each area, a ``shape`` or a closed ``ring``.

    center: the cell's centre lies in it; centroid: the one cell that holds the shape's centroid; full: the whole cell lies in it;
    overlap: they meet; bbox_overlap: their boxes meet; center_overlap: center, and overlap for shapes that hold no centre.
    """
    if contain not in CONTAIN:
        raise ValueError(f"contain must be one of {CONTAIN}")
    if contain == "centroid":
        at = shapes.centroid(shapes.of(areas))
        return areas.select(key, at.alias("__p")).filter("__p IS NOT NULL").select(key, hexgrid.cell(F.col("__p.x"), F.col("__p.y"), size).alias("__c")).select(key, "__c.q", "__c.r")
    shape, hexagon = F.col("shape"), shapes.of_ring(_hexagon(size))
    near = candidates(dealt(areas.select(key, shapes.of(areas).alias("shape"))), size)
    x, y = hexgrid.centre(F.col("q").cast("double"), F.col("r").cast("double"), size)
    centre = shapes.contains(shape, x, y)
    # Boxes first, a little wider than they are: most candidates go before their sides are looked at.
    b, half = shapes.bbox(shape), hexgrid.ROOT3 / 2 * size
    slack = (F.abs(x) + F.abs(y) + size) * 1e-9
    boxes = lambda by: (x + half + by >= b["xmin"]) & (x - half - by <= b["xmax"]) & (y + size + by >= b["ymin"]) & (y - size - by <= b["ymax"])
    if contain == "center":
        out = near.filter(centre)
    elif contain == "full":
        out = near.filter(shapes.inside(shape, hexagon))
    elif contain == "bbox_overlap":
        out = near.filter(boxes(F.lit(0.0)))
    elif contain == "overlap":
        out = near.filter(boxes(slack)).filter(shapes.meets(shape, hexagon))
    else:
        held = near.filter(boxes(slack)).withColumn("__in", F.coalesce(centre, F.lit(False)))
        held = held.filter(F.col("__in") | shapes.meets(shape, hexagon)).select(key, "q", "r", "__in")
        any_in = F.max("__in").over(Window.partitionBy(key))
        out = held.withColumn("__any", any_in).filter("__in OR NOT __any")
    return out.select(key, "q", "r")


def _grouped(rows: DataFrame, keys: list[str], methods: Mapping[str, str], orders: Mapping[str, Sequence], place: str | None) -> DataFrame:
    """The plain methods per key: first, last, min, max, mean, sum, count; columns with an order by their ranks."""
    aggs = []
    for c, how in methods.items():
        v = rank_of(F.col(c), orders[c]) if c in orders else F.col(c)
        v = F.when(v < len(orders[c]), v) if c in orders else v
        if how in ("first", "last"):
            # the row that comes first (last) by ``place`` among those with a value
            at = F.when(v.isNotNull(), F.col(place) if place else F.monotonically_increasing_id())
            a = (F.min_by if how == "first" else F.max_by)(v, at)
        else:
            a = {"min": F.min, "max": F.max, "mean": F.avg, "sum": F.sum, "distribute": F.sum, "count": F.count}[how](v)
        aggs.append(a.alias(c))
    out = rows.groupBy(*keys).agg(*aggs)
    decoded = [label_of(F.round(F.col(c)).cast("int"), orders[c]).alias(c) if c in orders else F.col(c) for c in methods]
    return out.select(*keys, *decoded)


def aggregate(rows: DataFrame, cells: str, methods: Mapping[str, str], orders: Mapping[str, Sequence] | None = None, place: str | None = None, cell_area: float | None = None, area: str | None = None) -> DataFrame:
    """Values of rows per cell of their array column ``cells``: one row per cell, a column per key of ``methods``.

    distribute shares a value evenly among its cells, so the total stays; density (with ``area``, a row's own, and ``cell_area``)
    is the mean density times the cell's area, scaled so that the total stays; first and last (by ``place``), min, max, mean, sum and count
    are over the rows of a cell. Columns in ``orders`` are ordered labels: they aggregate by place in the list, and what is not listed
    counts as null. Rows, and cells, without any value are left out.
    """
    orders = orders or {}
    some = reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in methods))
    rows = rows.filter(some & (F.size(cells) > 0))
    size = F.size(cells)
    shares = {c: F.col(c).cast("double") / size for c, how in methods.items() if how == "distribute"}
    dense = {c: F.col(c).cast("double") / F.col(area) for c, how in methods.items() if how == "density"}
    kept = [F.col(c) for c in methods if c not in shares and c not in dense]
    spread = rows.select(*kept, *(v.alias(c) for c, v in (shares | dense).items()), *([place] if place else []), F.explode(cells).alias("cell"))
    out = _grouped(spread, ["cell"], {c: "mean" if how == "density" else how for c, how in methods.items()}, orders, place)
    for c in dense:
        totals = rows.agg(F.sum(F.col(c).cast("double")).alias("__total")).crossJoin(out.agg(F.sum(F.col(c) * cell_area).alias("__sum")))  # one row each
        out = out.crossJoin(F.broadcast(totals)).withColumn(c, F.col(c) * cell_area * F.try_divide(F.col("__total"), F.col("__sum"))).drop("__total", "__sum")
    return out.filter(reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in methods)))


def whole_if_integral(value: Column) -> Column:
    """A sum as a whole number where it is one."""
    return F.when(value == F.floor(value), value.cast("long"))


def _blocked(areas: DataFrame, block: float, box: str) -> DataFrame:
    """``areas`` once per block of a square grid that the box in a column meets (bx, by)."""
    ends = lambda lo, hi: F.sequence(F.floor(F.col(box)[lo] / block).cast("long"), F.floor(F.col(box)[hi] / block).cast("long"))
    return areas.withColumn("bx", F.explode(ends("xmin", "xmax"))).withColumn("by", F.explode(ends("ymin", "ymax")))


def matches(sources: DataFrame, targets: DataFrame, block: float, contain: str = "center") -> DataFrame:
    """(tid, sid) of sources (sid) and targets (tid), each a ``shape`` or a closed ``ring``, by an equi-join on square blocks with the
    exact predicate left.

    center and centroid: the source's centroid lies in the target; full: the whole source does; overlap: they meet;
    bbox_overlap: their boxes do; center_overlap: center, and overlap for sources that it places nowhere.
    """
    # Centres and boxes are columns of their own side, so that no pair computes them again; sources are dealt to all cores for that.
    held = dealt(sources.select("sid", shapes.of(sources).alias("source")))
    held = held.select("sid", "source", shapes.centroid(F.col("source")).alias("at"), shapes.bbox(F.col("source")).alias("s_box"))
    t = _blocked(targets.select("tid", shapes.of(targets).alias("target")).withColumn("t_box", shapes.bbox(F.col("target"))), block, "t_box")
    if contain in ("center", "centroid"):
        # Only the block that holds the centre can hold a target of it, and nothing else of the source is looked at.
        place = lambda c: F.floor(F.col("at")[c] / block).cast("long")
        # By way of explode() a centre is worked out once, not again for each column that is made of it.
        s = held.select("sid", F.explode(F.array("at")).alias("at")).withColumns({"bx": place("x"), "by": place("y")})
        x, y, b = F.col("at.x"), F.col("at.y"), F.col("t_box")
        slack = (F.abs(x) + block) * 1e-9
        near = s.join(t, ["bx", "by"]).filter((y >= b["ymin"]) & (y <= b["ymax"]) & (x >= b["xmin"] - slack) & (x <= b["xmax"] + slack))
        return near.filter(shapes.contains(F.col("target"), x, y)).select("tid", "sid").distinct()
    s = _blocked(held, block, "s_box")
    near = s.join(t, ["bx", "by"])
    source, target, at, a, b = (F.col(c) for c in ("source", "target", "at", "s_box", "t_box"))
    boxes = (a["xmax"] >= b["xmin"]) & (a["xmin"] <= b["xmax"]) & (a["ymax"] >= b["ymin"]) & (a["ymin"] <= b["ymax"])
    rules = {
        "center": shapes.contains(target, at["x"], at["y"]),
        "full": shapes.inside(target, source),
        "overlap": shapes.meets(target, source),
        "bbox_overlap": boxes,
    }
    rules["centroid"] = rules["center"]
    pairs = lambda how: near.filter(boxes).filter(rules[how]).select("tid", "sid").distinct()
    if contain != "center_overlap":
        return pairs(contain)
    placed = pairs("center")
    return placed.unionByName(pairs("overlap").join(placed.select("sid").distinct(), "sid", "left_anti").select("tid", "sid"))


def resample(sources: DataFrame, targets: DataFrame, block: float, methods: Mapping[str, str], contain: str = "center", orders: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Every target (tid) with the values of the sources that match it; distribute shares a source among its targets."""
    pairs = matches(sources, targets, block, contain)
    n = pairs.groupBy("sid").agg(F.count("*").alias("__n"))
    rows = pairs.join(n, "sid").join(sources.drop("ring", "shape"), "sid")
    shared = [(F.col(c).cast("double") / F.col("__n")).alias(c) if how == "distribute" else F.col(c) for c, how in methods.items()]
    out = _grouped(rows.select("tid", "sid", *shared), ["tid"], methods, orders or {}, "sid")
    return targets.select("tid").join(out, "tid", "left")


def parents(children: DataFrame, above: DataFrame, block: float) -> DataFrame:
    """(sid, tid, n_children): the first parent that holds a child's centroid, and how many children it has."""
    first = matches(children, above, block, "center").groupBy("sid").agg(F.min("tid").alias("tid"))
    return first.join(first.groupBy("tid").agg(F.count("*").alias("n_children")), "tid")


def box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """A closed ring, counter-clockwise."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(point(xmin, ymin), point(xmax, ymin), point(xmax, ymax), point(xmin, ymax), point(xmin, ymin))


def cell_id(q: Column, r: Column) -> Column:
    """Axial coordinates as one long."""
    return F.shiftleft(q + (1 << 30), 31).bitwiseOR(r + (1 << 30))


def from_cell_id(cell: Column) -> tuple[Column, Column]:
    return F.shiftright(cell, 31) - (1 << 30), cell.bitwiseAND((1 << 31) - 1) - (1 << 30)


def from_raster(vectors: DataFrame, size: float, value: str = "value", contain: str = "center_overlap") -> DataFrame:
    """Cell boxes (id, xmin, ymin, xmax, ymax, value) shared among hexagons, the total kept."""
    areas = vectors.select("id", F.col(value).alias("value"), box(*(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))).alias("ring"))
    lists = fill(areas, "id", size, contain).groupBy("id").agg(F.collect_list(cell_id(F.col("q"), F.col("r"))).alias("cells"))
    out = aggregate(areas.join(lists, "id").select("value", "cells"), "cells", {"value": "distribute"})
    q, r = from_cell_id(F.col("cell"))
    return out.select(q.alias("q"), r.alias("r"), "value")


def hex_area_km2(size: float) -> float:
    return 1.5 * math.sqrt(3.0) * size * size / 1e6
