"""Spatial lookups by equi-joins on grid cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfield.functions import shapes
from wayfield.operators.hexcells import matches
from wayfield.session import materialize


def cell(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(size)).cast("long")


def _finite(df: DataFrame) -> DataFrame:
    """Rows whose x and y are numbers; others are near nothing."""
    number = lambda c: F.abs(F.col(c).cast("double")) < float("inf")
    return df.filter(number("x") & number("y"))


def nearest(points: DataFrame, targets: DataFrame, size: int, max_rings: int = 8) -> DataFrame:
    """Per point (pid, x, y) the nearest target (tid, x, y): pid, tid, d2 (squared distance; least tid among equals).

    Targets are looked up in the cells around the point's, ring by ring: a point is settled when its best is
    no farther than the rings searched so far can hide. The search radius doubles, so far points cost few rounds;
    beyond ``max_rings`` rings it goes on with rings of larger cells, until no point waits. Without targets, or without
    coordinates, a point has no row.
    """
    targets = _finite(targets).select("tid", F.col("x").alias("tx"), F.col("y").alias("ty"))
    waiting, done, radius = _finite(points).select("pid", "x", "y"), None, 1
    while True:
        placed = targets.select("*", cell(F.col("tx"), size).alias("cx"), cell(F.col("ty"), size).alias("cy"))
        around = F.sequence(F.lit(-radius), F.lit(radius))
        cells = waiting.select("pid", "x", "y", F.explode(around).alias("i")).select("*", F.explode(around).alias("j"))
        cells = cells.select("pid", "x", "y", (cell(F.col("x"), size) + F.col("i")).alias("cx"), (cell(F.col("y"), size) + F.col("j")).alias("cy"))
        d2 = (F.col("x") - F.col("tx")) * (F.col("x") - F.col("tx")) + (F.col("y") - F.col("ty")) * (F.col("y") - F.col("ty"))
        found = cells.join(placed, ["cx", "cy"], "left").groupBy("pid", "x", "y").agg(F.min(F.when(F.col("tid").isNotNull(), F.struct(d2.alias("d2"), F.col("tid")))).alias("best"))
        settled = F.coalesce(F.col("best.d2") <= (radius * size) * (radius * size), F.lit(False))
        judged = materialize(found.select("pid", "x", "y", "best.tid", "best.d2", settled.alias("settled")), "nearest")
        fresh = judged.filter("settled").select("pid", "tid", "d2")
        done = fresh if done is None else done.union(fresh)
        waiting = judged.filter("NOT settled").select("pid", "x", "y")
        if waiting.isEmpty() or (radius == 1 and targets.isEmpty()):
            return done
        if 2 * radius <= max_rings:
            radius *= 2
        else:
            size, radius = 2 * radius * size, 1


def within(points: DataFrame, targets: DataFrame, distance: int) -> DataFrame:
    """Pairs (point columns, tid, d2) at most ``distance`` apart, by cells of that size."""
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    spread = targets.select("tid", F.col("x").alias("tx"), F.col("y").alias("ty"), F.explode(around).alias("i")).select("*", F.explode(around).alias("j"))
    spread = spread.select("tid", "tx", "ty", (cell(F.col("tx"), distance) + F.col("i")).alias("cx"), (cell(F.col("ty"), distance) + F.col("j")).alias("cy"))
    keyed = points.withColumns({"cx": cell(F.col("x"), distance), "cy": cell(F.col("y"), distance)})
    d2 = (F.col("x") - F.col("tx")) * (F.col("x") - F.col("tx")) + (F.col("y") - F.col("ty")) * (F.col("y") - F.col("ty"))
    return keyed.join(spread, ["cx", "cy"]).withColumn("d2", d2).filter(F.col("d2") <= distance * distance).drop("cx", "cy", "tx", "ty")


def pairs_that_meet(a: DataFrame, b: DataFrame, block: float) -> DataFrame:
    """(aid, bid) of areas (aid) and (bid), each a ``shape`` or a closed ``ring``, that have a point in common: the true cells of the all-with-all matrix."""
    found = matches(b.withColumnRenamed("bid", "sid"), a.withColumnRenamed("aid", "tid"), block, "overlap")
    return found.select(F.col("tid").alias("aid"), F.col("sid").alias("bid"))


def _row_blocks(s: np.ndarray, block: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """(cx, cy, sides) of the blocks of a shape's sides (ax, ay, bx, by), so that in each its sides hold a point as all sides do."""
    s = s[np.isfinite(s).all(axis=1) & (s[:, 1] != s[:, 3])]
    if not len(s):
        return
    low, high = np.minimum(s[:, 1], s[:, 3]), np.maximum(s[:, 1], s[:, 3])
    r0, r1 = np.floor(low / block).astype(np.int64), np.floor(high / block).astype(np.int64)
    side = np.repeat(np.arange(len(s)), r1 - r0 + 1)
    row = r0[side] + np.arange(len(side)) - np.repeat(np.cumsum(r1 - r0 + 1) - (r1 - r0 + 1), r1 - r0 + 1)
    # Where a side lies while it is in a row, a little wider than that.
    ax, ay, bx, by = s[side].T
    at = [ax + (bx - ax) * np.clip(((row + k) * block - ay) / (by - ay), 0, 1) for k in (0, 1)]
    slack = 1e-9 * (np.abs(s[:, [0, 2]]).max() + block)
    c0 = np.floor(np.maximum(np.minimum(*at) - slack, np.minimum(ax, bx)) / block).astype(np.int64)
    c1 = np.floor(np.minimum(np.maximum(*at) + slack, np.maximum(ax, bx)) / block).astype(np.int64)
    under, over = low.min() - block, high.max() + block
    beyond = s[:, [0, 2]].max() + block
    order = np.lexsort((-c0, row))
    for mine in np.split(order, np.flatnonzero(np.diff(row[order])) + 1):
        cy = int(row[mine[0]])
        here: dict[int, list[int]] = {}
        for i in mine.tolist():
            for c in range(c0[i], c1[i] + 1):
                here.setdefault(c, []).append(i)
        # A side wholly to the right is crossed where just one of its ends is above: of ends at one height only an odd one matters.
        odd: set[float] = set()
        nxt = 0
        for cx in range(int(c1[mine].max()), int(c0[mine].min()) - 1, -1):
            while nxt < len(mine) and c0[mine[nxt]] > cx:
                for y in (ay[mine[nxt]], by[mine[nxt]]):
                    c = np.floor(y / block)
                    odd ^= {under if c < cy else over if c > cy else float(y)}
                nxt += 1
            heights = np.array(sorted(odd)).reshape(-1, 2)
            right = np.column_stack([np.full(len(heights), beyond), heights[:, 0], np.full(len(heights), beyond), heights[:, 1]])
            local = s[side[here[cx]]] if cx in here else s[:0]
            if len(local) or len(right):
                yield cx, cy, np.concatenate([local, right])


def _shape_sides(shape: pa.ListScalar) -> np.ndarray:
    rings = shape.values.flatten()
    x, y = (c.to_numpy(zero_copy_only=False).astype(np.float64) for c in rings.flatten().flatten())
    last = np.cumsum(rings.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64) - 1
    keep = np.ones(len(x), bool)
    keep[last[last >= 0]] = False
    at = np.flatnonzero(keep)
    return np.column_stack([x[at], y[at], x[at + 1], y[at + 1]])


def in_blocks(areas: DataFrame, block: float) -> DataFrame:
    """Areas (``shape`` and other columns) once per square block (cx, cy) in which they can hold a point, each with ``shape`` cut down to the
    sides that matter there: ``shapes.contains`` gives for the block's points what it gives for the whole shape. Sides in the block stay;
    those to its right become upright ones that are crossed at the same heights, with equal ends cancelled. So an area costs as much
    as it has sides and blocks, and not their product."""
    others = [c for c in areas.columns if c != "shape"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            points = np.concatenate(cut).reshape(-1, 2)
            xy = pa.StructArray.from_arrays([pa.array(points[:, k]) for k in (0, 1)], names=["x", "y"])
            lines = pa.ListArray.from_arrays(pa.array(np.arange(0, len(points) + 1, 2), pa.int32()), xy)
            parts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(c) for c in cut])]), pa.int32()), lines)
            shape = pa.ListArray.from_arrays(pa.array(np.arange(len(cut) + 1), pa.int32()), parts)
            own = [batch.column(c).take(pa.array(rows)) for c in others]
            return pa.RecordBatch.from_arrays([*own, pa.array(cx, pa.int64()), pa.array(cy, pa.int64()), shape], names=[*others, "cx", "cy", "shape"])

        for batch in batches:
            rows, cx, cy, cut, n = [], [], [], [], 0
            for i, shape in enumerate(batch.column("shape")):
                if not shape.is_valid:
                    continue
                for x, y, sides in _row_blocks(_shape_sides(shape), block):
                    rows.append(i), cx.append(x), cy.append(y), cut.append(sides)
                    n += len(sides)
                    if n > 50_000:
                        yield flush()
                        rows, cx, cy, cut, n = [], [], [], [], 0
            if rows:
                yield flush()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in areas.select(*others).schema)
    return areas.select(*others, "shape").mapInArrow(run, f"{fields}, cx long, cy long, shape {shapes.SHAPE}")


def points_in_rings(areas: DataFrame, points: DataFrame, block: float) -> DataFrame:
    """(aid, pid) of points (pid, x, y) inside areas (aid, ``shape`` or closed ``ring``), by an equi-join on square blocks."""
    spread = in_blocks(areas.select("aid", shapes.of(areas).alias("shape")), block)
    keyed = points.select("pid", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).withColumns({"cx": cell(F.col("x"), block), "cy": cell(F.col("y"), block)})
    return keyed.join(spread.hint("merge"), ["cx", "cy"]).filter(shapes.contains(F.col("shape"), F.col("x"), F.col("y"))).select("aid", "pid")
