"""Rasters as tables of cells (row_no, col, value) with a ``Grid`` that says where they lie."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfield.functions import shapes
from wayfield.session import dealt


@dataclass(frozen=True)
class Grid:
    """Origin (corner of cell 0, 0), cell sizes (dy may be negative: rows run down) and shape."""

    x0: float
    y0: float
    dx: float
    dy: float
    n_rows: int
    n_cols: int
    srid: int = 0

    @classmethod
    def from_affine(cls, a: float, b: float, c: float, d: float, e: float, f: float, n_rows: int, n_cols: int, srid: int = 0) -> Grid:
        """From x = a * col + b * row + c, y = d * col + e * row + f; turned grids are refused."""
        if b or d:
            raise ValueError("turned rasters are not supported")
        return cls(c, f, a, e, n_rows, n_cols, srid)

    def affine(self) -> tuple[float, float, float, float, float, float]:
        return (self.dx, 0.0, self.x0, 0.0, self.dy, self.y0)

    @property
    def cell_km2(self) -> float:
        return abs(self.dx * self.dy) / 1e6

    def x(self, col: Column, at: float = 0.5) -> Column:
        return F.lit(float(self.x0)) + (col + F.lit(at)) * F.lit(float(self.dx))

    def y(self, row: Column, at: float = 0.5) -> Column:
        return F.lit(float(self.y0)) + (row + F.lit(at)) * F.lit(float(self.dy))

    def col(self, x: Column) -> Column:
        return F.floor((x - F.lit(float(self.x0))) / F.lit(float(self.dx))).cast("long")

    def row(self, y: Column) -> Column:
        return F.floor((y - F.lit(float(self.y0))) / F.lit(float(self.dy))).cast("long")

    def inside(self, row: Column, col: Column) -> Column:
        return row.between(0, self.n_rows - 1) & col.between(0, self.n_cols - 1)

    def cells(self, spark: SparkSession) -> DataFrame:
        """All (row_no, col): rows are dealt to tasks, columns made there."""
        rows = spark.range(self.n_rows).select(F.col("id").alias("row_no"))
        return rows.withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.n_cols - 1).cast("long"))))


def has_data(value: Column, kind: str, nodata=None) -> Column:
    """Neither null, NaN nor the empty label, nor the raster's own nodata value."""
    ok = value.isNotNull()
    if kind in ("double", "float"):
        ok = ok & ~F.isnan(value)
    if kind == "string":
        ok = ok & (value != "")
    return ok if nodata is None else ok & (value != F.lit(nodata))


def crop(cells: DataFrame, grid: Grid, ring: Column | None = None, shape: Column | None = None) -> tuple[DataFrame, Grid]:
    """Cells whose centre lies in the ring or shape, in the smallest window that holds them, and that window's grid."""
    kept = cells.filter(shapes.contains(shapes.of_ring(ring) if shape is None else shape, grid.x(F.col("col")), grid.y(F.col("row_no"))))
    r0, r1, c0, c1 = kept.agg(F.min("row_no"), F.max("row_no"), F.min("col"), F.max("col")).first()
    if r0 is None:
        return kept, Grid(grid.x0, grid.y0, grid.dx, grid.dy, 0, 0, grid.srid)
    shifted = kept.withColumns({"row_no": F.col("row_no") - r0, "col": F.col("col") - c0})
    return shifted, Grid(grid.x0 + c0 * grid.dx, grid.y0 + r0 * grid.dy, grid.dx, grid.dy, r1 - r0 + 1, c1 - c0 + 1, grid.srid)


def vectorize(cells: DataFrame, grid: Grid, ring: Column | None = None, keep_nodata: bool = False, nodata=None, shape: Column | None = None) -> DataFrame:
    """id (row * columns + column), the box of each cell and its value; with ``ring`` or ``shape`` cells whose centre lies inside."""
    out = cells if keep_nodata else cells.filter(has_data(F.col("value"), dict(cells.dtypes)["value"], nodata))
    if ring is not None or shape is not None:
        out = out.filter(shapes.contains(shapes.of_ring(ring) if shape is None else shape, grid.x(F.col("col")), grid.y(F.col("row_no"))))
    xs, ys = (grid.x(F.col("col"), 0.0), grid.x(F.col("col"), 1.0)), (grid.y(F.col("row_no"), 0.0), grid.y(F.col("row_no"), 1.0))
    box = [F.least(*xs).alias("xmin"), F.least(*ys).alias("ymin"), F.greatest(*xs).alias("xmax"), F.greatest(*ys).alias("ymax")]
    return out.select((F.col("row_no") * grid.n_cols + F.col("col")).alias("id"), *box, "value")


def rank_of(value: Column, order: Sequence) -> Column:
    """Place in the list; what is not listed comes after all."""
    out = F.lit(len(order))
    for i in reversed(range(len(order))):
        out = F.when(value == F.lit(order[i]), i).otherwise(out)
    return F.coalesce(out, F.lit(len(order)))


def label_of(rank: Column, order: Sequence) -> Column:
    """The label at a place of the list, null beyond it."""
    out = F.lit(None)
    for i, label in enumerate(order):
        out = F.when(rank == i, F.lit(label)).otherwise(out)
    return out


def rasterize(areas: DataFrame, grid: Grid, value: str, order: Sequence | None = None, all_touched: bool = False) -> DataFrame:
    """(row_no, col, value) of areas (``shape`` or closed ``ring``): the first listed of ``order`` wins, else the largest value.

    An area is burnt into the cells whose centre it holds, or with ``all_touched`` into those it touches. Candidates
    come from its box, so the work is in proportion to the area covered; areas are dealt to all cores before that.
    """
    boxed = dealt(areas.select(F.col(value).alias("value"), shapes.of(areas).alias("shape"))).withColumn("b", shapes.bbox(F.col("shape")))
    ends = lambda f, lo, hi, n: (F.greatest(F.least(f(lo), f(hi)), F.lit(0).cast("long")), F.least(F.greatest(f(lo), f(hi)), F.lit(n - 1).cast("long")))
    r0, r1 = ends(grid.row, F.col("b.ymin"), F.col("b.ymax"), grid.n_rows)
    c0, c1 = ends(grid.col, F.col("b.xmin"), F.col("b.xmax"), grid.n_cols)
    spread = boxed.withColumns({"r0": r0, "r1": r1, "c0": c0, "c1": c1}).filter("r0 <= r1 AND c0 <= c1")
    spread = spread.select("value", "shape", "c0", "c1", F.explode(F.sequence("r0", "r1")).alias("row_no"))
    # The sides that a row of cells crosses are the same for all of its columns.
    if not all_touched:
        spread = spread.withColumn("shape", shapes.crossings(F.col("shape"), grid.y(F.col("row_no"))))
    spread = spread.select("value", "shape", "row_no", F.explode(F.sequence("c0", "c1")).alias("col"))
    if all_touched:
        xs, ys = (grid.x(F.col("col"), 0.0), grid.x(F.col("col"), 1.0)), (grid.y(F.col("row_no"), 0.0), grid.y(F.col("row_no"), 1.0))
        hit = shapes.touches_box(F.col("shape"), F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))
    else:
        hit = shapes.right_of(F.col("shape"), grid.x(F.col("col")))
    burnt = spread.filter(hit)
    if order is None:
        return burnt.groupBy("row_no", "col").agg(F.max("value").alias("value"))
    ranked = burnt.groupBy("row_no", "col").agg(F.min(rank_of(F.col("value"), order)).alias("rank_no"))
    return ranked.select("row_no", "col", label_of(F.col("rank_no"), order).alias("value"))


def reproject(cells: DataFrame, grid: Grid, target: Grid, to_source: Callable[[Column, Column], tuple[Column, Column]] | None = None) -> DataFrame:
    """Each cell of ``target`` with the value of the source cell under its centre, null where there is none."""
    centre = target.x(F.col("col")), target.y(F.col("row_no"))
    x, y = to_source(*centre) if to_source else centre
    source = cells.select(F.col("row_no").alias("sr"), F.col("col").alias("sc"), "value")
    wanted = target.cells(cells.sparkSession).withColumns({"sr": grid.row(y), "sc": grid.col(x)})
    return wanted.join(source, ["sr", "sc"], "left").select("row_no", "col", "value")


def global_grid(grid: Grid, resolution: float) -> Grid:
    """The grid of that resolution, anchored at 0, 0, that covers ``grid``; rows run down."""
    xs, ys = sorted((grid.x0, grid.x0 + grid.dx * grid.n_cols)), sorted((grid.y0, grid.y0 + grid.dy * grid.n_rows))
    c0, c1 = math.floor(xs[0] / resolution), math.ceil(xs[1] / resolution)
    r0, r1 = math.floor(ys[0] / resolution), math.ceil(ys[1] / resolution)
    return Grid(c0 * resolution, r1 * resolution, resolution, -resolution, r1 - r0, c1 - c0, grid.srid)


def kernel_widths(radius: int, shape: str = "disk") -> list[int]:
    """Half-width of the kernel's row at each distance 0..radius from its middle; a square has side 2 * radius + 1."""
    if shape not in ("disk", "square"):
        raise ValueError(f"unknown kernel {shape}")
    return [math.isqrt(radius * radius - d * d) if shape == "disk" else radius for d in range(radius + 1)]


def kernel_size(radius: int, shape: str = "disk") -> int:
    widths = kernel_widths(radius, shape)
    return sum((2 * w + 1) * (1 if d == 0 else 2) for d, w in enumerate(widths))


def focal_sum(cells: DataFrame, grid: Grid, radius: int, shape: str = "disk") -> DataFrame:
    """Per cell of the grid the sum of ``value`` over the kernel, zero beyond the edges.

    A row's running sums over each half-width come from one window per width; a kernel is then its 2 * radius + 1 rows, not its
    area, so a cell is copied that often.
    """
    widths = kernel_widths(radius, shape)
    dense = grid.cells(cells.sparkSession).join(cells.select("row_no", "col", "value"), ["row_no", "col"], "left").withColumn("value", F.coalesce(F.col("value").cast("double"), F.lit(0.0)))
    line = Window.partitionBy("row_no").orderBy("col")
    runs = dense.select("row_no", "col", *(F.sum("value").over(line.rowsBetween(-w, w)).alias(f"w{w}") for w in sorted(set(widths))))
    moves = [F.struct((F.col("row_no") + sign * d).alias("row_no"), F.col(f"w{w}").alias("s")) for d, w in enumerate(widths) for sign in ((1, -1) if d else (1,))]
    moved = runs.select("col", F.explode(F.array(*moves)).alias("m")).select("m.row_no", "col", "m.s").filter(F.col("row_no").between(0, grid.n_rows - 1))
    return moved.groupBy("row_no", "col").agg(F.sum("s").alias("value"))


def density(cells: DataFrame, grid: Grid, buffer: float, shape: str = "disk") -> DataFrame:
    """Focal sum per km2 of the kernel; a buffer of 0 is the cell alone."""
    radius = int(round(buffer / abs(grid.dx)))
    area = kernel_size(radius, shape) * grid.cell_km2
    return focal_sum(cells, grid, radius, shape).withColumn("value", F.col("value") / F.lit(area))


def mosaic(rasters: Sequence[DataFrame], how: str = "max") -> DataFrame:
    """Rasters of one grid laid over each other: max, min, sum, mean, or first (in the list's order) that has data."""
    agg = {"max": F.max("value"), "min": F.min("value"), "sum": F.sum("value"), "mean": F.avg("value"), "first": F.min_by("value", "place")}[how]
    placed = [r.select("row_no", "col", "value", F.lit(i).alias("place")).filter("value IS NOT NULL") for i, r in enumerate(rasters)]
    return reduce(DataFrame.unionByName, placed).groupBy("row_no", "col").agg(agg.alias("value"))
