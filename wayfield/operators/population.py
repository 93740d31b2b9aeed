"""Population on rasters and areas: cleaning, streets, densities, and levels of service."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfield.operators.raster import Grid, density, rank_of


def cleaned(value: Column) -> Column:
    """Text or number as a double: what is no number is null, infinite is 0."""
    number = value.try_cast("double")
    number = F.when(F.isnan(number), None).otherwise(number)
    return F.when(F.abs(number) == float("inf"), 0.0).otherwise(number)


def box_to_segment(x0: Column, y0: Column, x1: Column, y1: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Squared distance from a box to a segment, 0 where they meet."""

    def to_segment(x: Column, y: Column) -> Column:
        dx, dy = bx - ax, by - ay
        n = dx * dx + dy * dy
        t = F.when(n > 0, F.least(F.greatest(((x - ax) * dx + (y - ay) * dy) / n, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        ex, ey = ax + t * dx - x, ay + t * dy - y
        return ex * ex + ey * ey

    def to_box(x: Column, y: Column) -> Column:
        ex, ey = F.greatest(x0 - x, x - x1, F.lit(0.0)), F.greatest(y0 - y, y - y1, F.lit(0.0))
        return ex * ex + ey * ey

    side = lambda x, y: (bx - ax) * (y - ay) - (by - ay) * (x - ax)
    corners = [side(x, y) for x in (x0, x1) for y in (y0, y1)]
    apart = (F.greatest(*corners) < 0) | (F.least(*corners) > 0)
    boxes = (F.greatest(ax, bx) >= x0) & (F.least(ax, bx) <= x1) & (F.greatest(ay, by) >= y0) & (F.least(ay, by) <= y1)
    nearest = F.least(*(to_segment(x, y) for x in (x0, x1) for y in (y0, y1)), to_box(ax, ay), to_box(bx, by))
    return F.when(boxes & ~apart, 0.0).otherwise(nearest)


def touched_by_streets(grid: Grid, segments: DataFrame, buffer: float) -> DataFrame:
    """(row_no, col) of cells at most ``buffer`` from a segment (ax, ay, bx, by); candidates come from each segment's widened box."""
    x0, x1 = F.least("ax", "bx") - buffer, F.greatest("ax", "bx") + buffer
    y0, y1 = F.least("ay", "by") - buffer, F.greatest("ay", "by") + buffer
    rows, cols = (grid.row(y0), grid.row(y1)), (grid.col(x0), grid.col(x1))
    clip = lambda c, n: F.least(F.greatest(c, F.lit(0).cast("long")), F.lit(n - 1).cast("long"))
    spread = segments.select("ax", "ay", "bx", "by", F.explode(F.sequence(clip(F.least(*rows), grid.n_rows), clip(F.greatest(*rows), grid.n_rows))).alias("row_no"), clip(F.least(*cols), grid.n_cols).alias("c0"), clip(F.greatest(*cols), grid.n_cols).alias("c1"))
    spread = spread.select("ax", "ay", "bx", "by", "row_no", F.explode(F.sequence("c0", "c1")).alias("col"))
    xs, ys = (grid.x(F.col("col"), 0.0), grid.x(F.col("col"), 1.0)), (grid.y(F.col("row_no"), 0.0), grid.y(F.col("row_no"), 1.0))
    d2 = box_to_segment(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys), *(F.col(c).cast("double") for c in ("ax", "ay", "bx", "by")))
    return spread.filter(d2 <= F.lit(float(buffer) ** 2)).select("row_no", "col").distinct()


def filter_by_streets(cells: DataFrame, grid: Grid, segments: DataFrame, buffer: float, least: float = 0.0) -> DataFrame:
    """Cells over ``least`` that touch buffered streets, scaled up so that the whole raster's total is kept."""
    kept = cells.filter(F.col("value") > least).join(touched_by_streets(grid, segments, buffer), ["row_no", "col"], "left_semi")
    total = cells.agg(F.sum(F.col("value").cast("double")).alias("__whole"))
    part = kept.agg(F.sum(F.col("value").cast("double")).alias("__part"))
    scaled = kept.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(part))  # one row each
    return scaled.select("row_no", "col", (F.col("value") * F.col("__whole") / F.col("__part")).alias("value"))


def area_density(areas: DataFrame, population: str, area_km2: str) -> DataFrame:
    return areas.withColumn("density", F.try_divide(cleaned(F.col(population)), F.col(area_km2)))


def processing_order(matrix: DataFrame, labels: Sequence[str], density_column: str = "density") -> DataFrame:
    """A wide matrix (density, one column per distance with a label or null) as (density, distance, label, importance), the
    least important first, then by distance."""
    distances = [c for c in matrix.columns if c != density_column]
    long = matrix.unpivot(density_column, distances, "distance", "label").filter("label IS NOT NULL")
    long = long.withColumns({"distance": F.col("distance").cast("double"), "importance": rank_of(F.col("label"), labels)})
    return long.orderBy(F.desc("importance"), "distance", density_column)


def demand(cells: DataFrame, grid: Grid, thresholds: Sequence[tuple[float, float, str]], labels: Sequence[str], shape: str = "disk") -> DataFrame:
    """(row_no, col, demand): the best label whose (buffer, density) threshold a cell's density goes over, as its rank.

    A buffer's density is at most that of every smaller one, so a wide buffer cannot outdo what lies in the cell.
    """
    buffers = sorted({0.0, *(float(b) for b, _, _ in thresholds)})
    each = [density(cells, grid, b, shape).withColumnRenamed("value", f"b{i}") for i, b in enumerate(buffers)]
    wide = reduce(lambda a, b: a.join(b, ["row_no", "col"]), each)
    capped = {i: F.least(*(F.col(f"b{j}") for j in range(i + 1))) if i else F.col("b0") for i in range(len(buffers))}
    rank = F.lit(len(labels))
    for b, least, label in sorted(thresholds, key=lambda t: -labels.index(t[2])):
        rank = F.when(capped[buffers.index(float(b))] > F.lit(float(least)), labels.index(label)).otherwise(rank)
    return wide.select("row_no", "col", rank.alias("demand"), *(capped[i].alias(f"density_{b:g}") for i, b in enumerate(buffers)))


def level_of_service(cells: DataFrame, grid: Grid, offer: DataFrame, thresholds: Sequence[tuple[float, float, str]], labels: Sequence[str], shape: str = "disk") -> DataFrame:
    """Demand and offer (row_no, col, value: a label) as ranks, and demand - offer; below 0 a cell is under-served."""
    wanted = demand(cells, grid, thresholds, labels, shape)
    given = offer.select("row_no", "col", rank_of(F.col("value"), labels).alias("offer"))
    out = wanted.join(given, ["row_no", "col"], "left").withColumn("offer", F.coalesce("offer", F.lit(len(labels))))
    return out.withColumn("difference", F.col("demand") - F.col("offer"))


def service_statistics(levels: DataFrame, cells: DataFrame, labels: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Percent of the population that is under-served, and population by offered level, "No Service" where none."""
    both = cells.join(levels, ["row_no", "col"])
    under = both.agg((F.sum(F.when(F.col("difference") < 0, F.col("value")).otherwise(0.0)) * 100.0 / F.sum("value")).alias("percent"))
    name = F.when(F.col("offer") < len(labels), F.element_at(F.array(*(F.lit(x) for x in labels)), F.least(F.col("offer") + 1, F.lit(len(labels))))).otherwise("No Service")
    return under, both.groupBy(name.alias("level")).agg(F.sum("value").alias("population"))


def save_layers(levels: DataFrame, cells: DataFrame, path: str) -> None:
    """Population, density, offer, demand and difference as one Parquet table, by layer."""
    long = levels.join(cells.withColumnRenamed("value", "population"), ["row_no", "col"], "left")
    layers = [c for c in long.columns if c not in ("row_no", "col")]
    out = long.select("row_no", "col", *(F.col(c).cast("double").alias(c) for c in layers)).unpivot(["row_no", "col"], layers, "layer", "value")
    out.write.mode("overwrite").partitionBy("layer").option("compression", "zstd").parquet(path)
