"""Timetables: representative days, stop speeds and headways, scores of stops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfield.functions.scoring import TransitScore, grid_ceiling_clipped


def modal_band(rows: DataFrame, value: str, by: str | None = None, bins: int = 5) -> DataFrame:
    """Rows whose value is usual: at least half the 90th percentile, in the fullest of ``bins`` equal bins of these (tied bins and
    all between them count), and within one deviation of the mean there. ``band_mean`` is that mean. One band per ``by``.
    A value exactly one deviation away counts; for whole numbers this is decided without rounding, whatever the order of rows.

    Steps are grouped sums whose results (a few numbers per group) are joined back.
    """
    keys = [by] if by else []
    rows = rows.filter(F.col(value).isNotNull()).withColumn("__v", F.col(value).cast("double"))
    key = F.col(by) if by else F.lit(0)
    rows = rows.withColumn("__key", key)

    def attach(df: DataFrame, small: DataFrame) -> DataFrame:
        return df.join(small, F.col("__key").eqNullSafe(F.col("__of"))).drop("__of")

    of = F.col("__key").alias("__of")
    cut = rows.groupBy(of).agg((F.percentile("__v", 0.9) * 0.5).alias("__cut"))
    kept = attach(rows, cut).filter("__v >= __cut AND __v > 0")
    ends = kept.groupBy(of).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    # all values equal: the histogram is half a unit wide to both sides, as one around a point is
    lo = F.when(F.col("__lo") == F.col("__hi"), F.col("__lo") - 0.5).otherwise(F.col("__lo"))
    hi = F.when(F.col("__lo") == F.col("__hi"), F.col("__hi") + 0.5).otherwise(F.col("__hi"))
    ends = ends.select("__of", lo.alias("__lo"), hi.alias("__hi"))
    bin_ = F.least(F.floor((F.col("__v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * bins), F.lit(bins - 1)).cast("int")
    binned = attach(kept, ends).withColumn("__bin", bin_)
    counts = binned.groupBy(of, "__bin", "__lo", "__hi").agg(F.count("*").alias("__n"))
    most = F.max("__n").over(Window.partitionBy("__of"))
    modal = counts.withColumn("__most", most).filter("__n = __most").groupBy("__of").agg(F.min("__bin").alias("__b0"), F.max("__bin").alias("__b1"))
    edge = lambda b: F.col("__lo") + F.col(b) * (F.col("__hi") - F.col("__lo")) / bins
    inside = attach(binned, modal).filter((F.col("__v") >= edge("__b0")) & (F.col("__v") <= F.col("__lo") + (F.col("__b1") + 1) * (F.col("__hi") - F.col("__lo")) / bins))
    inside = inside.withColumn("__x", F.col("__v") - F.col("__lo"))
    # n x - sum x and n sum x^2 - (sum x)^2 are n times the distance from the mean and n^2 times the variance
    stats = inside.groupBy(of).agg(F.avg("__v").alias("band_mean"), F.sum("__x").alias("__sum"), F.sum(F.col("__x") * F.col("__x")).alias("__squares"), F.count("*").alias("__n"))
    out = attach(inside, stats).filter("__n = 1 OR (__n * __x - __sum) * (__n * __x - __sum) <= __n * __squares - __sum * __sum")
    columns = [c for c in rows.columns if not c.startswith("__")]
    return out.select(*dict.fromkeys([*keys, *columns]), "band_mean")


def representative(rows: DataFrame, value: str, order: str, by: str | None = None) -> DataFrame:
    """The one usual row: nearest to the mean of the usual rows (the first in ``order`` among equals); with several feeds
    (``by``) the largest of all their usual rows."""
    band = modal_band(rows, value, by)
    if by:
        return band.orderBy(F.desc(value), order).limit(1).drop("band_mean")
    mean = band.agg(F.avg(value).alias("__mean"))
    far = F.abs(F.col(value) - F.col("__mean"))
    return rows.crossJoin(F.broadcast(mean)).filter(F.col("__mean").isNotNull() & F.col(value).isNotNull()).orderBy(far, order).limit(1).drop("__mean")


def stop_speeds(rows: DataFrame, stop: str, speed: str, trips: str, mode: str, inside: str | None = None) -> DataFrame:
    """Per stop the mean absolute speed weighted by trips, how many modes serve it, and whether any row is inside the area."""
    mean = F.try_divide(F.sum(F.abs(F.col(speed)) * F.col(trips)), F.sum(F.when(F.col(speed).isNotNull(), F.col(trips))))
    aggs = [mean.alias("speed"), F.count_distinct(mode).alias("n_modes")]
    return rows.groupBy(stop).agg(*aggs, *([F.bool_or(inside).alias("any_inside")] if inside else []))


def with_speeds(stop_times: DataFrame, speeds: DataFrame, keys: Sequence[str], speed: str = "speed") -> DataFrame:
    """Stop times with the speed of their stop and trip, null where it is not known."""
    return stop_times.join(speeds.select(*keys, speed), list(keys), "left")


def headways(rows: DataFrame, keys: Sequence[str], departure_minutes: str) -> DataFrame:
    """Per ``keys`` the mean minutes between successive departures, and how many gaps there are."""
    gap = F.col(departure_minutes) - F.lag(departure_minutes).over(Window.partitionBy(*keys).orderBy(departure_minutes))
    return rows.withColumn("__gap", gap).groupBy(*keys).agg(F.avg("__gap").alias("headway"), F.count("__gap").alias("n_gaps"))


def stop_scores(rows: DataFrame, stop: str, direction: str, mode: str, speed: str, departure_minutes: str, speed_grid: Sequence[float], headway_grid: Sequence[float], model: TransitScore | None = None) -> DataFrame:
    """The best score of each stop over modes and speed bands.

    For each lower bound of ``speed_grid`` the departures at least that fast count, with the band's upper bound as their speed; a stop's
    headway is that of its best direction, snapped up to ``headway_grid`` for ``score_grid``.
    """
    score = (model or TransitScore()).stop()
    bands = F.array(*(F.struct(F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")) for a, b in zip(speed_grid, speed_grid[1:], strict=False)))
    fast = rows.withColumn("__band", F.explode(F.filter(bands, lambda b: F.col(speed) >= b["low"]))).withColumn("speed_grid", F.col("__band.high"))
    every = headways(fast, [stop, direction, mode, "speed_grid"], departure_minutes).filter("headway IS NOT NULL")
    best = every.groupBy(stop, mode, "speed_grid").agg(F.min("headway").alias("headway"))
    snapped = best.withColumn("headway_grid", grid_ceiling_clipped(F.col("headway"), headway_grid))
    scored = snapped.withColumns({"score": score(F.col("headway"), F.col(mode), F.col("speed_grid")), "score_grid": F.round(score(F.col("headway_grid"), F.col(mode), F.col("speed_grid")), 3)})
    order = Window.partitionBy(stop).orderBy(F.desc("score"), mode, "speed_grid")
    return scored.withColumn("__k", F.row_number().over(order)).filter("__k = 1").drop("__k")
