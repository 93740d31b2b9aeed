"""Whole runs, step by step: levels from a matrix, population by level, and levels by census area."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfield.facade import AccessibilityAnalyzer, HexGrid, PointsOfInterest, PopulationLayer, StreetNetwork
from wayfield.operators import census, hexcells


def levels_by_matrix(network: StreetNetwork, pois: PointsOfInterest, matrix: DataFrame, cell: int = 100, min_edge: int = 0, save_to: str | None = None) -> AccessibilityAnalyzer:
    """Workflow A: places of several qualities on a simplified network, levels by a matrix (quality, distance, rank_no)."""
    spark = network.nodes.sparkSession
    simple = network.simplify(min_edge) if min_edge > 0 else network
    distances = [r["distance"] for r in matrix.select("distance").distinct().orderBy("distance").collect()]
    run = AccessibilityAnalyzer(simple, pois, distances, cell)
    run.run(min_edge, matrix=matrix)
    if save_to is not None:
        run.save(spark, save_to, overwrite=True)
    return run


def population_by_level(levels: HexGrid, people: PopulationLayer, labels: Sequence[str], save_to: str | None = None) -> tuple[HexGrid, DataFrame]:
    """Workflow B: population and level per hexagon, and the statistics: population by level, total and percents."""
    both = people.to_hex(levels.base, levels.resolution).join(levels, "full")
    name = F.lit("none")
    for i, label in enumerate(labels):
        name = F.when(F.col("rank_no") == i, label).otherwise(name)
    rows = both.cells.select(name.alias("accessibility"), F.coalesce("value", F.lit(0.0)).alias("population"))
    stats = census.statistics(rows, "accessibility", "population").withColumn("population", F.round("population").cast("long"))
    if save_to is not None:
        both.cells.write.mode("overwrite").option("header", True).csv(os.path.join(save_to, "hexagons"))
        stats.write.mode("overwrite").option("header", True).csv(os.path.join(save_to, "statistics"))
    return both, stats


def levels_by_area(spark: SparkSession, hexes: HexGrid, blocks: DataFrame, population: str, higher: Mapping[str, DataFrame], block: float = 1000.0) -> dict[str, DataFrame]:
    """Workflow C: a block (sid, closed ring, population) takes the mean level of the hexagons whose centres it holds, and each higher
    layer (tid, ring) the mean of its blocks, weighted by population."""
    centres = hexes.with_rings().select(F.monotonically_increasing_id().alias("sid"), "ring", F.col("rank_no").cast("double").alias("level"))
    of_blocks = hexcells.resample(centres, blocks.select(F.col("sid").alias("tid"), "ring"), block, {"level": "mean"}).withColumnRenamed("tid", "sid")
    known = blocks.join(of_blocks, "sid", "left")
    out = {"blocks": known.drop("ring")}
    for name, areas in higher.items():
        weighted = known.filter("level IS NOT NULL").select("sid", "ring", population, "level")
        out[name] = census.resample_to(weighted, areas, block, [population], {"level": population})
    return out
