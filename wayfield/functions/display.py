"""What maps need of data: sizes of markers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_radius(df: DataFrame, value: str, largest: float = 12.0) -> DataFrame:
    """``df`` with ``radius``: 0 to ``largest`` for values from 0 to their 90th percentile, ``largest`` beyond it and where that is not over 0."""
    p90 = df.agg(F.percentile(value, 0.9).alias("__p90"))  # one row
    clipped = F.least(F.greatest(F.col(value).cast("double"), F.lit(0.0)), F.col("__p90"))
    radius = F.when(F.col("__p90") > 0, largest * clipped / F.col("__p90")).otherwise(largest)
    return df.crossJoin(F.broadcast(p90)).withColumn("radius", F.when(F.col(value).isNotNull(), radius)).drop("__p90")
