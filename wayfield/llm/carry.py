"""Input rows carried as one struct, so that no column of theirs can meet a helper's name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packed(docs: DataFrame) -> Column:
    """All columns of ``docs`` as the struct ``__row``."""
    return F.struct(*(F.col(f"`{c}`").alias(c) for c in docs.columns)).alias("__row")


def unpacked(docs: DataFrame, but: tuple[str, ...] = (), **new: Column) -> list[Column]:
    """The columns of ``docs`` out of ``__row``, those of ``new`` replaced, without those named in ``but`` (in either case)."""
    gone = {c.lower() for c in but}
    return [new.get(c, F.col("__row").getField(c)).alias(c) for c in docs.columns if c.lower() not in gone]
