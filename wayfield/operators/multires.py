"""Layers of a hierarchy, coarsest first: columns missing in a layer are filled from its neighbours."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfield.functions import shapes
from wayfield.operators.hexcells import parents
from wayfield.sources import files


def roll_up(child: DataFrame, parent_id: str, value: str, method: str = "sum", weight: str | None = None) -> DataFrame:
    """(parent_id, value): sum, mean, min or max over children, or with ``weight`` the weighted mean of a density."""
    if weight:
        agg = F.sum(F.col(value) * F.col(weight)) / F.sum(weight)
    else:
        agg = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[method](value)
    return child.filter(F.col(parent_id).isNotNull()).groupBy(parent_id).agg(agg.alias(value))


def roll_down(parent: DataFrame, child: DataFrame, parent_id: str, value: str, method: str = "sum") -> DataFrame:
    """``child`` with the parent's value: shared evenly among its children if it is a sum, else copied."""
    size = child.groupBy(parent_id).agg(F.count("*").alias("__n"))
    joined = child.join(parent.select(parent_id, value), parent_id, "left").join(size, parent_id, "left")
    return (joined.withColumn(value, F.col(value) / F.col("__n")) if method == "sum" else joined).drop("__n")


def fill(layers: list[DataFrame], ids: list[str], methods: dict[str, str]) -> list[DataFrame]:
    """Every column of ``methods`` in every layer: up from the finest that has it, then down. ``ids[i]`` is layer i's key,
    which layer i + 1 also has. The plan is decided from the schemas; no data is looked at."""
    layers = list(layers)
    for value, method in methods.items():
        for i in range(len(layers) - 2, -1, -1):
            if value not in layers[i].columns and value in layers[i + 1].columns:
                how, _, weight = method.partition("_")
                up = roll_up(layers[i + 1], ids[i], value, "mean", weight) if how == "density" else roll_up(layers[i + 1], ids[i], value, method)
                layers[i] = layers[i].join(up, ids[i], "left")
        for i in range(1, len(layers)):
            if value not in layers[i].columns and value in layers[i - 1].columns:
                layers[i] = roll_down(layers[i - 1], layers[i], ids[i - 1], value, method)
    return layers


@dataclass
class MultiresLayers:
    """Polygon layers (``shape`` or closed ``ring``, own id column), coarsest first, each linked to the one above by the centroids of its areas.

    ``methods`` says per column how it goes up (sum, mean, min, max, or density_<column>: the mean weighted by that column); sums are
    shared evenly on the way down, all else is copied.
    """

    layers: list[DataFrame] = field(default_factory=list)
    ids: list[str] = field(default_factory=list)
    methods: dict[str, str] = field(default_factory=dict)

    def add_layer(self, areas: DataFrame, key: str, methods: Mapping[str, str] | None = None, block: float = 1000.0) -> MultiresLayers:
        """A finer layer than those before; it gets the id of the area above that holds each centroid (null where none does)."""
        if self.layers:
            above, up = self.layers[-1], self.ids[-1]
            found = parents(areas.select(F.col(key).alias("sid"), shapes.of(areas).alias("shape")), above.select(F.col(up).alias("tid"), shapes.of(above).alias("shape")), block)
            areas = areas.join(found.select(F.col("sid").alias(key), F.col("tid").alias(up)), key, "left")
        return MultiresLayers([*self.layers, areas], [*self.ids, key], self.methods | dict(methods or {}))

    def add_feature(self, level: int, values: DataFrame, methods: Mapping[str, str]) -> MultiresLayers:
        """Columns of ``values`` (by the level's id) joined to that level, each with its own method."""
        layers = list(self.layers)
        layers[level] = layers[level].join(values, self.ids[level], "left")
        return MultiresLayers(layers, self.ids, self.methods | dict(methods))

    def filled(self) -> list[DataFrame]:
        """Every layer with every column, up first, then down."""
        return fill(self.layers, self.ids, self.methods)

    def __getitem__(self, level: int) -> DataFrame:
        return self.filled()[level]

    def save(self, spark: SparkSession, path: str, overwrite: bool = False) -> None:
        tables = {f"layer_{i}": df for i, df in enumerate(self.layers)}
        files.save(spark, path, "MultiresLayers", tables, {"ids": self.ids, "methods": self.methods}, overwrite)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> MultiresLayers:
        tables, attributes = files.load(spark, path, "MultiresLayers")
        return cls([tables[f"layer_{i}"] for i in range(len(tables))], attributes["ids"], attributes["methods"])
