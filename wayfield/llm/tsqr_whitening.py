"""Embedding whitening by a tall-skinny QR.

Entries become whole numbers, x = floor(1024 c) + 100000, so their sums S are exact in any order. Rows are centred with those sums,
each task reduces its rows to one triangular factor R (batch by batch: QR of the factor so far above the next rows), and factors meet
in a tree of fan-in ``FAN_IN``, each step a QR of a few stacked factors. The singular values s and right vectors of the last R are those
of the centred matrix: eigenvalues are s^2 / n, and rows times right vectors over sqrt(s^2 / n) are white. No covariance is formed for
that; the one of the white columns is measured afterwards, as a check.

What reaches the driver: one row of sums and one factor, both of the vectors' length and not of the table's. A lost executor repeats
its own tasks: factors are written after each level of the tree.

Defined cases
* Null vectors, nulls or non-finite entries in one: no row. Vectors of another length than most: no row. Empty table: no rows.
* Rows are taken as they are: repeated rows and null or equal ids count each by itself.
* A direction without variance (copies only, fewer rows than entries) has ``whitened`` null and ``explained`` 0; ``identity_error``
  is over the components that have variance, null if none has.
* Equal eigenvalues leave their components free up to a rotation; which one comes out depends on the rows' order in the tasks.
* |c| up to 2^40 keeps x exact; beyond, floor(1024 c) is cut to +-2^50.
* ``deviation`` is exact; null where it does not fit in a long.
* Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfield.llm.vectors import lists, matrix, usable
from wayfield.session import discard, materialize

COMPONENTS = 8
#: Factors that meet in one task of the tree.
FAN_IN = 16
SCALE, SHIFT, LARGEST = 1024, 100_000, 1 << 50
#: Singular values under this share of the largest are rounding.
NOTHING = 1e-12

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole(values: np.ndarray) -> np.ndarray:
    """x of the entries."""
    return np.clip(np.floor(SCALE * values), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def _sums(rows: DataFrame, dims: int) -> tuple[int, list[int]]:
    """n and S, exact: each task adds in longs while they hold and in Python's integers beyond; the partial sums are decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for batch in batches:
            x = whole(matrix(batch.column(0), dims))
            n += len(x)
            if len(x) and int(np.abs(x).max()) < (1 << 62) // len(x):
                total = [a + int(b) for a, b in zip(total, x.sum(axis=0), strict=True)]
            else:
                total = [a + sum(map(int, x[:, i])) for i, a in enumerate(total)]
        if n:
            yield pa.RecordBatch.from_pydict({"dim": pa.array(range(-1, dims), pa.int32()), "total": [str(v) for v in [n, *total]]})

    parts = rows.mapInArrow(run, "dim int, total string").groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found = {r.dim: int(r.total) for r in parts.collect()}  # a row for each of the vectors' entries
    return found.get(-1, 0), [found.get(i, 0) for i in range(dims)]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n; the whole part of the mean is taken off in integers, so only the fraction is rounded."""
    floor = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - floor) - rest


def _factor(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _packed(factor: np.ndarray, node: int = 0) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"node": pa.array([node], pa.int64()), "factor": pa.array([factor.tobytes()], pa.binary())})


def triangular_factor(rows: DataFrame, dims: int, n: int, sums: list[int]) -> np.ndarray:
    """R of the centred rows, by QR in every task and a tree of merges."""

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = np.zeros((0, dims))
        for batch in batches:
            x = whole(matrix(batch.column(0), dims))
            for at in range(0, len(x), 4096):
                factor = _factor(np.vstack([factor, _centred(x[at : at + 4096], n, sums)]))
        if len(factor):
            yield _packed(factor)

    def merge(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
        stacked = np.vstack([np.frombuffer(b, np.float64).reshape(-1, dims) for b in table.column("factor").to_pylist()])
        return pa.Table.from_batches([_packed(_factor(stacked), key[0].as_py())])

    schema = "node long, factor binary"
    level = materialize(rows.mapInArrow(leaves, schema).withColumn("node", F.spark_partition_id().cast("long")), "factors")
    try:
        while level.count() > 1:
            above = level.withColumn("node", F.expr(f"node div {FAN_IN}"))
            before, level = level, materialize(above.groupBy("node").applyInArrow(merge, schema), "factors")
            discard(before)
        top = level.head()
        return np.frombuffer(top.factor, np.float64).reshape(-1, dims)
    finally:
        discard(level)


def whiten(rows: DataFrame, vector: str = "embedding", row_id: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """For each row and component (numbered from 1 by falling eigenvalue, ``components`` at most): the white coordinate, the
    component's share of the variance, the row's exact deviation from the mean and how far the white covariance is from the identity."""
    spark = rows.sparkSession
    sound, dims = usable(rows, vector)
    ids = sound.select(F.col(f"`{row_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("v"))
    if not dims:
        return spark.createDataFrame([], SCHEMA)
    n, sums = _sums(ids.select("v"), dims)
    factor = triangular_factor(ids.select("v"), dims, n, sums)
    _, s, right = np.linalg.svd(factor, full_matrices=True)
    s = np.concatenate([s, np.zeros(dims - len(s))])
    kept = min(components, dims)
    alive = [bool(s[i] > NOTHING * s[0]) for i in range(kept)]
    explained = [float(s[i] ** 2 / (s**2).sum()) if alive[i] else 0.0 for i in range(kept)]
    scaled = np.stack([right[i] / (s[i] / np.sqrt(n)) if alive[i] else np.zeros(dims) for i in range(kept)], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole(matrix(batch.column(1), dims))
            far = np.abs(x.astype(np.float64) * n - np.array(sums, np.float64)).max(initial=0)
            if dims * far * far < 2.0**62 and n * float(np.abs(x).max(initial=0)) < 2.0**62:
                deviation = ((x * n - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
            else:
                deviation = [sum((n * int(v) - t) ** 2 for v, t in zip(row, sums, strict=True)) for row in x]
                deviation = [d if d < 1 << 63 else None for d in deviation]
            white = _centred(x, n, sums) @ scaled
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), lists(white)], names=["vec_id", "deviation", "white"])

    white = materialize(ids.mapInArrow(run, "vec_id long, deviation long, white array<double>"), "white")
    pairs = [(i, j) for i in range(kept) for j in range(i, kept) if alive[i] and alive[j]]
    error = None
    if pairs:
        of = [F.abs(F.covar_pop(F.col("white")[i], F.col("white")[j]) - float(i == j)) for i, j in pairs]
        error = white.agg(F.greatest(*of, *of[:1]).alias("e")).first().e
    shares = F.array(*(F.lit(e) for e in explained))
    out = white.select("vec_id", "deviation", F.posexplode("white").alias("at", "w"))
    return out.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.when(F.array(*(F.lit(a) for a in alive))[F.col("at")], F.col("w")).alias("whitened"),
        shares[F.col("at")].alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
