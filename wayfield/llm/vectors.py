"""What the vector operators share: which rows take part, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The rows whose vector is not null, holds neither nulls nor non-finite components and is as long as most (the longer length
    where two are as frequent), with that length; 0 where no row is left. A length counts over all rows that are otherwise
    sound, so one pass over the table finds it."""
    v = F.col(f"`{vector}`")
    sound = rows.filter(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))))
    lengths = sound.groupBy(F.size(v).alias("n")).count().filter("n > 0").orderBy(F.desc("count"), F.desc("n")).head()
    if lengths is None:
        return sound.filter("false"), 0
    return sound.filter(F.size(v) == lengths.n), lengths.n


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column, all of ``dims`` numbers, as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


def lists(values: np.ndarray) -> pa.Array:
    """Rows of doubles as a list column."""
    n, dims = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dims, pa.int32()), pa.array(values.ravel(), pa.float64()))
