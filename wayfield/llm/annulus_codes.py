"""Vector codes: product quantisation with integer codebooks, the nearest entries found by annular norm pruning.

Components become whole numbers floor(256 x); a vector is cut into equal parts and each part has its own codebook. The nearest entry to a
part p: entries lie sorted by norm; the two whose norms are next to |p| give a first distance d; since |p - e| >= ||p| - |e||, only entries with
a norm within [|p| - d, |p| + d] can be as near, ends included, and two binary searches find them. That annulus is evaluated exactly, in
integers, from the middle outwards: each doubling step searches the interval again with the d that the last one left. What is least then
is the nearest entry, ties going to the lower index. All rows of an Arrow batch are searched at once.

A round is one pass: tasks hold the codebooks (parts x entries, a bound on the parameter and not on the table), add up their own rows by
entry, and one row per task and entry meets in the sums. Whole numbers make the sums independent of the order of rows and of executors lost.

Defined cases
* Null vectors, nulls or non-finite components in one: no row. Vectors of another length than most: no row. Empty table: no rows.
* A length that parts do not divide is filled up with zeros to the next multiple.
* Fewer kept rows than entries: codebooks of as many entries as there are rows. Ids that come several times start in order of their
  vectors; a null id comes last. Every row gets a code of its own.
* floor(256 x) is cut to +-2^27, so squared distances and sums stay in longs.
* Ties between entries go to the lower index, also between equal entries. An entry that no part chose stays as it is.
* Other columns, whatever their names, are not read; a null label is a label.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfield.llm.vectors import matrix, usable
from wayfield.session import materialize

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE, LARGEST = 256, 1 << 27

SCHEMA = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def whole(values: np.ndarray, parts: int) -> np.ndarray:
    """(rows, parts, width) whole numbers, filled up with zeros."""
    n, dims = values.shape
    width = -(-dims // parts)
    out = np.zeros((n, parts * width), np.int64)
    out[:, :dims] = np.clip(np.floor(SCALE * values), -LARGEST, LARGEST)
    return out.reshape(n, parts, width)


class AnnulusSearch:
    """Nearest entries of one codebook (entries x width, whole numbers)."""

    def __init__(self, entries: np.ndarray):
        norms = np.sqrt((entries.astype(np.float64) ** 2).sum(axis=1))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.entries = norms[self.order], entries[self.order]
        self.evaluated = 0

    def _look(self, rows: np.ndarray, which: np.ndarray, low: np.ndarray, high: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        """Evaluate the sorted entries low to high (exclusive) of the rows ``which``, all non-empty, and better their best and index."""
        counts = high - low
        starts = np.cumsum(counts) - counts
        of = np.repeat(np.arange(len(which)), counts)
        at = np.arange(len(of)) - np.repeat(starts - low, counts)
        distance = ((rows[which[of]] - self.entries[at]) ** 2).sum(axis=1)
        self.evaluated += len(of)
        least = np.minimum.reduceat(distance, starts)
        first = np.minimum.reduceat(np.where(distance == least[of], self.order[at], len(self.norms)), starts)
        nearer, tie = least < best[which], least == best[which]
        index[which] = np.where(nearer, first, np.where(tie, np.minimum(first, index[which]), index[which]))
        best[which] = np.minimum(least, best[which])

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry to each row, ties to the lower index."""
        norms = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))
        middle = np.minimum(np.searchsorted(self.norms, norms), len(self.norms) - 1)
        best = np.full(len(rows), np.iinfo(np.int64).max)
        index = np.full(len(rows), len(self.norms))
        done_low, done_high = np.maximum(middle - 1, 0), middle + 1
        everyone = np.arange(len(rows))
        self._look(rows, everyone, done_low, done_high, best, index)
        step = 2
        while len(everyone):
            # Norms are rounded, the distance is not: a little more than the annulus holds every entry that may tie.
            mid, reach = norms[everyone], np.sqrt(best[everyone].astype(np.float64))
            reach += 1e-9 * (mid + reach + 1)
            low = np.maximum(np.searchsorted(self.norms, mid - reach, "left"), done_low[everyone] - step)
            high = np.minimum(np.searchsorted(self.norms, mid + reach, "right"), done_high[everyone] + step)
            under, over = low < done_low[everyone], high > done_high[everyone]
            for side, start, stop in ((under, low, done_low[everyone]), (over, done_high[everyone], high)):
                if side.any():
                    self._look(rows, everyone[side], start[side], stop[side], best, index)
            done_low[everyone], done_high[everyone] = np.minimum(low, done_low[everyone]), np.maximum(high, done_high[everyone])
            everyone = everyone[under | over]
            step *= 2
        return index, best


def assign(parts: np.ndarray, searches: list[AnnulusSearch]) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and squared distances, (rows, parts) each."""
    n = len(parts)
    index, distance = np.zeros((n, len(searches)), np.int64), np.zeros((n, len(searches)), np.int64)
    for at in range(0, n, 4096):
        for p, search in enumerate(searches):
            index[at : at + 4096, p], distance[at : at + 4096, p] = search.nearest(parts[at : at + 4096, p])
    return index, distance


def _start(ids: DataFrame, dims: int, parts: int, entries: int) -> np.ndarray:
    """The codebooks at the start: (parts, entries, width) from the rows with the smallest ids."""
    first = ids.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    return whole(np.array([r.v for r in first], np.float64).reshape(-1, dims), parts).transpose(1, 0, 2)


def _moved(ids: DataFrame, dims: int, books: np.ndarray) -> np.ndarray:
    """One round: every entry becomes the floored mean of the parts that chose it."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [AnnulusSearch(b) for b in books]
        totals, counts = np.zeros((parts * entries, width), object), np.zeros(parts * entries, np.int64)
        for batch in batches:
            x = whole(matrix(batch.column(0), dims), parts)
            index, _ = assign(x, searches)
            flat = (index + np.arange(parts) * entries).ravel()
            sums = np.zeros((parts * entries, width), np.int64)
            np.add.at(sums, flat, x.reshape(-1, width))
            totals += sums
            counts += np.bincount(flat, minlength=parts * entries)
        used = np.flatnonzero(counts)
        if len(used):
            sums = [[str(v) for v in totals[k]] for k in used]
            yield pa.RecordBatch.from_pydict({"entry": pa.array(used, pa.int32()), "n": pa.array(counts[used], pa.int64()), "sums": sums})

    found = ids.select("v").mapInArrow(run, "entry int, n long, sums array<string>")
    total = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    out = books.reshape(-1, width).copy()
    for r in found.groupBy("entry").agg(F.sum("n").alias("n"), *total).collect():  # parts x entries rows at most
        out[r.entry] = [int(r[f"s{i}"]) // r.n for i in range(width)]
    return out.reshape(books.shape)


def encode(
    rows: DataFrame,
    vector: str = "embedding",
    row_id: str = "vec_id",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error and the codebooks' digest of every kept row."""
    spark = rows.sparkSession
    if not 0 < entries <= 256:
        raise ValueError("a part's index has two hex digits: 1 to 256 entries")
    sound, dims = usable(rows, vector)
    ids = sound.select(F.col(f"`{row_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("v"), F.col(f"`{label}`").alias("label"))
    if not dims:
        return spark.createDataFrame([], SCHEMA)
    books = _start(ids, dims, parts, entries)
    for _ in range(rounds):
        books = _moved(ids, dims, books)
    digest = hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [AnnulusSearch(b) for b in books]
        for batch in batches:
            index, distance = assign(whole(matrix(batch.column(1), dims), parts), searches)
            codes = [row.tobytes().hex() for row in index.astype(np.uint8)]
            columns = [batch.column(0), batch.column(2), pa.array(codes, pa.string()), pa.array(distance.sum(axis=1), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])

    kind = ids.schema["label"].dataType.simpleString()
    coded = materialize(ids.mapInArrow(run, f"vec_id long, label {kind}, code string, error long"), "codes")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
