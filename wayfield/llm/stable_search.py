"""Nearest neighbours by inner product: 2-stable projections under a kd-tree, stopped by a chi-square test.

Reduction. With M the largest norm, a row x gets one more coordinate sqrt(M^2 - |x|^2) and a query q gets 0; then the squared Euclidean
distance is |q|^2 + M^2 - 2 <q, x>, so the nearest row has the largest inner product.

Projection. ``DIRECTIONS`` Gaussian directions, the same for all, map rows to few coordinates. For two points at distance d the squared
projected distance over d^2 follows a chi-square law with as many degrees. So when the next neighbour in projected space is farther than
d_k^2 times the law's quantile at ``CONFIDENCE``, d_k being the k-th best distance verified so far, a nearer row is still unseen with a
probability of 1 - CONFIDENCE at most, and the search stops. There is no cap on how many rows are verified.

On Spark. The upper levels of the kd-tree are split planes fitted to a sample of at most ``SAMPLE`` projections (a documented bound; every
row is indexed). Their regions are ``2^levels`` cells of about ``PIECE`` rows; a cell with more (rows that no plane parts, or levels beyond the
sample) is dealt into pieces of about that size by a hash. A piece is one row of a table: its vectors as bytes. In its task a piece
becomes a kd-tree of leaves. Queries travel to pieces in blocks, twice: to a piece of their own cell, which gives a first d_k, then to all
pieces whose region passes the test with it. In a piece a query takes leaves in the order of their projected distance and tests before each.

Equal vectors. Of rows with equal vectors only the k + 1 smallest ids can be in an answer (one may be the query itself), so only these are
indexed; a group of copies of any size costs no more. They are taken by a rank that Spark limits in each task before it shuffles.

Scores are recomputed for all rows that come within rounding of the k best, adding the products of components in their order, in double
precision, so equal vectors have equal scores wherever they lie.

Defined cases
* Null or zero vectors, nulls or non-finite components in one, a null id, vectors of another length than most: neither query nor candidate.
* Rows with the same id are rows of their own as candidates; a query leaves out all rows with its id. An id that comes several times as a
  query is asked once, with its smallest vector in order of components.
* Fewer candidates than k: all of them. Empty table, or no query: no rows. Ties go to the smaller id.
* Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfield.llm.vectors import matrix, usable
from wayfield.session import discard, materialize

DIRECTIONS = 8
CONFIDENCE = 0.95
#: Projections that the split planes are fitted to, and rows of the sample that a cell needs.
SAMPLE, SAMPLE_PER_CELL = 65_536, 32
PIECE, LEAF, BLOCK = 4096, 256, 512
SEED = 20_11

BLOCKS = pa.schema([("at", pa.int32()), ("q_ids", pa.binary()), ("q_vectors", pa.binary()), ("worst", pa.binary())])
HITS = "query_id long, vec_id long, score double"


def quantile(share: float, degrees: int) -> float:
    """The chi-square quantile, by bisection on the series of the regularised lower gamma function."""

    def below(x: float) -> float:
        a, half = degrees / 2, x / 2
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= half / k
            total += term
        return total * math.exp(a * math.log(half) - half - math.lgamma(a)) if half else 0.0

    low, high = 0.0, float(degrees)
    while below(high) < share:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < share else (low, middle)
    return high


class Space:
    """The reduction and the projection."""

    def __init__(self, dims: int, largest: float, directions: int = DIRECTIONS, confidence: float = CONFIDENCE):
        self.dims, self.largest, self.directions = dims, largest, directions
        self.stop = quantile(confidence, directions)
        self.gauss = np.random.default_rng(SEED).standard_normal((dims + 1, directions))

    def rows(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.largest**2 - (vectors**2).sum(axis=1), 0))
        return vectors @ self.gauss[:-1] + rest[:, None] * self.gauss[-1]

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.gauss[:-1]

    def radius(self, vectors: np.ndarray, worst: np.ndarray) -> np.ndarray:
        """The squared projected distance at which a search may stop, by the k-th best inner product so far."""
        size = (vectors**2).sum(axis=1) + self.largest**2
        return self.stop * np.maximum(size - 2 * worst, 0) + 1e-9 * size


class Planes:
    """A complete kd-tree of split planes in heap order: region ``i`` has the children 2i + 1 and 2i + 2, rows at the plane go right."""

    def __init__(self, points: np.ndarray, levels: int):
        inner = (1 << levels) - 1
        self.levels, self.axis, self.at = levels, np.zeros(inner, np.int64), np.zeros(inner)
        held = [np.arange(len(points))]
        for i in range(inner):
            mine = points[held[i]]
            axis = int(np.argmax(mine.max(axis=0) - mine.min(axis=0))) if len(mine) else 0
            at = float(np.median(mine[:, axis])) if len(mine) else 0.0
            self.axis[i], self.at[i] = axis, at
            right = mine[:, axis] >= at
            held += [held[i][~right], held[i][right]]
        self.leaves = held[inner:]

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.levels):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] >= self.at[node])
        return node - len(self.axis)

    def regions(self, directions: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper corners of the cells, infinite where no plane bounds them."""
        low, high = np.full((1, directions), -np.inf), np.full((1, directions), np.inf)
        for level in range(self.levels):
            nodes = np.arange((1 << level) - 1, (1 << (level + 1)) - 1)
            low, high = np.repeat(low, 2, axis=0), np.repeat(high, 2, axis=0)
            left, axis, at = 2 * np.arange(len(nodes)), self.axis[nodes], self.at[nodes]
            high[left, axis] = np.minimum(high[left, axis], at)
            low[left + 1, axis] = np.maximum(low[left + 1, axis], at)
        return low, high


def _gaps(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances from points to boxes, (points, boxes)."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        p = points[:, d : d + 1]
        out += np.maximum(np.maximum(low[:, d] - p, p - high[:, d]), 0) ** 2
    return out


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, components added in their order."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


class Piece:
    """The kd-tree of one piece, and the search in it."""

    def __init__(self, space: Space, ids: np.ndarray, vectors: np.ndarray):
        self.space, points = space, space.rows(vectors)
        planes = Planes(points, max(0, math.ceil(math.log2(max(len(ids), 1) / LEAF))))
        leaves = [x for x in planes.leaves if len(x)]
        self.leaves = [(ids[x], vectors[x]) for x in leaves]
        self.low = np.array([points[x].min(axis=0) for x in leaves])
        self.high = np.array([points[x].max(axis=0) for x in leaves])
        self.verified = 0

    def search(self, query_ids: np.ndarray, queries: np.ndarray, worst: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score): for each query, by its position, at least the k best of the piece that are not under ``worst``."""
        n, space = len(queries), self.space
        gaps = _gaps(space.queries(queries), self.low, self.high)
        order = np.argsort(gaps, axis=1, kind="stable")
        slack = 1e-12 * np.sqrt((queries**2).sum(axis=1)) * space.largest
        top, worst = np.full((n, k), -np.inf), worst.copy()
        radius = space.radius(queries, worst)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        alive = np.arange(n)
        for step in range(len(self.leaves)):
            leaf = order[alive, step]
            go = gaps[alive, leaf] <= radius[alive]  # the stopping test
            alive, leaf = alive[go], leaf[go]
            if not len(alive):
                break
            for which in np.unique(leaf):
                q = alive[leaf == which]
                ids, vectors = self.leaves[which]
                self.verified += len(q) * len(ids)
                scores = queries[q] @ vectors.T
                scores[query_ids[q][:, None] == ids] = -np.inf
                row, col = np.nonzero(scores >= (worst[q] - slack[q])[:, None])
                keep = scores[row, col] > -np.inf
                row, col = row[keep], col[keep]
                if not len(row):
                    continue
                found.append((q[row], ids[col], dots(queries[q[row]], vectors[col])))
                better = np.unique(row)
                both = np.concatenate([top[q[better]], scores[better]], axis=1)
                top[q[better]] = both = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                worst[q[better]] = np.maximum(worst[q[better]], both.min(axis=1))
            radius[alive] = space.radius(queries[alive], worst[alive])
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        query, ids, scores = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = scores >= worst[query] - slack[query]
        return query[keep], ids[keep], scores[keep]


def best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each query: by query, falling score, rising id."""
    order = np.lexsort((ids, -scores, query))
    of = query[order]
    rank = np.arange(len(of)) - np.searchsorted(of, of)
    return order[rank < k]


def _pieces(rows: DataFrame, space: Space, planes: Planes, k: int) -> tuple[DataFrame, list[list[int]]]:
    """(piece, ids, vectors), and the pieces of each cell."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(1), space.dims)
            columns = [batch.column(0), pa.array(planes.cell(space.rows(v)), pa.int32()), pa.array([r.tobytes() for r in v], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cell", "vector"])

    def gather(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "ids": [ids.tobytes()], "vectors": [b"".join(table.column("vector").to_pylist())]})

    placed = rows.mapInArrow(place, "vec_id long, cell int, vector binary")
    copies = Window.partitionBy("vector").orderBy("vec_id")
    indexed = materialize(placed.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).drop("copy"), "indexed")
    counts = {r.cell: r["count"] for r in indexed.groupBy("cell").count().collect()}  # a row for each cell, bounded by the sample
    of, total = [], 0
    for cell in range(1 << planes.levels):
        parts = max(1, round(counts.get(cell, 0) / PIECE))
        of.append(list(range(total, total + parts)) if cell in counts else [])
        total += len(of[-1])
    first, parts = F.array(*(F.lit(p[0] if p else 0) for p in of)), F.array(*(F.lit(max(1, len(p))) for p in of))
    piece = first[F.col("cell")] + F.pmod(F.xxhash64("vec_id", "vector"), parts[F.col("cell")]).cast("int")
    keyed = indexed.select(piece.alias("piece"), "vec_id", "vector")
    pieces = materialize(keyed.groupBy("piece").applyInArrow(gather, "piece int, ids binary, vectors binary"), "pieces")
    discard(indexed)
    return pieces, of


def _ask(queries: DataFrame, pieces: DataFrame, space: Space, planes: Planes, of: list[list[int]], k: int, first: bool) -> DataFrame:
    """Queries (query_id, vector, worst) against a piece of their own cell, or against all others that the test lets through."""
    low, high = planes.regions(space.directions)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, v, worst = batch.column(0).to_numpy(), matrix(batch.column(1), space.dims), batch.column(2).to_numpy()
            points = space.queries(v)
            gaps = _gaps(points, low, high)
            gaps[:, [not p for p in of]] = np.inf  # cells without rows
            home = gaps.argmin(axis=1)
            near = gaps <= space.radius(v, worst)[:, None]
            for cell in np.unique(home) if first else np.flatnonzero(near.any(axis=0)):
                for piece in of[cell][:1] if first else of[cell]:
                    own = home == cell
                    mine = np.flatnonzero(own if first else near[:, cell] & ~(own & (piece == of[cell][0])))  # that piece was the first
                    for at in range(0, len(mine), BLOCK):
                        q = mine[at : at + BLOCK]
                        row = {"at": [piece], "q_ids": [ids[q].tobytes()], "q_vectors": [v[q].tobytes()], "worst": [worst[q].tobytes()]}
                        yield pa.RecordBatch.from_pydict(row, BLOCKS)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["piece"] != at:
                    ids = np.frombuffer(row["ids"], np.int64)
                    at, tree = row["piece"], Piece(space, ids, np.frombuffer(row["vectors"], np.float64).reshape(len(ids), space.dims))
                query_ids = np.frombuffer(row["q_ids"], np.int64)
                vectors = np.frombuffer(row["q_vectors"], np.float64).reshape(len(query_ids), space.dims)
                query, found, scores = tree.search(query_ids, vectors, np.frombuffer(row["worst"], np.float64), k)
                top = best(query, found, scores, k)
                columns = [pa.array(query_ids[query[top]]), pa.array(found[top]), pa.array(scores[top])]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])

    blocks = queries.mapInArrow(route, "at int, q_ids binary, q_vectors binary, worst binary")
    joined = blocks.join(pieces.hint("merge"), blocks["at"] == pieces["piece"]).select("piece", "ids", "vectors", "q_ids", "q_vectors", "worst")
    return joined.mapInArrow(search, HITS)


def _top(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(
    rows: DataFrame,
    is_query: str,
    k: int = 20,
    vector: str = "embedding",
    row_id: str = "vec_id",
    directions: int = DIRECTIONS,
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the largest inner product for every row whose id, named ``id``, satisfies the
    SQL condition ``is_query``."""
    spark = rows.sparkSession
    sound, dims = usable(rows.filter(F.col(f"`{row_id}`").isNotNull()), vector)
    v = F.col(f"`{vector}`").cast("array<double>")
    ids = sound.select(F.col(f"`{row_id}`").cast("long").alias("id"), v.alias("v")).filter(F.exists("v", lambda x: x != 0))
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    about = ids.agg(F.count("*").alias("n"), F.max(square).alias("largest")).first()
    space = Space(dims, math.sqrt(about.largest or 0.0), directions, confidence)
    levels = max(0, math.ceil(math.log2(min(about.n / PIECE, SAMPLE / SAMPLE_PER_CELL)))) if about.n > PIECE else 0
    planes = Planes(_sample(ids, space, about.n) if levels else np.zeros((0, directions)), levels)
    pieces, of = _pieces(ids, space, planes, k)
    asked = ids.filter(is_query).groupBy("id").agg(F.min("v").alias("v"))
    queries = asked.select(F.col("id").alias("query_id"), "v", F.lit(float("-inf")).alias("worst"))
    seen = materialize(_top(_ask(queries, pieces, space, planes, of, k, first=True), k), "first-hits")
    bound = seen.filter(F.col("rank") == k).select(F.col("query_id").alias("of"), F.col("score").alias("bound"))
    again = queries.join(bound, F.col("query_id") == F.col("of"), "left").select("query_id", "v", F.coalesce("bound", "worst").alias("worst"))
    hits = _ask(again, pieces, space, planes, of, k, first=False)
    both = seen.select("query_id", "vec_id", "score").unionByName(hits)
    out = materialize(_top(both, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "nearest")
    discard(seen)
    discard(pieces)
    return out


def _sample(ids: DataFrame, space: Space, n: int) -> np.ndarray:
    """Projections of at most SAMPLE rows, taken by the hash of their ids."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = space.rows(matrix(batch.column(0), space.dims))
            yield pa.RecordBatch.from_pydict({"point": pa.array([p.tobytes() for p in points], pa.binary())})

    share = max(1, math.ceil(n / (SAMPLE // 2)))
    taken = ids.filter(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(share)) == 0).select("v").limit(SAMPLE)
    return np.array([np.frombuffer(r.point, np.float64) for r in taken.mapInArrow(project, "point binary").collect()]).reshape(-1, space.directions)
