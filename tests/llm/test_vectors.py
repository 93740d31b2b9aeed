"""The vector operators against plain versions, with bad vectors, copies, ties, null labels, few rows and clashing names."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfield.llm import annulus_codes, stable_search, tsqr_whitening

SCHEMA = "vec_id long, embedding array<float>, label int, cell int, v string, white int, `of` string"


def table(spark, n=700, dims=32, seed=3, bad=True):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims)).astype(np.float32)
    x[n // 3 : 2 * n // 3] = x[0]  # a third of the rows are copies
    x[-40:] *= 3
    rows = [(i, [float(v) for v in x[i]], None if i % 7 == 0 else i % 3) for i in range(n)]
    if bad:
        rows += [(n, None, 1), (n + 1, [float("nan")] * dims, 1), (n + 20, [1.0] * (dims - 1) + [None], 1), (n + 3, [1.0, 2.0], 1), (n + 4, [], None)]
        rows += [(n + 5, [float("inf")] + [0.0] * (dims - 1), 1)]
    return spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA)


def kept(df, dims):
    rows = [r for r in df.collect() if r.embedding is not None and len(r.embedding) == dims and all(v is not None and math.isfinite(v) for v in r.embedding)]
    return [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64).reshape(-1, dims), [r.label for r in rows]


def nearest_rows(ids, x, queries, k):
    out = {}
    for q in queries:
        at = ids.index(q)
        score = [sum_in_order(x[at], x[j]) if ids[j] != q else -np.inf for j in range(len(ids))]
        out[q] = [(ids[j], score[j]) for j in sorted(range(len(ids)), key=lambda j: (-score[j], ids[j])) if ids[j] != q][:k]
    return out


def sum_in_order(a, b):
    total = 0.0
    for v in a * b:
        total += v
    return total


@pytest.mark.parametrize(("piece", "leaf"), [(4096, 256), (64, 8)])
def test_search_equals_brute_force(spark, monkeypatch, piece, leaf):
    monkeypatch.setattr(stable_search, "PIECE", piece)
    monkeypatch.setattr(stable_search, "LEAF", leaf)
    df = table(spark)
    ids, x, _ = kept(df, 32)
    got = stable_search.nearest(df, "id % 20 = 0", k=20, confidence=0.9999999)
    rows = got.orderBy("query_id", "rank").collect()
    want = nearest_rows(ids, x, [i for i in ids if i % 20 == 0], 20)
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in rows] == [(q, k + 1, *hit) for q in sorted(want) for k, hit in enumerate(want[q])]
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "double"]


def test_search_recall_at_the_default_confidence(spark, monkeypatch):
    monkeypatch.setattr(stable_search, "PIECE", 128)
    monkeypatch.setattr(stable_search, "LEAF", 8)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    ids, x, _ = kept(df, 64)
    found = {}
    for r in stable_search.nearest(df, "id % 20 = 0").collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    want = nearest_rows(ids, x, [i for i in ids if i % 20 == 0], 20)
    assert sum(len({v for v, _ in want[q]} & found[q]) for q in want) >= 0.97 * 20 * len(want)


def test_search_stops_before_everything_is_verified():
    """Clustered rows: leaves far from the query are never looked at."""
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((64, 24))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    x = np.repeat(centres, 64, axis=0) + 0.01 * rng.standard_normal((4096, 24))
    space = stable_search.Space(24, float(np.linalg.norm(x, axis=1).max()))
    piece = stable_search.Piece(space, np.arange(4096), x)
    query, ids, scores = piece.search(np.arange(0, 4096, 64), x[::64], np.full(64, -np.inf), 10)
    top = stable_search.best(query, ids, scores, 10)
    exact = np.where(np.eye(4096, dtype=bool)[::64], -np.inf, x[::64] @ x.T)
    want = {(q, i) for q in range(64) for i in np.argsort(-exact[q])[:10]}
    assert len(want & set(zip(query[top], ids[top], strict=True))) >= 0.95 * len(want)
    assert piece.verified < 0.7 * 64 * 4096


def test_chi_square_quantile():
    assert abs(stable_search.quantile(0.95, 8) - 15.507313) < 1e-5
    assert abs(stable_search.quantile(0.5, 2) - 2 * math.log(2)) < 1e-9


def test_search_small_tables(spark):
    df = table(spark, bad=True)
    assert stable_search.nearest(df.limit(0), "id % 20 = 0").count() == 0
    assert stable_search.nearest(df.filter("vec_id >= 700"), "id % 20 = 0").filter("vec_id is null").count() == 0
    few = df.filter("vec_id < 5")
    assert [(r.query_id, r["rank"]) for r in stable_search.nearest(few, "id = 0").orderBy("rank").collect()] == [(0, k) for k in (1, 2, 3, 4)]
    assert stable_search.nearest(df.filter("vec_id = 20"), "id % 20 = 0").count() == 0
    zero = few.union(spark.createDataFrame([(40, [0.0] * 32, 1, 1, "x", 1, "y"), (None, [1.0] * 32, 1, 1, "x", 1, "y")], SCHEMA))
    assert {r.vec_id for r in stable_search.nearest(zero, "id % 20 = 0").collect()} == {1, 2, 3, 4}


def plain_codes(ids, x, labels, parts, entries, rounds):
    width = -(-x.shape[1] // parts)
    whole = np.zeros((len(x), parts * width), np.int64)
    whole[:, : x.shape[1]] = np.floor(256 * x)
    whole = whole.reshape(len(x), parts, width)
    first = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, list(x[i])))[:entries]
    books = whole[first].transpose(1, 0, 2).copy()
    for r in range(rounds + 1):
        far = ((whole[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        index, error = far.argmin(axis=2), far.min(axis=2).sum(axis=1)
        for p in range(parts):
            for e in range(books.shape[1]):
                mine = whole[index[:, p] == e, p]
                if len(mine) and r < rounds:
                    books[p, e] = [math.floor(int(s) / len(mine)) for s in mine.sum(axis=0)]
    by = Counter()
    for label, e in zip(labels, error, strict=True):
        by[label] += int(e)
    digest = hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()
    return sorted((i or -1, "".join(f"{k:02x}" for k in index[j]), int(error[j]), by[labels[j]], digest) for j, i in enumerate(ids))


@pytest.mark.parametrize(("dims", "n", "entries"), [(32, 700, 64), (32, 20, 64), (30, 300, 7)])
def test_codes_equal_brute_force(spark, dims, n, entries):
    df = table(spark, n=n, dims=dims)
    df = df.union(df.filter("vec_id in (1, 2)")).union(df.filter("vec_id = 3").withColumn("vec_id", F.lit(None).cast("long")))
    ids, x, labels = kept(df, dims)
    got = annulus_codes.encode(df, entries=entries)
    assert sorted((-1 if r.vec_id is None else r.vec_id or -1, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got.collect()) == plain_codes(ids, x, labels, 16, entries, 2)
    assert annulus_codes.encode(df.limit(0)).count() == 0


def test_annulus_is_exact_and_prunes():
    rng = np.random.default_rng(5)
    entries = np.vstack([rng.integers(-200, 200, (60, 4)), np.zeros((2, 4), int), [[3, 0, 0, 0], [0, 3, 0, 0]]])
    rows = np.vstack([rng.integers(-250, 250, (500, 4)), entries])
    search = annulus_codes.AnnulusSearch(entries)
    index, least = search.nearest(rows)
    far = ((rows[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (index == far.argmin(axis=1)).all()
    assert (least == far.min(axis=1)).all()
    assert search.evaluated < 0.8 * far.size


@pytest.mark.parametrize(("n", "dims", "tasks"), [(700, 32, 40), (5, 8, 3), (300, 4, 2)])
def test_whitening_equals_eigenvectors(spark, n, dims, tasks):
    rng = np.random.default_rng(n)
    x = (rng.standard_normal((n, dims)) * np.linspace(1, 3, dims)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r], 1, 1, "x", 1, "y") for i, r in enumerate(x)], SCHEMA).repartition(tasks)
    df = df.union(table(spark, n=1, dims=dims).filter("vec_id > 0"))
    whole = np.floor(1024 * x.astype(np.float64)).astype(np.int64) + 100_000
    mean = whole.sum(axis=0) / n
    values, vectors = np.linalg.eigh((whole - mean).T @ (whole - mean) / n)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    k = min(8, dims)
    rows = tsqr_whitening.whiten(df).orderBy("vec_id", "component").collect()
    assert [(r.vec_id, r.component, r.n) for r in rows] == [(i, c + 1, n) for i in range(n) for c in range(k)]
    deviation = ((n * whole - whole.sum(axis=0)) ** 2).sum(axis=1)
    alive = [c for c in range(k) if values[c] > 1e-9 * values[0]]
    assert len(alive) == min(k, n - 1)
    for r in rows:
        c = r.component - 1
        assert r.deviation == deviation[r.vec_id]
        assert abs(r.explained - values[c] / values.sum()) < 1e-9
        assert r.identity_error < 1e-9
        if c in alive:
            assert abs(abs(r.whitened) - abs((whole[r.vec_id] - mean) @ vectors[:, c]) / math.sqrt(values[c])) < 1e-8
        else:
            assert r.whitened is None


def test_whitening_without_variance(spark):
    copies = spark.createDataFrame([(i, [1.0, -2.0, 0.5], None, 1, "x", 1, "y") for i in range(5)], SCHEMA)
    rows = tsqr_whitening.whiten(copies).collect()
    assert {(r.whitened, r.explained, r.identity_error, r.deviation) for r in rows} == {(None, 0.0, None, 0)}
    assert len(rows) == 15
    assert tsqr_whitening.whiten(copies.limit(0)).count() == 0


def test_whitening_deviation_beyond_a_long(spark):
    large = spark.createDataFrame([(0, [1e9, 0.0], 1, 1, "x", 1, "y"), (1, [0.0, 0.0], 1, 1, "x", 1, "y"), (2, [0.0, 1.0], 1, 1, "x", 1, "y")], SCHEMA)
    assert {r.vec_id: r.deviation for r in tsqr_whitening.whiten(large).filter("component = 1").collect()}[0] is None
