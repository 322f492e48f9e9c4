import math
import random

import numpy as np
from pyspark.sql import types as T

from vantage.llm.queries import op12_embedding_whitening
from vantage.llm.whitening import whiten_vectors


def frame(spark, rows, kind=T.FloatType):
    fields = [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(kind())), T.StructField("n", T.StringType()), T.StructField("x", T.StringType()), T.StructField("id", T.StringType())]
    return spark.createDataFrame([(i, v, "x", None, "y") for i, v in rows], T.StructType(fields)).repartition(3)


def slow(rows, components, dim, scale=64):
    """n, {id: deviations}, eigenvalues, axes and means by whole matrices; the covariance in exact fractions of integers."""
    kept = [(i, [math.floor(scale * float(c)) + 1_000_000 for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    moved = [[n * x - s for x, s in zip(row, sums)] for row in fit]
    cov = np.array([[sum(r[i] * r[j] for r in moved) / n**3 for j in range(dim)] for i in range(dim)])
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)[:components]
    y = np.array([[(n * x - s) / n for x, s in zip(row, sums)] for _, row in kept]) @ axes[:, order] / np.sqrt(values[order])
    dev = [sum((n * x - s) ** 2 for x, s in zip(row, sums)) for _, row in kept]
    return n, [i for i, _ in kept], dev, y, values[order] / np.trace(cov)


def same(found, want):
    n, ids, dev, y, explained = want
    assert found.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    rows = found.collect()
    assert len(rows) == y.size
    assert {r["n"] for r in rows} == {n}
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-9
    key = lambda r: (r[0] is None, r)
    assert sorted({(r["vec_id"], r["deviation"]) for r in rows}, key=key) == sorted({*zip(ids, dev)}, key=key)
    mine = {}
    for r in rows:
        mine.setdefault(r["component"], []).append(((r["vec_id"] is None, r["vec_id"], r["deviation"]), r["whitened"], r["explained"]))
    assert sorted(mine) == list(range(1, y.shape[1] + 1))
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k], dev[k]))
    for c, values in mine.items():
        values.sort(key=lambda v: v[0])
        got, true = np.array([v[1] for v in values]), y[order, c - 1]
        assert min(np.abs(got - true).max(), np.abs(got + true).max()) < 1e-7
        assert all(abs(v[2] / explained[c - 1] - 1) < 1e-9 for v in values)


def test_query_matches_whole_matrices(spark, small):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    same(op12_embedding_whitening(spark, small), slow(rows, 16, 64))


def test_odd_rows_and_uneven_tiles(spark):
    """Nulls, non-finite entries, other lengths, repeated rows and ids, a hot vector; five dimensions in tiles of two."""
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, s) for s in (5, 3, 2, 1, 0.5)]) for i in range(60)] + [(200 + i, [1.0, -1.0, 0.5, 0.0, 0.25]) for i in range(40)]
    rows += [(1, None), (2, []), (3, [1.0, 2.0]), (4, [None, 1.0, 1.0, 1.0, 1.0]), (5, [math.nan] * 5), (6, [math.inf, 0.0, 0.0, 0.0, 0.0])]
    rows += [(7, [0.1, 0.2, 0.3, 0.4, 0.5])] * 3 + [(None, [2.0, 0.0, 1.0, 0.0, -1.0])] * 2
    rows = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    same(whiten_vectors(frame(spark, rows), components=16, tile=2), slow(rows, 5, 5))
    same(whiten_vectors(frame(spark, rows), components=2, tile=32), slow(rows, 2, 5))


def test_wide_entries_are_exact(spark):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) * 1e4, rng.uniform(-1, 1) * 6e5, rng.uniform(-1, 1) * 3e4]) for i in range(25)]
    same(whiten_vectors(frame(spark, rows, T.DoubleType), components=3), slow(rows, 3, 3))
    huge = [(i, [rng.uniform(-1, 1) * 1e16, rng.uniform(-1, 1) * 1e16]) for i in range(25)]
    found = whiten_vectors(frame(spark, huge + [(99, [1e30, 0.0])], T.DoubleType), components=2).collect()
    assert len(found) == 50 and all(r["deviation"] is None for r in found) and found[0]["identity_error"] < 1e-9


def test_nothing_to_spread(spark):
    assert whiten_vectors(frame(spark, [])).collect() == []
    assert whiten_vectors(frame(spark, [(1, None), (2, [None])])).collect() == []
    assert whiten_vectors(frame(spark, [(1, [1.0, 2.0])] * 5)).collect() == []
    flat = [(i, [float(i), 2.0 * i, 5.0]) for i in range(6)]  # one direction only
    found = whiten_vectors(frame(spark, flat)).collect()
    assert {r["component"] for r in found} == {1} and len(found) == 6 and abs(found[0]["explained"] - 1) < 1e-9
