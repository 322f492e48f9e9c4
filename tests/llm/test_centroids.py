import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantage.llm.centroids import Centroids, cluster_vectors, scaled
from vantage.llm.queries import op11_centroid_clustering


def slow(rows, k=8, dim=64, rounds=10, scale=1024):
    """Plain exact Lloyd rounds: ``[(id, cluster, distance, cluster_inertia, inertia, sha)]``."""
    kept = [(i, [math.floor(scale * float(x)) if abs(x) < 1e30 else int(x) * scale for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [v for _, v in start]
    if not centres:
        return []

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for j in range(len(centres)):
            mine = [v for (_, v), (_, own) in zip(kept, at) if own == j]
            if mine:
                centres[j] = [sum(c) // len(mine) for c in zip(*mine)]
    at = assign()
    fits = lambda d: d if d < 2**63 else None
    own = {j: sum(d for d, at_j in at if at_j == j) for j in range(len(centres))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, j, fits(d), fits(own[j]), fits(sum(own.values())), sha[j]) for (i, _), (d, j) in zip(kept, at)]


def frame(spark, rows, kind=T.FloatType):
    fields = [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(kind())), T.StructField("cluster", T.StringType()), T.StructField("v", T.StringType()), T.StructField("id", T.StringType())]
    return spark.createDataFrame([(i, v, "x", None, "y") for i, v in rows], T.StructType(fields)).repartition(3)


def same(found, want):
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(want, key=key)


def test_query_matches_plain_rounds(spark, small):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    found = op11_centroid_clustering(spark, small)
    assert found.dtypes == [("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string")]
    same(found, slow(rows))


def test_odd_rows(spark):
    """Nulls, wrong lengths, non-finite entries, repeated and null ids, equal vectors, a third of all rows the same."""
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(40)] + [(100 + i, [0.5, 0.25, -0.5, 0.0]) for i in range(30)]
    rows += [(5, None), (6, []), (7, [1.0]), (8, [None, 1.0, 1.0, 1.0]), (9, [math.nan, 0.0, 0.0, 0.0]), (10, [math.inf, 0.0, 0.0, 0.0]), (11, [-math.inf, 0.0, 0.0, 0.0])]
    rows += [(3, [0.1, 0.2, 0.3, 0.4])] * 3 + [(None, [0.9, 0.9, 0.9, 0.9])] * 2 + [(12, [0.0] * 4), (13, [-0.0] * 4)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    same(cluster_vectors(frame(spark, rows), k=5, dim=4, rounds=4), slow(rows, 5, 4, 4))
    same(cluster_vectors(frame(spark, rows[:3]), k=8, dim=4), slow(rows[:3], 8, 4))
    assert cluster_vectors(frame(spark, rows[70:76]), dim=4).collect() == []
    assert cluster_vectors(frame(spark, [])).collect() == []


def test_values_beyond_floats_and_longs(spark):
    rows = [(i, [x * 10.0**e, 1.0, -3.5]) for i, (x, e) in enumerate([(1, 0), (2, 0), (-1, 3), (1, 7), (1, 8), (3, 12), (-1, 18), (1, 30), (1, 200), (-1e-20, 0)])]
    want = slow(rows, 3, 3, 3)
    assert any(r[2] is None for r in want)
    same(cluster_vectors(frame(spark, rows, T.DoubleType), k=3, dim=3, rounds=3), want)


@pytest.mark.parametrize("size", [3, 1000, 60_000_000])
def test_screening_never_drops_the_nearest(size):
    """Near ties of every scale: centroids one unit apart, and rows half-way between two of them."""
    rng = np.random.default_rng(size)
    base = rng.integers(-size, size + 1, 64)
    centres = np.array([base + rng.integers(-1, 2, 64) for _ in range(6)] + [base, base])
    x = np.concatenate((np.array([base + rng.integers(-2, 3, 64) for _ in range(300)]), (centres[:3] + centres[3:6]) // 2, rng.integers(-size, size + 1, (100, 64))))
    own = Centroids(centres.tolist())
    d = ((x[:, None].astype(object) - centres[None]) ** 2).sum(2)
    best = d.argmin(1)
    near = own.shortlist(x)
    assert near[np.arange(len(x)), best].all()
    assert (own.nearest(x) == best).all()
    assert own.distances(x, best) == d.min(1).tolist()


def test_most_rows_are_settled_in_float32(spark, small):
    x = scaled(np.array([r[0] for r in spark.read.parquet(f"{small}/embeddings.parquet").select("embedding").collect()]), 1024)
    near = Centroids(x[:8].tolist()).shortlist(x)
    assert (near.sum(1) == 1).mean() > 0.9


def test_partitions_do_not_matter(spark, small):
    vectors = spark.read.parquet(f"{small}/embeddings.parquet")
    one = cluster_vectors(vectors.coalesce(1), k=3, rounds=2)
    many = cluster_vectors(vectors.repartition(7, F.col("vec_id")), k=3, rounds=2)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
