import numpy as np
from pyspark.sql import types as T

from vantage.llm.crosspolytope import Rotations, centre_of, hadamard, nearest, search


def brute(rows, every=100, k=10):
    seen = {(i, tuple(v)): np.array(v, float) for i, v in rows}
    out = {}
    for (q, _), x in seen.items():
        if q % every:
            continue
        near = {}
        for (i, _), y in seen.items():
            if i != q:
                d = float(np.sqrt(((x - y) ** 2).sum()))
                near[i] = min(d, near.get(i, d))
        best = sorted((d, i) for i, d in near.items())[:k]
        out[q] = [i for _, i in best], [d for d, _ in best]
    return out


def collect(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, ([], []))
        out[r.query_id][0].append(r.vec_id)
        out[r.query_id][1].append(r.score)
        assert r["rank"] == len(out[r.query_id][0])
    return out


def test_hadamard_is_orthogonal():
    h = hadamard(np.eye(8))
    assert np.allclose(h @ h.T, np.eye(8))


def test_every_vector_has_its_own_bucket_first():
    x = np.random.default_rng(0).normal(size=(50, 12))
    r = Rotations(12, 3)
    assert (r.buckets(x, 5)[:, :, 0] == r.buckets(x, 1)[:, :, 0]).all()
    assert r.buckets(x, 32).shape == (50, 3, 32)


def test_recall(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want, got = brute(rows), collect(search(df))
    hits = sum(len(set(got[q][0]) & set(want[q][0])) for q in want)
    assert hits >= 0.9 * sum(len(want[q][0]) for q in want)


def test_full_probing_is_exact_with_ties_and_copies(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 5)).round(1).tolist()
    rows = [(i, base[i % 40]) for i in range(230)] + [(300 + i, [1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(120)] + [(300, [1.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert collect(search(df, probes=99, block=16)) == brute(rows)


def test_odd_rows(spark):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), *[T.StructField(c, T.StringType()) for c in ("k1", "gid", "vec", "rank", "score", "ids")]])
    vecs = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (100, [0.0, 1.0]), (0, [1.0, 0.0]), (8, [])]
    df = spark.createDataFrame([(*v, *["x"] * 6) for v in vecs], schema)
    got = collect(search(df, probes=9))
    assert got[0][0] == [1, 100] and got[100][0] == [1, 0]
    assert search(df.limit(0)).collect() == []
    alone = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert search(alone).collect() == []


def test_queries_whose_buckets_are_empty_are_searched_exactly(spark):
    rng = np.random.default_rng(6)
    q = rng.normal(size=64)
    cone = (q + 0.01 * rng.normal(size=(300, 64))).tolist()
    for rows in ([(0, q.tolist()), (1, (-q).tolist())], [(0, (-q).tolist())] + [(i + 1, v) for i, v in enumerate(cone)]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        want, got = brute(rows), collect(search(df, block=64))
        assert got.keys() == want.keys() and got[0][0] == want[0][0]
        assert np.allclose(got[0][1], want[0][1]) and all(len(got[i][0]) == len(want[i][0]) for i in want)


def test_nearest_keeps_the_smaller_id_of_ties_and_measures_exactly():
    axes = np.concatenate((np.eye(64), -np.eye(64)))
    rng = np.random.default_rng(2)
    far = 1e8 + rng.normal(size=(200, 3))
    for q, x in ((np.full((3, 64), 1 / 8), axes), (far[:5], far), (np.array([[1e200, 0.0]]), np.array([[1e200, 1.0], [-1e200, 0.0], [1e200, 0.5]])), (rng.normal(size=(4, 2)), np.zeros((0, 2)))):
        gid = rng.permutation(len(x))
        with np.errstate(over="ignore"):
            norms = (x * x).sum(1)
        row, col, exact = nearest(q, x, norms, gid, 10)
        for i, v in enumerate(q):
            with np.errstate(over="ignore"):
                want = sorted(zip(np.sqrt(((v - x) ** 2).sum(1)).tolist(), gid.tolist()))[:10]
            assert list(zip(exact[row == i].tolist(), gid[col[row == i]].tolist())) == want


def test_six_rows_have_all_their_neighbours(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(6)]
    got = collect(search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert got[0][0] == brute(rows)[0][0] and len(got[0][0]) == 5


def test_a_narrow_cone_is_spread_over_the_buckets(spark):
    """A query meets fewer rows in all tables together than there are; from the origin it would meet each of them several times."""
    rng = np.random.default_rng(13)
    q = rng.normal(size=64)
    x = q / np.linalg.norm(q) + 0.02 * rng.normal(size=(4000, 64))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    centre = centre_of(df.withColumnRenamed("embedding", "vec"), 64)
    assert np.allclose(centre, x.mean(0))
    r = Rotations(64, 8)

    def met(x):
        own, asked = r.buckets(x, 1)[:, :, 0], r.buckets(x[:40], 12)
        return sum((own[None, :, t, None] == asked[:, t][:, None]).any(2).sum(1).mean() for t in range(8)) / len(x)

    assert met(x) > 4 and met(x - centre) < 1
    rows = list(enumerate(x.tolist()))
    want, got = brute(rows, 400), collect(search(df, every=400))
    assert sum(len(set(got[i][0]) & set(want[i][0])) for i in want) >= 0.9 * sum(len(want[i][0]) for i in want)
    assert search(df.selectExpr("vec_id", "transform(embedding, v -> 1e307 * v) as embedding")).count() > 0
