"""Aggregators with parameters against plain loops over one image at a time; numbering, k-means, whitening and small rules."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantage.operators import aggregators as AG
from vantage.operators import graph, knn, metrics, pooling
from vantage.operators.numbering import numbered
from vantage.sources import tables

D, W, H = 8, 5, 4


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(5)
    return {i: (rng.normal(size=(W * H, D)), rng.normal(size=D)) for i in range(7)}


@pytest.fixture(scope="module")
def local(spark, images):
    rows = [(i, p, p % W, p // W, False, x.tolist()) for i, (xs, _) in images.items() for p, x in enumerate(xs)]
    rows += [(i, -1, 0, 0, True, c.tolist()) for i, (_, c) in images.items()]
    return spark.createDataFrame(rows, "image_id long, pos int, x int, y int, is_cls boolean, v array<double>").repartition(5).cache()


def got(df):
    return {r["image_id"]: np.array(r["v"]) for r in df.collect()}


def close(found, want):
    assert found.keys() == want.keys()
    for k in want:
        np.testing.assert_allclose(found[k], want[k], atol=1e-9)


def norm(x):
    return x / max(np.sqrt((x * x).sum()), 1e-12)


def soft(z):
    e = [math.exp(v - max(z)) for v in z]
    return np.array(e) / sum(e)


def plain_norm(x, w=1.0, b=0.0):
    return np.array([(r - r.mean()) / math.sqrt(((r - r.mean()) ** 2).mean() + 1e-5) * w + b for r in x])


def plain_attention(q, x, p, name, heads):
    out = []
    for row in q:
        parts = []
        size = len(p[f"{name}.q"]) // heads
        for h in range(heads):
            cut = slice(h * size, (h + 1) * size)
            a = (p[f"{name}.q"] @ row + p.get(f"{name}.bq", 0.0))[cut]
            z = [float(a @ (p[f"{name}.k"] @ y)[cut]) / math.sqrt(size) for y in x]
            parts.append(sum(w * (p[f"{name}.v"] @ y)[cut] for w, y in zip(soft(z), x)))
        out.append(p[f"{name}.o"] @ np.concatenate(parts))
    return np.array(out)


def plain_layer(x, p, name, heads, act):
    x = plain_norm(x + plain_attention(x, x, p, f"{name}.attn", heads), p.get(f"{name}.n1.w", 1.0))
    ff = np.array([p[f"{name}.ff.1.w"] @ np.array([act(t) for t in p[f"{name}.ff.0.w"] @ r + p.get(f"{name}.ff.0.b", 0.0)]) for r in x])
    return plain_norm(x + ff)


def layer_parameters(rng, name, d, wide):
    p = {f"{name}.attn.{c}": rng.normal(size=(d, d)) / 3 for c in "qkvo"}
    return p | {f"{name}.attn.bq": rng.normal(size=d), f"{name}.n1.w": rng.normal(size=d), f"{name}.ff.0.w": rng.normal(size=(wide, d)), f"{name}.ff.0.b": rng.normal(size=wide), f"{name}.ff.1.w": rng.normal(size=(d, wide)) / 4}


def test_query_bags(local, images):
    rng = np.random.default_rng(1)
    d, n = 6, 3
    p = {"conv.w": rng.normal(size=(d, 9 * D)), "conv.b": rng.normal(size=d), "norm.w": rng.normal(size=d), "fc.w": rng.normal(size=(2, 2 * n)), "fc.b": rng.normal(size=2)}
    for at in range(2):
        p |= layer_parameters(rng, f"block{at}.encoder", d, 10)
        p |= {f"block{at}.{m}.{c}": rng.normal(size=(d, d)) / 2 for m in ("self", "cross") for c in "qkvo"} | {f"block{at}.queries": rng.normal(size=(n, d))}
    want = {}
    for i, (xs, _) in images.items():
        grid = xs.reshape(H, W, D)
        w = p["conv.w"].reshape(d, 3, 3, D)
        x = np.zeros((H * W, d))
        for y in range(H):
            for c in range(W):
                for dy in range(3):
                    for dx in range(3):
                        if 0 <= y + dy - 1 < H and 0 <= c + dx - 1 < W:
                            x[y * W + c] += w[:, dy, dx] @ grid[y + dy - 1, c + dx - 1]
        x, outs = plain_norm(x + p["conv.b"], p["norm.w"]), []
        for at in range(2):
            x = plain_layer(x, p, f"block{at}.encoder", 2, lambda t: max(t, 0.0))
            q = p[f"block{at}.queries"]
            q = plain_norm(q + plain_attention(q, q, p, f"block{at}.self", 2))
            outs.append(plain_norm(plain_attention(q, x, p, f"block{at}.cross", 2)))
        want[i] = norm((p["fc.w"] @ np.concatenate(outs) + p["fc.b"][:, None]).T.ravel())
    close(got(AG.encode("boq", local, p, heads=2, blocks=2)), want)


def test_attention_across_images(local, images):
    rng = np.random.default_rng(2)
    p = layer_parameters(rng, "encoder0", D, 12)
    gelu = lambda t: t * 0.5 * (1 + math.erf(t / math.sqrt(2)))
    tokens = {}
    for i, (xs, cls) in images.items():
        grid = np.array([norm(x) for x in xs]).reshape(H, W, D)
        out = [cls]
        for n in (2, 3):
            edge = lambda size, n=n: [round(size * k / n) for k in range(n + 1)]
            for a, b in zip(edge(H), edge(H)[1:]):
                for c, e in zip(edge(W), edge(W)[1:]):
                    out.append((np.maximum(grid[a:b, c:e].reshape(-1, D), 1e-6) ** 3).mean(0) ** (1 / 3))
        tokens[i] = np.array(out)
    want = {}
    for batch in ([0, 1, 2], [3, 4, 5], [6]):
        for t in range(14):
            for i, row in zip(batch, plain_layer(np.array([tokens[i][t] for i in batch]), p, "encoder0", 4, gelu)):
                want.setdefault(i, []).append(row)
    close(got(AG.encode("cricavpr", local, p, heads=4, blocks=1, width=W, height=H, batch=3)), {i: norm(np.concatenate(r)) for i, r in want.items()})


def test_learned_vlad_with_gate_and_power(local, images):
    rng = np.random.default_rng(3)
    p = {"centers": rng.normal(size=(4, D)), "assign.w": rng.normal(size=(6, D)), "assign.b": rng.normal(size=6), "softp.0.w": rng.normal(size=(3, 1)), "softp.0.b": rng.normal(size=3), "softp.1.w": rng.normal(size=(1, 3)), "softp.alpha": np.array([0.4])}
    p |= {"dpn.0.w": rng.normal(size=(5, D)), "dpn.1.w": rng.normal(size=(1, 5)), "dpn.1.b": np.array([0.3])}
    logistic = lambda t: 1 / (1 + math.exp(-t))
    want = {}
    for i, (xs, _) in images.items():
        v = np.zeros((4, D))
        for x in xs:
            h = np.maximum(p["softp.0.w"] @ [np.linalg.norm(x) + 1e-6] + p["softp.0.b"], 0)
            x = x * (1 + 0.4 * logistic(float((p["softp.1.w"] @ h)[0])))
            a = soft(p["assign.w"] @ x + p["assign.b"])
            for k in range(4):
                v[k] += a[k] * (x - p["centers"][k])
        e = logistic(float((p["dpn.1.w"] @ np.maximum(p["dpn.0.w"] @ v.mean(0), 0) + p["dpn.1.b"])[0]))
        v = np.sign(v) * (np.abs(v) + 1e-6) ** e + v
        want[i] = norm(np.concatenate([norm(r) for r in v]))
    close(got(AG.encode("ghostvlad", local, p, ghosts=2)), want)


def test_optimal_transport_with_layers(spark, local, images):
    rng = np.random.default_rng(4)
    p = {f"{n}.{k}.{c}": rng.normal(size=(s if c == "w" else s[:1])) for n, k, s in (("score", 0, (5, D)), ("score", 1, (3, 5)), ("feature", 0, (6, D)), ("feature", 1, (2, 6)), ("token", 0, (4, D))) for c in "wb"}
    run = lambda n, x: p[f"{n}.1.w"] @ np.maximum(p[f"{n}.0.w"] @ x + p[f"{n}.0.b"], 0) + p[f"{n}.1.b"]

    def one(xs, cls):
        t = pooling.sinkhorn(np.array([run("score", x) for x in xs]).T, 1.0, 3)[:-1]
        f = np.array([run("feature", x) for x in xs])
        return norm(np.concatenate([norm(p["token.0.w"] @ cls + p["token.0.b"]), *[norm((t[k][:, None] * f).sum(0)) for k in range(3)]]))

    close(got(AG.encode("salad", local, p)), {i: one(xs, c) for i, (xs, c) in images.items()})
    bare = local.filter("image_id < 2 and not (image_id = 1 and is_cls)").unionByName(spark.createDataFrame([(0, 99, 0, 0, False, None), (0, 98, 0, 0, None, [None] * D)], local.schema))
    close(got(AG.encode("salad", bare, p)), {0: one(*images[0]), 1: one(images[1][0], images[1][0].mean(0))})


def test_tail_of_an_encoder(spark, local, images):
    rng = np.random.default_rng(6)
    p = {"bn.mean": rng.normal(size=D), "bn.var": rng.uniform(0.5, 2, D), "bn.w": rng.normal(size=D), "bn.b": rng.normal(size=D), "whiten.w": rng.normal(size=(3, D)), "whiten.b": rng.normal(size=3)}
    tail = lambda x: p["whiten.w"] @ ((x - p["bn.mean"]) / np.sqrt(p["bn.var"] + 1e-5) * p["bn.w"] + p["bn.b"]) + p["whiten.b"]
    mean = {i: xs.mean(0) for i, (xs, _) in images.items()}
    close(got(AG.encode("avg", local, p)), {i: norm(tail(m)) for i, m in mean.items()})
    close(got(AG.encode("avg", local, p, final_norm=False)), {i: tail(m) for i, m in mean.items()})
    table = spark.createDataFrame([("whiten.w", r, row.tolist()) for r, row in enumerate(p["whiten.w"])], "name string, row int, v array<double>")
    np.testing.assert_array_equal(AG.read_parameters(table)["whiten.w"], p["whiten.w"])


def test_names_and_class_tokens(local):
    with pytest.raises(ValueError, match="unknown aggregator"):
        AG.encode("cfp", local)
    for name in AG.NEED_CLASS_TOKEN:
        with pytest.raises(ValueError, match="class tokens"):
            AG.encode(name, local.drop("is_cls"))
    with pytest.raises(Exception, match="no class token in image 3"):
        pooling.class_token(local.filter("not (is_cls and image_id = 3)")).collect()


def test_numbers_without_gaps(spark):
    rows = [(i * 7919 % 500, f"s{i % 3}") for i in range(500)]
    df = spark.createDataFrame(rows, "a long, b string").repartition(6)
    found = numbered(df, ["b", -F.col("a")], "n").collect()
    assert [(r.a, r.b) for r in sorted(found, key=lambda r: r.n)] == sorted(rows, key=lambda r: (r[1], -r[0]))
    assert sorted(r.n for r in found) == list(range(500))
    assert numbered(df.limit(0), ["a"]).collect() == []


def test_kmeans_by_plain_rounds(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(80, 3)) + 5 * rng.integers(0, 3, (80, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [None] * 3)], "id long, v array<double>").repartition(4)
    order = sorted(range(80), key=lambda i: ((i + 42) * 2654435761 % 2**32, i))
    for cap, used in ((16384, order), (10, order[:40])):
        c = x[order[:4]].copy()
        for _ in range(6):
            at = [min(range(4), key=lambda k: (((x[i] - c[k]) ** 2).sum(), k)) for i in used]
            c = np.array([x[[i for i, a in zip(used, at) if a == k]].mean(0) if k in at else c[k] for k in range(4)])
        found = {r["k"]: r["v"] for r in pooling.kmeans_centers(df, 4, rounds=6, per_centre=cap).collect()}
        np.testing.assert_allclose([found[k] for k in range(4)], c, atol=1e-9)
    twins = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "id long, v array<double>")
    assert [r["v"] for r in pooling.kmeans_centers(twins, 3).orderBy("k").collect()] == [[1.0, 2.0]] * 3
    assert pooling.kmeans_centers(twins.limit(0), 3).collect() == []


def test_whitening_by_numpy(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(60, 4)) @ rng.normal(size=(4, 4)) + 3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0, None, 1.0, 1.0])], "id long, v array<double>").repartition(3)
    cov = np.cov(x.T)
    found = np.zeros((4, 4))
    for r in pooling.moments(df).collect():
        found[r["i"], r["j"]] = r["cov"]
        assert r["mean"] == pytest.approx(x.mean(0)[r["i"]])
    np.testing.assert_allclose(found, cov, atol=1e-9)
    values, axes = np.linalg.eigh(cov + 1e-4 * np.eye(4))
    want = ((x - x.mean(0)) @ axes[:, ::-1][:, :2]) / np.sqrt(values[::-1][:2])
    rows = {r["id"]: r["v"] for r in pooling.whiten(df, 2).collect()}
    assert rows.keys() == set(range(60))
    y = np.array([rows[i] for i in range(60)])
    for c in range(2):
        assert min(np.abs(y[:, c] - want[:, c]).max(), np.abs(y[:, c] + want[:, c]).max()) < 1e-8


def test_dropping_neighbours_does_not_depend_on_partitions(spark):
    edges = spark.createDataFrame([(s, r, (s * 31 + r) % 997) for s in range(300) for r in range(10)], "src long, rank int, dst long")
    a, b = (sorted(map(tuple, graph.drop_neighbours(edges.repartition(n), 0.3, 4).collect())) for n in (2, 9))
    assert a == b and sum(r[1] == 0 for r in a) == 300 and 0.65 < (len(a) - 300) / 2700 < 0.75
    assert a != sorted(map(tuple, graph.drop_neighbours(edges, 0.3, 5).collect()))


def test_profiles_and_lookups(spark):
    rng = np.random.default_rng(12)
    f = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(12, 3)))], "id long, v array<double>")
    truth = spark.createDataFrame([(i, (i + 3) % 12) for i in range(12)], "src long, dst long")
    names = lambda n: {(r["name"], r["k"]) for r in metrics.validation_metrics(n, f, f, truth).collect()}
    assert names("my_GL3D_set") == {("mAP", 0), *[(m, k) for m in ("mAP", "R") for k in (1, 25, 50, 100)]}
    assert names("u1652-drone") == {("mAP", 0), *[(m, k) for m in ("mAP", "CMC") for k in (1, 5, 10)]}
    assert names("else") == {("mAP", 0), *[(m, k) for m in ("mAP", "R", "CMC") for k in (1, 10, 20)]}
    with pytest.raises(ValueError):
        knn.topk_neighbours(f, 12)
    assert knn.topk_neighbours(f, 11).groupBy("src").count().filter("count = 11").count() == 12
    wanted = spark.createDataFrame([("w/a.pt", True), ("w/a.pt", False), ("b", True), ("c", False), (None, True)], "name string, is_file boolean")
    entries = spark.createDataFrame([("a",), ("a.pt",), ("b",)], "key string")
    assert sorted(((r.name or "", r.is_file, r.key) for r in tables.look_up(wanted, entries).collect())) == sorted([("w/a.pt", True, "a.pt"), ("w/a.pt", False, None), ("b", True, "b"), ("c", False, None), ("", True, None)], key=str)


def test_truth_of_files(spark):
    files = spark.createDataFrame([("a/d2s.npz", "d2s"), ("b/s2d.npz", "s2d")], "path string, task string")
    registry = spark.createDataFrame([("d2s", 1, 2), ("d2s", 1, 3), ("s2d", 4, 5)], "task string, src long, dst long")
    assert sorted((r.path, r.src, r.dst) for r in tables.truth_of_files(files, registry).collect()) == [("a/d2s.npz", 1, 2), ("a/d2s.npz", 1, 3), ("b/s2d.npz", 4, 5)]
    with pytest.raises(Exception, match="no ground truth for task s2d"):
        tables.truth_of_files(files, registry.filter("task = 'd2s'")).collect()
