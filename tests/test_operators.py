"""Hand-computed cases: repeated edges, ties, null and zero vectors, large ids, empty tables, files written and read."""

import itertools
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantage.operators import graph, knn, metrics, pairs, pooling, rerank
from vantage.sources import storage, tables
from vantage.streaming.search import search_stream


def test_symmetrize_keeps_the_largest_of_repeated_edges(spark):
    rows = [("s", 0, 1, 0.2), ("s", 1, 0, 0.7), ("s", 0, 1, 0.5), ("s", 2, 2, 0.9), ("s", 1, 2, 1.5), ("s", 0, 2, -0.3), ("t", 0, 1, 0.1)]
    got = {(r.scene, r.u, r.v): r.w for r in graph.symmetrize(spark.createDataFrame(rows, "scene string, u long, v long, w double")).collect()}
    assert got == {("s", 0, 1): 0.7, ("s", 1, 0): 0.7, ("s", 1, 2): 1.0, ("s", 2, 1): 1.0, ("s", 0, 2): 0.0, ("s", 2, 0): 0.0, ("t", 0, 1): 0.1, ("t", 1, 0): 0.1}


def test_fetch_nodes_takes_the_largest_of_repeated_edges(spark):
    nodes = spark.createDataFrame([("s", i) for i in range(3)], "scene string, idx long")
    edges = spark.createDataFrame([("s", 0, 1, 0.2), ("s", 0, 1, 0.6), ("s", 0, 1, 0.4)], "scene string, u long, v long, w double")
    got = graph.fetch_nodes(nodes, edges, nodes.filter("idx = 0")).collect()
    assert {r.v: r.w for r in got} == {1: 0.6, 2: 0.0}


def test_hashed_order_of_any_id(spark):
    ids = [0, 1, 977, 2**31, 3_500_000_000, 2**40 + 12345, 2**62]
    got = spark.createDataFrame([(i,) for i in ids], "id long").select("id", graph.hashed(F.col("id"), 7).alias("h")).collect()
    assert {r.id: r.h for r in got} == {i: (i + 7) * 2654435761 % 2**32 for i in ids}


def test_labels_of_a_thousand_samples_do_not_collide(spark):
    rows = [(s, i) for s in (0, 1, 1000, 1001) for i in range(3)]
    got = graph.collate_labels(spark.createDataFrame(rows, "sample long, slot long")).collect()
    assert len({r.label for r in got if r.slot == 2} | {r.label for r in got if r.slot < 2}) == 8


def test_families_are_dropped_by_their_whole_name(spark):
    rows = [("R", 1, 1.0), ("mAP", 0, 2.0), ("mAR", 1, 3.0), ("num_valid_queries", 0, 4.0)]
    got = metrics.drop_families(spark.createDataFrame(rows, "name string, k int, value double"), ["R"]).collect()
    assert {r.name for r in got} == {"mAP", "mAR"}


def test_match_pairs_counts_ranks_after_the_query_itself(spark):
    names = spark.createDataFrame([(0, "c"), (1, "a"), (2, "b"), (3, "d")], "id long, name string")
    edges = spark.createDataFrame([(0, 1, 0), (0, 2, 1), (0, 3, 2), (1, 1, 1), (1, 2, 0), (1, 3, 3), (2, 1, 3), (2, 2, 2), (2, 3, 0)], "src long, rank int, dst long")
    got = lambda n: sorted(tuple(r) for r in pairs.match_pairs(edges, names, n).collect())
    assert got(None) == [("a", "c"), ("a", "d"), ("b", "c"), ("b", "d")]
    assert got(1) == [("a", "c"), ("b", "d")]
    assert got(2) == got(None)


def test_rotary_by_hand(spark):
    """A 2 x 3 grid, 8 components: rows at -1/2 and 1/2, columns at -2/3, 0, 2/3; periods 1 and 10."""
    v = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]
    rows = [(0, y * 3 + x, x, y, v) for y in range(2) for x in range(3)]
    got = pooling.rotary(spark.createDataFrame(rows, "image_id long, pos int, x int, y int, v array<double>")).collect()
    for r in got:
        down, along = (-0.5, 0.5)[r.y], (-2 / 3, 0.0, 2 / 3)[r.x]
        angles = [2 * math.pi * c / p for c in (down, along) for p in (1.0, 10.0)]
        for j, t in enumerate(angles):
            assert r.v[j] == pytest.approx(v[j] * math.cos(t) - v[j + 4] * math.sin(t))
            assert r.v[j + 4] == pytest.approx(v[j + 4] * math.cos(t) + v[j] * math.sin(t))


def brute_ranking(q, g, metric):
    out = {}
    for i, a in q:
        sims = []
        for j, b in g:
            if metric == "cosine":
                a1, b1 = (np.array(x) / max(np.linalg.norm(x), 1e-12) for x in (a, b))
                sims.append((-float(a1 @ b1), j))
            else:
                sims.append((float(np.linalg.norm(np.array(a) - b)), j))
        out[i] = [j for _, j in sorted((round(s, 9), j) for s, j in sims)]
    return out


@pytest.mark.parametrize("limit", [0, 3000, 1 << 20])
@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_search_with_ties_zero_and_null_vectors(spark, metric, limit):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, [0.6, 0.8]), (5, [-1.0, 0.0])]
    f = spark.createDataFrame([*rows, (6, None), (7, [None, 1.0])], "id long, v array<double>")
    want = brute_ranking(rows, rows, metric)
    got = {}
    for r in knn.knn_self(f, 20, metric, block=2, limit=limit).collect():
        got.setdefault(r.src, {})[r["rank"]] = r.dst
    assert {i: [d[k] for k in sorted(d)] for i, d in got.items()} == want
    stated = spark.createDataFrame([(0, 2), (0, 4), (4, 3), (5, 5), (0, 6), (9, 1)], "src long, dst long")
    ranks = {(r.src, r.dst): r["rank"] for r in knn.pair_ranks(f, f, stated, metric, block=2, limit=limit).collect()}
    assert ranks == {(s, d): want[s].index(d) + 1 for s, d in [(0, 2), (0, 4), (4, 3), (5, 5)]}
    assert knn.knn_self(f.limit(0), 3, metric, limit=limit).collect() == []


@pytest.mark.parametrize("limit", [0, 3000, 1 << 20])  # nothing, the queries, or the pairs too are sent to all tasks
def test_many_ranks_at_once(spark, limit):
    rng = np.random.default_rng(3)
    rows = [(i, x) for i, x in enumerate(rng.integers(-2, 3, (60, 3)).astype(float).tolist())]  # many ties
    f = spark.createDataFrame(rows, "id long, v array<double>")
    stated = f.select(F.col("id").alias("src")).crossJoin(f.select(F.col("id").alias("dst")))
    want = brute_ranking(rows, rows, "l2")
    got = {(r.src, r.dst): r["rank"] for r in knn.pair_ranks(f, f, stated, "l2", block=16, limit=limit).collect()}
    assert got == {(i, j): r + 1 for i, js in want.items() for r, j in enumerate(js)}


def test_queries_without_truth_are_not_scored(spark):
    ranks = spark.createDataFrame([(1, 5, 1), (1, 6, 3)], "src long, dst long, rank long")
    truth = spark.createDataFrame([(1, 5), (1, 6), (2, 9)], "src long, dst long")
    got = {(r.name, r.k): r.value for r in metrics.retrieval_metrics(ranks, truth, [1], 3).collect()}
    assert got["mAP", 0] == pytest.approx(100 * ((1 + 2 / 3) / 2) / 2) and got["CMC", 1] == 50 and got["num_valid_queries", 0] == 2 and got["num_queries_total", 0] == 3


def test_all_junk_query_is_left_out(spark):
    ranked = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 5, 1)], "src long, dst long, rank long")
    graded = spark.createDataFrame([(1, 5, "junk"), (1, 6, "ok"), (2, 5, "junk")], "src long, dst long, grade string")
    got = metrics.map_with_junk(ranked, graded, [1]).collect()
    assert [(r.src, r.n_pos, r.ap, r.p1) for r in got] == [(1, 1, 1.0, 1.0)]


def test_intermediate_tables(spark):
    table, figures = storage.measured(spark.range(10).repartition(3), "t", n=F.count(F.lit(1)), most=F.max("id"))
    assert figures == {"n": 10, "most": 9} and table.count() == 10
    storage.discard(table)
    with pytest.raises(Exception):
        spark.read.parquet(storage.shared_dir(spark) + "/none-such").count()


def test_shuffle_files_go_with_the_table_they_were_for(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = lambda: {n.rsplit("/", 1)[-1] for n in blocks.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in n}
    before, setting = names(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = spark.conf.get(setting, None)
    table = storage.materialize(spark.range(1000).repartition(3, "id").groupBy(F.col("id") % 7).count(), "t")
    for _ in range(50):  # they go in the background
        left = {n for n in names() - before if n.endswith(".data")}
        if not left:
            break
        time.sleep(0.1)
    assert not left and table.count() == 7 and spark.conf.get(setting, None) == kept
    storage.discard(table)


def test_features_and_metrics_round_trip(spark, tmp_path):
    rows = [("a", [1.0, 2.0]), ("b", [3.0, 4.0])]
    df = spark.createDataFrame(rows, "image_name string, feat array<float>")
    where = f"file://{tmp_path}/features"
    tables.write_features(df, where, {"model": "m", "dim": "2"})
    found, meta = tables.read_features(spark, where)
    assert sorted((r.image_name, list(r.feat)) for r in found.collect()) == rows and meta["model"] == "m" and meta["dim"] == "2"
    m = spark.createDataFrame([("mAP", 0, 51.25), ("R", 1, 40.0)], "name string, k int, value double")
    tables.write_metrics(m, f"file://{tmp_path}/metrics", {"model": "m"})
    assert sorted((r.name, r.k, r.value, r.model) for r in spark.read.json(f"file://{tmp_path}/metrics").collect()) == [("R", 1, 40.0, "m"), ("mAP", 0, 51.25, "m")]


def test_pair_lines_and_initial_centres_round_trip(spark, tmp_path):
    tables.write_pairs(spark.createDataFrame([("b", "c"), ("a", "z")], "name_a string, name_b string"), f"file://{tmp_path}/pairs")
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/pairs").orderBy("value").collect()] == ["a z", "b c"]
    spark.createDataFrame([(0, [1.0])], "k int, vec array<float>").write.parquet(f"file://{tmp_path}/init/centers")
    spark.createDataFrame([(7, [2.0])], "id long, vec array<float>").write.parquet(f"file://{tmp_path}/init/descriptors")
    centers, descriptors = tables.read_vlad_init(spark, f"file://{tmp_path}/init")
    assert centers.count() == descriptors.count() == 1
    for part in ("db", "q", "gt"):
        spark.range(3).write.parquet(f"file://{tmp_path}/set/{part}")
    assert set(tables.read_retrieval(spark, f"file://{tmp_path}", "set", ("set",))) == {"db", "q", "gt"}
    with pytest.raises(ValueError, match="unknown set"):
        tables.read_retrieval(spark, f"file://{tmp_path}", "other", ("set",))


def test_find_images(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("b.JPG", "a.png", "in/c.jpeg", "no.txt"):
        (tmp_path / name).write_bytes(b"x")
    got = [r.path.rsplit("/", 1)[1] for r in tables.find_images(spark, [f"file://{tmp_path}", f"file://{tmp_path}/none"]).collect()]
    assert got == ["a.png", "b.JPG", "c.jpeg"]


def test_search_of_a_stream(spark, tmp_path):
    gallery = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "id long, v array<double>")
    gallery.filter("id < 2").write.parquet(f"file://{tmp_path}/asked")
    stream = spark.readStream.schema(gallery.schema).parquet(f"file://{tmp_path}/asked")
    run = search_stream(stream, gallery, f"file://{tmp_path}/found", f"file://{tmp_path}/state", k=2)
    assert run.awaitTermination(120)
    got = sorted((r.src, r["rank"], r.dst) for r in spark.read.parquet(f"file://{tmp_path}/found").collect())
    assert got == sorted((r.src, r["rank"], r.dst) for r in knn.knn(gallery.filter("id < 2"), gallery, 2).collect())


def slow_balanced(n, order, near, target=0.5, slack=0.05):
    """The same search over a whole scene."""
    chosen = order[:n]
    pairs = max(1, len(chosen) * (len(chosen) - 1) // 2)
    count = lambda c: sum(frozenset(p) in near for p in itertools.combinations(c, 2))
    for _ in range(min(50, len(order))):
        off, best = abs(count(chosen) / pairs - target), (0.01, None)
        unused = [x for x in order if x not in chosen][:20]
        if off <= slack:
            break
        for i in range(len(chosen)):
            for x in unused:
                other = chosen[:i] + [x] + chosen[i + 1 :]
                gain = off - abs(count(other) / pairs - target)
                if gain > best[0] + 1e-12:
                    best = (gain, other)
        if best[1] is None:
            break
        chosen = best[1]
    return set(chosen)


def test_balanced_sample_is_that_of_the_whole_scene(spark):
    rng = np.random.default_rng(5)
    nodes, edges = [], []
    for scene, (size, chance) in enumerate([(60, 0.1), (45, 0.9), (5, 0.5)]):
        nodes += [(scene, i) for i in range(size)]
        edges += [(scene, int(i), int(j), 1.0) for i, j in itertools.combinations(range(size), 2) if rng.random() < chance]
    e = graph.symmetrize(spark.createDataFrame(edges, "scene long, u long, v long, w double"))
    got = graph.balanced_sample(spark.createDataFrame(nodes, "scene long, idx long"), e, 6, 0.5, seed=2).collect()
    for scene in range(3):
        order = sorted((i for s, i in nodes if s == scene), key=lambda i: ((i + 2) * 2654435761 % 2**32, i))
        near = {frozenset((u, v)) for s, u, v, _ in edges if s == scene}
        assert {r.idx for r in got if r.scene == scene} == slow_balanced(6, order, near)


def test_propagated_rows_as_dense_vectors(spark):
    rng = np.random.default_rng(7)
    f = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(20)], "id long, v array<double>")
    q, g = rerank.apply_reranking("gnn", f.filter("id < 5"), f.filter("id >= 5"), k1=4, k2=2)
    sparse = {(r.i, r.f): r.w for r in rerank.graph_rows(f.filter("id < 5"), f.filter("id >= 5"), 4, 2).collect()}
    rows = q.collect() + g.collect()
    assert len(rows) == 20 and all(len(r.v) == 20 for r in rows)
    assert all(r.v[j] == pytest.approx(sparse.get((r.id, j), 0.0)) for r in rows for j in range(20))
