"""Blocks of rows that meet a whole table in one task, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantage.operators import graph, knn, pooling
from vantage.operators import losses as L
from vantage.operators import metrics as M
from vantage.operators.blocks import GroupPairs, squared_distances
from vantage.operators.sweep import NO_GROUP, Rows, similarity, streamed, swept


@pytest.fixture(scope="module")
def rows():
    """Few different vectors, so many are equally near; some labels and some vectors are missing."""
    rng = random.Random(4)
    kinds = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(25)]
    return [(i, rng.randrange(4) if i % 13 else None, kinds[rng.randrange(25)] if i % 17 else None) for i in range(120)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "id long, label int, v array<double>").repartition(3).cache()


def slow_rankings(rows):
    """By query: its positives, and its ranking without itself, ties to smaller ids."""
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows if v}
    for i, label, v in rows:
        positives = {j for j, other, _ in rows if j != i and label is not None and other == label}
        ranking = sorted((j for j in unit if j != i), key=lambda j: (-round(float(unit[i] @ unit[j]), 12), j)) if v else []
        yield i, positives, ranking


@pytest.mark.parametrize("held", [1, 1 << 24])
def test_label_metrics_need_no_list_of_pairs(table, rows, monkeypatch, held):
    monkeypatch.setattr("vantage.operators.sweep.HELD", held)
    found = {(r["name"], r["k"]): r["value"] for r in M.compute_metrics(table, table, None, [1, 7], exclude_self=True).collect()}
    aps, at7, hit1 = [], [], []
    for _, positives, ranking in slow_rankings(rows):
        if positives:
            hits = [n for n, j in enumerate(ranking, 1) if j in positives]
            aps.append(sum(k / n for k, n in enumerate(hits, 1)) / len(positives))
            at7.append(sum(n <= 7 for n in hits) / len(positives))
            hit1.append(1 in hits)
    assert found["mAP", 0] == pytest.approx(100 * np.mean(aps))
    assert found["R", 7] == pytest.approx(100 * np.mean(at7)) and found["CMC", 1] == pytest.approx(100 * np.mean(hit1))
    assert found["num_valid_queries", 0] == len(aps) and found["num_queries_total", 0] == len(rows)


def test_graded_labels_agree_with_listed_grades(spark, table, rows):
    grade = lambda src, dst, _, __: np.where((src + dst) % 5 == 0, M.JUNK, M.EASY if src % 3 == 0 else M.HARD)
    found = {(r["protocol"], r["src"]): r for r in M.map_by_label(table, table, grade, [1, 5], M.BY_GRADE, exclude_self=True).collect()}
    ranked, graded = [], []
    for i, positives, ranking in slow_rankings(rows):
        ranked += [(i, j, n) for n, j in enumerate(ranking, 1)]
        graded += [(i, j, "junk" if (i + j) % 5 == 0 else "easy" if i % 3 == 0 else "hard") for j in positives]
    ranked, graded = spark.createDataFrame(ranked, "src long, dst long, rank long"), spark.createDataFrame(graded, "src long, dst long, grade string")
    for name, (ok, junk) in M.PROTOCOLS.items():
        own = graded.replace({g: "ok" for g in ok} | {g: "junk" for g in junk}, subset=["grade"])
        want = M.map_with_junk(ranked, own, [1, 5]).collect()
        assert len(want) == sum(p == name for p, _ in found)
        for w in want:
            f = found[name, w["src"]]
            assert (f["n_pos"], f["ap"], f["p1"], f["p5"]) == (w["n_pos"], pytest.approx(w["ap"]), pytest.approx(w["p1"]), pytest.approx(w["p5"]))


def test_a_right_side_is_read_once_for_many_rows(spark):
    """A left block is met in parts, and all of them see the rows that its task was given once."""
    rng = np.random.default_rng(7)
    rows = spark.createDataFrame([(i, i % 3, x) for i, x in enumerate(rng.normal(size=(3000, 4)).tolist())], "id long, g long, v array<double>").repartition(3)

    def work(mine, met, sims):
        met.served = getattr(met, "served", 0) + 1
        return {"id": mine.ids, "n": np.full(len(mine.ids), len(met.ids)), "served": np.full(len(mine.ids), met.served), "s": (sims**2).sum(1)}

    found = {r.id: r for r in swept(rows, rows, work, "id long, n long, served long, s double", held=1).collect()}
    assert len(found) == 3000 and {r.n for r in found.values()} == {3000} and max(r.served for r in found.values()) > 1
    v = np.array([r.v for r in rows.orderBy("id").collect()])
    v = v / np.linalg.norm(v, axis=1)[:, None]
    assert np.allclose([found[i].s for i in range(3000)], ((v @ v.T) ** 2).sum(1))


@pytest.mark.parametrize("values", ["any", "few", "last bits", "zeros"])
def test_ranks_read_off_a_sorted_row_are_those_of_a_plain_sort(values):
    rng = np.random.default_rng(8)
    n, m = 400, 30
    sims = rng.normal(size=(m, n))
    if values == "few":
        sims = np.round(sims)
    if values == "last bits":
        sims = (np.float64(0.3).view(np.int64) + rng.integers(-9, 9, (m, n))).view(np.float64)
    if values == "zeros":
        sims = rng.choice([0.0, -0.0, 5e-324, -5e-324, 1.0], (m, n))
    groups = rng.choice([0, 1, 2, NO_GROUP], n)
    met = Rows(rng.permutation(n), groups, np.zeros(n, np.int64), rng.random(n) < 0.9, np.zeros((n, 0)))
    mine = Rows(*(x[:m] for x in (met.ids, groups, met.marks, met.held, met.v)))
    grade = lambda src, dst, _, __: (src + dst) % 5 - 1  # noqa: E731  -1 and 3 are none of the three grades
    for g in (None, grade):
        for i, every, codes, rank in M._of_label(mine, met, sims.copy(), True, g):
            same = [k for k in range(n) if groups[k] == groups[i] != NO_GROUP and k != i]
            code = {k: 1 if g is None else (int(met.ids[i] + met.ids[k]) % 5) % 4 for k in same}
            assert sorted(every.tolist()) == sorted(code.values())
            order = sorted((k for k in range(n) if met.held[k] and k != i), key=lambda k: (-sims[i, k], met.ids[k]))
            want = [(code[k], at) for at, k in enumerate(order, 1) if code.get(k)] if met.held[i] else []
            assert list(zip(codes.tolist(), rank.tolist())) == want


def test_equal_rows_are_equally_near_wherever_they_lie():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2500, 64))
    x[[0, 511, 2047, 2048]] = x[2499]
    for n in (1, 8, 163, 256):
        s = similarity(rng.normal(size=(n, 64)), x, "cosine")
        assert (s[:, [0, 511, 2047, 2048]] == s[:, [2499]]).all()


def test_a_sweep_within_groups_meets_the_whole_group_once(table, rows):
    def work(mine, met, sims):
        same = mine.groups[:, None] == met.groups[None]
        return {"id": mine.ids, "n": same.sum(1), "cells": np.full(len(mine.ids), sims.size)}

    side = table.filter("label is not null").select("id", table["label"].alias("g"), "v")
    found = {r.id: r for r in swept(side, side, work, "id long, n long, cells long", "dot", within=True, held=1).collect()}
    sizes = {g: sum(label == g for _, label, _ in rows) for g in range(4)}
    assert {i: f.n for i, f in found.items()} == {i: sizes[label] for i, label, _ in rows if label is not None}


@pytest.fixture(scope="module")
def scenes(spark):
    """Scene 0 has most nodes; some have no vector, and some are equal to others."""
    rng, rows = random.Random(9), []
    for scene, n in ((0, 40), (1, 17), (2, 1)):
        kinds = [np.array([rng.gauss(0, 1) for _ in range(4)]) for _ in range(max(1, n // 2))]
        for i in range(n):
            v = kinds[rng.randrange(len(kinds))]
            rows.append((scene, i, (v / np.linalg.norm(v)).tolist() if i % 9 != 8 else None))
    return spark.createDataFrame(rows, "scene long, idx long, v array<double>").repartition(3).cache()


@pytest.fixture(scope="module")
def listed(scenes):
    from vantage.plans import inputs

    return graph.symmetrize(inputs.scene_pairs(scenes).filter("w >= 0.05")).cache()


def bag(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else tuple(x) if isinstance(x, list) else x for x in (r[c] for c in sorted(df.columns))) for r in df.collect()), key=repr)


GRAPHS = {
    "neighbours": lambda n, e: graph.neighbor_lists(n.select("scene", "idx"), e, 0.15),
    "subgraph": lambda n, e: graph.subgraph(e, graph.uniform_sample(n.select("scene", "idx"), 12, seed=3), add_self=True),
    "fetch": lambda n, e: graph.fetch_nodes(n, e, graph.uniform_sample(n.select("scene", "idx"), 2, seed=5)),
    "eligible": lambda n, e: graph.eligible_anchors(n, e, 0.2),
    "ratio": lambda n, e: graph.positive_ratio(n, e, 0.1),
    "expand": lambda n, e: graph.expand_anchors(n, e, graph.uniform_sample(n.select("scene", "idx"), 1, seed=5), 16, hops=3, fan=2, threshold=0.3, seed=2),
    "balanced": lambda n, e: graph.balanced_sample(n, e, 8, 0.1),
    "triplets": lambda n, e: graph.triplets(n.select("scene", "idx"), n, e, 0.2, n_pos=3, n_neg=2, seed=4),
}


@pytest.mark.parametrize("name", GRAPHS)
def test_edges_where_they_are_asked_for_give_what_a_table_of_all_gives(scenes, listed, name):
    found = GRAPHS[name](scenes, graph.Overlaps(scenes, 0.05))
    want = GRAPHS[name](scenes, listed)
    assert sorted(found.columns) == sorted(want.columns) and bag(found) == bag(want) and want.count() > 0


def test_all_edges(scenes, listed):
    assert bag(graph.Overlaps(scenes, 0.05).edges()) == bag(listed)


@pytest.mark.parametrize("text", [False, True])
def test_anchors_of_large_groups_meet_them_whole(scenes, text):
    """Groups of more than one block, as one block each would give; what meets is not exchanged in lists."""
    nodes = scenes.select(scenes["scene"].cast("string" if text else "long").alias("sample"), scenes["idx"].alias("i"), "v")
    pairs = [GroupPairs(nodes, lambda s: np.clip(3 * s, 0.0, 1.0), block) for block in (7, 1000)]
    assert bag(L.overlap_ranking(pairs[0])) == bag(L.overlap_ranking(pairs[1]))
    assert bag(L.multi_similarity_miner(pairs[0])) == bag(L.multi_similarity_miner(pairs[1].rows()))
    want = L.semihard_triplets(pairs[1].rows()).groupBy("sample", "i").agg(F.count("*").alias("n"), F.min("j").alias("least_j"), F.max("l").alias("most_l"))
    assert bag(L.semihard_counts(pairs[0])) == bag(want) and want.count() > 5
    plan = pairs[0].anchors(lambda s, o: (float(s.sum()), len(s)), "x double, n long")._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_attention_of_images_and_heads(spark):
    rng = np.random.default_rng(2)
    rows = [(image, head, pos, rng.normal(size=3).tolist()) for image, n in ((4, 30), (7, 2)) for head in (0, 1) for pos in range(n)]
    side = spark.createDataFrame(rows, "image_id long, head int, pos int, v array<double>").repartition(3)
    found = {(r.image_id, r.head, r.qpos, r.kpos): r.a for r in pooling.attention_map(side, side, 3).collect()}
    for image, head, pos, v in rows:
        keys = [(k, np.exp(np.dot(v, u) / 3**0.5)) for i, h, k, u in rows if (i, h) == (image, head)]
        for k, e in keys:
            assert found.pop((image, head, pos, k)) == pytest.approx(e / sum(x for _, x in keys))
    assert not found


def test_what_is_rounded_in_its_task_is_what_a_rounded_column_is(spark, scenes):
    rng = np.random.default_rng(4)
    side = spark.createDataFrame([(i % 2, 0, i // 2, x) for i, x in enumerate(rng.normal(size=(90, 3)).tolist())], "image_id long, head int, pos int, v array<double>").repartition(3)
    overlaps, far = graph.Overlaps(scenes, 0.05), scenes.select(scenes["scene"].alias("sample"), scenes["idx"].alias("i"), "v")
    for plain, there, c in (
        (pooling.attention_map(side, side, 3), pooling.attention_map(side, side, 3, digits=3), "a"),
        (overlaps.edges(), overlaps.edges(digits=3), "w"),
        (squared_distances(far), squared_distances(far, digits=3), "d"),
    ):
        assert bag(there) == bag(plain.withColumn(c, F.round(c, 3))) and there.count() > 90


def moved(spark, df) -> int:
    """Bytes that exchanges write while the plan runs."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._jvm.java.util.ArrayList()
    stages = lambda: sum(x.shuffleWriteBytes() for x in sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)))
    before = stages()
    df().write.format("noop").mode("overwrite").save()
    return stages() - before


@pytest.mark.parametrize("buffered", [40, 1 << 19])
def test_streamed_blocks_meet_everything_and_cut_no_class(spark, buffered):
    rng = random.Random(5)
    rows = [(i, rng.randrange(9), [rng.gauss(0, 1) for _ in range(3)]) for i in range(130)]
    table = spark.createDataFrame(rows, "id long, g long, v array<double>").repartition(4)
    own = table.selectExpr("g as id", "g", "v")

    def seen(mine, others):
        blocks = [(len(b.ids), set(b.groups.tolist())) for b in others]
        again = sum(len(g) for _, g in blocks) - len(set().union(*(g for _, g in blocks)))
        n = len(mine.ids)
        return {"id": mine.ids, "n": np.full(n, sum(n for n, _ in blocks)), "again": np.full(n, again), "least": np.full(n, min(mine.groups))}

    found = streamed(table, own, seen, "id long, n long, again long, least long", block=6, whole=True, buffered=buffered)
    met = found.groupBy("id").agg(F.sum("n").alias("n"), F.sum("again").alias("again")).collect()
    assert {r.id: (r.n, r.again) for r in met} == {i: (130, 0) for i in range(130)}


def test_a_search_over_many_blocks_deals_each_row_once(spark):
    rng = np.random.default_rng(1)
    rows = [(i, x) for i, x in enumerate(rng.normal(size=(600, 16)).tolist())]
    f = spark.createDataFrame(rows, "id long, v array<double>").repartition(2).cache()
    f.count()
    own = f.select(F.col("id").alias("i"), F.col("id").alias("label"), "v")
    for run in (lambda block: knn.knn_self(f, 3, block=block, limit=0), lambda block: L.class_proxies(own, own, block=block)):
        few, many = (moved(spark, lambda: run(block)) for block in (300, 10))  # rows were copied for each of 2 blocks of the other side, and of 60
        assert 0 < many < 2 * few


def test_squared_distances_deal_each_row_once(spark):
    rng = np.random.default_rng(3)
    nodes = spark.createDataFrame([(i % 2, i, x) for i, x in enumerate(rng.normal(size=(600, 16)).tolist())], "sample long, i long, v array<double>").repartition(2).cache()
    nodes.count()
    few, many = (moved(spark, lambda: squared_distances(nodes, block=block)) for block in (300, 10))  # rows were copied for each of 1 block, and of 30
    assert 0 < many < 2 * few
    named = nodes.select(F.concat(F.lit("s"), "sample").alias("sample"), "i", "v")
    assert bag(squared_distances(named, digits=6).select("i", "j", "d")) == bag(squared_distances(nodes, digits=6).select("i", "j", "d"))


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_best_so_far_agrees_with_all_at_once(metric):
    rng = np.random.default_rng(6)
    x = rng.integers(-2, 3, (900, 4)) + 1000.0 * (metric == "l2")  # many ties, far from zero
    x = x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None] if metric == "cosine" else x
    gid = rng.permutation(900)
    for exclude in (False, True):
        exact = knn._in_order(x[:, None], x[None], metric)
        if exclude:
            exact[np.arange(900), np.arange(900)] = -np.inf
        want = knn._first(np.tile(gid, (900, 1)), exact, 7)
        ids, sims = np.empty((900, 0), np.int64), np.empty((900, 0))
        for at in range(0, 900, 90):
            ids, sims = knn._better_yet(x, gid, x[at : at + 90], gid[at : at + 90], ids, sims, 7, metric, exclude)
        assert (ids == want[0]).all() and (sims == want[1]).all()


def test_neighbour_lists_are_not_dealt_again(spark):
    rng = np.random.default_rng(2)
    rows = [(i % 2, i // 2, x) for i, x in enumerate(rng.normal(size=(800, 4)).tolist())]
    n = spark.createDataFrame(rows, "scene long, idx long, v array<double>").cache()
    n.count()
    overlaps, asked = graph.Overlaps(n, float("-inf")), spark.createDataFrame([(s, i) for s in (0, 1) for i in range(0, 400, 2)] + [(None, 3), (7, 1), (0, 900)], "scene long, idx long").cache()
    asked.count()
    counts = lambda: overlaps.each(lambda scene, u, ids, w: {"idx": u, "n": len(ids)}, "idx long, n long", asked)
    assert moved(spark, lambda: graph.neighbor_lists(asked, overlaps, 0.0)) < 1.5 * moved(spark, counts)
    found = {(r.scene, r.idx): len(r.neighbors) for r in graph.neighbor_lists(asked, overlaps, 0.0).collect()}
    assert found == {(s, i): 399 for s in (0, 1) for i in range(0, 400, 2)} | {(None, 3): 0, (7, 1): 0, (0, 900): 0}
