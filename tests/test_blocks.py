"""Pairs within groups by blocks, and the losses on them, against plain loops."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vantage.operators import losses as L
from vantage.operators.blocks import GroupPairs, meet, squared_distances


@pytest.fixture(scope="module")
def data():
    """Group 0 holds a third of all rows; group 3 a single row; some vectors are missing."""
    rng = random.Random(8)
    sizes = {0: 90, 1: 40, 2: 60, 3: 1, 4: 79}
    rows = []
    for g, n in sizes.items():
        for i in range(n):
            v = np.array([rng.gauss(0, 1) for _ in range(6)])
            rows.append((g, i, f"c{rng.randrange(4)}" if i % 11 else None, (v / np.linalg.norm(v)).tolist()))
    return rows


@pytest.fixture(scope="module")
def nodes(spark, data):
    gaps = [(0, 500, "c1", None), (2, 501, "c1", [None] * 6), (7, 0, "c1", None)]
    return spark.createDataFrame(data + gaps, "sample long, i long, label string, v array<double>").repartition(4).cache()


def slow_pairs(data, overlap):
    for g, i, a, v in data:
        for h, j, b, u in data:
            if g == h and i != j:
                s = float(np.dot(v, u))
                yield g, i, j, overlap(s, a, b, (g, i, j)), s


clipped = lambda sim: np.clip(3 * sim, 0.0, 1.0)  # noqa: E731  sent to tasks by value


@pytest.mark.parametrize("block", [7, 1000])
def test_rows_of_all_pairs(nodes, data, block):
    found = {(r.sample, r.i, r.j): (r.overlap, r.sim) for r in GroupPairs(nodes, clipped, block).rows().collect()}
    want = {(g, i, j): (o, s) for g, i, j, o, s in slow_pairs(data, lambda s, a, b, k: min(max(3 * s, 0), 1))}
    assert found.keys() == want.keys()
    assert all(found[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    half = GroupPairs(nodes, block=block).rows(both=False)
    assert half.count() * 2 == len(want) and half.filter("i >= j").isEmpty()


def test_a_large_group_is_many_tasks(nodes):
    """No task meets more than two blocks, and the largest group is spread over its triangle of them."""
    met = GroupPairs(nodes, block=10).nodes.groupBy("sample", "a", "b").count()
    assert met.filter("sample = 0").count() == 9 * 10 // 2
    assert met.agg(F.max("count")).first()[0] < 50


@pytest.mark.parametrize("block", [9, 1000])
def test_labels_and_tables_of_overlaps(spark, nodes, data, block):
    found = {(r.sample, r.i, r.j): r.overlap for r in GroupPairs(nodes, "label", block).rows().collect()}
    assert found == {(g, i, j): float(a is not None and a == b) for g, i, j, (a, b), _ in slow_pairs(data, lambda s, a, b, k: (a, b))}
    edges = [(0, 1, 2, 0.5), (0, 2, 1, 0.7), (0, 3, 80, 0.9), (1, 0, 39, 0.25), (2, 5, 5, 1.0), (0, 4, 999, 1.0), (9, 1, 2, 1.0), (1, 2, 3, None)]
    table = spark.createDataFrame(edges, "sample long, i long, j long, overlap double")
    got = GroupPairs(nodes, table, block).rows().filter("overlap > 0").collect()
    assert {(r.sample, r.i, r.j, r.overlap) for r in got} == {(0, 1, 2, 0.7), (0, 2, 1, 0.7), (0, 3, 80, 0.9), (0, 80, 3, 0.9), (1, 0, 39, 0.25), (1, 39, 0, 0.25)}


def test_squared_distances(nodes, data):
    found = {(r.sample, r.i, r.j): r.d for r in squared_distances(nodes, block=13).collect()}
    want = {(g, i, j): sum((x - y) ** 2 for x, y in zip(v, u)) for g, i, _, v in data for h, j, _, u in data if g == h}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_meeting_on_a_hot_key(spark):
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 0), (None, 1), (3, 7), (2, 0)], "k long, x long")
    right = spark.createDataFrame([(1, -i) for i in range(30)] + [(2, 5), (None, 1), (4, 7)], "k long, y long")
    found = meet(left, right, "k", block=8)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, left.join(right, "k").select("k", "x", "y").collect()))


def brute_dominance(s, o, om, sm):
    pairs = [(j, k) for j in range(len(s)) for k in range(len(s)) if o[j] - o[k] > om]
    return sum(max(0.0, sm - (s[j] - s[k])) for j, k in pairs), len(pairs)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([-1.0, -0.3, 0.0, 0.1, 0.15, 0.2, 0.9]) | st.floats(-1, 1), st.sampled_from([0.0, 0.05, 0.1, 0.15, 1.0]) | st.floats(0, 1)), max_size=40), st.sampled_from([0.0, 0.05, 0.3]), st.sampled_from([0.0, 0.05, 0.5]))
def test_dominance_sums(rows, om, sm):
    s, o = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    total, n = L.dominance(s, o, om, sm)
    want, pairs = brute_dominance(s, o, om, sm)
    assert n == pairs and total == pytest.approx(want, abs=1e-9)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(0, 2), max_size=20), st.lists(st.floats(0, 2), max_size=20), st.sampled_from([0.0, 0.05, 1.0]))
def test_hinge_sums(near, far, margin):
    total, n = L.hinge_sums(np.array(near), np.array(far), margin)
    each = [p + margin - q for p in near for q in far]
    assert total == pytest.approx(sum(x for x in each if x > 0), abs=1e-9) and n == sum(q < p + margin for p in near for q in far)


LOSSES = {
    "supcon": (clipped, L.supcon), "soft": (clipped, lambda p: L.supcon(p, soft=True)), "circle": (clipped, L.circle), "multi": (clipped, L.multi_similarity),
    "rank": (clipped, L.overlap_ranking), **{n: ("label", f) for n, f in L.NAMED.items()},
}


@pytest.mark.parametrize("name", sorted(LOSSES))
def test_blocks_do_not_change_losses(nodes, name):
    overlap, loss = LOSSES[name]
    small, whole = (loss(GroupPairs(nodes, overlap, block)).first()["loss"] for block in (11, 10_000))
    assert math.isfinite(whole) and whole > 0 and small == pytest.approx(whole, rel=1e-9)


@pytest.mark.parametrize("name", sorted(LOSSES))
def test_losses_without_pairs_are_zero(spark, nodes, name):
    overlap, loss = LOSSES[name]
    assert loss(GroupPairs(nodes.filter("sample in (3, 7)"), overlap)).first()["loss"] == 0
    assert loss(GroupPairs(nodes.limit(0), overlap)).first()["loss"] == 0


def test_ranking_loss_by_plain_pairs(nodes, data):
    per = {}
    for g, i, j, o, s in slow_pairs(data, lambda s, a, b, k: min(max(3 * s, 0), 1)):
        per.setdefault((g, i), []).append((s, o))
    sums = [brute_dominance([s for s, _ in rows], [o for _, o in rows], 0.05, 0.05) for rows in per.values()]
    assert L.overlap_ranking(GroupPairs(nodes, clipped, 16)).first()["loss"] == pytest.approx(10 * sum(x for x, _ in sums) / sum(n for _, n in sums), rel=1e-9)


def test_class_proxies_in_blocks(spark, data):
    rng = random.Random(2)
    rows = spark.createDataFrame([(k, k % 7, v) for k, (_, _, _, v) in enumerate(data)] + [(10_000, 99, data[0][3]), (10_001, 1, None)], "i long, label long, v array<double>")
    table = [(c, [rng.gauss(0, 1) for _ in range(6)]) for c in range(7) for _ in range(3)]
    proxies = spark.createDataFrame(table, "label long, v array<double>")
    want = []
    for k, (_, _, _, v) in enumerate(data):
        z = []
        for c in range(7):
            s = np.array([np.dot(v, u) / np.linalg.norm(u) for label, u in table if label == c])
            w = np.exp(s / 0.1)
            z.append(20 * ((w * s).sum() / w.sum() - 0.01 * (c == k % 7)))
        want.append(np.log(np.exp(z).sum()) - z[k % 7])
    for block in (5, 4096):
        assert L.class_proxies(rows, proxies, 20.0, 0.1, 0.01, block).first()["loss"] == pytest.approx(np.mean(want), rel=1e-9)


def test_losses_by_name(nodes):
    with pytest.raises(NotImplementedError):
        L.by_name("NoSuchLoss", GroupPairs(nodes, "label"))
    with pytest.raises(ValueError):
        L.by_name("SoftTripleLoss", None)
    assert L.by_name("my TripletLoss v2", GroupPairs(nodes, "label")).first()["loss"] > 0
