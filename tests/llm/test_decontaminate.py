import math
from collections import Counter, defaultdict

from vantage.llm.decontaminate import drop_contaminated, find_contamination


def brute(docs, items, width=5, threshold=0.8):
    sh = lambda w: [tuple(w[i : i + width]) for i in range(len(w) - width + 1)]
    bench = {i: t.lower().split() for i, t in items if t and len(t.split()) >= width}
    seen = Counter(s for w in bench.values() for s in set(sh(w)))
    weight = lambda s: 1 + math.log(len(bench) / seen.get(s, 1))
    index = defaultdict(set)
    for i, w in bench.items():
        for s in sh(w):
            index[s].add(i)
    out = {}
    for d, t in docs:
        w = (t or "").lower().split()
        for i in {i for s in sh(w) for i in index.get(s, ())}:
            n, own = len(bench[i]), Counter(sh(bench[i]))
            for at in range(max(1, len(w) - n + 1)):
                c = Counter(sh(w[at : at + n]))
                j = sum(weight(s) * min(k, own[s]) for s, k in c.items()) / sum(weight(s) * max(c[s], own[s]) for s in {*c, *own})
                if j >= threshold and j > out.get((d, i), 0):
                    out[d, i] = j
    return out


def test_documents(spark, small, documents):
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in bench.collect()])
    got = {(r.doc_id, r.item_id): r.similarity for r in find_contamination(documents, bench).collect()}
    assert want and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 2e-3 for k in want)
    assert drop_contaminated(documents, bench).count() == documents.count() - len({d for d, _ in want})


ITEM = " ".join(f"w{i}" for i in range(60))


def test_edits_ends_and_shuffle_join(spark):
    words = ITEM.split()
    texts = {
        1: "x y " + ITEM + " z",
        2: ITEM.upper(),
        3: " ".join(words[:30] + ["new"] + words[31:]) + " tail end",
        4: " ".join(words[:30]),
        5: "a b c d e f g",
        6: " ".join(words[:20] + ["added"] + words[20:] + ["q"] * 5),
        7: " ".join(["p"] * 10 + words[3:]),
    }
    items = [(1, ITEM), (2, None), (3, "w1 w2"), (4, "only four words here now indeed")]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(texts.items(), items)
    for limit in (10**6, 0):
        got = {(r.doc_id, r.item_id): r.similarity for r in find_contamination(docs, bench, broadcast_bytes=limit).collect()}
        assert got.keys() == want.keys() and {d for d, _ in got} == {1, 2, 3, 6, 7}


def test_messy_and_empty(spark, messy, empty):
    bench = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog near the river bank today.", "x"), (None, "null id item of six words", "x")], "item_id long, text string, words string")
    got = find_contamination(messy, bench).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3]
    assert find_contamination(empty, bench).collect() == []
    assert find_contamination(messy, bench.limit(0)).collect() == []
    kept = drop_contaminated(messy, bench)
    assert kept.columns == messy.columns and kept.count() == messy.count() - 4


def test_items_that_share_a_template(spark):
    """Light shingles that all items have and a few heavy ones: what differs weighs far more than what is shared."""
    template = " ".join(f"t{i}" for i in range(195))
    items = [(i, f"{template} " + " ".join(f"own{i}x{j}" for j in range(4))) for i in range(40)]
    docs = [(d, f"{template} " + " ".join(f"new{d}x{j}" for j in range(4 + d % 2))) for d in range(12)]
    want = brute(docs, items)
    got = {(r.doc_id, r.item_id): r.similarity for r in find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) == 480 and min(want.values()) < 0.85
    assert {d for d, _ in got} == {d for d, _ in want} and len(got) >= 0.98 * len(want)  # a radius of 20 bits is no certainty
    assert all(abs(want[k] - x) < 2e-3 for k, x in got.items())


def test_best_start_lies_between_two_runs(spark):
    words = [f"w{i}" for i in range(60)]
    docs = [(1, " ".join(["a"] * 9 + words[:6] + ["in", "sert"] + words[6:] + ["b"] * 9)), (2, " ".join(words[:30] + ["in", "sert", "ed"] + words[30:]))]
    items = [(1, " ".join(words)), (2, " ".join(words[:40]))]
    want = brute(docs, items)
    got = {(r.doc_id, r.item_id): r.similarity for r in find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-3 for k in want)
