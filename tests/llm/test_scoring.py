import math
import zlib
from collections import Counter

import numpy as np
import pytest

from vantage.llm import brown
from vantage.llm.brown import END, _association, class_counts, class_information, exchange_classes, score_texts, tokens_of, transition_table


def expected_base(rows):
    toks = [(d, tokens_of(t)) for d, t in rows]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter(w for d, t in toks if d is not None and not held(d) for w in t)
    n, v = sum(c.values()), len(c)
    return sorted((d is None, d or 0, held(d), len(t), sum(w in c for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 5)) for d, t in toks)


def test_tokens():
    assert tokens_of(None) == [END]
    assert tokens_of(" A b\tÉ\x1cX \n") == ["a b".encode(), "É\x1cx".encode(), END]


def test_base_and_gain(documents):
    got = score_texts(documents, classes=8, rounds=4).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5))
    assert sorted(map(key, got)) == expected_base([(r.doc_id, r.text) for r in documents.collect()])
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score <= 0 for r in got)


def test_messy_and_empty(messy, messy_rows, empty):
    got = score_texts(messy, classes=4, rounds=2, chunk_rows=2).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5))
    want = expected_base([(d, t) for d, t, _ in messy_rows])
    assert [x[:-1] for x in sorted(map(key, got))] == [x[:-1] for x in want]
    assert np.allclose([x[-1] for x in sorted(map(key, got))], [x[-1] for x in want])
    assert all(math.isfinite(r.score) for r in got)
    assert score_texts(empty).collect() == []


def test_nothing_to_learn_from(spark):
    only = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert all(r.score == r.base_score for r in score_texts(only, classes=3, rounds=1).collect())


def test_chances_sum_to_one(spark):
    """Every known word and the unknown one, after each word, by scoring two-word texts."""
    train = [(i, t) for i, t in enumerate(["a b a c", "b a c a b", "d a d b", "c c a"] * 5) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = [i for i in range(10_000) if zlib.crc32(str(i).encode()) % 7 == 2]
    words = ["a", "b", "c", "d", "zzz"]
    ask = [(held[i], w) for i, w in enumerate(words)] + [(held[len(words)], "")]
    got = {r.doc_id: r.score for r in score_texts(spark.createDataFrame(train + ask, "doc_id long, text string"), classes=3, rounds=2).collect()}
    # log p(w | start) + log p(end | w): sum p(w | start) over w cannot pass 1, nor p(end | w)
    assert sum(10 ** got[d] for d, _ in ask) <= 1 + 1e-9


def test_transitions_are_distributions():
    counts = np.array([[3.0, 0, 1], [0, 0, 0], [5, 5, 5]])
    assert np.allclose(transition_table(counts, 10).sum(1), 1)


def test_exchange_finds_the_blocks(spark):
    """Words 0-4 precede words 5-9 and the other way about; two classes tell them apart."""
    rows = [(a, b, 10) for a in range(5) for b in range(5, 10)] + [(b, a, 10) for a in range(5) for b in range(5, 10)] + [(10, a, 1) for a in range(10)]
    pairs = spark.createDataFrame(rows, "a long, b long, n long")
    best = None
    for sizes in ([50, 49, 48, 47, 46, 30, 31, 32, 33, 34, 5], [9, 1, 8, 2, 7, 3, 6, 4, 5, 0, 1]):
        got, matrix = exchange_classes(pairs, np.array(sizes), 3, 12, 10)
        began = np.empty(11, int)
        began[np.argsort(-np.array(sizes), kind="stable")] = np.arange(11) % 2
        began[10] = 2
        assert class_information(matrix) >= class_information(class_counts(pairs, began, 3)) - 1e-12
        assert np.array_equal(matrix, class_counts(pairs, got, 3))
        assert got[10] == 2 and 2 not in got[:10]
        best = best or (len(set(got[:5])) == 1 and len(set(got[5:10])) == 1 and got[0] != got[5])
    assert best


def test_association_is_finite():
    assert np.isfinite(_association(np.zeros((3, 3)))).all()


@pytest.mark.parametrize("text,n", [(None, 1), ("", 1), ("a", 2)])
def test_lengths(text, n):
    assert len(tokens_of(text)) == n


def test_scores_are_those_of_a_plain_model(spark, monkeypatch, documents):
    """All words in given classes; transitions, discounted emissions and new words by plain counting."""
    k, strength = 5, 50.0
    rows = [(r.doc_id, " ".join((r.text or "").split()[:60])) for r in documents.limit(60).collect()]
    of = lambda w: k - 1 if w == END else zlib.crc32(w) % (k - 1)

    def given(pairs, sizes, classes, rounds, fixed):
        words = sorted({END, *(w for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2 for w in tokens_of(t))})
        found = np.array([of(w) for w in words])
        return found, class_counts(pairs, found, k)

    monkeypatch.setattr(brown, "exchange_classes", given)
    got = {r.doc_id: r.score for r in score_texts(spark.createDataFrame(rows, "doc_id long, text string"), classes=k, share=0.0, strength=strength).collect()}
    learned = [tokens_of(t) for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2]
    n = Counter(w for t in learned for w in t)
    once, twice = sum(c == 1 for c in n.values()), sum(c == 2 for c in n.values())
    discount = min(max(once / (once + 2 * twice), 0.05), 0.95)
    tokens, words = Counter(), Counter()
    for w, c in n.items():
        tokens[of(w)] += c
        words[of(w)] += 1
    moves = Counter((of(a), of(b)) for t in learned for a, b in zip([END, *t], t))
    total, into, out = sum(moves.values()), Counter(), Counter()
    for (a, b), c in moves.items():
        into[b] += c
        out[a] += c
    move = lambda a, b: (moves[a, b] + strength * (into[b] + 1) / (total + k)) / (out[a] + strength)
    new = lambda c: 0.0 if c == k - 1 else discount * words[c] / tokens[c] if tokens[c] else 1.0
    for d, t in rows:
        at, score = k - 1, 0.0
        for w in tokens_of(t):
            if n[w]:
                c = of(w)
                score += math.log10(move(at, c) * (n[w] - (0 if c == k - 1 else discount)) / tokens[c])
                at = c
            else:
                chances = [move(at, c) * new(c) for c in range(k)]
                score += math.log10(sum(chances))
                at = int(np.argmax(chances))
        assert abs(score - got[d]) < 1e-6 * max(1, abs(score))


def test_long_texts_are_chunks_of_their_own(spark, documents):
    docs = documents.limit(40)
    key = lambda rows: sorted((r.doc_id, r.n_tokens, r.n_known, round(r.score, 6)) for r in rows)
    assert key(score_texts(docs, classes=4, rounds=1).collect()) == key(score_texts(docs, classes=4, rounds=1, chunk_rows=3, long_bytes=500).collect())


def test_texts_are_parted_in_columns_as_they_are_one_by_one():
    import random

    import pyarrow as pa

    draw = random.Random(1)
    texts = ["".join(draw.choice("aBZ \t\n\x0b\x0c\r\x1c\x1f\x85\xa0éÄİ　\x00") for _ in range(draw.randrange(12))) for _ in range(3000)] + [None, "", "  "]
    flat, lengths = brown._tokens(pa.array(texts))
    flat, ends = [w.encode() for w in flat.to_pylist()], lengths.cumsum().tolist()
    assert [flat[a:b] for a, b in zip([0, *ends], ends)] == [brown.tokens_of(t) for t in texts]
