import zlib

import numpy as np

from vantage.llm import langid
from vantage.llm.langid import Chain, Reader, identify_language, keep_identified, sample_labelled, train_tagger, words_of


def slow_marginals(e, moves):
    a, e = np.exp(moves), np.exp(e)
    f, b = [e[0]], [np.ones(e.shape[1])]
    for x in e[1:]:
        f.append(f[-1] @ a * x)
    for x in e[:0:-1]:
        b.append(a @ (x * b[-1]))
    p = np.array(f) * np.array(b[::-1])
    pairs = sum(np.outer(f[t - 1], e[t] * b[::-1][t]) * a / (f[-1].sum()) for t in range(1, len(e))) if len(e) > 1 else np.zeros_like(a)
    return p / p.sum(1, keepdims=True), pairs


def test_chain_is_forward_backward():
    rng = np.random.default_rng(0)
    lengths = np.array([1, 5, 64, 65, 200, 129, 2])
    e, moves = rng.normal(size=(lengths.sum(), 3)), rng.normal(size=(3, 3))
    p, pairs = Chain(lengths).run(e, moves, pairs=True)
    at, total = 0, np.zeros((3, 3))
    for n in lengths:
        q, m = slow_marginals(e[at : at + n], moves)
        assert np.allclose(p[at : at + n], q)
        total += m
        at += n
    assert np.allclose(pairs, total)


def test_held_out_accuracy(documents):
    lang = {r.doc_id: r.lang for r in documents.collect()}
    rows = identify_language(documents, per_label=40).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_switch_within_a_text():
    english, german = "the quick fox and the lazy dog with other things", "der schnelle fuchs und die faule katze mit dem hund"
    tagger = train_tagger([(english, "en"), (german, "de")] * 20, rounds=25)
    words = words_of(english) + words_of(german)
    p = Chain(np.array([len(words)])).run(tagger.emissions(words), tagger.moves)
    en = tagger.labels.index("en")
    assert (p[: len(words_of(english)), en] > 0.5).all() and (p[len(words_of(english)) :, en] < 0.5).all()


def test_messy_and_empty(spark, messy, messy_rows, empty):
    rows = identify_language(messy).collect()
    assert len(rows) == len(messy_rows)
    by = {r.doc_id: r for r in rows}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (4, 5, 6, 7))
    assert by[1].lang_pred == "en"
    assert identify_language(empty).collect() == []
    unlabelled = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert identify_language(unlabelled).first().lang_pred == "und"
    kept = keep_identified(messy)
    assert kept.columns == messy.columns and {4, 5, 6, 7}.isdisjoint({r.doc_id for r in kept.collect()})


def test_letters_only_and_whole_words():
    assert words_of("m² ½ ① ² 12 _ Ⅷ -") == ["m"]
    run = "abcdefghij" * 7
    assert "".join(words_of(run)) == run and max(map(len, words_of(run))) <= 32
    assert words_of("Été 日本 ça") == ["été", "日本", "ça"]


def test_numbers_alone_have_no_language(spark):
    rows = [(i, "the quick fox and the lazy dog", "en") for i in range(20)] + [(i, "der schnelle fuchs und die katze", "de") for i in range(20, 40)]
    rows += [(100 + i, t, None) for i, t in enumerate(["²", "½ ① 12", "the ²", "²the"])]
    got = {r.doc_id: r.lang_pred for r in identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[100] == got[101] == "und" and got[102] == got[103] == "en"


def test_cache_is_bounded_and_changes_nothing(monkeypatch):
    tagger = train_tagger([("the quick fox and the dog", "en"), ("der fuchs und die katze mit", "de")] * 20, rounds=10)
    texts = ["the fox und die dog", None, "", "der der der", "unseen words entirely"] * 3
    want = Reader(tagger).predict(texts)
    monkeypatch.setattr(langid, "_CACHE_BYTES", 10)
    monkeypatch.setattr(langid, "_SLICE", 3)
    got = Reader(tagger).predict(texts)
    assert got[0] == want[0] and np.allclose(got[1], want[1], atol=1e-6)


def test_sample_is_bounded_however_many_labels(spark):
    rows = [(i, "some words here", f"l{i % 300}") for i in range(3000)] + [(5000, "x " * 40_000, "long")]
    got = sample_labelled(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 5, max_rows=700)
    assert len(got) == 700 and {lab for _, lab in got} == {f"l{i}" for i in range(300)}


def test_the_driver_holds_neither_the_sample_nor_the_fit(spark, monkeypatch):
    def here(samples):
        raise AssertionError("fitted on the driver")

    docs = spark.createDataFrame([(i, t, lab) for i in range(8) for t, lab in (("the cat and the dog", "en"), ("le chat et le chien", "fr"))], "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "train_tagger", here)  # workers import their own
    found = {r.lang_pred for r in langid.identify_language(docs).collect()}
    assert found == {"en", "fr"}


def test_no_text_with_letters_goes_for_want_of_learning(spark):
    """Where nothing is labelled, and where all that is labelled is long, held out, or hidden among texts without a letter."""
    schema = "doc_id long, text string, lang string"
    bare = spark.createDataFrame([(1, "the cat", None), (2, "12 ²", None), (3, None, None), (4, "le chat", None)], schema)
    assert {r.doc_id for r in keep_identified(bare).collect()} == {1, 4} and keep_identified(bare, min_score=0.1).count() == 0
    en, fr = "the cat and the dog with other things ", "le chat et le chien avec les autres choses "
    texts = [(i, t * 1500, lab) for i in range(8) for t, lab in ((en, "en"), (fr, "fr"))] + [(100, en, None), (101, fr, None)]
    docs = spark.createDataFrame(texts, schema)
    got = {r.doc_id: r.lang_pred for r in identify_language(docs).collect()}
    assert (got[100], got[101]) == ("en", "fr")
    assert keep_identified(docs, min_score=0.9).count() == len(texts)
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 == 2]
    few = spark.createDataFrame([(i, t, lab) for i in held for t, lab in ((en, "en"), (fr, "fr"))], schema)
    assert keep_identified(few, min_score=0.9).count() == 2 * len(held)
    empty = spark.createDataFrame([(i, "...", "en") for i in range(2000)] + [(5000, en, "en"), (5001, fr, "fr"), (5002, en, "en"), (5003, fr, "fr")], schema)
    assert set(langid._tagger(empty, 5, 4, None).labels) == {"en", "fr"}


def test_pieces_of_long_texts_are_bounded(spark):
    rows = [(i, "x " * 500, lab) for i, lab in enumerate(["long"] * 6 + ["both"])] + [(9, "x", "both"), (10, "y", "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.long_sample(docs, 7, max_chars=300).collect()
    assert len(found) == 7 and {r.lang for r in found} == {"long"} and all(0 < len(r.text) <= 300 for r in found)
    assert len(langid.long_sample(docs, 100, max_chars=300).collect()) == 6 * 4 and len(langid.long_sample(docs, 7, max_rows=3, max_chars=300).collect()) == 3
