import hashlib
import re

import numpy as np

from vantage.llm.pii import KINDS, base_spans, candidates, estimate_reliabilities, find_pii, luhn, redact, train_classifier

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    """The base by regular expressions alone."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 16 <= len(d) <= 19 and luhn(d) or kind == "phone" and 8 <= len(d) <= 15:
                out.append((kind, *m.span()))
    return out


ODD = [
    "a@b a@b.c@d.e x@@y.z a@b@c.com .@-.- é@ü.com bob@x.y.z. %@a.b",
    "1.2.3.4.5.6.7.8 01.2.3.4 256.1.1.1 1.2.3 999.1.2.3.4 1.1.1.1.",
    "4111 1111 1111 1111, 4111-1111-1111-1111x 4111  1111 1111 1111 41111111111111112222 5",
    "+1 (555) 123-4567 +12 +1234567 +123456789012345 +1234567890123456 +1((((2 + 1 2 +1 (269) 555-3296 4132524132264652876 ",
    "😀 a@b.co 😀 10.0.0.1 +49 30 1234567",
    "",
    "9" * 3000 + "." * 50 + "a" * 3000 + "@" * 30,
]


def test_base_spans_are_those_of_the_patterns():
    rng = np.random.default_rng(5)
    letters = list("ab.@-+ 0123456789()") + ["é", "😀"]
    for text in ODD + ["".join(rng.choice(letters, 60)) for _ in range(3000)]:
        assert base_spans(text) == plain(text), text


def test_query_over_documents(documents):
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    for r in find_pii(documents).collect():
        base = plain(texts[r.doc_id])
        assert [r[f"n_{k}"] for k in KINDS] == [sum(k == x[0] for x in base) for k in KINDS]
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= set(r.spans.split(","))
        assert len([x for x in r.spans.split(",") if x]) == len(base) + r.n_added


def test_messy_and_empty(messy, messy_rows, empty):
    rows = find_pii(messy).collect()
    assert len(rows) == len(messy_rows)
    one = next(r for r in rows if r.doc_id == 10)
    assert (one.n_email, one.n_phone) == (1, 1)
    assert find_pii(empty).collect() == []


def test_em_weighs_labelers():
    """Three labelers right nine times in ten and one that guesses."""
    rng = np.random.default_rng(2)
    truth = rng.random(4000) < 0.4
    votes = np.stack([np.where(rng.random(4000) < 0.9, truth, ~truth) for _ in range(3)] + [rng.random(4000) < 0.5], 1).astype(int)
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    fit = estimate_reliabilities(patterns, counts.astype(float))
    right = ((fit["posterior"][at.ravel()] > 0.5) == truth).mean()
    assert right > 0.95 and abs(fit["prior"] - 0.4) < 0.05
    assert abs(fit["true"][3] - fit["false"][3]) < 0.1 < fit["true"][0] - fit["false"][0]


def test_classifier_follows_soft_labels():
    p = train_classifier([(0, 1), (0, 2)], np.array([90.0, 5.0]), np.array([100.0, 100.0]))
    assert p[0] > 0.8 and p[1] < 0.2
    assert len(train_classifier([], np.zeros(0), np.zeros(0))) == 0


def test_adjacent_numbers_are_added_and_words_left_alone(spark):
    rows = [(i, f"call me on +1 (269) 555-{3000 + i} today, card 4111111111111111 end") for i in range(60)]
    rows += [(100, "joined +1 (269) 555-3296 4111111111111111 here"), (101, "nothing to see in chapter 12 of 2024")]
    got = {r.doc_id: r for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "phone:7:24" in got[100].spans and "card:25:41" in got[100].spans
    assert got[101].spans == ""


def test_redact(messy, documents):
    out = {r.doc_id: r for r in redact(messy, length_col="n_chars").collect()}
    assert out[10].text == "Écrivez à <EMAIL> ou appelez le <PHONE> 😀 vite" and out[10].n_chars == len(out[10].text)
    assert out[4].text is None
    assert redact(messy).columns == messy.columns
    assert sum(len(base_spans(r.text or "")) for r in redact(documents).collect()) == 0


def test_candidates_do_not_overlap_in_a_kind():
    for text in ODD:
        for kind in KINDS:
            spans = sorted((s, e) for k, s, e, *_ in candidates(text)[1] if k == kind)
            assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_secrets(spark):
    rows = [(i, f'the run token = "{hashlib.sha1(str(i).encode()).hexdigest()}" is here') for i in range(40)]
    rows += [(100, "see http://www.example.com/some/long/path and note: incomprehensibilities ahead"), (101, "ratio=0.1234567890123456789")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in find_pii(docs).collect()}
    assert got[0].secrets == "secret:17:57" and got[0].spans == "" and got[0].n_secret == got[0].n_spans == 1
    assert got[100].n_spans == got[101].n_spans == 0
    assert {r.text for r in redact(docs).collect() if r.doc_id < 40} == {'the run token = "<SECRET>" is here'}


def test_redact_keeps_rows_and_columns(spark, messy, messy_rows, empty):
    docs = spark.createDataFrame([(1, "x@y.zz", 1, "r"), (1, "x@y.zz", 1, "r"), (2, None, None, None)], "doc_id long, text string, spans int, row string")
    out = redact(docs, length_col="n_chars")
    assert out.columns == docs.columns and sorted((r.doc_id, r.text, r.spans, r.row) for r in out.collect() if r.doc_id == 1) == [(1, "<EMAIL>", 1, "r")] * 2
    assert redact(messy).count() == len(messy_rows) and redact(empty).collect() == []


def test_classifier_in_blocks_is_the_same():
    rng = np.random.default_rng(3)
    patterns = sorted({tuple(int(x) for x in rng.integers(0, 4, 5)) for _ in range(300)})
    counts = rng.integers(1, 50, len(patterns)).astype(float)
    positive = counts * rng.random(len(patterns))
    assert np.allclose(train_classifier(patterns, positive, counts), train_classifier(patterns, positive, counts, block=7))
