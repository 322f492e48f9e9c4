import hashlib
import random
import sys

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vantage.llm import bpe
from vantage.llm.bpe import Encoder, decode_ids, default_tokenizer, encode_texts, vocabulary
from vantage.llm.queries import op13_bpe


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


@pytest.fixture(scope="module")
def encoder():
    return Encoder(default_tokenizer())


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(library, texts):
    out = []
    for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False):
        out.append((len(e.ids), digest(",".join(map(str, e.ids))), digest(library.decode(e.ids, skip_special_tokens=False))))
    return out


def test_query_matches_the_library(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    want = [(d["doc_id"], *e) for d, e in zip(docs, expected(library, [d["text"] for d in docs]))]
    found = op13_bpe(spark, small)
    assert found.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_messy_rows(messy, messy_rows, library):
    rows = decode_ids(encode_texts(messy)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = [(i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t, _ in messy_rows]
    assert sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in rows), key=key) == sorted(want, key=key)


def test_empty_table(empty):
    assert decode_ids(encode_texts(empty)).collect() == []


def test_batches_are_cut(spark, messy, monkeypatch):
    whole = sorted(encode_texts(messy).select(F.hash("doc_id", "ids")).collect())
    assert len(whole) == messy.count()
    run = bpe._encoded(default_tokenizer())
    monkeypatch.setattr(bpe, "_PART", 50)
    import pyarrow as pa

    texts = [f"word number {i} " * (i % 9) for i in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array([t.encode() for t in texts])], names=["id", "text"])
    parts = list(run(iter([batch])))
    assert len(parts) > 5
    own = Encoder(default_tokenizer())
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(60))
    assert [i for p in parts for i in p.column(1).to_pylist()] == [own.encode(t) for t in texts]
    decoded = [x for p in parts for q in bpe._decoded(default_tokenizer())(iter([p])) for x in q.column(2).to_pylist()]
    assert decoded == texts


PIECES = ["ab", "a", "aaaa ", "  ", "\n\n", "'s", "'ll", "é", "ß", "日本語", "👍🏽", "0123", " The", "ing", "<|endoftext|>", "<|endoftext", "\x00", "\x1c\x85", "　", "‍", "़", "-----", "\t", "\r\n", "\U0001e6c0", "՘", " token", "isation", "'re"]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(PIECES), max_size=30).map("".join), st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60), st.text(alphabet="abet in'ro \n", max_size=80)))
def test_any_text_as_the_library(text):
    from tokenizers import Tokenizer

    library = test_any_text_as_the_library.__dict__.setdefault("library", None) or Tokenizer.from_file(default_tokenizer())
    test_any_text_as_the_library.__dict__["library"] = library
    ids = Encoder(default_tokenizer()).encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert vocabulary(default_tokenizer()).decode(np.array(ids, np.int32)) == text


@pytest.mark.parametrize("text", ["x" * 100_000, " " * 100_000, "ab" * 50_000, "é" * 30_000, "=" * 50_001, "".join(random.Random(2).choices("abcdefghijklmnopqrstuvwxyz", k=100_000))])
def test_very_long_words(encoder, library, text):
    assert encoder.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_words_of_every_character(encoder, library):
    """Where words begin and end, for each code point beside a letter, a digit, a mark and a blank."""
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    for at in range(0, len(points), 32768):
        some = [f"a{c}1{c}. {c}  {c}\n" for c in map(chr, points[at : at + 32768])]
        text = "".join(some)
        cut = library.pre_tokenizer.pre_tokenize_str(text)
        assert encoder.split(text) == [text[a:b] for _, (a, b) in cut]


def test_decoding_any_ids(library):
    own, rng = vocabulary(default_tokenizer()), random.Random(3)
    for _ in range(500):
        ids = [rng.randrange(50_257) for _ in range(rng.randrange(30))]
        assert own.decode(np.array(ids, np.int32)) == library.decode(ids, skip_special_tokens=False)
    assert own.decode(np.array([-1, 10**6], np.int64)) == ""


def test_null_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [464, None, 99_999_999, 3290])], "doc_id long, ids array<int>")
    assert [r["decoded"] for r in decode_ids(rows).orderBy("doc_id").collect()] == [None, "", "The dog"]


def test_pairs_agree_with_plain_merging(encoder):
    """The pair table against merging both tokens' bytes from scratch, lowest rank first."""
    own, rng = vocabulary(default_tokenizer()), random.Random(7)

    def merged(b):
        parts = [own.ids[bytes([x])] for x in b]
        while True:
            ranked = [(own.merges[p][0], i) for i, p in enumerate(zip(parts, parts[1:])) if p in own.merges]
            if not ranked:
                return parts
            at = min(ranked)[1]
            parts[at : at + 2] = [own.merges[parts[at], parts[at + 1]][1]]

    tokens = sorted(own.valid)
    for _ in range(3000):
        a, b = rng.choice(tokens[: rng.choice((300, 2000, 50_000))]), rng.choice(tokens[: rng.choice((300, 2000, 50_000))])
        assert own.compatible(a, b) == (merged(own.bytes[a] + own.bytes[b]) == [a, b])


def test_other_kinds_of_vocabularies_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
