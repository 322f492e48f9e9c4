"""Language identification of code-switched text by a linear-chain conditional random field."""

from __future__ import annotations

import pickle
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W\d_]+")
_SEGMENT, _SLICE, _CACHE_BYTES = 64, 150_000, 48 << 20
_LONGEST = 32
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased; a run of more than ``_LONGEST`` letters is read as several words, so all of it counts."""
    found = _WORD.findall(text.lower())
    if not text.isascii():  # numbers such as a superscript two are no letters
        found = [p for w in found for p in ((w,) if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]
    if any(len(w) > _LONGEST for w in found):
        found = [w[i : i + _LONGEST] for w in found for i in range(0, len(w), _LONGEST)]
    return found


def word_features(word: str, lexicon: dict[str, int]) -> list[str]:
    """Affixes to three letters, letter bigrams and trigrams, and the language lists that hold the word."""
    w = word
    out = [f"^{w[:1]}", f"^{w[:2]}", f"^{w[:3]}", f"{w[-1:]}$", f"{w[-2:]}$", f"{w[-3:]}$"]
    out += [w[i : i + 2] for i in range(len(w) - 1)]
    out += [w[i : i + 3] for i in range(len(w) - 2)]
    if (mask := lexicon.get(word)) is not None:
        out.append(f"={mask}")
    return out


class Chain:
    """Forward-backward over many texts at once.

    Texts are cut into segments whose transfer matrices are multiplied out side by side; vectors are
    then carried over the segments of each text, and last through the words of all segments. The
    result is that of a pass over each whole text.
    """

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        per = -(-lengths // _SEGMENT)
        self.segments = int(per.sum())
        self.first = np.concatenate(([0], np.cumsum(per)[:-1])).astype(np.int64)
        self.per = per
        seg_of_word = np.repeat(self.first, lengths) + (np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)) // _SEGMENT
        pos = (np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)) % _SEGMENT
        self.slot = seg_of_word * _SEGMENT + pos
        self.starts = np.zeros(self.segments, bool)
        self.starts[self.first] = True
        self.valid = np.zeros(self.segments * _SEGMENT, bool)
        self.valid[self.slot] = True
        self.valid = self.valid.reshape(-1, _SEGMENT)

    def run(self, emissions: np.ndarray, moves: np.ndarray, pairs: bool = False):
        """Marginals of each word, from log emissions and log transitions; with ``pairs`` the expected moves too."""
        k, n = moves.shape[0], self.segments
        a = np.exp(moves)
        e = np.ones((n * _SEGMENT, k))
        e[self.slot] = np.exp(emissions - emissions.max(1, keepdims=True))
        e = e.reshape(n, _SEGMENT, k)
        whole = np.tile(np.eye(k), (n, 1, 1))
        for s in range(_SEGMENT):
            on = self.valid[:, s]
            moved = (whole.reshape(-1, k) @ a).reshape(n, k, k)
            if s == 0:
                moved[self.starts] = np.eye(k)
            moved *= e[:, s, None, :]
            moved /= moved.sum((1, 2), keepdims=True)
            whole = moved if on.all() else np.where(on[:, None, None], moved, whole)
        into, back = np.full((n, k), 1 / k), np.full((n, k), 1 / k)
        order = np.argsort(-self.per, kind="stable")
        longest, first = self.per[order], self.first[order]
        for step in range(1, int(longest[0]) if len(longest) else 0):
            live = first[: np.searchsorted(-longest, -step, side="left")]
            v = np.einsum("ni,nij->nj", into[live + step - 1], whole[live + step - 1])
            into[live + step] = v / v.sum(1, keepdims=True)
        for step in range(int(longest[0]) - 1 if len(longest) else 0, 0, -1):
            live = first[: np.searchsorted(-longest, -step, side="left")]
            v = np.einsum("nij,nj->ni", whole[live + step], back[live + step])
            back[live + step - 1] = v / v.sum(1, keepdims=True)
        alpha, before = np.empty((n, _SEGMENT, k)), np.empty((n, _SEGMENT, k)) if pairs else None
        v = into
        for s in range(_SEGMENT):
            if pairs:
                before[:, s] = v
            w = v @ a
            if s == 0:
                w = np.where(self.starts[:, None], v, w)
            w = w * e[:, s]
            w /= w.sum(1, keepdims=True)
            v = alpha[:, s] = np.where(self.valid[:, s, None], w, v)
        beta = np.empty((n, _SEGMENT, k))
        v = back
        for s in range(_SEGMENT - 1, -1, -1):
            beta[:, s] = v
            w = (v * e[:, s]) @ a.T
            if s == 0:
                w = np.where(self.starts[:, None], v * e[:, s], w)
            w /= w.sum(1, keepdims=True)
            v = np.where(self.valid[:, s, None], w, v)
        p = (alpha * beta).reshape(-1, k)[self.slot]
        p /= p.sum(1, keepdims=True)
        if not pairs:
            return p
        inner = self.valid.copy()
        inner[self.starts, 0] = False
        u, w = before[inner], (e * beta)[inner]
        norm = ((u @ a) * w).sum(1, keepdims=True)
        return p, (u / norm).T @ w * a


class Tagger:
    """A trained model: feature weights by label, transitions, word lists. It holds nothing of the texts it judges."""

    def __init__(self, labels: list[str], index: dict[str, int], weights: np.ndarray, moves: np.ndarray, lexicon: dict[str, int]):
        self.labels, self.index, self.weights, self.moves, self.lexicon = labels, index, weights, moves, lexicon

    def emissions(self, words: list[str]) -> np.ndarray:
        """Log emissions, a row for each word."""
        flat, ends, get = [], [0], self.index.get
        for w in words:
            flat += [i for f in word_features(w, self.lexicon) if (i := get(f)) is not None]
            ends.append(len(flat))
        sums = np.concatenate((np.zeros((1, len(self.labels))), np.cumsum(self.weights[flat], axis=0)))
        return (sums[ends[1:]] - sums[ends[:-1]]).astype(np.float32)

    def predict(self, texts: Iterable[str | None]) -> tuple[list[str], list[float]]:
        return Reader(self).predict(texts)


class Reader:
    """Judges texts by a ``Tagger`` and keeps the emissions of words seen, up to ``_CACHE_BYTES``, for one task."""

    def __init__(self, tagger: Tagger):
        self.tagger = tagger
        self.forget()

    def forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.rows, self.used, self.held = np.zeros((1024, len(self.tagger.labels)), np.float32), 0, 0

    def emissions(self, words: list[str]) -> np.ndarray:
        if self.held > _CACHE_BYTES:
            self.forget()
        seen = self.seen
        new = [w for w in dict.fromkeys(words) if w not in seen]
        for at in range(0, len(new), 20_000):
            fresh = self.tagger.emissions(new[at : at + 20_000])
            while self.used + len(fresh) > len(self.rows):
                self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
            self.rows[self.used : self.used + len(fresh)] = fresh
            seen.update(zip(new[at : at + 20_000], range(self.used, self.used + len(fresh))))
            self.used += len(fresh)
        self.held += sum(map(len, new)) + (140 + 8 * len(self.tagger.labels)) * len(new)
        return self.rows[np.fromiter(map(seen.__getitem__, words), np.int64, len(words))].astype(np.float64)

    def predict(self, texts: Iterable[str | None]) -> tuple[list[str], list[float]]:
        """The label with the largest share of word marginals, and that share; ``und`` without a letter."""
        labels, moves = self.tagger.labels, self.tagger.moves
        out_l, out_s = [], []
        rows: list[int] = []
        words: list[str] = []
        lengths: list[int] = []

        def flush():
            n = np.array(lengths, np.int64)
            p = Chain(n).run(self.emissions(words), moves)
            share = np.add.reduceat(p, np.cumsum(n) - n, axis=0) / n[:, None]
            for row, best, x in zip(rows, share.argmax(1).tolist(), share):
                out_l[row], out_s[row] = labels[best], float(min(1.0, x[best]))
            rows.clear(), words.clear(), lengths.clear()

        for row, text in enumerate(texts):
            out_l.append(UNKNOWN)
            out_s.append(0.0)
            found = words_of(text) if text and labels else []
            if found:
                if words and len(words) + len(found) > _SLICE:
                    flush()
                rows.append(row)
                words.extend(found)
                lengths.append(len(found))
        if rows:
            flush()
        return out_l, out_s


def train_tagger(samples: list[tuple[str, str]], rounds: int = 35, l2: float = 1.0, splice: float = 0.5, seed: int = 3, list_words: int = 300) -> Tagger:
    """Fit weights and transitions by greatest likelihood (Adam on the whole sample).

    Every word takes its text's label; a share ``splice`` of the texts is followed by another
    one's words, so that switches occur. The word lists hold each label's commonest words.
    """
    samples = sorted((lab, t) for t, lab in samples if t and lab is not None)
    labels = sorted({lab for lab, _ in samples})
    texts = [(labels.index(lab), w) for lab, t in samples if (w := words_of(t))]
    if not texts:
        return Tagger([], {}, np.zeros((0, 0)), np.zeros((0, 0)), {})
    counts = [Counter() for _ in labels]
    for y, w in texts:
        counts[y].update(w)
    lexicon: dict[str, int] = {}
    for y, c in enumerate(counts):
        for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:list_words]:
            lexicon[w] = lexicon.get(w, 0) | 1 << y
    rng = random.Random(seed)
    sequences = []
    shuffled = texts[:]
    rng.shuffle(shuffled)
    while shuffled:
        parts = [shuffled.pop()]
        while shuffled and rng.random() < splice:
            parts.append(shuffled.pop())
        sequences.append(parts)
    vocabulary: dict[str, int] = {}
    ids, gold, lengths = [], [], []
    for parts in sequences:
        lengths.append(sum(len(w) for _, w in parts))
        for y, w in parts:
            ids += [vocabulary.setdefault(x, len(vocabulary)) for x in w]
            gold += [y] * len(w)
    ids, gold, lengths = np.array(ids), np.array(gold), np.array(lengths)
    seen = Counter(f for w in vocabulary for f in set(word_features(w, lexicon)))
    index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= 3 or f[0] == "="))}
    at, feat = [], []
    for w, i in vocabulary.items():
        found = [index[f] for f in word_features(w, lexicon) if f in index]
        at += [i] * len(found)
        feat += found
    at, feat = np.array(at), np.array(feat)
    order = np.argsort(feat, kind="stable")
    by_feat, bounds = at[order], np.searchsorted(feat[order], np.arange(len(index)))
    word_first = np.searchsorted(at, np.arange(len(vocabulary)))
    k = len(labels)
    flat_gold = np.zeros((len(gold), k))
    flat_gold[np.arange(len(gold)), gold] = 1
    inner = np.ones(len(gold), bool)
    inner[np.cumsum(lengths) - lengths] = False
    moved = np.zeros((k, k))
    np.add.at(moved, (gold[np.flatnonzero(inner) - 1], gold[inner]), 1)
    cuts = [0]
    for i, n in enumerate(np.cumsum(lengths)):
        if n - (np.cumsum(lengths)[cuts[-1] - 1] if cuts[-1] else 0) > _SLICE:
            cuts.append(i + 1)
    if cuts[-1] != len(lengths):
        cuts.append(len(lengths))
    spans = [(int(lengths[:a].sum()), int(lengths[:b].sum()), Chain(lengths[a:b])) for a, b in zip(cuts, cuts[1:])]
    n_feat = len(index)
    params = np.zeros(n_feat * k + k * k)
    m1, m2 = np.zeros_like(params), np.zeros_like(params)
    empty = np.diff(np.append(word_first, len(at))) == 0
    for t in range(1, rounds + 1):
        weights, moves = params[: n_feat * k].reshape(n_feat, k), params[n_feat * k :].reshape(k, k)
        emit = np.add.reduceat(weights[feat], np.minimum(word_first, len(at) - 1), axis=0) if len(at) else np.zeros((len(vocabulary), k))
        emit[empty] = 0
        push, expected = np.zeros((len(vocabulary), k)), np.zeros((k, k))
        for lo, hi, chain in spans:
            p, pairs = chain.run(emit[ids[lo:hi]], moves, pairs=True)
            expected += pairs
            d = flat_gold[lo:hi] - p
            for y in range(k):
                push[:, y] += np.bincount(ids[lo:hi], d[:, y], len(vocabulary))
        grad = np.concatenate(((np.add.reduceat(push[by_feat], bounds, axis=0) if n_feat else np.zeros((0, k))).ravel(), (moved - expected).ravel())) - l2 * params
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        params = params + 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
    return Tagger(labels, index, params[: n_feat * k].reshape(n_feat, k), params[n_feat * k :].reshape(k, k), lexicon)


def remainder(id_col: str, modulus: int) -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def labelled_sample(docs: DataFrame, per_label: int, max_rows: int = 20_000, max_chars: int = 50_000) -> DataFrame:
    """``(text, lang)``: whole texts to learn from, by least hash of id and label: at most ``per_label`` of each label, at most
    ``max_rows`` in all however many labels there are, none of more than ``max_chars`` code points."""
    short = docs.filter(F.length("text") <= max_chars)
    keys = short.select(F.col("doc_id"), "lang", F.xxhash64("doc_id", "lang").alias("h"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    ranked = keys.withColumn("r", rank).filter(F.col("r") <= per_label)
    chosen = ranked.orderBy("r", "h", "lang").limit(max_rows).select("doc_id", "lang").distinct()
    again = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "lang"), "doc_id", F.xxhash64("text")))
    rows = short.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").select("lang", "text", again.alias("r"))  # max_rows at most
    return rows.filter(F.col("r") <= per_label).orderBy("r", "lang").limit(max_rows).select("text", "lang")


def long_sample(docs: DataFrame, per_label: int, max_rows: int = 20_000, max_chars: int = 50_000) -> DataFrame:
    """``(text, lang)`` of labels whose texts are all longer than ``max_chars``, of which ``labelled_sample`` has none: pieces of their texts of
    ``max_chars`` code points, within the same bounds, by least hash of id, label and piece."""
    only = docs.groupBy("lang").agg(F.min(F.length("text")).alias("least")).filter(F.col("least") > max_chars)
    only = only.orderBy(F.xxhash64("lang"), "lang").limit(max_rows).select("lang")  # no more than max_rows labels have a piece
    own = docs.join(F.broadcast(only), "lang", "left_semi")
    keys = own.select("doc_id", "lang", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / max_chars).cast("int"))).alias("p"))
    order = [F.xxhash64("doc_id", "lang", "p"), F.col("doc_id"), F.col("p")]
    ranked = keys.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("r") <= per_label)
    chosen = ranked.orderBy("r", *order, "lang").limit(max_rows).select("doc_id", "lang", "p").distinct()
    again = F.row_number().over(Window.partitionBy("lang").orderBy(*order, F.xxhash64("text")))
    pieces = own.join(F.broadcast(chosen), ["doc_id", "lang"]).withColumn("text", F.col("text").substr(F.col("p") * max_chars + 1, F.lit(max_chars)))
    return pieces.select("lang", "text", again.alias("r")).filter(F.col("r") <= per_label).orderBy("r", "lang").limit(max_rows).select("text", "lang")


def sample_labelled(docs: DataFrame, per_label: int, max_rows: int = 20_000, max_chars: int = 50_000) -> list[tuple[str, str]]:
    """The rows of ``labelled_sample``."""
    return [(r["text"], r["lang"]) for r in labelled_sample(docs, per_label, max_rows, max_chars).collect()]


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    samples = [(text, lab) for batch in batches for text, lab in zip(*(c.to_pylist() for c in batch.columns))]
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train_tagger(samples))], pa.binary())], names=["tagger"])


def _predict(tagger: Tagger):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(tagger)
        for batch in batches:
            labels, scores = reader.predict(x.as_py() for x in batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"]
            )

    return run


def _tagger(rows: DataFrame, per_label: int, modulus: int, held: int | None) -> Tagger:
    """Learn from labelled rows (doc_id, text, lang) with a letter that are not held out, if any are. A task fits the bounded sample; the driver gets the model alone."""
    learn = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    if held is not None:
        learn = learn.filter(F.coalesce(remainder("doc_id", modulus) != held, F.lit(False)))
    found = labelled_sample(learn, per_label).unionByName(long_sample(learn, per_label)).repartition(1).mapInArrow(_fit, "tagger binary").first()
    return pickle.loads(found["tagger"]) if found else train_tagger([])


def keep_identified(docs: DataFrame, min_score: float = 0.0, per_label: int = 200, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text has a language with a score of at least ``min_score``.

    Learning is that of ``identify_language``, but from all labelled rows, as nothing is held out here; ``docs`` must
    have the three named columns. Null texts and texts without a letter go; by default nothing else does, a text of several languages
    included. If there is nothing to learn from, texts with a letter are in a language without a name, at score 0. Repeated rows stay or go
    together. An empty table gives an empty table; other columns may have any names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("lang"))
    shared = docs.sparkSession.sparkContext.broadcast(_tagger(rows, per_label, 4, None))  # features of a sample of bounded size
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            texts = [x.as_py() for x in batch.column(at)]
            labels, scores = reader.predict(texts)
            if not shared.value.labels:
                labels = ["" if text and words_of(text) else UNKNOWN for text in texts]
            yield batch.filter(pa.array([lab != UNKNOWN and x >= min_score for lab, x in zip(labels, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify_language(docs: DataFrame, per_label: int = 200, modulus: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every text.

    The field learns from at most ``per_label`` texts of each non-null label, among rows whose
    crc32(id) modulo ``modulus`` is not ``held`` and whose text has a letter (see ``labelled_sample``; ``long_sample`` for labels that have
    long texts only); this bounds what one task fits on. Prediction reads the text alone, and all of it: texts are judged in groups of about 150,000 words, a longer
    one by itself in segments, with memory in proportion to its words. Words are tagged by marginals of the whole text; the prediction is the label with the largest
    mean marginal, the score. ``und`` with score 0 where the text is null or has no letter, or nothing
    could be learned. Rows with a null id are predicted but not learned from (held_out false). Rows with equal ids
    are predicted each on its own. An empty table gives an empty table; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("lang"))
    held_out = F.coalesce(remainder("doc_id", modulus) == held, F.lit(False))
    tagger = _tagger(rows, per_label, modulus, held)
    shared = docs.sparkSession.sparkContext.broadcast(tagger)  # features of a sample of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _predict(shared.value)(batches)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
