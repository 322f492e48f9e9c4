"""Brown class-based bigram language model with distributed exchange clustering."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: The end of a text, counted as a token; no word holds white space.
END = b"\n"
_FLUSH = 1_000_000
_SLAB = 1024  # texts that are parted at once


def tokens_of(text: str | None) -> list[bytes]:
    """Words, with A-Z lower-cased, parted by ASCII white space; then the end."""
    out = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out.append(END)
    return out


def _strings(words: Iterable[bytes]) -> pa.Array:
    return pa.array(list(words), pa.binary()).cast(pa.string())


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``tokens_of`` each of some texts: all words and ends in order, and how many each text has."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = pc.list_flatten(lists)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    kept = np.flatnonzero(pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False))  # space at an end gives an empty string
    lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[kept], minlength=len(lengths))
    place = np.insert(kept, np.cumsum(lengths), len(flat))
    return pa.concat_arrays([flat, _strings([END])]).take(pa.array(place)), lengths + 1


def _slabs(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[pa.Array]:
    for batch in batches:
        for at in range(0, len(batch), _SLAB):
            yield batch.column(column).slice(at, _SLAB)


def _places(words: pa.Array, known: pa.Array) -> np.ndarray:
    """Where each word stands among ``known``; -1 for others."""
    return pc.fill_null(pc.index_in(words, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _added(tables: Iterator[pa.Table], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Counts ``n`` by ``keys``, put together as long as no more than ``_FLUSH`` rows remain."""
    held, size = [], 0
    for table in tables:
        held.append(table)
        size += len(table)
        if size >= 2 * _FLUSH:
            whole = pa.concat_tables(held).group_by(keys).aggregate([("n", "sum")]).rename_columns([*keys, "n"])
            held, size = ([whole], len(whole)) if len(whole) < _FLUSH else ([], 0)
            if not held:
                yield from whole.to_batches()
    if held:
        yield from pa.concat_tables(held).group_by(keys).aggregate([("n", "sum")]).rename_columns([*keys, "n"]).to_batches()


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def counted():
        for texts in _slabs(batches):
            seen = pc.value_counts(_tokens(texts)[0])
            yield pa.table({"word": seen.field("values"), "n": seen.field("counts")})

    yield from _added(counted(), ["word"])


def _pair_counts(index: dict[bytes, int]):
    """Counts of neighbouring frequent words, as ``(a, b, n)``; the end also stands before a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, held, size, known = len(index), [], 0, _strings(index)

        def out():
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(codes // k), pa.array(codes % k), pa.array(n)], names=["a", "b", "n"])

        for texts in _slabs(batches):
            ids = _places(_tokens(texts)[0], known)
            before = np.concatenate(([index[END]], ids[:-1]))
            held.append((before * k + ids)[(before >= 0) & (ids >= 0)])
            size += len(held[-1])
            if size >= _FLUSH:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return run


def _class_matrix(classes: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            a, b, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            total += np.bincount(classes[a] * k + classes[b], n, k * k).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    return run


def _contexts(classes: np.ndarray, k: int):
    """``(w, c, n)``: how often class c stands before word w, or, as k + c, after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            codes = np.concatenate((b * 2 * k + classes[a], a * 2 * k + k + classes[b]))
            found, at = np.unique(codes, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found // (2 * k)), pa.array((found % (2 * k)).astype(np.int32)), pa.array(np.bincount(at, np.concatenate((n, n))).astype(np.int64))], names=["w", "c", "n"]
            )

    return run


def _best_class(gain: np.ndarray, keep: int):
    """The class of largest gain of each row ``(key, seen)``, seen a list of (context, count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = batch.column(keep)
            starts, values = np.asarray(seen.offsets)[:-1], seen.values
            lo, hi = int(seen.offsets[0].as_py()), int(seen.offsets[-1].as_py())
            c = values.field("c").to_numpy(zero_copy_only=False)[lo:hi]
            n = values.field("n").to_numpy(zero_copy_only=False)[lo:hi]
            best = np.zeros(batch.num_rows, np.int32)
            for at in range(0, batch.num_rows, 4096):
                s = starts[at : at + 4096] - lo
                e = starts[at + 4096] - lo if at + 4096 < batch.num_rows else hi - lo
                best[at : at + 4096] = np.add.reduceat(gain[c[s[0] : e]] * n[s[0] : e, None], s - s[0], axis=0).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array(best)], names=[*batch.schema.names[:keep], "cls"])

    return run


def _association(matrix: np.ndarray) -> np.ndarray:
    """log N(a, b) / (N(a) N(b)), with half a count added to each cell."""
    m = matrix + 0.5
    return np.log(m) - np.log(m.sum(1, keepdims=True)) - np.log(m.sum(0, keepdims=True))


def class_information(matrix: np.ndarray) -> float:
    """Mutual information of neighbouring classes, in nats a token, from their counts: what exchange raises."""
    total = matrix.sum()
    if not total:
        return 0.0
    expected = np.outer(matrix.sum(1), matrix.sum(0)) / total
    on = matrix > 0
    return float((matrix[on] * np.log(matrix[on] / expected[on])).sum() / total)


def class_counts(pairs: DataFrame, classes: np.ndarray, k: int) -> np.ndarray:
    matrix = np.zeros(k * k)
    for row in pairs.mapInArrow(_class_matrix(classes, k), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        matrix[row["id"]] = row["n"]
    return matrix.reshape(k, k)


def exchange_classes(pairs: DataFrame, sizes: np.ndarray, k: int, rounds: int, fixed: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of each frequent word, and the counts of neighbouring classes; word ``fixed`` keeps the last class to itself.

    In a round, every other word in turn is put where the mutual information of neighbouring classes
    gains most, given the classes of the words around it. Words of a round move at once, so the
    information is counted anew after each; a round that lowers it is undone. Only class counts (k x k) and the words'
    new classes come to the driver; what stands around a word is gathered by word on the executors.
    """
    classes = np.empty(len(sizes), np.int64)
    classes[np.argsort(-sizes, kind="stable")] = np.arange(len(sizes)) % (k - 1)
    classes[fixed] = k - 1
    matrix, still = class_counts(pairs, classes, k), 0
    for r in range(rounds):
        link = _association(matrix)
        gain = np.concatenate((link, link.T))
        gain[:, k - 1] = -1e9
        around = (
            pairs.mapInArrow(_contexts(classes, k), "w long, c int, n long")
            .groupBy("w", "c").agg(F.sum("n").alias("n"))
            .groupBy("w").agg(F.collect_list(F.struct("c", "n")).alias("seen"))  # at most 2k contexts
        )
        new = classes.copy()
        for row in around.filter(F.pmod(F.xxhash64("w"), F.lit(2)) == r % 2).mapInArrow(_best_class(gain, 1), "w long, cls int").collect():
            if row["w"] != fixed:
                new[row["w"]] = row["cls"]
        if (new == classes).all():
            still += 1
        else:
            after = class_counts(pairs, new, k)
            if class_information(after) >= class_information(matrix):
                classes, matrix, still = new, after, 0
            else:
                still += 1
        if still == 2:  # neither half of the words has anything to gain
            break
    return classes, matrix


def _left_classes(index: dict[bytes, int], classes: np.ndarray, k: int):
    """``(word, c, n)``: each word with the class before it; k where that word is not a frequent one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, of = _strings(index), np.append(classes, k)  # a place of -1 gives k

        def counted():
            for texts in _slabs(batches):
                coded = _tokens(texts)[0].dictionary_encode()
                words = coded.indices.to_numpy().astype(np.int64)
                own = of[_places(coded.dictionary, known)][words]
                before = np.concatenate(([of[index[END]]], own[:-1]))
                codes, n = np.unique(words * (k + 1) + before, return_counts=True)
                yield pa.table({"word": coded.dictionary.take(pa.array(codes // (k + 1))), "c": pa.array((codes % (k + 1)).astype(np.int32)), "n": pa.array(n)})

        yield from _added(counted(), ["word", "c"])

    return run


def _chunk_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each chunk, whose rows come one after another but for long texts, each a chunk of its own."""
    held, words = None, []

    def out(chunk: int, words: list[pa.Array]):
        every = pc.unique(pa.concat_arrays(words))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(every), chunk)), every], names=["chunk", "word"])

    for batch in batches:
        chunks = batch.column(0).to_numpy(zero_copy_only=False)
        for at in np.flatnonzero(chunks < 0).tolist():
            yield out(int(chunks[at]), [_tokens(batch.column(1).slice(at, 1))[0]])
        rows = np.flatnonzero(chunks >= 0)
        texts, chunks = batch.column(1).take(pa.array(rows)), chunks[rows]
        starts = np.flatnonzero(np.diff(chunks, prepend=-1))
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(chunks)]):
            if chunks[start] != held:
                if words:
                    yield out(held, words)
                held, words = int(chunks[start]), []
            words += [pc.unique(_tokens(texts.slice(at, min(_SLAB, end - at)))[0]) for at in range(start, end, _SLAB)]
    if words:
        yield out(held, words)


@dataclass
class Sizes:
    """Totals of the training part: tokens, distinct tokens, discount, tokens and words by class."""

    tokens: int
    distinct: int
    discount: float
    class_tokens: np.ndarray
    class_words: np.ndarray
    k: int = field(default=0)


def _sequences(sizes: Sizes):
    """Texts and words of a chunk to one row a text: classes in order (0: unknown), and sums over known words."""

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        names = words.column("word").combine_chunks()
        c = np.nan_to_num(words.column("n").to_numpy().astype(float)).astype(np.int64)
        cls = np.nan_to_num(words.column("cls").to_numpy().astype(float), nan=-1).astype(np.int64)
        base = np.log10((c + 1) / (sizes.tokens + sizes.distinct + 1))
        known = c > 0
        emit = np.zeros(len(c))
        last = sizes.k - 1
        off = np.where(cls == last, 0.0, sizes.discount)
        emit[known] = np.log10((c[known] - off[known]) / sizes.class_tokens[cls[known]])
        code = np.where(known, cls + 1, 0).astype(np.uint8)
        out: dict[str, list] = {x: [] for x in ("n_tokens", "n_known", "base_score", "emitted", "classes")}
        for at in range(0, len(docs), _SLAB):
            tokens, lengths = _tokens(docs.column("text").slice(at, _SLAB))
            every, ends = _places(tokens, names), np.cumsum(lengths)
            for ids in np.split(every, ends[:-1]):
                out["n_tokens"].append(len(ids))
                out["n_known"].append(int(known[ids].sum()))
                out["base_score"].append(float(base[ids].sum()))
                out["emitted"].append(float(emit[ids].sum()))
                out["classes"].append(code[ids].tobytes())
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "held_out": docs.column("held_out"),
                "learned": docs.column("learned"),
                "n_tokens": pa.array(out["n_tokens"], pa.int64()),
                "n_known": pa.array(out["n_known"], pa.int64()),
                "base_score": pa.array(out["base_score"], pa.float64()),
                "emitted": pa.array(out["emitted"], pa.float64()),
                "classes": pa.array(out["classes"], pa.binary()),
            }
        )

    return run


def _moves(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                c = np.frombuffer(x, np.uint8).astype(np.int64) - 1
                total += np.bincount(np.concatenate(([k - 1], c[:-1])) * k + c, minlength=k * k)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    return run


def transition_table(counts: np.ndarray, strength: float) -> np.ndarray:
    """Class transitions, each row drawn towards the classes' overall shares by ``strength`` counts."""
    share = (counts.sum(0) + 1) / (counts.sum() + len(counts))
    return (counts + strength * share) / (counts.sum(1, keepdims=True) + strength)


def _score(moves: np.ndarray, unknown: np.ndarray, train_tokens: int):
    """``unknown[c]`` is the chance of a new word in class c. A new word may come from any class; for
    what follows it counts as the class it most likely came from."""
    k = len(moves)
    with np.errstate(divide="ignore"):
        log_move, log_new = np.log10(moves), np.log10(np.maximum(moves @ unknown, 1e-300))
    came = (moves * unknown).argmax(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for x, emitted in zip(batch.column("classes").to_pylist(), batch.column("emitted").to_pylist()):
                c = np.concatenate(([k - 1], np.frombuffer(x, np.uint8).astype(np.int64) - 1))
                new = np.flatnonzero(c < 0)
                for i in new.tolist():
                    c[i] = came[c[i - 1]]
                terms = log_move[c[:-1], c[1:]]
                terms[new - 1] = log_new[c[new - 1]]
                scores.append(float(terms.sum() + emitted))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(x) for x in ("doc_id", "held_out", "n_tokens", "n_known")], pa.array([train_tokens] * n, pa.int64()), batch.column("base_score"), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def score_texts(
    docs: DataFrame,
    classes: int = 40,
    share: float = 1e-5,
    rounds: int = 8,
    strength: float = 50.0,
    modulus: int = 7,
    held: int = 2,
    chunk_rows: int = 4096,
    long_bytes: int = 1 << 16,
    stable: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Score every whole text by a class bigram model learned from the rows not held out.

    Words with at least ``share`` of all tokens (so at most 1 / share of them, a proven bound) are put
    into ``classes`` - 1 classes by exchange clustering; each rarer word then joins the class
    that what stands before it gains most by. The end of a text is a class of its own. p(w | h) is the
    smoothed transition from the class of h to that of w times the word's discounted share of its class;
    what the discount frees in a class is the chance of a new word there. So probabilities sum to one
    over the known words and one unknown word.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score,
    both log10. A null text is empty: its end is its only token. Rows with a null id are scored, not
    learned from, and not held out. Equal rows are scored each on its own. With nothing to learn from,
    score is base_score. A text is read whole, however long, with memory in proportion to its own length. An empty
    table gives an empty table; other columns are ignored, whatever their names.

    Words of a text are looked up by a join: texts are taken in chunks of ``chunk_rows`` rows, whose distinct
    words meet the word table and come back with their chunk, so no task holds the vocabulary. A text of more
    than ``long_bytes`` is a chunk of its own, which bounds the bytes of the others. Texts are written first,
    so that a repeated task sees the same chunks, unless they are ``stable``: read from a table as it is.
    """
    mod = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumns(
        {"held_out": F.coalesce(mod == held, F.lit(False)), "learned": F.coalesce(mod != held, F.lit(False))}
    )
    if not stable:
        rows = materialize(rows, "texts")
    kind = rows.schema["doc_id"].dataType.simpleString()
    learn = rows.filter("learned").select("text")

    counted = materialize(learn.mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    tokens, distinct, n1, n2 = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    frequent = {r["word"].encode("utf-8", "surrogatepass"): r["n"] for r in counted.filter(F.col("n") >= share * tokens).collect()}
    core = sorted({END: 0, **frequent}.items())
    index = {w: i for i, (w, _) in enumerate(core)}
    sizes = np.array([n for _, n in core], np.int64)

    pairs = learn.mapInArrow(_pair_counts(index), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    pairs = materialize(pairs, "pairs")
    of, matrix = exchange_classes(pairs, sizes, classes, rounds, index[END])

    gain = np.concatenate((_association(matrix), np.log((matrix.sum(0) + 1) / (matrix.sum() + classes))[None]))
    gain[:, classes - 1] = -1e9
    left = learn.mapInArrow(_left_classes(index, of, classes), "word string, c int, n long").repartition("word")
    listed = (
        left.groupBy("word", "c").agg(F.sum("n").alias("n"))
        .groupBy("word").agg(F.sum("n").alias("n"), F.collect_list(F.struct("c", "n")).alias("seen"))  # at most classes + 1 contexts
    )
    given = {w: int(of[i]) for w, i in index.items()}
    choose = _best_class(gain, 2)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in choose(batches):
            cls = batch.column(2).to_pylist()
            for i, w in enumerate(batch.column(0).cast(pa.binary()).to_pylist()):
                if (own := given.get(w)) is not None:
                    cls[i] = own
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(cls, pa.int32())], names=["word", "n", "cls"])

    words = materialize(listed.mapInArrow(assign, "word string, n long, cls int"), "words")
    by_class = words.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("w")).collect()
    class_tokens, class_words = np.zeros(classes), np.zeros(classes)
    for r in by_class:
        class_tokens[r["cls"]], class_words[r["cls"]] = r["n"], r["w"]
    discount = min(max(n1 / (n1 + 2 * n2), 0.05), 0.95) if n1 + n2 else 0.5
    totals = Sizes(tokens, distinct, discount, class_tokens, class_words, classes)

    place = F.monotonically_increasing_id()
    chunked = rows.withColumn("chunk", F.when(F.octet_length("text") > long_bytes, -1 - place).otherwise(F.floor(place / chunk_rows)))
    wanted = chunked.select("chunk", "text").mapInArrow(_chunk_words, "chunk long, word string").repartition("word")  # each once
    found = wanted.join(words, "word", "left").select("chunk", "word", "n", "cls")
    ordered = chunked.select("chunk", "doc_id", "held_out", "learned", "text")
    sequences = ordered.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(
        _sequences(totals), f"doc_id {kind}, held_out boolean, learned boolean, n_tokens long, n_known long, base_score double, emitted double, classes binary"
    )
    sequences = materialize(sequences, "sequences")
    seen = np.zeros(classes * classes)
    for row in sequences.filter("learned").select("classes").mapInArrow(_moves(classes), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        seen[row["id"]] = row["n"]
    moves = transition_table(seen.reshape(classes, classes), strength)
    with np.errstate(invalid="ignore", divide="ignore"):
        fresh = np.where(class_tokens > 0, discount * class_words / class_tokens, 1.0)
    fresh[classes - 1] = 0.0 if tokens else 1.0
    out = sequences.mapInArrow(
        _score(moves, fresh, tokens), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return out if tokens else out.withColumn("score", F.col("base_score"))
