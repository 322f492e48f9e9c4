"""Bound-certified best-fit packing of token sequences."""

from __future__ import annotations

import functools
import gc
import logging
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

_CACHE_BYTES = 128 << 20
_LOG = logging.getLogger(__name__)

#: Words of these characters alone need none of the tokenizer's normalising but lower case: they are composed
#: forms, and their letters, digits and marks are told apart by ``_PARTS`` as by the tokenizer's own pattern.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The characters that byte-level models write bytes with: printable ones stand for themselves, the rest follow from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Words(dict):
    """Token ids by word, as little-endian bytes; a word not seen yet is encoded when it is asked for."""

    def __init__(self, full, model):
        super().__init__()
        self.full, self.model, self.parts, self.held = full, model, {}, 0
        self.letters = _byte_letters()

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if _PLAIN.fullmatch(text) and "<|" not in text:
            text = text.lower()
            if text.isalpha():
                found = self.part(text)
            elif text[:-1].isalpha():  # one mark or digit at the end
                found = self.part(text[:-1]) + self.part(text[-1])
            else:
                found = b"".join([self.part(p) for p in _PARTS.findall(text)])
        else:
            found = _bytes(self.full.encode(text, add_special_tokens=False).ids)
        self[word] = found
        self.held += len(word) + len(found) + 140
        return found

    def part(self, text: str) -> bytes:
        found = self.parts.get(text)
        if found is None:
            written = text if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
            found = self.parts[text] = _bytes([t.id for t in self.model.tokenize(written)])
            self.held += len(text) + len(found) + 140
        return found


def _bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class WordTokenizer:
    """Token ids of whole texts, encoded one white-space-delimited word at a time.

    The tokenizer drops white space and never joins what it separates, so a text's ids are its
    words' ids in order. Plain words go to the tokenizer's merges directly, all others through the
    whole tokenizer. Words seen are kept up to ``_CACHE_BYTES``, then all are forgotten.
    """

    def __init__(self, path: str):
        self.full = _tokenizer(path)
        self.model = self.full.model
        self.words = _Words(self.full, self.model)

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of a text."""
        if self.words.held > _CACHE_BYTES:
            self.words = _Words(self.full, self.model)
        return b"".join(map(self.words.__getitem__, (text or "").encode().split()))


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The file as read, one a worker process; what is learned from texts lives no longer than a task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = WordTokenizer(path), _bytes([end_id])
        gc.set_threshold(100_000, 50, 1000)  # the many small objects below hold no cycles, and need not be looked through so often
        for batch in batches:
            rows, cols = [], ([], [], [], [])
            for i, text in enumerate(batch.column(1)):
                ids = tokenizer.encode(text.as_py()) + end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append(i)
                    for col, x in zip(cols, (n, at // 4, len(part) // 4, zlib.crc32(part))):
                        col.append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(cols[0], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[1:]]],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def token_pieces(docs: DataFrame, capacity: int, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_pieces(tokenizer, capacity, end_id), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(bin, offset, fill of each bin)``. Ties in length keep their order; an item goes where least room stays."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, room = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fits = rooms >> need
        if fits:
            r = need + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                rooms ^= 1 << r
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        bins[i], offsets[i] = b, capacity - r
        room[b] = r - need
        if room[b]:
            if not by_room[room[b]]:
                rooms |= 1 << room[b]
            by_room[room[b]].append(b)
    return bins, offsets, capacity - np.array(room, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int, steps: int = 20, counts: np.ndarray | None = None) -> int:
    """The largest bound on the bins from two families of dual-feasible functions.

    With x a length over the capacity: cut(e) maps x > 1-e to 1, x < e to 0 and keeps the rest;
    stair(k) keeps x where (k+1)x is whole and else gives floor((k+1)x)/k. Sums of either over the
    items never exceed the number of bins. All cuts and the first ``steps`` stairs are tried, in whole
    numbers. ``counts`` says how often each length comes, where not once.
    """
    if not len(lengths):
        return 0
    each = counts
    counts = np.zeros(capacity + 1, np.int64)
    np.add.at(counts, lengths, 1 if each is None else each)
    sizes = np.arange(capacity + 1)
    number, total = np.cumsum(counts), np.cumsum(counts * sizes)
    e = np.arange(1, capacity // 2 + 1)
    large = number[-1] - number[capacity - e]
    middle = total[capacity - e] - total[e - 1]
    best = int(max(-(-total[-1] // capacity), (-(-(large * capacity + middle) // capacity)).max()))
    for k in range(1, steps + 1):
        up, whole = (k + 1) * sizes // capacity, (k + 1) * sizes % capacity == 0
        scaled = np.where(whole, k * sizes, up * capacity)  # of k * capacity
        best = max(best, int(-(-int((counts * scaled).sum()) // (k * capacity))))
    return best


def _level(fill: np.ndarray, capacity: int) -> np.ndarray:
    """Spare room, in bins, of the bins less full than each: a bin is given up for more than so many bins."""
    by_fill, level = np.argsort(fill, kind="stable"), np.empty(len(fill))
    level[by_fill] = np.cumsum(np.concatenate(([0], (capacity - fill[by_fill])[:-1]))) / capacity
    return np.where(fill < capacity, level, np.inf)


def _pack(capacity: int, round_: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "uid"], ascending=[False, True], kind="stable")
        lengths = rows["length"].to_numpy(np.int64)
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        return pd.DataFrame(
            {
                "uid": rows["uid"].to_numpy(),
                "length": lengths,
                "sequence_id": (round_ << 56) | (int(key[0]) << 28) | bins,
                "offset": offsets,
                "level": _level(fill, capacity)[bins],
                "gap": len(fill) - lower_bound(lengths, capacity),
                "grp": key[0],
            }
        )

    return run


def _round(items: DataFrame, capacity: int, per_group: int, round_: int) -> DataFrame:
    n = items.count()
    groups = max(1, -(-n // per_group))
    dealt = items.select("uid", "length", F.pmod(F.xxhash64(F.lit(round_), "uid"), F.lit(groups)).alias("grp"))
    packed = dealt.groupBy("grp").applyInPandas(
        _pack(capacity, round_), "uid long, length long, sequence_id long, offset long, level double, gap long, grp long"
    )
    return materialize(packed, "packed")


def _bound(items: DataFrame, capacity: int) -> int:
    """``lower_bound`` of all the items; at most ``capacity`` counts reach the driver."""
    counts = items.groupBy("length").count().collect()
    if not counts:
        return 0
    return lower_bound(np.array([r["length"] for r in counts]), capacity, counts=np.array([r["count"] for r in counts]))


def packing_gap(packed: DataFrame, capacity: int = 4096) -> tuple[int, int]:
    """``(sequences, bound)`` of rows with length and sequence_id: how many there are and are needed at least."""
    return packed.agg(F.count_distinct("sequence_id")).first()[0], _bound(packed, capacity)


def pack_items(items: DataFrame, capacity: int = 4096, per_group: int = 4096) -> DataFrame:
    """``(uid, length)`` to ``(uid, length, sequence_id, offset)``, in as few sequences as found.

    Items are dealt to groups of about ``per_group`` by hash and packed by best-fit decreasing, group
    by group. Dual-feasible bounds certify a group whose bin count is proven least; the bound of all items
    together leaves a further gap, which is shared among the groups. Each group gives up its least full
    bins, until their spare room is more than its gap and that share; a certified group gives up one
    where the share is nothing. What is given up is exchanged between groups and packed anew. This ends
    when the bound of all items is met, when that of the bins given up is, or when a round saves no
    bin. A gap that is left then is logged as a warning; ``packing_gap`` counts it from the result.
    uids must be distinct and lengths from 1 to ``capacity``.
    """
    bins = F.count_distinct("sequence_id").alias("bins")
    bound, kept, closed, last, before, r = _bound(items, capacity), [], 0, None, 0, 0
    open_ = items
    while True:
        packed = _round(open_, capacity, per_group, r)
        every, = packed.agg(bins).first()
        if last is not None and every >= before:
            kept.append(last)
            closed += before
            break
        own, groups = packed.groupBy("grp").agg(F.first("gap").alias("gap")).agg(F.sum("gap"), F.count("*")).first()
        share = max(0, closed + every - bound - own) / groups if groups else 0
        given = F.col("level") <= F.col("gap") + share
        loose = packed.filter(given)
        loose_bins = loose.agg(bins).first()[0]
        if closed + every <= bound or loose_bins <= _bound(loose, capacity) or r == 127:  # ids have room for 128 rounds
            kept.append(packed)
            closed += every
            break
        kept.append(packed.filter(~given))
        closed += every - loose_bins
        last, before, open_, r = loose, loose_bins, loose.select("uid", "length"), r + 1
    if closed > bound:
        _LOG.warning("packed into %d sequences; at least %d are needed, so a gap of %d is not certified", closed, bound, closed - bound)
    return functools.reduce(DataFrame.unionByName, kept).select("uid", "length", "sequence_id", "offset")


def pack_documents(
    docs: DataFrame,
    capacity: int = 4096,
    tokenizer: str | None = None,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Tokenize every document and pack all pieces into sequences of at most ``capacity`` tokens.

    Returns, per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset. Documents end
    with ``end_id``; only longer ones are cut, into pieces of ``capacity`` tokens and a rest. A null or
    empty text is the end id alone. Rows with null or equal ids are packed each on its own. A text is encoded
    whole, however long, with memory in proportion to its own length. An empty table gives an empty table; other columns
    are ignored, whatever their names.
    """
    pieces = token_pieces(docs, capacity, tokenizer or default_tokenizer(), end_id, id_col, text_col)
    pieces = materialize(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    placed = pack_items(pieces.select("uid", "length"), capacity)
    return pieces.join(placed.select("uid", "sequence_id", "offset"), "uid").drop("uid")
