"""Near-duplicate texts: candidates from a byte-position index of wide SimHash fingerprints, counted, then compared shingle by shingle; what
the index misses is found by the rarest shingles of each text, without exception."""

from __future__ import annotations

import random
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_once, materialize, measured, row_key
from .components import connected_components
from .simhash import _fingerprints, _names, words_of

_BUCKET = 1_000_000  # postings that one task sorts
_BATCH = 1024  # texts whose postings are made at once
_PREFIXES = 400_000  # prefix postings that one task sorts
_HELD = 1 << 19  # shingles whose prefixes are made at once
_PARITY, _WIDEST = 1024, 1 << 20  # bits of a set's parity, at least and at most
_SAMPLE = 4096  # texts that say which shingles are common


@dataclass(frozen=True)
class WideIndex:
    """Fingerprints of ``lanes`` 64-bit words; a posting holds the bytes at ``bytes_`` positions, drawn once at random.

    Pairs that share a posting are counted: ``least`` equal positional bytes of all ``8 * lanes`` are needed, then no more than
    ``radius`` differing bits. ``parts`` are numbers of postings that are dealt one after another: what is within ``near`` bits of another text goes on
    to the next part only through it. In the last part the member of a posting list that the others are
    compared with is another one in each list; before that it is the smallest, so large groups give few pairs.

    The bounds stand for 0.8 of the shingles in common, where texts differ in 155 of 1024 bits and share 34 of 128 bytes in the
    mean: 0.999 of such pairs are within both. Unrelated texts share half a byte. The default postings find a quarter of the pairs at 0.8 and most
    of those at 0.9, enough to put large groups together; ``crossing`` finds the rest.
    """

    lanes: int = 16
    bytes_: int = 4
    parts: tuple[int, ...] = (12, 52)
    least: int = 16
    radius: int = 200
    near: int = 140

    def choices(self) -> list[np.ndarray]:
        draw = random.Random(7)
        seen: set[tuple[int, ...]] = set()
        while len(seen) < sum(self.parts):
            seen.add(tuple(sorted(draw.sample(range(8 * self.lanes), self.bytes_))))
        every, out, at = np.array(sorted(seen, key=lambda c: (draw.random(), c))), [], 0
        for n in self.parts:
            out.append(every[at : at + n])
            at += n
        return out


WIDE = WideIndex()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _lists(h: np.ndarray, node: np.ndarray, turn: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings in order of their key: (key, node) of each list's pivot, and the pairs of pivots with their lists' other members."""
    rank = _mixed(node.view(np.uint64) ^ h) if turn else node
    order = np.lexsort((rank, h))
    h, node = h[order], node[order]
    first = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    pivot = node[first][np.cumsum(first) - 1] if len(h) else node
    other = ~first & (pivot != node)
    pairs = np.stack((np.minimum(pivot[other], node[other]), np.maximum(pivot[other], node[other])), 1)
    return h[first], node[first], np.unique(pairs, axis=0)


def _planes(node: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes first: those that are alike compress."""
    return np.ascontiguousarray(node.view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _postings(choices: np.ndarray, number: int, buckets: int, turn: bool):
    """Rows ``(bucket, pair, x, y)``: a batch's postings, packed by ranges of their key, lists of the batch already put down to
    their pivots, and the pairs this gives. However many texts share a posting, one of a batch goes on. Of a
    posting's hash its bucket and 32 bits remain; two that agree in these by chance are one more pair to count."""
    numbers = _mixed(np.arange(number, number + len(choices), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _BATCH):
                some = batch.slice(at, _BATCH)
                node = some.column(0).to_numpy(zero_copy_only=False)
                prints = np.stack([c.to_numpy(zero_copy_only=False) for c in some.columns[1:]], 1).view(np.uint8)
                keys = np.zeros((len(node), len(choices)), np.uint64)
                for j in range(choices.shape[1]):
                    keys |= prints[:, choices[:, j]].astype(np.uint64) << np.uint64(8 * j)
                h = _mixed(keys ^ numbers[None]).ravel()
                h = ((h >> np.uint64(32)) * np.uint64(buckets) & ~np.uint64(0xFFFFFFFF)) | (h & np.uint64(0xFFFFFFFF))  # bucket, then 32 bits
                h, held, pairs = _lists(h, np.repeat(node, len(choices)), turn)
                cuts = np.searchsorted(h >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64)).tolist()
                low = h.astype(np.uint32)
                rows = [(b, False, low[i:j].tobytes(), _planes(held[i:j])) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
                rows += [(int(node[0]) % buckets, True, _planes(np.ascontiguousarray(p[:, 0])), _planes(np.ascontiguousarray(p[:, 1]))) for p in [pairs] if len(p)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.bool_(), pa.binary(), pa.binary()))], names=["bucket", "pair", "x", "y"])

    return run


def _met(turn: bool):
    """Pairs of a partition's buckets: those that batches found, and those of pivots of different batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, node = [], []
        give = lambda a, b: pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        for batch in batches:
            for bucket, pair, x, y in zip(*batch.columns):
                if pair.as_py():
                    yield give(_numbers(x.as_py()), _numbers(y.as_py()))
                else:
                    h.append(np.frombuffer(x.as_py(), np.uint32).astype(np.uint64) | np.uint64(bucket.as_py() << 32))
                    node.append(_numbers(y.as_py()))
        if h:
            pairs = _lists(np.concatenate(h), np.concatenate(node), turn)[2]
            yield give(pairs[:, 0], pairs[:, 1])

    return run


def _looked_up(pairs: DataFrame, lookup: DataFrame, end: str, mark: str) -> DataFrame:
    """Pairs with the columns of ``lookup`` for the node at one ``end``; a node that very many pairs name is looked up in parts."""
    named = lookup.select(F.col("node").alias(end), *[F.col(c).alias(mark + c) for c in lookup.columns if c != "node"])
    counted = named.join(pairs.groupBy(end).agg(F.count("*").alias("_n")), end)
    return join_once(pairs, counted, end, "_n", per=20_000)


def _counted(index: WideIndex):
    """The tally of equal bytes decides first; the bits of what it leaves are counted."""
    lanes = index.lanes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.stack([batch.column(2 + side * lanes + i).to_numpy(zero_copy_only=False) for i in range(lanes)], 1).view(np.uint64) for side in (0, 1))
            differ = np.ascontiguousarray(x ^ y)
            kept = np.flatnonzero((differ.view(np.uint8) == 0).sum(1) >= index.least)
            apart = np.bitwise_count(differ[kept]).sum(1)
            close = apart <= index.radius
            kept = pa.array(kept[close])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept), pa.array(apart[close].astype(np.int32))], names=["a", "b", "apart"])

    return run


def candidates(nodes: DataFrame, index: WideIndex = WIDE) -> DataFrame:
    """``(a, b, apart)``, a below b: pairs of ``(node, f0, ..)`` that share a posting, have enough equal bytes and are close enough.

    The postings of a part are dealt by ranges of their hashed key and sorted in tasks; they never become rows.
    """
    names = _names(index.lanes)
    spark, at, live, found = nodes.sparkSession, 0, nodes.select("node", *names), []
    for turn, choices in enumerate(index.choices()):
        last = turn + 1 == len(index.parts)
        dealt, seen = measured(live.repartition(max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.xxhash64("node")), "live", n=F.count(F.lit(1)))
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-seen["n"] * len(choices) // _BUCKET))
        posted = dealt.mapInArrow(_postings(choices, at, buckets, last), "bucket int, pair boolean, x binary, y binary")
        pairs = materialize(posted.repartition(buckets, "bucket").mapInArrow(_met(last), "a long, b long").distinct(), "pairs")
        both = _looked_up(_looked_up(pairs, nodes.select("node", *names), "b", "b"), nodes.select("node", *names), "a", "a")
        both = both.select("a", "b", *[f"a{f}" for f in names], *[f"b{f}" for f in names])
        close = materialize(both.mapInArrow(_counted(index), "a long, b long, apart int"), "close")
        found.append(close)
        at += len(choices)
        if not last:
            roots = connected_components(close.filter(F.col("apart") <= index.near).select("a", "b"))
            live = materialize(dealt.join(roots.filter("node <> root").select("node"), "node", "left_anti"), "left")
        discard(pairs)
        discard(dealt)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.dropDuplicates(["a", "b"])


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Distinct hashes of a text's shingles, sorted; fewer words than ``width`` are one shingle, no word none."""
    words = words_of(text)
    n = min(width, len(words))
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)] if n else [], np.uint64))


def _similar(width: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[int, np.ndarray] = OrderedDict()
        for batch in batches:
            ends, keep = [batch.column(i).to_pylist() for i in (0, 1)], []
            for r, (a, b) in enumerate(zip(*ends)):
                x = held.pop(a, None)
                x = shingles(batch.column(2)[r].as_py(), width) if x is None else x
                held[a] = x  # the texts that many pairs share come one after another
                if len(held) > 8:
                    held.popitem(last=False)
                y = shingles(batch.column(3)[r].as_py(), width)
                common = len(np.intersect1d(x, y, assume_unique=True))
                whole = len(x) + len(y) - common
                if not whole or common >= least * whole:
                    keep.append(r)
            rows = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows)], names=["a", "b"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """The pairs ``(a, b)`` whose texts have at least ``least`` of their distinct shingles in common.

    Texts that pairs name are picked out first, so all texts are dealt once and not once for each end.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    named = materialize(texts.select("node", "text").join(ends, "node", "left_semi"), "named")
    both = _looked_up(_looked_up(pairs.select("a", "b"), named, "b", "b"), named, "a", "a")
    out = materialize(both.select("a", "b", "atext", "btext").mapInArrow(_similar(width, least), "a long, b long"), "links")
    discard(named)
    return out


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    for end in ("a", "b"):
        own = roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}root"))
        pairs = pairs.join(own, end, "left").withColumn(f"{end}root", F.coalesce(f"{end}root", end))
    return pairs.filter("aroot <> broot")


def _usual(nodes: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and counts of shingles that are common in a sample of ``_SAMPLE`` texts. They only say which shingles of a text come
    last; whatever they are, no pair is lost."""
    n = nodes.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py(), width).view(np.int64))], names=["h"])

    some = nodes.filter(F.pmod(F.xxhash64("node"), F.lit(-(-n // _SAMPLE) or 1)) == 0).select("text")
    seen = some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).filter("n >= 4")
    found = seen.orderBy(F.desc("n"), "h").limit(20_000).toArrow()
    h, counts = (found.column(c).to_numpy() for c in ("h", "n"))
    order = np.argsort(h.view(np.uint64))
    return h.view(np.uint64)[order], counts[order]


def _least_common(least: float, n: np.ndarray) -> np.ndarray:
    """How many shingles of a set of ``n`` any other has that is ``least`` alike."""
    return np.ceil(least * n - 1e-9).astype(np.int64)


def _widths(n: np.ndarray) -> np.ndarray:
    """Bits of the parity of a set of ``n``: a power of two, at least twice ``n`` if allowed, so that sets that are not alike differ in far more bits than alike ones may."""
    return np.clip(1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64), _PARITY, _WIDEST)


def _prefixes(width: int, least: float, buckets: int, usual: Broadcast):
    """Of ``(node, root, text)``, packed by ranges of their key: ``(h, node, root, n, at)``, the shingles that come first in a set of ``n``, by number in
    one order for all texts, rare ones first: so many that no set ``least`` alike lacks all of them. In bucket -1, sets' parities: how often, modulo 2, each
    remainder comes in the set, of two to four times as many remainders as it has shingles; ``at`` says how many."""
    names = ["bucket", "h", "node", "root", "n", "at"]

    def packed(node: list, root: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        frequent, counts = usual.value
        n = np.array([len(s) for s in sets])
        h, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
        width = _widths(n)
        parity = (np.bincount(np.repeat(np.cumsum(width) - width, n) + (h & np.repeat(width - 1, n).astype(np.uint64)).astype(np.int64), minlength=width.sum()) & 1).astype(np.uint8)
        place = np.minimum(np.searchsorted(frequent, h), max(0, len(frequent) - 1))
        count = np.where(frequent[place] == h, counts[place], 0) if len(frequent) else np.zeros(len(h), np.int64)
        h = h[np.lexsort((h, count, owner))]
        at = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
        first = at < np.repeat(n - _least_common(least, n) + 1, n)
        h, owner, at = _mixed(h[first]), owner[first], at[first]
        bucket = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        order = np.argsort(bucket, kind="stable")
        low, owner, at = h.astype(np.uint32)[order], owner[order], at[order].astype(np.int32)
        node, root, n = np.array(node, np.int64), np.array(root, np.int64), n.astype(np.int32)
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64)).tolist()
        rows = [(-1, np.packbits(parity).tobytes(), _planes(node), _planes(root), n.tobytes(), width.astype(np.int32).tobytes())]
        for b, (i, j) in enumerate(zip(cuts, cuts[1:])):
            if j > i:
                own = owner[i:j]
                rows.append((b, low[i:j].tobytes(), _planes(node[own]), _planes(root[own]), n[own].tobytes(), at[i:j].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 5))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, root, sets, held = [], [], [], 0
        for batch in batches:
            for a, b, text in zip(*batch.columns):
                node.append(a.as_py())
                root.append(b.as_py())
                sets.append(shingles(text.as_py(), width))
                held += len(sets[-1])
                if held >= _HELD or len(sets) >= 4 * _BATCH:
                    yield packed(node, root, sets)
                    node, root, sets, held = [], [], [], 0
        if sets:
            yield packed(node, root, sets)

    return run


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for bits, node, n, width in zip(*batch.columns):
            ends = np.concatenate(([0], np.cumsum(np.frombuffer(width.as_py(), np.int32).astype(np.int64) // 8)))
            parity = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), bits.as_buffer()]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(_numbers(node.as_py())), pa.array(np.frombuffer(n.as_py(), np.int32)), parity], names=["node", "n", "parity"])


def _crossed(h: np.ndarray, node: np.ndarray, root: np.ndarray, n: np.ndarray, at: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes with another root that share a posting, if sizes and places allow that they are ``least`` alike: before the first
    shingle in common no other can be, so nothing is lost by judging each list on its own."""

    def by_list(keep: np.ndarray | slice) -> tuple:
        own = tuple(x[keep] for x in (h, node, root, n, at))
        first = np.concatenate(([True], own[0][1:] != own[0][:-1])) if len(own[0]) else np.zeros(0, bool)
        return own, first, np.flatnonzero(first), np.diff(np.append(np.flatnonzero(first), len(first)))

    (h, node, root, n, at), first, starts, lengths = by_list(np.lexsort((root, h)))
    if not len(h):
        return
    other = np.concatenate(([False], root[1:] != root[:-1])) & ~first
    (h, node, root, n, at), first, starts, lengths = by_list(np.repeat(np.logical_or.reduceat(other, starts), lengths))
    ends = np.repeat(starts + lengths, lengths)

    def alike(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        there = (root[i] != root[j]) & (np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-9)
        there &= np.minimum(n[i] - at[i], n[j] - at[j]) >= least / (1 + least) * (n[i] + n[j]) - 1e-6
        i, j = node[i[there]], node[j[there]]
        return np.minimum(i, j), np.maximum(i, j)

    place, near = np.arange(len(h)), 64
    for step in range(1, min(near, int(lengths.max(initial=0)))):
        place = place[place + step < ends[place]]
        yield alike(place, place + step)
    for start, length in zip(starts[lengths > near].tolist(), lengths[lengths > near].tolist()):
        for i in range(start, start + length - near):
            j = np.arange(i + near, start + length)
            yield alike(np.full(len(j), i), j)


def _needed(least: float, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of the shingles that come first in sets of ``x`` and ``y`` are common to both if the sets are ``least`` alike: all that come before the
    end of the prefix that ends first are, so of the others no more can be than one set has after its prefix."""
    return np.ceil(least / (1 + least) * (x + y) - 1e-6).astype(np.int64) - np.maximum(_least_common(least, x), _least_common(least, y)) + 1


def _crossing(least: float):
    """``(a, b, n, placed, needed)``: how many postings a pair shares in some of the lists, whether the place of one allows that it is the first in common, and how
    many it must share in all lists."""

    def counted(parts: list[tuple[np.ndarray, np.ndarray]], node: np.ndarray, n: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        i, j = (np.concatenate(c) for c in zip(*parts))
        a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
        order = np.lexsort((b, a))
        i, j, a, b = i[order], j[order], a[order], b[order]
        starts = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        x, y = n[i].astype(np.int64), n[j].astype(np.int64)
        placed = np.minimum(x - at[i], y - at[j]) >= least / (1 + least) * (x + y) - 1e-6
        columns = [a[starts], b[starts], np.diff(np.append(starts, len(a))), np.logical_or.reduceat(placed, starts), _needed(least, x[starts], y[starts])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "n", "placed", "needed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], [], [], []]
        for batch in batches:
            for bucket, low, node, root, n, at in zip(*batch.columns):
                h = np.frombuffer(low.as_py(), np.uint32).astype(np.uint64) | np.uint64(bucket.as_py() << 32)
                for to, x in zip(held, (h, _numbers(node.as_py()), _numbers(root.as_py()), np.frombuffer(n.as_py(), np.int32), np.frombuffer(at.as_py(), np.int32))):
                    to.append(x)
        if not held[0]:
            return
        h, node, root, n, at = map(np.concatenate, held)
        held.clear()
        waiting, size = [], 0
        for pair in _crossed(h, np.arange(len(h)), root, n, np.zeros_like(at), least):  # all that are in common count, wherever they stand
            waiting.append(pair)
            size += len(pair[0])
            if size >= 1 << 20:
                yield counted(waiting, node, n, at)
                waiting, size = [], 0
        if size:
            yield counted(waiting, node, n, at)

    return run


def _folded(parities: pa.Array, width: int, to: int) -> np.ndarray:
    """Parities of ``width`` bytes as those of ``to`` bytes: remainders that are equal modulo fewer bits are counted together."""
    bits = np.frombuffer(b"".join(parities.to_pylist()), np.uint64).reshape(len(parities), -1)
    return np.bitwise_xor.reduce(bits.reshape(len(parities), width // to, -1), axis=1)


def _even(least: float):
    """Pairs ``(a, b, an, aparity, bn, bparity)`` whose parities differ in no more bits than sets of these sizes may have shingles apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            an, bn = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 4))
            sizes = np.stack([pc.binary_length(batch.column(i)).to_numpy(zero_copy_only=False) for i in (3, 5)], 1)
            apart = np.zeros(len(batch), np.int64)
            for x, y in np.unique(sizes, axis=0).tolist():
                own = np.flatnonzero((sizes == (x, y)).all(1))
                sides = (_folded(batch.column(i).take(pa.array(own)), w, min(x, y)) for i, w in ((3, x), (5, y)))
                apart[own] = np.bitwise_count(np.bitwise_xor(*sides)).sum(1, dtype=np.int64)
            kept = pa.array(np.flatnonzero(apart <= (1 - least) / (1 + least) * (an + bn) + 1e-6))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept)], names=["a", "b"])

    return run


def crossing(nodes: DataFrame, roots: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """``(a, b)``, a below b: pairs of ``(node, text)`` in different components of ``(node, root)``, all those that are ``least`` alike among them.

    Sets that are ``least`` alike share one of the shingles that come first in each, whatever the order is; rare ones first gives few pairs. Components
    that are found already are not parted into pairs, so a large group costs no more than its postings.
    """
    spark = nodes.sparkSession
    usual = spark.sparkContext.broadcast(_usual(nodes, width))
    rooted = nodes.select("node", "text").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "text")
    seen = nodes.agg(F.sum(F.length("text")).alias("c")).first()["c"] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-seen // (25 * _PREFIXES)))  # a posting for about 25 code points
    made = materialize(rooted.mapInArrow(_prefixes(width, least, buckets, usual), "bucket int, h binary, node binary, root binary, n binary, at binary"), "prefixes")
    met = made.filter("bucket >= 0").repartition(buckets, "bucket").mapInArrow(_crossing(least), "a long, b long, n long, placed boolean, needed long")
    met = met.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("placed").alias("placed"), F.max("needed").alias("needed"))
    pairs = materialize(met.filter("placed and n >= needed").select("a", "b"), "pairs")
    parities = materialize(made.filter("bucket < 0").select("h", "node", "n", "at").mapInArrow(_parities, "node long, n int, parity binary"), "parities")
    both = _looked_up(_looked_up(pairs, parities, "b", "b"), parities, "a", "a")
    out = materialize(both.select("a", "b", "an", "aparity", "bn", "bparity").mapInArrow(_even(least), "a long, b long"), "even")
    for done in (made, pairs, parities):
        discard(done)
    return out


def link_texts(nodes: DataFrame, width: int = 5, least: float = 0.8, index: WideIndex = WIDE) -> DataFrame:
    """``(node, root)`` of the components of ``(node, text, f0, ..)``; two texts are linked if they are at least ``least`` alike.

    The index comes first: of its candidates each text is compared with the closest, then those that would join different components. It may
    miss links; all those between its components are found by ``crossing``.
    """
    pairs = materialize(candidates(nodes, index), "candidates")
    closest = pairs.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    first = verified(closest, nodes, width, least)
    rest, seen = measured(_apart(pairs, connected_components(first)).select("a", "b").join(closest, ["a", "b"], "left_anti"), "rest", n=F.count(F.lit(1)))
    links = first if not seen["n"] else first.unionByName(verified(rest, nodes, width, least))
    roots = connected_components(links)
    missed = crossing(nodes, roots, width, least)
    more = verified(missed, nodes, width, least)
    if not more.isEmpty():
        roots = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    for done in (pairs, first, rest, missed):
        discard(done)
    return roots


def near_duplicates(docs: DataFrame, width: int = 5, least: float = 0.8, index: WideIndex = WIDE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(k1, k2)`` of the row that each component of near-duplicates keeps: the smallest id, null ids last, then by content.

    Texts of the same words are one node, however many rows have them.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), *row_key(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    kind, names = rows.schema["doc_id"].dataType.simpleString(), _names(index.lanes)
    shape = f"doc_id {kind}, k1 long, k2 long, t1 long, t2 long, " + ", ".join(f"{f} long" for f in names)
    prints = rows.mapInArrow(_fingerprints(width, 42, index.lanes, True), shape)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("first")
    texts = prints.groupBy("t1", "t2").agg(first, *[F.min(f).alias(f) for f in names])
    nodes = materialize(texts.select("first", *names, F.monotonically_increasing_id().alias("node")), "texts")
    own = nodes.select("node", F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2"), *names)
    text = rows.select("k1", "k2", "text").join(own, ["k1", "k2"]).dropDuplicates(["k1", "k2"])  # as dealt for the join: texts are dealt once
    whole = materialize(text.drop("k1", "k2"), "nodes")
    roots = link_texts(whole, width, least, index)
    discard(whole)
    rooted = nodes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.k1", "first.k2")


def keep_one(docs: DataFrame, width: int = 5, least: float = 0.8, index: WideIndex = WIDE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of near-duplicates, that with the smallest id (null ids last), all columns as they are.

    Texts are linked if they have ``least`` of their distinct shingles of ``width`` words in common, all those that have and no
    others; ``index`` only says how many of the links are found before the rest is searched. Of rows
    that are equal in id and text, one stays. Null and empty texts, and those without words, are one component. An
    empty table gives an empty table; columns may have any names.
    """
    kept = near_duplicates(docs, width, least, index, id_col, text_col)
    marked = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *row_key(id_col, text_col))
    return marked.join(kept, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("row.*")
