"""SimHash near-duplicates: a positional byte index with count filtering, then components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, join_once, materialize, measured
from .components import connected_components

_BLOCK = 1 << 14


@dataclass(frozen=True)
class ByteIndex:
    """How fingerprints of ``lanes`` 64-bit words are indexed, filtered and linked.

    A linked pair has equal bytes at ``matches`` positions at least. A posting holds one position less (or one, if that is none), and
    there is one for every choice, so a linked pair has ``matches`` postings or more in common. A pair with a posting
    in common is counted: how many of all its positional bytes are equal. Only those with ``matches`` are verified.
    """

    lanes: int = 1
    matches: int = 4
    radius: int = 4

    @property
    def held(self) -> int:
        return max(1, self.matches - 1)

    def choices(self) -> list[tuple[int, ...]]:
        return list(combinations(range(8 * self.lanes), self.held))


#: Links at 4 bits of 64 share 4 of 8 bytes at least: a changed bit touches one byte.
EXACT = ByteIndex()


def _lanes(h: np.ndarray, lanes: int) -> np.ndarray:
    """The hashes themselves, then as many mixtures of them as there are further lanes."""
    out = [h]
    for i in range(1, lanes):
        x = h + np.uint64(i * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(x ^ (x >> np.uint64(31)))
    return np.stack(out, 1)


def words_of(text: str | None) -> list[bytes]:
    """Words, with A-Z lower-cased, parted by ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def fingerprint(words: list[bytes], width: int = 4, seed: int = 42, lanes: int = 1) -> np.ndarray:
    """SimHash over all shingles of ``width`` words, repeats included, in 64-bit lanes; zero without a word."""
    if not words:
        return np.zeros(lanes, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    span = min(width, len(words))
    firsts, lasts = starts[: len(words) - span + 1].tolist(), ends[span - 1 :].tolist()
    counts, digest = np.zeros(64 * lanes, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(firsts), _BLOCK):
        h = np.array([digest(joined[s:e], seed) for s, e in zip(firsts[at : at + _BLOCK], lasts[at : at + _BLOCK])], np.uint64)
        bits = np.unpackbits(_lanes(h, lanes).view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little")
        for part in range(0, len(h), 255):  # sums of at most 255 bits fit a byte
            counts += np.add.reduce(bits[part : part + 255], axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(firsts), bitorder="little").view(np.uint64)


def _fingerprints(width: int, seed: int, lanes: int, keyed: bool):
    """Fingerprints of the last column; with ``keyed``, digests of the normalised words before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            found, digests = np.empty((len(texts), lanes), np.uint64), np.empty((len(texts), 2), np.uint64)
            for i, text in enumerate(texts):
                words = words_of(text.as_py())
                found[i] = fingerprint(words, width, seed, lanes)
                if keyed:
                    digests[i] = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), np.uint64)
            every = np.concatenate((digests, found), 1) if keyed else found
            names = (["t1", "t2"] if keyed else []) + _names(lanes)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *[pa.array(c) for c in np.ascontiguousarray(every.T).view(np.int64)]], names=[*batch.schema.names[:-1], *names]
            )

    return run


def _names(lanes: int) -> list[str]:
    return [f"f{i}" for i in range(lanes)]


def shared_bytes(left: list[Column], right: list[Column]) -> Column:
    """The tally of a pair: at how many positions the bytes of two fingerprints are equal."""
    differing = []
    for a, b in zip(left, right):
        x = a.bitwiseXOR(b)
        for shift, keep in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):  # fold each byte onto its lowest bit
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(keep))
        differing.append(F.bit_count(x))
    return F.lit(8 * len(differing)) - reduce(add, differing)


def linked(left: list[Column], right: list[Column], index: ByteIndex) -> Column:
    """Count filter first, then the distance itself."""
    apart = reduce(add, [F.bit_count(a.bitwiseXOR(b)) for a, b in zip(left, right)])
    return (shared_bytes(left, right) >= index.matches) & (apart <= index.radius)


def _postings(nodes: DataFrame, index: ByteIndex) -> DataFrame:
    """``(key, node)``: one row for each choice of positions; a key is the choice's number and the bytes there."""
    choices = np.array(index.choices())
    if (len(choices) - 1).bit_length() + 8 * index.held > 63:
        raise ValueError("a posting's bytes and number do not fit 63 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = np.arange(len(choices), dtype=np.int64) << 8 * index.held
        for batch in batches:
            prints = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], 1).view(np.uint8)
            for at in range(0, len(prints), 1024):
                some = prints[at : at + 1024]
                keys = np.tile(numbers, (len(some), 1))
                for j in range(index.held):
                    keys |= some[:, choices[:, j]].astype(np.int64) << 8 * j
                node = np.repeat(batch.column(0)[at : at + 1024].to_numpy(zero_copy_only=False), len(choices))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(node)], names=["key", "node"])

    return nodes.select("node", *_names(index.lanes)).mapInArrow(run, "key long, node long")


def _with_lanes(rows: DataFrame, col: str, mark: str, nodes: DataFrame, index: ByteIndex) -> DataFrame:
    """The fingerprint of the node in ``col``, as lanes named with ``mark``; a single lane is its own node."""
    if index.lanes == 1:
        return rows.withColumn(f"{mark}f0", F.col(col))
    return rows.join(nodes.select(F.col("node").alias(col), *[F.col(f).alias(mark + f) for f in _names(index.lanes)]), col)


def _joined(first: DataFrame, second: DataFrame) -> DataFrame:
    """``(node, root)`` after the roots of ``first`` have been linked as ``second`` says."""
    over = second.select(F.col("node").alias("root"), F.col("root").alias("top"))
    wide = first.join(over, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return wide.unionByName(second.join(first.select("node"), "node", "left_anti").select("node", "root"))


def link_nodes(nodes: DataFrame, index: ByteIndex, block: int = 256) -> DataFrame:
    """Components ``(node, root)`` of distinct ``(node, f0, ..)`` that are linked; nodes without a link are absent.

    Each member of a posting list is filtered and verified against the list's smallest member. Of these links
    each node follows that to the smallest first; then those that still join different components count. What
    they join needs no further proof. The last pass takes only lists whose members are still in
    different components, and of these only the pairs that are. It compares blocks of about ``block``
    members, block pair by block pair, so no task holds a long list. No link between
    different components is lost, and a group of copies never becomes all its pairs.
    """
    names = _names(index.lanes)
    parts = max(8, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    posted = _postings(nodes.repartition(parts, F.xxhash64("node")), index)  # a node becomes many postings: spread them
    own = Window.partitionBy("key")  # read in order of the keys; a long list spills, and each posting stays one row
    shared = materialize(posted.withColumns({"a": F.min("node").over(own), "z": F.max("node").over(own)}).filter("a <> z").select("key", "a", "node"), "postings")
    left, right = [F.col("a" + f) for f in names], [F.col("b" + f) for f in names]
    pairs = shared.filter("a <> node").select("a", F.col("node").alias("b")).distinct()
    pairs = _with_lanes(_with_lanes(pairs, "b", "b", nodes, index), "a", "a", nodes, index)
    stars = materialize(pairs.filter(linked(left, right, index)).select("a", "b"), "stars")
    found = materialize(connected_components(stars.groupBy("b").agg(F.min("a").alias("a"))), "roots")
    ends = stars
    for end in ("a", "b"):
        ends = ends.join(found.select(F.col("node").alias(end), F.col("root").alias(f"{end}root")), end, "left").withColumn(f"{end}root", F.coalesce(f"{end}root", end))
    more, figures = measured(ends.filter("aroot <> broot").select(F.col("aroot").alias("a"), F.col("broot").alias("b")).distinct(), "between", n=F.count(F.lit(1)))
    if figures["n"]:
        found = materialize(_joined(found, connected_components(more)), "roots")
    marked = shared.join(found, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = marked.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    open_, figures = measured(marked.join(mixed.filter("lo <> hi").drop("lo", "hi"), "key"), "open", n=F.count(F.lit(1)))
    for done in (shared, stars, more):
        discard(done)
    if not figures["n"]:
        return found
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = open_.withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    dealt = dealt.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "root")

    def side(mark: str) -> DataFrame:
        rows = _with_lanes(dealt.withColumnRenamed("node", mark), mark, mark, nodes, index)
        return rows.withColumnsRenamed({"own": f"{mark}own", "root": f"{mark}root"})

    apart = (F.col("aroot") < F.col("broot")) & ((F.col("aown") != F.col("bown")) | (F.col("lo") == F.col("hi")))  # a pair within a block meets once
    met = side("a").join(side("b"), ["key", "lo", "hi"]).filter(apart & linked(left, right, index))
    second = materialize(connected_components(met.select(F.col("aroot").alias("a"), F.col("broot").alias("b"))), "bridges")
    discard(open_)
    return _joined(found, second)


def link_fingerprints(prints: DataFrame, radius: int = 4) -> DataFrame:
    """Components ``(node, root)`` of distinct 64-bit fingerprints ``fp`` linked at ``radius`` or fewer bits, up to 7.

    ``radius`` flipped bits touch at most ``radius`` of the eight bytes, so a linked pair shares at
    least 8 - radius positional bytes, the guaranteed minimum.
    """
    if not 0 < radius < 8:
        raise ValueError("radius must be from 1 to 7")
    return link_nodes(prints.select(F.col("fp").alias("node"), F.col("fp").alias("f0")), ByteIndex(1, 8 - radius, radius))


def simhash_components(docs: DataFrame, width: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint and near-duplicate component of every row.

    Returns doc_id, fingerprint (16 lowercase hex digits) and component_id, the smallest doc_id that
    links reach, the row's own included. A null or empty text, or one without words, has fingerprint
    zero and links like any other. Null ids take part and are named only where a component has no
    other id. Repeated rows stay rows. A text is read whole, in blocks of shingles, however long. An
    empty table gives an empty table; other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    prints = materialize(rows.mapInArrow(_fingerprints(width, 42, 1, False), f"doc_id {kind}, f0 long").withColumnRenamed("f0", "fp"), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    roots = link_fingerprints(distinct.select("fp"), radius)
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id", "n")
    placed = join_once(prints, materialize(named, "components"), "fp", "n")
    return placed.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
