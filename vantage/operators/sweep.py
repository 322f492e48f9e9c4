"""Rows in blocks, each of which meets all rows of another table, block after block, in one task.

Both sides are packed: a row is a block of rows. Their Cartesian product is read in the order of the left blocks and shuffles nothing;
of all similarities only those of one left block are held, and no pair becomes a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql import types as T

from ..functions import vectors as V
from ..sources.storage import materialize

#: Similarities that a task holds at once, 8 bytes each; of a left block never fewer rows than ``_LEAST``.
HELD, _LEAST, _MOST, _RIGHT, _STEP = 1 << 24, 8, 256, 512, 2048
#: A right side of up to so many rows and bytes is kept by a task while a large left block meets it, ``_AT_ONCE`` rows or more at a time.
KEPT_ROWS, KEPT_BYTES, _AT_ONCE = 1 << 20, 1 << 29, 64
#: The group of rows that have none; it is equal to no group, not to itself either.
NO_GROUP = np.iinfo(np.int64).min

_PACKED = "n int, low long, high long, ids binary, groups binary, marks binary, held binary, v binary"


class Rows:
    """Rows of a block: ``ids``, ``groups``, ``marks``, ``held`` (whether there is a vector) and ``v``, zeros where there is none."""

    def __init__(self, ids: np.ndarray, groups: np.ndarray, marks: np.ndarray, held: np.ndarray, v: np.ndarray):
        self.ids, self.groups, self.marks, self.held, self.v = ids, groups, marks, held, v

    @classmethod
    def read(cls, row: dict, mark: str) -> Rows:
        n = row[f"{mark}n"].as_py()
        ids, groups, marks = (np.frombuffer(row[mark + c].as_buffer(), np.int64) for c in ("ids", "groups", "marks"))
        return cls(ids, groups, marks, np.frombuffer(row[f"{mark}held"].as_buffer(), bool), np.frombuffer(row[f"{mark}v"].as_buffer(), np.float64).reshape(n, -1))

    @classmethod
    def joined(cls, parts: list[Rows]) -> Rows:
        return cls(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("ids", "groups", "marks", "held", "v")))

    @cached_property
    def by_group(self) -> tuple[np.ndarray, np.ndarray]:
        """Places in the order of the groups, and the groups in this order."""
        at = np.argsort(self.groups, kind="stable")
        return at, self.groups[at]

    @cached_property
    def by_id(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.argsort(self.ids, kind="stable")
        return at, self.ids[at]

    def __getitem__(self, at: slice) -> Rows:
        return Rows(*(getattr(self, c)[at] for c in ("ids", "groups", "marks", "held", "v")))


def _cuts(groups: np.ndarray, block: int, whole: bool) -> list[int]:
    """Where blocks begin: every ``block`` rows, or with ``whole`` groups at the next row that begins one."""
    at = np.arange(0, len(groups), block)
    if not whole:
        return at.tolist()
    begins = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
    at = np.searchsorted(begins, at)
    return np.unique(begins[at[at < len(begins)]]).tolist()


def _packing(block: int, metric: str, whole: bool):
    def rows(table: pa.Table) -> pa.RecordBatch:
        out = []
        groups = table.column("g").to_numpy()
        held, v = table.column("held").to_numpy(), table.column("v").combine_chunks()
        v = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(table), -1)
        if metric == "cosine":
            total = np.zeros(len(v))
            for i in range(v.shape[1]):
                total = total + v[:, i] * v[:, i]
            v = v / np.maximum(np.sqrt(total), V.EPS)[:, None]
        cuts = _cuts(groups, block, whole)
        for at, end in zip(cuts, [*cuts[1:], len(table)]):
            s = slice(at, end)
            own = (table.column("id").to_numpy()[s], groups[s], table.column("mark").to_numpy()[s], held[s], v[s])
            out.append((len(own[0]), int(groups[s].min()), int(groups[s].max()), *[np.ascontiguousarray(x).tobytes() for x in own]))
        kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[c.split()[0] for c in _PACKED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, len(batch), block):
                held.append(batch.slice(at, block))
                n += len(held[-1])
                if n >= block:
                    table = pa.Table.from_batches(held)
                    groups = table.column("g").to_numpy()
                    full = int(np.searchsorted(groups, groups[-1])) if whole else n // block * block
                    if full:
                        yield rows(table.slice(0, full))
                    held, n = (table.slice(full).to_batches(), n - full)
        if n:
            yield rows(pa.Table.from_batches(held))

    return run


def packed(rows: DataFrame, size: int, block: int, parts: int, metric: str, whole: bool = False) -> DataFrame:
    """``(id, g, mark, v)`` as blocks of at most ``block`` rows, in ``parts`` partitions, by group within each. ``size`` is the vectors' length.

    With ``whole``, a group of a partition is never cut, and a block as much longer as that takes.
    """
    there = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull())
    plain = rows.select(
        F.col("id").cast("long").alias("id"),
        F.coalesce(F.col("g").cast("long"), F.lit(NO_GROUP)).alias("g"),
        (F.col("mark").cast("long") if "mark" in rows.columns else F.lit(0).cast("long")).alias("mark"),
        F.coalesce(there, F.lit(False)).alias("held"),
        F.when(there, V.as_vector("v")).otherwise(F.array_repeat(F.lit(0.0), size)).alias("v"),
    )
    return plain.repartition(parts, F.xxhash64("id")).sortWithinPartitions("g", "id").mapInArrow(_packing(block, metric, whole), _PACKED)


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Negative distances, each summed from the first component on."""
    total = np.zeros((len(a), len(b)))
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)):
        one = x[:, None] - y[None]
        total += one * one
    return -np.sqrt(total)


def similarity(a: np.ndarray, b: np.ndarray, metric: str, out: np.ndarray | None = None) -> np.ndarray:
    """All similarities of two blocks, in ``out`` if there is one; equal rows are equally near, bit by bit: products are taken in one shape, filled up with
    zeros, in which every entry is summed alike. Distances are negative, those of "squared" are not."""
    out = np.empty((len(a), len(b))) if out is None else out
    if metric == "l2":
        out[:] = _in_order(a, b)
        return out
    for i in range(0, len(a), _MOST):
        some = _filled(a[i : i + _MOST], 64)
        rows = min(_MOST, len(a) - i)
        long = (some * some).sum(1)[:rows, None] if metric == "squared" else None
        for j in range(0, len(b), _STEP):
            other, to = _filled(b[j : j + _STEP], _STEP), out[i : i + _MOST, j : j + _STEP]
            if to.shape == (len(some), _STEP):
                np.matmul(some, other.T, out=to)
            else:
                to[:] = (some @ other.T)[:rows, : to.shape[1]]
            if long is not None:
                np.maximum(long + (other * other).sum(1)[None, : to.shape[1]] - 2 * to, 0.0, out=to)
    return out


def _filled(rows: np.ndarray, step: int) -> np.ndarray:
    """With rows of zeros after them, up to a multiple of ``step``."""
    short = -len(rows) % step
    return np.concatenate((rows, np.zeros((short, rows.shape[1])))) if short else rows


#: What becomes of a left block: its rows, the rows it met (without their vectors) and the similarities -> columns, all at once or in parts.
Work = Callable[[Rows, Rows, np.ndarray], dict[str, np.ndarray] | Iterator[dict[str, np.ndarray]]]


def by_row(f: Callable[[int, int, np.ndarray, np.ndarray], dict], itself: bool = False, every: bool = False, most: int = 1 << 18) -> Work:
    """``f(group, id, ids, sims)`` of each left row and the others of its group and mark (and ``itself``) that have a vector, none where
    it has none; with ``every``, rows without a vector too, at -inf."""

    def work(mine: Rows, met: Rows, sims: np.ndarray) -> Iterator[dict]:
        waiting, n, last = [], 0, None
        by_group, groups = met.by_group
        for i, own in enumerate(zip(mine.groups.tolist(), mine.marks.tolist(), mine.held.tolist())):
            group, mark, there = own
            if own != last:  # left rows come by group
                at = by_group[slice(*np.searchsorted(groups, (group, group + 1)))] if group != NO_GROUP else by_group[:0]
                at = at[(every | (met.held[at] & there)) & (met.marks[at] == mark)]
                ids, gaps, last = met.ids[at], np.flatnonzero(~(met.held[at] & there)), own
            kept = slice(None) if itself else ids != mine.ids[i]
            found = sims[i, at]
            found[gaps] = -np.inf
            waiting.append({"g": group, "mark": mark} | f(group, int(mine.ids[i]), ids[kept], found[kept]))
            n += _length(waiting[-1])
            if n >= most or i + 1 == len(mine.groups):
                yield {c: _column([w[c] for w in waiting], [_length(w) for w in waiting]) for c in waiting[0]}
                waiting, n = [], 0

    return work


def _length(columns: dict) -> int:
    return max((len(c) for c in columns.values() if not np.isscalar(c)), default=1)


def _column(parts: list, lengths: list[int]):
    """A scalar holds for all rows of its part."""
    if np.isscalar(parts[0]):
        return np.repeat(np.array(parts), lengths)
    return [x for p in parts for x in p] if isinstance(parts[0], list) else np.concatenate(parts)


def _met(work: Work, metric: str, schema: pa.Schema, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, mine, met, waiting, vectors, sims = None, None, [], [], [], []

        def multiply(least: int = 1):
            """What waits, in the one shape that products are taken in; vectors stay only for a left block that is met in parts."""
            if sum(len(b.ids) for b in waiting) >= least:
                block = Rows.joined(waiting)
                waiting.clear()
                if len(block.ids) > _STEP and least > 1:
                    waiting.append(block[len(block.ids) // _STEP * _STEP :])
                    block = block[: len(block.ids) // _STEP * _STEP]
                vectors.append(block.v) if len(mine.ids) > most else sims.append(similarity(mine.v, block.v, metric))
                block.v = np.zeros((len(block.ids), 0))
                met.append(block)

        def parts() -> Iterator[tuple[Rows, np.ndarray]]:
            if not vectors:
                yield mine, np.concatenate(sims, 1) if len(sims) > 1 else sims[0]
                return
            ends = np.cumsum([len(v) for v in vectors])
            held = np.empty((most, ends[-1]))
            for at in range(0, len(mine.ids), most):
                some = mine[at : at + most]
                for v, end in zip(vectors, ends):
                    similarity(some.v, v, metric, held[: len(some.ids), end - len(v) : end])
                yield some, held[: len(some.ids)]

        def done():
            if waiting:
                multiply()
            every = Rows.joined(met)
            met.clear()
            for some, product in parts():
                sims.clear()
                found = work(some, every, product)
                for columns in [found] if isinstance(found, dict) else found:
                    yield pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema], schema=schema)
            vectors.clear()

        for batch in batches:
            for r in range(len(batch)):
                row = {n: batch.column(i)[r] for i, n in enumerate(batch.schema.names)}
                number = row["block"].as_py()
                if number != own:
                    if own is not None:
                        yield from done()
                    own, mine = number, Rows.read(row, "l")
                waiting.append(Rows.read(row, "r"))
                multiply(_STEP)
        if own is not None:
            yield from done()

    return run


def swept(left: DataFrame, right: DataFrame, work: Work, schema: str, metric: str = "cosine", within: bool = False, held: int | None = None) -> DataFrame:
    """``work`` on each block of ``left(id, g, v)`` with all of ``right``, or ``within`` its groups alone. Either may hold a ``mark``.

    A task holds ``held`` similarities, or those of ``_LEAST`` rows of the left if these are more, and streams the right. A right side of at most
    ``KEPT_ROWS`` and ``KEPT_BYTES`` is kept instead, if all of it is met, so it is read for few, large left blocks; ``work`` gets a part of these at a time,
    ``_AT_ONCE`` rows at least, and may change the similarities. ``metric`` "dot" takes vectors as they are.
    """
    spark = left.sparkSession
    size = F.max(F.size("v"))
    seen = [t.agg(F.count(F.lit(1)).alias("n"), size.alias("d")).first() for t in (left, right)]
    d = max([s["d"] or 0 for s in seen] + [1])
    (nl, nr), cores = (s["n"] for s in seen), spark.sparkContext.defaultParallelism
    across = right.groupBy("g").count().agg(F.max("count")).first()[0] or 1 if within else nr
    kept = not within and nr <= KEPT_ROWS and 8 * d * nr <= KEPT_BYTES
    most = int(min(_MOST, max(_AT_ONCE if kept else _LEAST, (HELD if held is None else held) // max(1, across))))
    most = most // _AT_ONCE * _AT_ONCE or most
    row = max(1, min(_STEP, (1 << 20) // (8 * d)))  # a row of packed vectors is 1 MB
    block = max(most, min(row, -(-nl // (4 * cores)))) if kept else most
    parts = max(1, min(-(-nl // block), 4 * cores))
    a = packed(left, d, block, parts, metric).withColumn("block", F.monotonically_increasing_id())
    b = materialize(packed(right, d, row if kept else _RIGHT, max(1, -(-nr // (64 * _RIGHT))), metric), "blocks").coalesce(1)
    names = [c.split()[0] for c in _PACKED.split(", ")]
    a = a.select("block", *[F.col(c).alias("l" + c) for c in names])
    b = b.select(*[F.col(c).alias("r" + c) for c in names])
    on = (F.col("llow") <= F.col("rhigh")) & (F.col("lhigh") >= F.col("rlow")) if within else None
    pairs = a.join(b.hint("shuffle_replicate_nl"), on)
    sent = ("n", "ids", "groups", "marks", "held", "v")
    return pairs.select("block", *[s + c for s in "lr" for c in sent]).mapInArrow(_met(work, metric, to_arrow_schema(T._parse_datatype_string(schema)), most), schema)


#: Right rows that a task buffers at once in ``streamed``; a larger right side is met in as many parts.
BUFFERED = 1 << 19

#: What becomes of a left block and the right side's rows, which come a block at a time -> columns.
Fold = Callable[[Rows, Iterator[Rows]], dict[str, np.ndarray]]


def _stream(fold: Fold, step: int, schema: pa.Schema):
    def gathered(blocks: Iterator[Rows]) -> Iterator[Rows]:
        held: list[Rows] = []
        for block in blocks:
            held.append(block)
            if sum(len(b.ids) for b in held) >= step:
                yield Rows.joined(held)
                held = []
        if held:
            yield Rows.joined(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ({n: batch.column(i)[r] for i, n in enumerate(batch.schema.names)} for batch in batches for r in range(len(batch)))
        for _, own in groupby(rows, lambda row: row["block"].as_py()):
            first = next(own)
            columns = fold(Rows.read(first, "l"), gathered(Rows.read(row, "r") for row in chain([first], own)))
            yield pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema], schema=schema)

    return run


def streamed(left: DataFrame, right: DataFrame, fold: Fold, schema: str, metric: str = "cosine", block: int = 4096, whole: bool = False, buffered: int | None = None) -> DataFrame:
    """``fold`` of each block of ``left(id, g, v)`` and all of ``right``, ``block`` rows at a time or a few more; of at most ``buffered`` rows, else
    once for each part of so many. With ``whole``, rows of ``right`` that share both id and group come together.

    As in ``swept``, only packed rows are shuffled; but what a left block has met is not kept, so left blocks are large and the right is read for few of them.
    """
    spark, size = left.sparkSession, F.max(F.size("v"))
    seen = [t.agg(F.count(F.lit(1)).alias("n"), size.alias("d")).first() for t in (left, right)]
    d = max([s["d"] or 0 for s in seen] + [1])
    (nl, nr), cores = (s["n"] for s in seen), spark.sparkContext.defaultParallelism
    long = max(1, min(block, (1 << 20) // (8 * d)))  # a row of packed vectors is 1 MB
    own = max(1, min(long, -(-nl // (2 * cores))))
    parts = max(1, min(-(-nl // own), 4 * cores))
    a = packed(left, d, own, parts, metric).withColumn("block", F.monotonically_increasing_id())
    b = materialize(packed(right, d, min(long, _STEP), max(1, -(-nr // (64 * _RIGHT))), metric, whole), "blocks")
    b = b.coalesce(max(1, -(-nr // (BUFFERED if buffered is None else buffered))))
    kept = ("n", "ids", "groups", "marks", "held", "v")
    pairs = a.select("block", *[F.col(c).alias("l" + c) for c in kept]).join(b.select(*[F.col(c).alias("r" + c) for c in kept]).hint("shuffle_replicate_nl"))
    return pairs.mapInArrow(_stream(fold, block, to_arrow_schema(T._parse_datatype_string(schema))), schema)
