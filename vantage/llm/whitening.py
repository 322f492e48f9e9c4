"""Embedding whitening from a tiled covariance."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, measured

_LONG = 2**63 - 1
#: Entries this large have no place in a long, once scaled.
_MOST = 2.0**56


class Spread:
    """What tasks need of the fit list: the number of its vectors and, by dimension, the sum of their whole numbers."""

    def __init__(self, n: int, sums: list[int], most: int, kind: str):
        self.n, self.sums, self.kind = n, sums, kind
        top = n * most + max(map(abs, sums), default=0)
        self.fits = top < 2**62
        self.squares_fit = top <= math.isqrt(2**62 // max(1, len(sums)))

    def matrix(self, column: pa.Array, width: int) -> np.ndarray:
        """Packed rows as integers."""
        flat = column.cast(pa.large_binary()) if pa.types.is_binary(column.type) else column
        size = np.dtype(self.kind).itemsize * width
        start = flat.offset * size
        data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[start : start + len(flat) * size] if len(flat) else np.zeros(0, np.uint8)
        return data.view(self.kind).reshape(len(flat), width)

    def moved(self, x: np.ndarray, first: int = 0) -> np.ndarray:
        """n * x - S, exactly."""
        kind = np.int64 if self.fits else object
        return self.n * x.astype(kind) - np.array(self.sums[first : first + x.shape[1]], kind)

    def centred(self, x: np.ndarray, first: int = 0) -> np.ndarray:
        return self.moved(x, first).astype(np.float64) / self.n

    def deviations(self, moved: np.ndarray) -> list[int | None]:
        if self.squares_fit:
            return (moved * moved).sum(1).tolist()
        exact = [sum(int(v) ** 2 for v in row) for row in moved.tolist()]
        return [d if d <= _LONG else None for d in exact]


def _packed(scale: int, dim: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), dim)
            x = np.ascontiguousarray(np.floor(scale * v).astype(kind))
            offsets = np.arange(len(batch) + 1, dtype=np.int32) * (x.dtype.itemsize * dim)
            packed = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(offsets), pa.py_buffer(x.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], names=["id", "x"])

    return run


def _sums(kind: str, dim: int):
    unit = Spread(1, [0] * dim, 0, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim, object)
        for batch in batches:
            x = unit.matrix(batch.column(0), dim)
            for at in range(0, len(x), 4096):
                part = x[at : at + 4096]
                total += part.astype(np.int64 if part.dtype.itemsize < 8 else object).sum(0).astype(object)
        from decimal import Decimal

        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([Decimal(int(s)) for s in total], pa.decimal128(38, 0))], names=["i", "s"])

    return run


def _column_blocks(spread: Spread, dim: int, tile: int, rows: int):
    """Row blocks cut into blocks of ``tile`` columns, each sent to every tile that multiplies it."""
    cuts = range(0, dim, tile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            x = spread.matrix(batch.column(0), dim)
            for at in range(0, len(x), rows):
                out = []
                for a, left in enumerate(cuts):
                    part = np.ascontiguousarray(x[at : at + rows, left : left + tile]).tobytes()
                    out += [(block, min(a, b), max(a, b), a, part) for b in range(len(cuts))]
                block += 1
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *[pa.array(c, pa.int32()) for c in columns[1:4]], pa.array(columns[4], pa.binary())], names=["block", "a", "b", "own", "x"])

    return run


def _products(spread: Spread, dim: int, tile: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        a, b = key[1].as_py(), key[2].as_py()
        sides = {}
        for own, x in zip(table.column("own").to_pylist(), table.column("x").to_pylist()):
            width = min(tile, dim - own * tile)
            sides[own] = spread.centred(np.frombuffer(x, spread.kind).reshape(-1, width), own * tile)
        product = sides[a].T @ sides[b]
        i, j = np.indices(product.shape)
        return pa.table({"i": pa.array((i + a * tile).ravel(), pa.int32()), "j": pa.array((j + b * tile).ravel(), pa.int32()), "s": pa.array(product.ravel())})

    return run


def _second_moments(spread: Spread, dim: int, axes: np.ndarray):
    """Sums and products of the whitened components, which are centred already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((axes.shape[1] + 1, axes.shape[1]))
        for batch in batches:
            x = spread.matrix(batch.column(0), dim)
            for at in range(0, len(x), 4096):
                y = spread.centred(x[at : at + 4096]) @ axes
                total += np.vstack((y.T @ y, y.sum(0)))
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "s"])

    return run


def _whitened(spread: Spread, dim: int, axes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = spread.matrix(batch.column(1), dim)
            for at in range(0, len(batch), 4096):
                moved = spread.moved(x[at : at + 4096])
                y = (moved.astype(np.float64) / spread.n) @ axes
                offsets = np.arange(len(y) + 1, dtype=np.int32) * axes.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(y)), pa.array(spread.deviations(moved), pa.int64()), lists], names=["id", "deviation", "w"])

    return run


def covariance(fit: DataFrame, spread: Spread, dim: int, tile: int = 32, rows: int = 4096) -> np.ndarray:
    """Covariance of the packed vectors ``x``, tile by tile: no task holds more than two column blocks of ``rows`` rows."""
    blocks = fit.select("x").mapInArrow(_column_blocks(spread, dim, tile, rows), "block long, a int, b int, own int, x binary")
    tiles = blocks.groupBy("block", "a", "b").applyInArrow(_products(spread, dim, tile), "i int, j int, s double")
    out = np.zeros((dim, dim))
    for r in tiles.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["s"] / spread.n
    return out


def whiten_vectors(
    vectors: DataFrame, components: int = 16, scale: int = 64, tile: int = 32, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """``id_col, component, n, deviation, whitened, explained, identity_error``, a row for each vector and component.

    An entry c counts as floor(``scale`` * c); a constant added to all of them changes nothing that is returned. Rows whose vector is null, or
    has an entry that is null, non-finite or 2^56 and more, are left out; so are those of another length than
    most vectors have (of equally frequent lengths, the longer one). The fit list is every distinct vector once: n of
    them, with sums S. ``deviation`` is the sum of (n x - S)^2, null where it does not fit a long. The covariance is
    taken from (n x - S) / n: column blocks meet by row block and tile, and Spark adds up the tiles. Only the D x D matrix and D
    sums reach the driver. Components whose eigenvalue is no more than rounding (D * 2^-50 of the largest)
    have no direction and are left out: repeats of a single vector give no rows. Repeated rows are all returned.
    """
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(_MOST)))
    given = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    id_kind = given.schema["id"].dataType
    largest = F.greatest(F.max(F.array_max("v")), -F.min(F.array_min("v"))).cast("double")
    shape = given.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("c"), largest.alias("m")).orderBy(F.desc("c"), F.desc("d")).limit(1).collect()
    fields = [(id_col, id_kind), ("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())]
    nothing = vectors.sparkSession.createDataFrame([], T.StructType([T.StructField(*f) for f in fields]))
    if not shape:
        return nothing
    dim, most = shape[0]["d"], math.ceil(scale * shape[0]["m"]) + 1
    kind = next(k for k, top in (("<i1", 2**7), ("<i2", 2**15), ("<i4", 2**31), ("<i8", 2**63)) if most < top)
    rows = materialize(given.filter(F.size("v") == dim).mapInArrow(_packed(scale, dim, kind), f"id {id_kind.simpleString()}, x binary"), "packed")
    fit, seen = measured(rows.select("x").distinct(), "fit", n=F.count(F.lit(1)))
    n = seen["n"]
    sums = fit.mapInArrow(_sums(kind, dim), "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
    spread = Spread(n, [int(s) for _, s in sorted((r["i"], r["s"]) for r in sums)], most, kind)
    v = covariance(fit, spread, dim, tile)
    values, vectors_ = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(values.max(), 0.0) * dim * 2.0**-50]
    if not len(order):
        discard(fit)
        discard(rows)
        return nothing
    axes = vectors_[:, order] / np.sqrt(values[order])
    found = np.zeros((len(order) + 1, len(order)))
    for r in fit.mapInArrow(_second_moments(spread, dim, axes), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        found[r["i"], r["j"]] = r["s"] / n
    error = float(np.abs(found[:-1] - np.outer(found[-1], found[-1]) - np.eye(len(order))).max())
    discard(fit)
    share = F.array(*[F.lit(float(s)) for s in values[order] / np.trace(v)])
    out = rows.mapInArrow(_whitened(spread, dim, axes), f"id {id_kind.simpleString()}, deviation long, w array<double>")
    each = out.select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select(
        F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")
    )
