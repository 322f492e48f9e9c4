"""Centroid clustering of integer vectors: float32 screening within rounding bounds, exact integers where it cannot tell."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize

_UNIT = 2.0**-24  # half a unit in the last place of 1 in float32
_LIMB = 36
_LONG = 2**63 - 1


def scaled(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles: 64-bit integers where all fit with room, else Python's own."""
    x = np.asarray(vectors, np.float64)
    if not x.size or np.abs(x).max() < 2.0**60 / scale:
        return np.floor(x * scale).astype(np.int64)
    exact = [[math.floor(v * scale) if abs(v) < 2.0**52 else math.floor(v) * scale for v in row] for row in x.tolist()]
    return np.array(exact, object).reshape(x.shape)


class Centroids:
    """The nearest of a few integer centroids, squared Euclidean distance, ties to the smaller number.

    |c|^2 - 2 x.c orders the centroids of one x. Its product is taken in float32. The error of an n-term product in
    any order of summing, of factors rounded to float32 first, is at most g |x| |c| with g = (n + 2) u / (1 - (n + 2) u)
    and u = 2^-24; what follows is in double and adds under 2^-50 of its terms. Centroids whose interval
    reaches below the smallest upper end are the shortlist; if it has more than one, their distances are taken in
    integers. Vectors too large for 64-bit squares are compared in Python's integers throughout.
    """

    def __init__(self, values: list[list[int]]):
        self.values, self.dim = values, len(values[0])
        self.limit = math.isqrt(2**62 // max(1, self.dim)) // 2
        self.fits = all(abs(v) <= self.limit for row in values for v in row)
        m = self.dim + 2
        self.gamma = m * _UNIT / (1 - m * _UNIT) if m * _UNIT < 0.5 else math.inf
        if self.fits:
            self.exact = np.array(values, np.int64).reshape(len(values), self.dim)
            self.single = self.exact.astype(np.float32)
            self.squares = (self.exact * self.exact).sum(1).astype(np.float64)

    def _small(self, x: np.ndarray) -> bool:
        return self.fits and x.dtype != object and (not x.size or int(np.abs(x).max()) <= self.limit)

    def shortlist(self, x: np.ndarray) -> np.ndarray:
        """Which centroids may be the nearest of each row."""
        lengths = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        product = (x.astype(np.float32) @ self.single.T).astype(np.float64)
        score = self.squares - 2 * product
        radius = 2 * self.gamma * (1 + 1e-9) * lengths[:, None] * np.sqrt(self.squares) + 2.0**-50 * (self.squares + 2 * np.abs(product))
        return score - radius <= (score + radius).min(1)[:, None]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        if not self._small(x):
            return np.array([min(range(len(self.values)), key=lambda j: (_squared(row, self.values[j]), j)) for row in x.tolist()], np.int64)
        near = self.shortlist(x)
        best = near.argmax(1)
        for at in _chunks(np.flatnonzero(near.sum(1) > 1), max(1, (1 << 21) // near.shape[1])):
            rows, cols = np.nonzero(near[at])
            d = np.concatenate([((x[at[rows[i : i + 65536]]] - self.exact[cols[i : i + 65536]]) ** 2).sum(1) for i in range(0, len(rows), 65536)])
            starts = np.flatnonzero(np.diff(rows, prepend=-1))
            least = np.repeat(np.minimum.reduceat(d, starts), np.diff(np.append(starts, len(rows))))
            first = np.unique(rows[d == least], return_index=True)[1]
            best[at] = cols[d == least][first]
        return best

    def distances(self, x: np.ndarray, at: np.ndarray) -> list[int | None]:
        """Squared distance to centroid ``at`` of each row; none where it does not fit a long."""
        if self._small(x):
            return ((x - self.exact[at]) ** 2).sum(1).tolist()
        exact = [_squared(row, self.values[j]) for row, j in zip(x.tolist(), at.tolist())]
        return [d if d <= _LONG else None for d in exact]


def _squared(a: list[int], b: list[int]) -> int:
    return sum((int(x) - int(y)) ** 2 for x, y in zip(a, b))


def _chunks(rows: np.ndarray, size: int) -> Iterator[np.ndarray]:
    for at in range(0, len(rows), size):
        yield rows[at : at + size]


def _matrix(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    return scaled(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim), scale)


def _limbs(value: int) -> list[int]:
    """The number in base 2^36, the sign on each digit, so that sums of many stay within a long."""
    out, rest = [], abs(value)
    while rest:
        out.append((rest & (2**_LIMB - 1)) * (1 if value > 0 else -1))
        rest >>= _LIMB
    return out


def _sums(values: list[list[int]], scale: int):
    schema = pa.schema([("cluster", pa.int32()), ("component", pa.int32()), ("limb", pa.int32()), ("s", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Centroids(values)
        total = np.zeros((len(values), own.dim + 1), object)
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column(0), own.dim, scale)
            at = own.nearest(x)
            order = np.argsort(at, kind="stable")
            starts = np.flatnonzero(np.diff(at[order], prepend=-1))
            named = at[order][starts]
            total[named, :-1] += np.add.reduceat(x[order], starts, axis=0).astype(object)
            total[named, -1] += np.diff(np.append(starts, len(at))).astype(object)
        rows = [(j, i, n, limb) for j, row in enumerate(total.tolist()) for i, v in enumerate(row) for n, limb in enumerate(_limbs(int(v)))]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, schema)], schema=schema)

    return run


def _assigned(values: list[list[int]], scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Centroids(values)
        for batch in batches:
            x = _matrix(batch.column(1), own.dim, scale)
            at = own.nearest(x) if len(batch) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.int32()), pa.array(own.distances(x, at), pa.int64())], names=["id", "cluster", "distance"])

    return run


def usable(vectors: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """``id`` and ``v`` of vectors with ``dim`` components, none of them null or non-finite."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    return rows.filter(F.col("v").isNotNull() & (F.size("v") == dim) & finite)


def cluster_vectors(
    vectors: DataFrame, k: int = 8, dim: int = 64, rounds: int = 10, scale: int = 1024, salt: str = "3:", id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """Lloyd rounds in exact integers: ``id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    Vectors count as floor(``scale`` * x), if they have ``dim`` components, none null or non-finite; others are left
    out. Centroids start as the ``k`` vectors with the smallest sha256 of ``salt`` and id, equal ones in order of the
    vectors, those without an id last; fewer vectors give fewer centroids, none an empty result. A round
    assigns every vector and replaces each non-empty centroid by the floor of its mean. The driver holds the centroids; tasks send
    it sums, added up by Spark, so what it gets is ``k`` times ``dim`` numbers a round. Rounds after one that changes
    nothing are skipped. Repeated ids are rows of their own. A distance or inertia that does not fit a long is null.
    """
    spark = vectors.sparkSession
    rows = materialize(usable(vectors, id_col, vec_col, dim), "vectors")
    kind = rows.schema["id"].dataType
    name = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    first = rows.select(name.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    names = [id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    if not first:
        fields = [T.StructField(id_col, kind), T.StructField("cluster", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in names[2:5]], T.StructField(names[5], T.StringType())]
        return spark.createDataFrame([], T.StructType(fields))
    values = [[int(v) for v in row] for row in scaled(np.array([r["v"] for r in first], np.float64), scale).tolist()]
    for _ in range(rounds):
        sums = rows.select("v").mapInArrow(_sums(values, scale), "cluster int, component int, limb int, s long")
        total = [[0] * (dim + 1) for _ in values]
        for r in sums.groupBy("cluster", "component", "limb").agg(F.sum("s").alias("s")).collect():
            total[r["cluster"]][r["component"]] += r["s"] << (_LIMB * r["limb"])
        moved = [[s // t[-1] for s in t[:-1]] if t[-1] else old for t, old in zip(total, values)]
        if moved == values:
            break
        values = moved
    near = materialize(rows.mapInArrow(_assigned(values, scale), f"id {kind.simpleString()}, cluster int, distance long"), "clusters")
    discard(rows)
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    sizes = near.groupBy("cluster").agg(F.when(F.count("*") == F.count("distance"), exact).alias("s")).collect()
    own = {r["cluster"]: None if r["s"] is None else int(r["s"]) for r in sizes}
    whole = None if None in own.values() else sum(own.values())
    long = lambda s: s if s is not None and s <= _LONG else None
    digest = lambda row: hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()
    facts = [(j, long(own.get(j)), long(whole), digest(row)) for j, row in enumerate(values)]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return near.join(F.broadcast(known), "cluster").select(F.col("id").alias(id_col), *names[1:])
