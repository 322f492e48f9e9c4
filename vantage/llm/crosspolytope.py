"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import vector_mean
from .common import materialize, row_key


def hadamard(x: np.ndarray) -> np.ndarray:
    """Normalised Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), 2)
        h *= 2
    return x.reshape(n, d) / np.sqrt(d)


class Rotations:
    """One pseudo-rotation a table: three rounds of random signs and a Hadamard transform."""

    def __init__(self, dim: int, tables: int, seed: int = 11):
        self.dim, self.width = dim, 1 << max(0, dim - 1).bit_length()
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, self.width))

    def scores(self, x: np.ndarray, table: int) -> np.ndarray:
        """Nearness of unit vectors to each signed axis: first the positive ones."""
        length = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / np.where(length > 0, length, 1.0)
        y = np.zeros((len(x), self.width))
        y[:, : self.dim] = x
        for s in self.signs[table]:
            y = hadamard(y * s)
        return np.concatenate((y, -y), 1)

    def buckets(self, x: np.ndarray, probes: int) -> np.ndarray:
        """Rows by tables by probes: the nearest signed axes, nearest first."""
        out = np.empty((len(x), len(self.signs), probes), np.int32)
        for t in range(len(self.signs)):
            out[:, t] = np.argsort(-self.scores(x, t), axis=1, kind="stable")[:, :probes]
        return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def centre_of(rows: DataFrame, dim: int) -> np.ndarray:
    """Mean of the vectors ``vec``; zero where it is not a finite number."""
    mean = vector_mean(rows.select(F.lit(0).alias("all"), "vec"), ["all"], "vec", "m").first()
    found = np.array(mean["m"] if mean else [0.0] * dim, np.float64)
    return np.where(np.isfinite(found), found, 0.0)


def _hash(rotations: Rotations, probes: int, centre: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = rotations.buckets(_matrix(batch.column(3), rotations.dim) - centre, probes)
            flat = found.reshape(len(found), -1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "buckets"])

    return run


def nearest(q: np.ndarray, x: np.ndarray, norms: np.ndarray, gid: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``q``, rows of ``x`` and distances of the ``keep`` nearest to each query, ties to the smaller ``gid``.

    A matrix product finds who may be among them: all whose rounded distance is not above the ``keep``-th
    smallest by more than rounding can be. Those are measured exactly and sorted. Where numbers are
    too large for the product, all are measured.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        own = (q * q).sum(1)
        rough = norms + own[:, None] - 2 * (q @ x.T)
        if keep < len(x) and np.isfinite(rough).all():
            slack = 8 * (q.shape[1] + 4) * np.finfo(float).eps * (norms.max() + own)
            row, col = np.nonzero(rough <= (np.partition(rough, keep - 1, axis=1)[:, keep - 1] + slack)[:, None])
        else:
            row, col = np.divmod(np.arange(len(q) * len(x)), max(1, len(x)))
        exact = np.concatenate([np.zeros(0), *[np.sqrt(((q[row[i : i + 65536]] - x[col[i : i + 65536]]) ** 2).sum(1)) for i in range(0, len(row), 65536)]])
    order = np.lexsort((gid[col], exact, row))
    row, col, exact = row[order], col[order], exact[order]
    first = np.searchsorted(row, row)
    best = np.arange(len(row)) - first < keep
    return row[best], col[best], exact[best]


def _nearest(dim: int, keep: int):
    """The ``keep`` nearest vectors of a bucket to each query probing it, by exact distance."""

    def run(queries: pa.Table, index: pa.Table) -> pa.Table:
        out = pa.schema([("q1", pa.int64()), ("q2", pa.int64()), ("gid", pa.int64()), ("score", pa.float64())])
        if not len(queries) or not len(index):
            return out.empty_table()
        x = _matrix(index.column("vec").combine_chunks(), dim)
        gid = index.column("gid").to_numpy()
        q = _matrix(queries.column("vec").combine_chunks(), dim)
        q1, q2 = queries.column("k1").to_numpy(), queries.column("k2").to_numpy()
        norms, parts = (x * x).sum(1), []
        for at in range(0, len(q), 512):
            row, col, exact = nearest(q[at : at + 512], x, norms, gid, keep)
            parts.append((q1[at + row], q2[at + row], gid[col], exact))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], schema=out)

    return run


def search(
    vectors: DataFrame,
    every: int = 100,
    k: int = 10,
    tables: int = 8,
    probes: int = 12,
    block: int = 8192,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest rows found to each row whose id is divisible by ``every``.

    Nearness is Euclidean distance in double precision on the original vectors; ties go to the smaller
    id. Vectors are hashed from their mean, as distances stay the same and a narrow cone would share its buckets. Every row is in one bucket of each
    table, that of the signed axis nearest to its rotated unit vector; a query looks into the ``probes`` buckets nearest to it in each table, and what it finds is
    ranked by exact distance. Vectors that are null, zero, hold null or non-finite components, or
    differ in length from the commonest length take no part, nor do rows with a null id. Repeated rows
    count once; rows that share an id are never each other's neighbours. A query that finds fewer than
    ``k`` rows so, though there are more, is searched again in all buckets of one table, which is exact;
    one with fewer than ``k`` candidates gets all of them. An empty table gives an empty table; other columns are ignored.

    Equal vectors are searched as one, with their ``k`` + 1 smallest ids, which is all a query
    can need of them. A bucket's rows, and the queries that look into it, are cut into blocks of about
    ``block`` vectors; each task compares one block with another.
    """
    kept = "array<float>" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"  # floats move as they are; distances are of doubles
    vec = F.col(vec_col).cast(kept)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec")).filter(
        "vec_id is not null and vec is not null and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vec, x -> x <> 0)"
    )
    most = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = most["d"] if most else 1
    rows = rows.filter(F.size("vec") == dim).withColumns(dict(zip(("k1", "k2"), row_key("vec"))))
    least = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))
    few = rows.dropDuplicates(["k1", "k2", "vec_id"]).withColumn("r", least).filter(F.col("r") <= k + 1)
    groups = few.groupBy("k1", "k2").agg(F.min("vec_id").alias("gid"), F.first("vec").alias("vec"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    rotations, centre = Rotations(dim, tables), centre_of(rows, dim)
    probes = min(probes, 2 * rotations.width)

    shape = f"k1 long, k2 long, gid long, vec {kept}, ids array<long>, buckets array<int>"
    index = materialize(groups.select("k1", "k2", "gid", "vec", "ids").mapInArrow(_hash(rotations, 1, centre), shape), "hashed")
    asked = materialize(rows.filter(F.col("vec_id") % every == 0).select("vec_id", "k1", "k2", "vec").dropDuplicates(["vec_id", "k1", "k2"]), "asked")
    shape = f"k1 long, k2 long, gid long, vec {kept}, buckets array<int>"
    queries = asked.groupBy("k1", "k2").agg(F.min("vec_id").alias("gid"), F.first("vec").alias("vec")).select("k1", "k2", "gid", "vec").mapInArrow(_hash(rotations, probes, centre), shape)
    queries = materialize(queries, "probing")

    placed = index.select("gid", "vec", F.posexplode("buckets").alias("tbl", "bucket"))
    sizes = placed.groupBy("tbl", "bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sizes = F.broadcast(sizes)  # tables x signed axes rows at most
    wanted = queries.select("k1", "k2", "vec", F.posexplode("buckets").alias("i", "bucket")).withColumn("tbl", F.floor(F.col("i") / probes).cast("int"))

    def met(wanted: DataFrame, placed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Queries and rows by bucket, in blocks of each: a query block meets every row block of its bucket."""
        asking = F.broadcast(wanted.groupBy("tbl", "bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("turns")))
        both = sizes.join(asking, ["tbl", "bucket"])
        probing = wanted.join(both, ["tbl", "bucket"]).withColumn("turn", F.pmod(F.xxhash64("k1", "k2"), F.col("turns")).cast("int"))
        posted = placed.join(both, ["tbl", "bucket"]).withColumn("at", F.pmod(F.xxhash64("gid"), F.col("blocks")).cast("int"))
        return (
            probing.select("k1", "k2", "vec", "tbl", "bucket", "turn", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("at")),
            posted.select("gid", "vec", "tbl", "bucket", "at", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn")),
        )

    def ranked(probing: DataFrame, posted: DataFrame) -> DataFrame:
        found = (
            probing.groupBy("tbl", "bucket", "at", "turn")
            .cogroup(posted.groupBy("tbl", "bucket", "at", "turn"))
            .applyInArrow(_nearest(dim, k + 1), "q1 long, q2 long, gid long, score double")
            .groupBy("q1", "q2", "gid")
            .agg(F.min("score").alias("score"))
        )
        best = found.withColumn("r", F.row_number().over(Window.partitionBy("q1", "q2").orderBy("score", "gid"))).filter(F.col("r") <= k + 1).drop("r")
        named = best.join(index.select("gid", "ids"), "gid")
        pairs = (
            asked.select(F.col("vec_id").alias("query_id"), F.col("k1").alias("q1"), F.col("k2").alias("q2"))
            .join(named, ["q1", "q2"])
            .select("query_id", "score", F.explode("ids").alias("vec_id"))
            .filter("vec_id <> query_id")
            .groupBy("query_id", "vec_id")
            .agg(F.min("score").alias("score"))
        )
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        return pairs.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    first = materialize(ranked(*met(wanted, placed)), "ranked")
    want = min(k, rows.select("vec_id").distinct().limit(k + 1).count() - 1)
    full = first.groupBy("query_id").count().filter(F.col("count") >= want).select("query_id") if want > 0 else asked.select(F.col("vec_id").alias("query_id"))
    short = materialize(asked.join(full, F.col("vec_id") == F.col("query_id"), "left_anti"), "short")
    if short.isEmpty():
        return first
    everywhere = short.dropDuplicates(["k1", "k2"]).join(F.broadcast(sizes.filter("tbl = 0")))  # every row is in a bucket of table 0
    everywhere = materialize(everywhere.select("k1", "k2", "vec", "tbl", "bucket"), "everywhere")
    rest = ranked(*met(everywhere, placed.filter("tbl = 0"))).join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_semi")
    return first.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(rest)
