"""Vectors as ``ARRAY<DOUBLE>`` columns. Sums run from the first component on, so results repeat."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-12


def as_vector(col: str | Column) -> Column:
    return F.col(col).cast("array<double>") if isinstance(col, str) else col.cast("array<double>")


def vsum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return vsum(F.zip_with(a, b, lambda x, y: x * y))


def squared_l2(a: Column, b: Column) -> Column:
    return vsum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def norm(v: Column) -> Column:
    return F.sqrt(vsum(F.transform(v, lambda x: x * x)))


def scaled_by(v: Column, factor: Column, f) -> Column:
    """``f(x, factor)`` of each component; the factor is worked out once a row, not once a component."""
    return F.get(F.transform(F.array(factor), lambda m: F.transform(v, lambda x: f(x, m))), F.lit(0))


def normalize(v: Column, eps: float = EPS) -> Column:
    """v over its length, or over ``eps`` where that is more."""
    return scaled_by(v, F.greatest(norm(v), F.lit(eps)), lambda x, n: x / n)


def add(a: Column, b: Column, scale: Column | float = 1.0) -> Column:
    s = scale if isinstance(scale, Column) else F.lit(scale)
    return F.zip_with(a, b, lambda x, y: x + s * y)


def lerp(old: Column, new: Column, keep: float) -> Column:
    return F.zip_with(old, new, lambda x, y: F.lit(keep) * x + F.lit(1.0 - keep) * y)


def signed_power(v: Column, p: float, eps: float = 1e-6) -> Column:
    return F.transform(v, lambda x: F.signum(x) * F.pow(F.abs(x) + eps, F.lit(p)) + x)


def norm_gate(v: Column, alpha: float, weight: float, bias: float) -> Column:
    """v scaled by 1 + alpha * sigmoid(weight * length + bias)."""
    g = 1 + F.lit(alpha) / (1 + F.exp(-(F.lit(weight) * norm(v) + F.lit(bias))))
    return scaled_by(v, g, lambda x, m: x * m)


def affine(v: Column, rows: list[list[float]], bias: list[float] | None = None) -> Column:
    """Matrix times v plus bias, for a matrix of fixed size."""
    out = [dot(v, F.array(*[F.lit(float(x)) for x in row])) + (float(bias[i]) if bias else 0.0) for i, row in enumerate(rows)]
    return F.array(*out)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def _codes(columns: list[pa.Array]) -> np.ndarray:
    """A number for each row, equal where all the columns are."""
    total = np.zeros(len(columns[0]), np.int64)
    for column in columns:
        if pa.types.is_struct(column.type):
            code = _codes(column.flatten())
        else:
            code = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        total = np.unique(total * (int(code.max(initial=0)) + 1) + code, return_inverse=True)[1]
    return total


def _summed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of equal keys as one, their vectors (the last column) summed."""
    keys, column = batch.columns[:-1], batch.columns[-1]
    x = column.flatten().to_numpy(zero_copy_only=False)
    if len(x) % len(batch) or len(set(np.diff(column.offsets.to_numpy()).tolist())) > 1:
        raise ValueError("vectors that are summed must have the same length")
    code = _codes(keys)
    order = np.argsort(code, kind="stable")
    starts = np.flatnonzero(np.diff(code[order], prepend=-1))
    sums = np.add.reduceat(x.reshape(len(batch), -1)[order], starts, axis=0)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1) * sums.shape[1], pa.int32()), pa.array(sums.ravel()))
    return pa.RecordBatch.from_arrays([*[k.take(pa.array(order[starts])) for k in keys], lists], names=batch.schema.names)


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            yield _summed(batch)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``_combine``, of rows in order of their keys, one of which may go on in the next batch."""
    held = None
    for batch in batches:
        if not len(batch):
            continue
        if held is not None:
            batch = pa.Table.from_batches([held.cast(batch.schema), batch]).combine_chunks().to_batches()[0]
        summed = _summed(batch)
        last = _codes([pa.concat_arrays([s, k.slice(len(batch) - 1, 1)]) for s, k in zip(summed.columns[:-1], batch.columns[:-1])])
        at = int(np.flatnonzero(last[:-1] == last[-1])[0])
        rest = [i for i in range(len(summed)) if i != at]
        held = summed.slice(at, 1)
        if rest:
            yield summed.take(pa.array(rest))
    if held is not None:
        yield held


def vector_sum(df: DataFrame, keys: list[str], vec: str, weight: Column | float = 1.0, out: str = "v") -> DataFrame:
    """Weighted sum of vectors of one length by key; rows without a vector, or with a null in it, are left out.

    Whole vectors are summed in Arrow batches before the rows are dealt by key, which leaves a row for each key and batch however frequent
    a key is, and again afterwards, key after key.
    """
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    v = as_vector(vec)
    rows = df.filter(F.col(vec).isNotNull() & w.isNotNull() & F.forall(vec, lambda x: x.isNotNull()))
    rows = rows.select(*keys, scaled_by(v, w.cast("double"), lambda x, m: x * m).alias(out))
    dealt = rows.mapInArrow(_combine, rows.schema).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(_merge, rows.schema)


def vector_mean(df: DataFrame, keys: list[str], vec: str, out: str = "v") -> DataFrame:
    """As ``vector_sum``, over the number of vectors, which is summed along as one more component."""
    longer = df.select(*keys, F.concat(as_vector(vec), F.array(F.lit(1.0))).alias("_v"))
    sums = vector_sum(longer, keys, "_v", 1.0, out)
    return sums.select(*keys, scaled_by(F.slice(out, F.lit(1), F.size(out) - 1), F.element_at(out, -1), lambda x, n: x / n).alias(out))


def log_sum_exp(df: DataFrame, keys: list[str], x: str, out: str = "lse", extra_zero: bool = False) -> DataFrame:
    """Grouped log-sum-exp, rows dealt once; ``extra_zero`` adds a logit of zero to each group. Rows left out are the mask."""
    top = F.max(x).over(Window.partitionBy(*keys))
    rows = df.withColumn("_m", F.greatest(top, F.lit(0.0)) if extra_zero else top)
    total = F.sum(F.exp(F.col(x) - F.col("_m")))
    if extra_zero:
        total = total + F.exp(-F.first("_m"))
    return rows.groupBy(*keys).agg((F.first("_m") + F.log(total)).alias(out))
