"""Gapless numbers over a whole table, without a window over one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import materialize


def numbered(df: DataFrame, order: list[str | Column], name: str = "number") -> DataFrame:
    """Rows with their place from 0 in rising ``order`` (columns or values), which should tell all rows apart.

    Rows are dealt by ranges of the order and written, so that the ranges stay as they are; the ranges' counts, one for each partition,
    give the offsets, and each range is numbered for itself.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    named = df.withColumns({f"_o{i}": k for i, k in enumerate(keys)})
    names = [f"_o{i}" for i in range(len(keys))]
    ranges = materialize(named.repartitionByRange(*names).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = sorted((r["_part"], r["count"]) for r in ranges.groupBy("_part").count().collect())
    starts = accumulate([0, *[c for _, c in counts][:-1]])
    offsets = df.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(counts, starts)], "_part int, _start long")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*names)) - 1
    return ranges.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_start") + own).select(*df.columns, name)
