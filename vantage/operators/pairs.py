"""Match pairs for reconstruction, mined from neighbour lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def match_pairs(edges: DataFrame, names: DataFrame, per_query: int | None = None) -> DataFrame:
    """``(name_a, name_b)``, name_a first in order, each unordered pair once.

    ``edges``: (src, rank, dst) best first; ``names``: (id, name). With ``per_query``, only a source's
    best so many neighbours other than itself count; a pair that either end counts is kept.
    """
    a = names.select(F.col("id").alias("src"), F.col("name").alias("_a"))
    b = names.select(F.col("id").alias("dst"), F.col("name").alias("_b"))
    rows = edges.filter("src <> dst")
    if per_query is not None:
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("src").orderBy("rank"))).filter(F.col("n") <= per_query)
    named = rows.join(a, "src").join(b, "dst")
    return named.select(F.least("_a", "_b").alias("name_a"), F.greatest("_a", "_b").alias("name_b")).distinct()
