"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, measured

_SALTS = 8


def _round(edges: DataFrame) -> DataFrame:
    """A large and a small step over ``(a, b)`` links of any orientation; gives links with b < a.

    Large: every node u, with m the smallest of u and its neighbours, points its larger neighbours at
    m. The minimum is a partial aggregate and the rest an equi-join whose keys are parted among
    ``_SALTS``, so a hub is never gathered in one task. Small: every node points its smaller
    neighbours, and itself, at the smallest of them. They are what the large step leaves, few as a rule; they are
    read in order, in one shuffle, and spill where a node has many.
    """
    both = edges.filter("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    salted = both.filter("b > a").withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(_SALTS)).cast("int"))
    large = salted.join(least.hint("merge"), ["a", "salt"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
    links = large.repartition("a").dropDuplicates(["a", "b"])
    m = F.first("b").over(Window.partitionBy("a").orderBy("b"))
    small = links.withColumn("m", m).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
    return small.dropDuplicates(["a", "b"])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(a, b)`` links of any orientation to ``(node, root)``, root the smallest node of the component.

    Nodes without a link to another node are absent. Self links and repeated links change nothing;
    null ends link nothing; an empty table gives an empty table. Each round is written to the shared
    folder, with its number of links and a checksum of them, and the one before it deleted.
    """
    now, seen, last = edges, None, None
    for _ in range(max_rounds):
        new, figures = measured(_round(now), "links", n=F.count(F.lit(1)), print=F.expr("bit_xor(xxhash64(a, b))"))
        if last is not None:
            discard(now)
        now, last, seen = new, seen, (figures["n"], figures["print"])
        if not seen[0] or seen == last:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
