"""Hierarchical weighted hash tree: documents descend regions, racks and shards by hash draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def _draw(key: Column, shard: int, weight: float) -> Column:
    """An exponential variate of rate ``weight``, fixed by the key and the shard."""
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(f"shard/{shard}"), key), 11) + F.lit(0.5)) * F.lit(2.0**-53)
    return -F.log(unit) / F.lit(float(weight))


def _least(cols: list[Column]) -> Column:
    return cols[0] if len(cols) == 1 else F.least(*cols)


def tree_shard(key: Column, weights: Sequence[float], shards_per_rack: int = 2, racks_per_region: int = 2) -> dict:
    """Columns ``region``, ``rack`` and ``shard`` of a key in a tree of weighted shards.

    A node's draw is the smallest draw among its children. The smallest of exponential variates of
    rates w1..wn is one of rate w1+..+wn, so every level is a weighted hash draw by subtree weight,
    and a subtree whose weights stay as they are keeps its draws: when one shard is added or gains
    weight, keys can move only into that shard, and the rest of the tree is left alone.
    """
    n = len(weights)
    draws = [_draw(key, s, w) for s, w in enumerate(weights)]
    racks = {r: range(r * shards_per_rack, min(n, (r + 1) * shards_per_rack)) for r in range(-(-n // shards_per_rack))}
    regions = {g: range(g * racks_per_region, min(len(racks), (g + 1) * racks_per_region)) for g in range(-(-len(racks) // racks_per_region))}
    of_rack = {r: _least([draws[s] for s in racks[r]]) for r in racks}
    of_region = {g: _least([of_rack[r] for r in regions[g]]) for g in regions}

    def pick(options: dict[int, Column]) -> Column:
        best = F.array_min(F.array(*[F.struct(d.alias("draw"), F.lit(i).alias("at")) for i, d in options.items()]))
        return best["at"]

    def within(parent: Column, groups: dict[int, range], child: dict[int, Column]) -> Column:
        chain = None
        for g, members in groups.items():
            chosen = pick({i: child[i] for i in members})
            chain = F.when(parent == g, chosen) if chain is None else chain.when(parent == g, chosen)
        return chain

    region = pick(of_region)
    rack = within(region, regions, of_rack)
    shard = within(rack, racks, dict(enumerate(draws)))
    return {"region": region, "rack": rack, "shard": shard}


def hash_tree_shards(
    docs: DataFrame,
    shards: int = 8,
    weights: Sequence[float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Place every row in one of ``shards`` shards by its id alone.

    Returns doc_id, size (UTF-8 bytes + 1), text_crc32, region, rack, shard, slot (gapless from 0 in
    each shard) and grown_shard, the shard with one more shard of weight 1 in the tree.

    A null text has no bytes (size 1, checksum 0). Null ids are one key and share a shard. Equal ids
    share a shard; each of their rows has its own slot. Of a text, however long, only its size and checksum
    are taken. An empty table gives an empty table; columns
    other than the two named are ignored, whatever their names.

    Slots: rows are numbered within (shard, input partition) and shifted by the rows of earlier
    partitions, so no task ever holds a shard. The placed rows are written once, for a repeated task
    must not see another partitioning.
    """
    weights = list(weights or [1.0] * shards)
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.col(id_col)
    placed = docs.select(
        key.alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *[c.cast("int").alias(k) for k, c in tree_shard(key, weights).items()],
        tree_shard(key, [*weights, 1.0])["shard"].cast("int").alias("grown_shard"),
        F.spark_partition_id().alias("part"),
    )
    placed = materialize(placed, "placed")
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    local = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        placed.withColumn("local", local)
        .join(offsets, ["shard", "part"])
        .select("doc_id", "size", "text_crc32", "region", "rack", "shard", (F.col("first") + F.col("local")).alias("slot"), "grown_shard")
    )
