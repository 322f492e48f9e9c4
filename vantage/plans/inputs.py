"""Views of the driver's tables in the shapes the operators take."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators.blocks import GroupPairs, meet


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, v."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", V.as_vector("embedding").alias("v"))


def roles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries (a fifth of the ids) and the gallery (the rest)."""
    f = features(spark, sf_dir)
    return f.filter("id % 5 = 0"), f.filter("id % 5 <> 0")


def truth_self(f: DataFrame) -> DataFrame:
    return meet(f.select(F.col("id").alias("src"), "label"), f.select(F.col("id").alias("dst"), "label"), "label").filter("src <> dst").select("src", "dst")


def truth_cross(q: DataFrame, g: DataFrame) -> DataFrame:
    return meet(q.select(F.col("id").alias("src"), "label"), g.select(F.col("id").alias("dst"), "label"), "label").select("src", "dst")


def nodes(f: DataFrame) -> DataFrame:
    """scene, idx (from 0 by id), id, v."""
    at = F.row_number().over(Window.partitionBy("label").orderBy("id")) - 1
    return f.select(F.col("label").cast("long").alias("scene"), at.cast("long").alias("idx"), "id", V.normalize(F.col("v")).alias("v"))


def scene_pairs(n: DataFrame) -> DataFrame:
    """All pairs of a scene in order u < v, with cosine ``w``."""
    pairs = GroupPairs(n.select(F.col("scene").alias("sample"), F.col("idx").alias("i"), "v"))
    return pairs.rows(both=False).select(F.col("sample").alias("scene"), F.col("i").alias("u"), F.col("j").alias("v"), F.col("sim").alias("w"))


#: Cosine from which two images of a scene have an edge.
LEAST = 0.05


def raw_edges(n: DataFrame) -> DataFrame:
    return scene_pairs(n).filter(F.col("w") >= LEAST)


def loss_pairs(n: DataFrame) -> GroupPairs:
    """Pairs of a scene; overlap stands for three times the cosine within 0 and 1."""
    return GroupPairs(n.select(F.col("scene").alias("sample"), F.col("idx").alias("i"), "v"), overlap=lambda sim: np.clip(3 * sim, 0.0, 1.0))


def batches(f: DataFrame, size: int = 256) -> GroupPairs:
    """Pairs within batches of ``size`` consecutive ids, positives being those of one label."""
    unit = f.select(F.floor(F.col("id") / size).alias("sample"), F.col("id").alias("i"), "label", V.normalize(F.col("v")).alias("v"))
    return GroupPairs(unit, overlap="label")


def local(f: DataFrame) -> DataFrame:
    """image_id, pos, x, y, is_cls, v: an image a label; its first vector stands as class token too."""
    at = F.row_number().over(Window.partitionBy("label").orderBy("id")) - 1
    rows = f.select(F.col("label").cast("long").alias("image_id"), at.cast("int").alias("pos"), "v")
    return rows.withColumns({"x": F.col("pos") % 8, "y": F.floor(F.col("pos") / 8).cast("int"), "is_cls": F.col("pos") == 0})


def centers(f: DataFrame, n: int) -> DataFrame:
    return f.filter(F.col("id") < n).select(F.col("id").cast("int").alias("k"), "v")


def flat(df: DataFrame, keys: list[str], vec: str = "v", digits: int = 6) -> DataFrame:
    """A row for each component, rounded."""
    return df.select(*keys, F.posexplode(vec).alias("i", "x")).withColumn("x", F.round("x", digits))
