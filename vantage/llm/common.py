"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import discard, join_once, materialize, measured

__all__ = ["discard", "join_once", "materialize", "measured", "row_key", "table"]


def row_key(*cols: str) -> list[Column]:
    """Two independent 64-bit hashes that name a row by its content; equal rows share a key."""
    return [F.xxhash64(*cols).alias("k1"), F.xxhash64(F.lit("second"), *cols).alias("k2")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
