"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. In local mode, a temporary one where it names none; on a cluster that is an error."""
    found = spark.conf.get(_SETTING, None)
    if not found:
        master = spark.conf.get("spark.master", "local")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="vantage-")
        spark.conf.set(_SETTING, found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write and read back: lineage is cut, and a lost executor costs no more than its running tasks.

    Nothing reads the shuffles of a table that is written, so their files go at once and not when the driver happens to collect its garbage.
    """
    path, conf = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}", df.sparkSession.conf
    before = conf.get(_TIDY, None)
    conf.set(_TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(_TIDY) if before is None else conf.set(_TIDY, before)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[found] = path
    return found


def measured(df: DataFrame, name: str, **figures) -> tuple[DataFrame, dict]:
    """``materialize`` and, from the same job, aggregates over the rows written."""
    seen = Observation()
    out = materialize(df.observe(seen, *[c.alias(k) for k, c in figures.items()]), name)
    return out, seen.get


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and that no later plan reads."""
    path = _PATHS.pop(df, None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def join_once(rows: DataFrame, lookup: DataFrame, keys: str | list[str], count: str, per: int = 100_000) -> DataFrame:
    """Inner join of ``rows`` with ``lookup``, which has one row a key and says in ``count`` how many rows have it.

    Keys of more than ``per`` rows are parted among salts, so no task gets all the rows of one. There
    are at most rows / ``per`` such keys, which is what is broadcast.
    """
    keys = [keys] if isinstance(keys, str) else keys
    salts = F.ceil(F.col(count) / per).cast("int")
    hot = lookup.filter(F.col(count) > per).select(*keys, salts.alias("salts"))
    left = rows.join(F.broadcast(hot), keys, "left")
    others = [c for c in rows.columns if c not in keys] or keys
    left = left.withColumn("salt", F.pmod(F.xxhash64(*others), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    right = lookup.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return left.join(right.drop(count), [*keys, "salt"]).drop("salt")
