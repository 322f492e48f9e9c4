"""Readers and writers: feature tables, manifests, ground truth, scene graphs, folders, pair lists."""

from __future__ import annotations

import json
import logging
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P

_LOG = logging.getLogger(__name__)


def require_columns(df: DataFrame, names: list[str], what: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks {', '.join(missing)}")
    return df


def write_features(df: DataFrame, path: str, metadata: dict | None = None, mode: str = "errorifexists") -> None:
    """Features as Parquet; metadata goes to a one-row table beside them."""
    df.write.mode(mode).option("compression", "zstd").parquet(f"{path}/features")
    pairs = sorted((str(k), v if isinstance(v, str) else json.dumps(v, default=str)) for k, v in (metadata or {}).items())
    rows = df.sparkSession.createDataFrame([(dict(pairs),)], "metadata map<string,string>")
    rows.coalesce(1).write.mode(mode).parquet(f"{path}/metadata")


def read_features(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    features = require_columns(spark.read.parquet(f"{path}/features"), ["image_name", "feat"], "a feature table")
    return features, dict(spark.read.parquet(f"{path}/metadata").first()["metadata"])


def by_name(features: DataFrame, position: str) -> DataFrame:
    """One row a name; of repeated names the last."""
    return features.groupBy("image_name").agg(F.max_by("feat", position).alias("feat"))


def read_vlad_init(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Centres and descriptors; both are needed."""
    centers = require_columns(spark.read.parquet(f"{path}/centers"), ["k", "vec"], "centers")
    return centers, require_columns(spark.read.parquet(f"{path}/descriptors"), ["id", "vec"], "descriptors")


def read_retrieval(spark: SparkSession, root: str, name: str, known: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Gallery, queries and ground truth of a named set."""
    if known and name not in known:
        raise ValueError(f"unknown set {name!r}; known: {', '.join(known)}")
    return {part: spark.read.parquet(f"{root}/{name}/{part}") for part in ("db", "q", "gt")}


def with_roles(gallery: DataFrame, queries: DataFrame) -> DataFrame:
    return gallery.withColumn("role", F.lit("gallery")).unionByName(queries.withColumn("role", F.lit("query")))


def scene_edges(raw: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """``(scene, u, v, w)`` from a table whose fields go by one of several names."""
    aliases = aliases or {"u": ["u", "row", "rows", "i"], "v": ["v", "col", "cols", "j"], "w": ["w", "val", "data", "overlap"]}

    def pick(names: list[str]) -> Column:
        found = [n for n in names if n in raw.columns]
        if not found:
            raise ValueError(f"none of {', '.join(names)} is there")
        return F.coalesce(*[F.col(n) for n in found])

    return raw.select("scene", *[pick(n).alias(k) for k, n in aliases.items()])


def image_names(index: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """``(scene, idx, name)`` from ``(scene, json)``: a list, ``id_to_name`` or ``name_to_id``; else from the folder's ``(scene, name)``."""
    plain = F.from_json("json", "array<string>")
    listed = F.from_json(F.get_json_object("json", "$.id_to_name"), "array<string>")
    mapped = F.from_json(F.get_json_object("json", "$.name_to_id"), "map<string,bigint>")
    by_id = F.transform(F.array_sort(F.transform(F.map_entries(mapped), lambda e: F.struct(e["value"].alias("i"), e["key"].alias("n")))), lambda s: s["n"])
    head = F.ltrim(F.col("json"))
    found = F.when(head.startswith("["), plain).otherwise(F.coalesce(listed, by_id))
    out = index.select("scene", F.posexplode(found).alias("idx", "name"))
    if listing is None:
        return out
    files = listing.filter(P.has_extension(F.col("name"), [".jpg", ".png"])).groupBy("scene").agg(F.array_sort(F.collect_list("name")).alias("l"))
    rest = files.join(out.select("scene").distinct(), "scene", "left_anti").select("scene", F.posexplode("l").alias("idx", "name"))
    return out.unionByName(rest)


def find_images(spark: SparkSession, roots: list[str], extensions: tuple[str, ...] = (".jpg", ".jpeg", ".png")) -> DataFrame:
    """Sorted paths below the roots with one of the extensions in any case; contents are not read. A root that is not there is passed over with a warning."""
    out = spark.createDataFrame([], "path string")
    for root in roots:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            _LOG.warning("no folder %s", root)
            continue
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
        out = out.unionByName(files)
    return out.filter(P.has_extension(F.col("path"), list(extensions))).distinct().orderBy("path")


def view_index(listing: DataFrame, views: list[str]) -> DataFrame:
    """``(view, cls, path)`` of ``view/class/file`` paths, for the classes that the first view has."""
    parts = F.split("path", "/")
    rows = listing.select(F.element_at(parts, -3).alias("view"), F.element_at(parts, -2).alias("cls"), "path").filter(F.col("view").isin(views))
    anchor = rows.filter(F.col("view") == views[0]).select("cls").distinct()
    return rows.join(anchor, "cls", "left_semi").select("view", "cls", "path")


def resolve(listing: DataFrame, name: str, suffix: str | None = None) -> DataFrame:
    """The file of that name, else with ``suffix`` (any, where none is given), else the shortest that holds the name (and ends so)."""
    base = P.basename(F.col("path"))
    named = P.stem(F.col("path")) == name if suffix is None else base == name + suffix
    held = base.contains(name) if suffix is None else base.contains(name) & base.endswith(suffix)
    rank = F.when(base == name, 0).when(named, 1).when(held, 2)
    rows = listing.withColumn("_r", rank).filter("_r is not null")
    return rows.agg(F.min_by("path", F.struct("_r", F.length("path"), "path")).alias("path"))


def paired_files(left: DataFrame, right: DataFrame) -> DataFrame:
    """Names that both listings have once a trailing ``_<digits>`` and the extension are cut off."""
    cut = F.regexp_replace(P.stem(F.col("path")), r"_[0-9]+$", "")
    return left.select(cut.alias("name")).intersect(right.select(cut.alias("name"))).orderBy("name")


def files_of_tasks(listing: DataFrame, tasks: list[str]) -> DataFrame:
    """Files whose name holds a task, sorted, with the task."""
    task = F.regexp_extract("path", "(" + "|".join(re.escape(t) for t in tasks) + ")", 1)
    return listing.withColumn("task", task).filter("task <> ''").orderBy("path")


def write_pairs(pairs: DataFrame, path: str) -> None:
    """One ``name name`` a line, sorted."""
    pairs.orderBy("name_a", "name_b").select(F.concat_ws(" ", "name_a", "name_b").alias("value")).write.text(path)


def write_metrics(metrics: DataFrame, path: str, parameters: dict) -> None:
    """A few metric rows as JSON lines, with the parameters of the run."""
    out = metrics
    for k, v in parameters.items():
        out = out.withColumn(k, F.lit(v))
    out.coalesce(1).write.json(path)


def state_keys(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(key, status)``: keys that are missing and keys that nobody asked for."""
    return wanted.join(found, "key", "left_anti").withColumn("status", F.lit("missing")).unionByName(
        found.join(wanted, "key", "left_anti").withColumn("status", F.lit("unexpected"))
    )


def look_up(wanted: DataFrame, entries: DataFrame) -> DataFrame:
    """``wanted`` with ``key``: the first of a name's forms that ``entries`` holds (``key``), or null.

    The forms of a name that ``is_file`` are its file name, its stem and itself; of others, itself alone.
    """
    itself = F.col("name")
    forms = F.when(F.col("is_file"), F.array(P.basename(itself), P.stem(itself), itself)).otherwise(F.array(itself))
    named = wanted.select("name", "is_file").distinct().select("name", "is_file", F.posexplode(forms).alias("_at", "key"))
    best = named.join(entries.select("key").distinct(), "key").groupBy("name", "is_file").agg(F.min_by("key", "_at").alias("key"))
    return wanted.join(best, ["name", "is_file"], "left")


def truth_of_files(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Files with the ground truth ``(task, src, dst)`` of their task; a task without any is an error when it is met."""
    error = F.raise_error(F.concat(F.lit("no ground truth for task "), F.col("task")))
    rows = files.join(registry, "task", "left")
    return rows.withColumn("src", F.when(F.col("src").isNull(), error.cast("long")).otherwise(F.col("src")))
