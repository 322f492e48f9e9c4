"""Re-rankers: they refine embeddings over the neighbour graph; ranking comes after."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.storage import materialize
from .knn import knn, knn_self, reciprocal
from .numbering import numbered

Pair = tuple[DataFrame, DataFrame]
RERANKERS: dict[str, Callable[..., Pair]] = {}


def register(name: str):
    def keep(f):
        RERANKERS[name] = f
        return f

    return keep


def apply_reranking(method: str | None, queries: DataFrame, gallery: DataFrame, **options) -> Pair:
    """Refine both sides (``id``, ``v``) by the named method; None or "none" leaves them. Names ignore case."""
    name = (method or "none").lower()
    if name == "none":
        return queries, gallery
    if name not in RERANKERS:
        raise ValueError(f"unknown re-ranking method {method!r}; known: {', '.join(sorted(RERANKERS))}")
    return RERANKERS[name](queries, gallery, **options)


def softmax_weights(edges: DataFrame, alpha: float) -> DataFrame:
    """Edges with ``w``, the softmax of alpha * sim over the edges of a source."""
    own = Window.partitionBy("src")
    e = F.exp(alpha * (F.col("sim") - F.max("sim").over(own)))
    return edges.withColumn("_e", e).withColumn("w", F.col("_e") / F.sum("_e").over(own)).drop("_e")


def neighbour_sum(edges: DataFrame, features: DataFrame) -> DataFrame:
    """``(id, a)``: the features of a source's neighbours summed by edge weight ``w``."""
    f = features.select(F.col("id").alias("dst"), F.col("v").alias("_v"))
    return V.vector_sum(edges.select("src", "dst", "w").join(f, "dst"), ["src"], "_v", F.col("w"), "a").withColumnRenamed("src", "id")


def _unit(df: DataFrame) -> DataFrame:
    return df.select("id", V.normalize(V.as_vector("v")).alias("v"))


def _both(queries: DataFrame, gallery: DataFrame) -> DataFrame:
    """Queries and gallery as one table; their ids must not overlap."""
    return _unit(queries).unionByName(_unit(gallery))


def _split(x: DataFrame, queries: DataFrame, gallery: DataFrame) -> Pair:
    return x.join(queries.select("id"), "id", "left_semi"), x.join(gallery.select("id"), "id", "left_semi")


@register("aqe")
def query_expansion(queries: DataFrame, gallery: DataFrame, k: int = 100, alpha: float = 10.0, gamma: float = 1.0) -> Pair:
    """Queries move towards their ``k`` nearest gallery rows; the gallery stays."""
    q, g = _unit(queries), _unit(gallery)
    pulled = neighbour_sum(softmax_weights(knn(q, g, k), alpha), g)
    return q.join(pulled, "id").select("id", V.normalize(V.add(F.col("v"), F.col("a"), gamma)).alias("v")), gallery


@register("dba")
def database_augmentation(queries: DataFrame, gallery: DataFrame, k: int = 30, alpha: float = 3.0, gamma: float = 0.3) -> Pair:
    """Gallery rows move towards their ``k`` nearest others; the queries stay."""
    g = _unit(gallery)
    pulled = neighbour_sum(softmax_weights(knn_self(g, k, exclude_self=True), alpha), g)
    return queries, g.join(pulled, "id").select("id", V.normalize(V.add(F.col("v"), F.col("a"), gamma)).alias("v"))


@register("dfs")
def diffusion(queries: DataFrame, gallery: DataFrame, k: int = 30, steps: int = 3, alpha: float = 5.0, beta: float = 0.2) -> Pair:
    """All rows mix with their neighbours (themselves among them) ``steps`` times over a fixed graph."""
    x = _both(queries, gallery)
    edges = materialize(softmax_weights(knn_self(x, max(1, k)), alpha), "edges")
    for _ in range(max(1, steps)):
        mixed = x.join(neighbour_sum(edges, x), "id").select("id", V.normalize(V.lerp(F.col("v"), F.col("a"), beta)).alias("v"))
        x = materialize(mixed, "diffused")
    return _split(x, queries, gallery)


@register("krnn")
def reciprocal_neighbours(queries: DataFrame, gallery: DataFrame, k1: int = 40, k2: int = 15, alpha: float = 0.5, lam: float = 1.0) -> Pair:
    """Softmax over mutual neighbours, then a mean over the ``k2`` nearest, added to each row.

    A row is its own first neighbour; ranks above count from there.
    """
    x = _both(queries, gallery)
    others = knn_self(x, k1, exclude_self=True).withColumn("rank", F.col("rank") + 1)
    own = x.select(F.col("id").alias("src"), F.lit(1).alias("rank"), F.col("id").alias("dst"), F.lit(1.0).alias("sim"))
    edges = materialize(own.unionByName(others), "edges")
    first = materialize(neighbour_sum(softmax_weights(reciprocal(edges, k1 + 1), alpha), x).withColumnRenamed("a", "v"), "firsts")
    near = edges.filter(F.col("rank") <= min(k2, k1)).withColumn("w", F.lit(1.0) / F.count("*").over(Window.partitionBy("src")))
    second = neighbour_sum(near, first)
    out = x.join(second, "id").select("id", V.normalize(V.add(F.col("v"), F.col("a"), lam)).alias("v"))
    return _split(out, queries, gallery)


def adjacency(edges: DataFrame, k1: int) -> DataFrame:
    """Sparse ``(i, f, w)`` of ones at the ``k1`` nearest."""
    return edges.filter(F.col("rank") <= k1).select(F.col("src").alias("i"), F.col("dst").alias("f"), F.lit(1.0).alias("w"))


def propagate(rows: DataFrame, edges: DataFrame, k2: int) -> DataFrame:
    """A row's neighbours' rows, each made symmetric first, summed by squared similarity and normalised."""
    both = rows.unionByName(rows.select(F.col("f").alias("i"), F.col("i").alias("f"), "w")).groupBy("i", "f").agg(F.sum("w").alias("w"))
    near = edges.filter(F.col("rank") <= k2).select(F.col("src"), F.col("dst").alias("i"), (F.col("sim") * F.col("sim")).alias("s"))
    moved = near.join(both, "i").groupBy("src", "f").agg(F.sum(F.col("s") * F.col("w")).alias("w"))
    length = moved.groupBy("src").agg(F.greatest(F.sqrt(F.sum(F.col("w") * F.col("w"))), F.lit(V.EPS)).alias("n"))
    return moved.join(length, "src").select(F.col("src").alias("i"), "f", (F.col("w") / F.col("n")).alias("w"))


def graph_rows(queries: DataFrame, gallery: DataFrame, k1: int = 50, k2: int = 20, steps: int = 2) -> DataFrame:
    """The sparse embeddings ``(i, f, w)`` of graph propagation; ``k2`` of 1 leaves the adjacency as it is."""
    x = _both(queries, gallery)
    edges = materialize(knn_self(x, max(k1, k2)), "edges")
    rows = adjacency(edges, k1)
    if k2 > 1:
        for _ in range(steps):
            rows = materialize(propagate(rows, edges, k2), "propagated")
    return rows


@register("gnn")
def graph_propagation(queries: DataFrame, gallery: DataFrame, k1: int = 50, k2: int = 20) -> Pair:
    """Rows of the propagated adjacency as dense vectors, a component for each row of either side, by id."""
    rows = graph_rows(queries, gallery, k1, k2)
    ids = _both(queries, gallery).select("id")
    place = numbered(ids, ["id"], "at").select(F.col("id").alias("f"), F.col("at").cast("int").alias("at"))
    n = ids.count()
    listed = rows.join(place, "f").groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("at", "w"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.coalesce(F.try_element_at("m", j), F.lit(0.0)))
    return _split(listed.select(F.col("i").alias("id"), dense.alias("v")), queries, gallery)


def sparse_similarity(rows: DataFrame, queries: DataFrame, gallery: DataFrame) -> DataFrame:
    """``(src, dst, sim)`` of sparse rows that share a component: a join on it, never a dense product."""
    a = rows.join(queries.select(F.col("id").alias("i")), "i", "left_semi").select(F.col("i").alias("src"), "f", F.col("w").alias("wa"))
    b = rows.join(gallery.select(F.col("id").alias("i")), "i", "left_semi").select(F.col("i").alias("dst"), "f", F.col("w").alias("wb"))
    return a.join(b, "f").groupBy("src", "dst").agg(F.sum(F.col("wa") * F.col("wb")).alias("sim"))


def sparse_ranking(rows: DataFrame, queries: DataFrame, gallery: DataFrame, k: int) -> DataFrame:
    """``(src, rank, dst, sim)``: the ``k`` best of ``sparse_similarity``; similarities within 1e-9 are ties, for the smaller id."""
    order = Window.partitionBy("src").orderBy(F.desc(F.round("sim", 9)), "dst")
    return sparse_similarity(rows, queries, gallery).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("src", "rank", "dst", "sim")
