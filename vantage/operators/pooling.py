"""Local descriptors to one vector an image: ``local(image_id, pos, x, y, v)``."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.rounding import rounded
from ..sources.storage import materialize
from .graph import hashed
from .sweep import by_row, swept


def average(local: DataFrame) -> DataFrame:
    return V.vector_mean(local, ["image_id"], "v")


def class_token(local: DataFrame) -> DataFrame:
    """The vector marked ``is_cls`` of each image; an image without one is an error when it is met."""
    own = F.min_by(F.when(F.col("is_cls"), F.col("v")), F.when(F.col("is_cls"), F.col("pos")))
    found = local.groupBy("image_id").agg(own.alias("v"))
    error = F.raise_error(F.concat(F.lit("no class token in image "), F.col("image_id").cast("string")))
    return found.withColumn("v", F.when(F.col("v").isNull(), error.cast(local.schema["v"].dataType)).otherwise(F.col("v")))


def generalized_mean(local: DataFrame, p: float = 3.0, eps: float = 1e-6, clamp: bool = False) -> DataFrame:
    """(mean of f(x)^p)^(1/p), f the absolute value plus eps or, with ``clamp``, max(x, eps)."""
    if p < 1:
        raise ValueError("p must be at least 1")
    f = (lambda x: F.greatest(x, F.lit(eps))) if clamp else (lambda x: F.abs(x) + eps)
    raised = local.withColumn("v", F.transform("v", lambda x: F.pow(f(x), F.lit(float(p)))))
    return V.vector_mean(raised, ["image_id"], "v").withColumn("v", F.transform("v", lambda x: F.pow(x, F.lit(1.0 / p))))


def cosplace(local: DataFrame, rows: list[list[float]], p: float = 3.0, eps: float = 1e-6) -> DataFrame:
    """Unit local vectors, generalized mean with clamping, linear layer, unit length."""
    unit = local.withColumn("v", V.normalize(F.col("v")))
    return generalized_mean(unit, p, eps, clamp=True).withColumn("v", V.normalize(V.affine(F.col("v"), rows)))


def grid_cell(local: DataFrame, width: int, height: int, across: int, down: int) -> DataFrame:
    """Rows with the cells (i, j) that hold them: edges are rounded even steps, an empty cell is one wide."""

    def edges(size: int, n: int) -> list[tuple[int, int]]:
        cut = [round(size * i / n) for i in range(n + 1)]
        return [(a, max(b, a + 1)) for a, b in zip(cut, cut[1:])]

    def inside(col: str, spans: list[tuple[int, int]]):
        return F.filter(F.array(*[F.when((F.col(col) >= a) & (F.col(col) < b), F.lit(i)) for i, (a, b) in enumerate(spans)]), lambda c: c.isNotNull())

    return local.withColumn("i", F.explode(inside("x", edges(width, across)))).withColumn("j", F.explode(inside("y", edges(height, down))))


def grid_pool(local: DataFrame, width: int, height: int, across: int, down: int, p: float = 3.0) -> DataFrame:
    """Generalized mean of each grid cell of each image."""
    cells = grid_cell(local, width, height, across, down)
    keyed = cells.withColumn("image_id", F.struct("image_id", "i", "j"))
    return generalized_mean(keyed, p).select("image_id.*", "v")


def vlad_parameters(centers: DataFrame) -> DataFrame:
    """One row ``alpha``: such that the nearest other centre gets a hundredth of a centre's own weight."""
    a, b = centers.select(F.col("k").alias("ka"), F.col("v").alias("va")), centers.select(F.col("k").alias("kb"), F.col("v").alias("vb"))
    nearest = a.join(F.broadcast(b), F.col("ka") != F.col("kb")).groupBy("ka").agg(F.min(V.squared_l2(F.col("va"), F.col("vb"))).alias("d"))
    return nearest.agg((-F.log(F.lit(0.01)) / (F.avg("d") + 1e-12)).alias("alpha"))


def assign(local: DataFrame, centers: DataFrame, alpha: float, bias: bool = True) -> DataFrame:
    """``(image_id, pos, v, k, a)``: softmax over centres of 2 alpha v.c - alpha |c|^2, the centres few."""
    c = centers.select("k", F.col("v").alias("c"))
    logit = 2 * F.lit(alpha) * V.dot(F.col("v"), F.col("c"))
    if bias:
        logit = logit - F.lit(alpha) * V.dot(F.col("c"), F.col("c"))
    own = Window.partitionBy("image_id", "pos")
    rows = local.crossJoin(F.broadcast(c)).withColumn("logit", logit)
    e = F.exp(F.col("logit") - F.max("logit").over(own))
    return rows.withColumn("e", e).withColumn("a", F.col("e") / F.sum("e").over(own)).select("image_id", "pos", "v", "k", "c", "a")


def vlad(assigned: DataFrame, clusters: int, subtract: bool = True) -> DataFrame:
    """Weighted (residual) sums of each cluster, unit length each, laid out by cluster; ghosts from ``clusters`` on are dropped."""
    rows = assigned.filter(F.col("k") < clusters)
    moved = F.zip_with("v", "c", lambda x, y: x - y) if subtract else F.col("v")
    sums = V.vector_sum(rows.withColumn("r", moved), ["image_id", "k"], "r", F.col("a"), "s").withColumn("s", V.normalize(F.col("s")))
    return sums.groupBy("image_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"])).alias("v"))


def ghost_share(assigned: DataFrame, clusters: int) -> DataFrame:
    """How much of each local vector the ghosts take."""
    return assigned.filter(F.col("k") >= clusters).groupBy("image_id", "pos").agg(F.sum("a").alias("discarded"))


def balance_loss(assigned: DataFrame, clusters: int) -> DataFrame:
    """How uneven the clusters are used: mean squared error and divergence from an even share."""
    use = assigned.groupBy("k").agg(F.avg("a").alias("p"))
    total = use.agg(F.sum("p").alias("t"))
    p = F.col("p") / F.col("t")
    even = 1.0 / clusters
    return use.crossJoin(F.broadcast(total)).agg(F.avg(F.pow(p - even, F.lit(2.0))).alias("mse"), F.sum(p * F.log((p + 1e-12) / even)).alias("kl"))


def discard_rate(assigned: DataFrame, clusters: int) -> DataFrame:
    return ghost_share(assigned, clusters).agg(F.avg("discarded").alias("rate"))


def supervlad_alpha(local: DataFrame, centers: DataFrame) -> DataFrame:
    """alpha from the mean gap between the best two dot products with unit centres."""
    c = centers.select("k", V.normalize(F.col("v")).alias("c"))
    scores = local.crossJoin(F.broadcast(c)).withColumn("s", V.dot(F.col("v"), F.col("c")))
    rank = F.row_number().over(Window.partitionBy("image_id", "pos").orderBy(F.desc("s"), "k"))
    best = scores.withColumn("r", rank).filter("r <= 2").groupBy("image_id", "pos").agg((F.max("s") - F.min("s")).alias("gap"))
    return best.agg((-F.log(F.lit(0.01)) / (F.avg("gap") + 1e-12)).alias("alpha"))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def sinkhorn(scores: np.ndarray, bin_score: float = 1.0, rounds: int = 3) -> np.ndarray:
    """Transport of n positions to m clusters and a dust bin; (m + 1, n), each column summing to one."""
    m, n = scores.shape
    if n <= m:
        raise ValueError("more positions than clusters are needed")
    s = np.vstack((scores, np.full((1, n), bin_score)))
    c = -np.log(n + m)
    log_a = np.full(m + 1, c)
    log_a[m] = c + np.log(n - m)
    u, v = np.zeros(m + 1), np.zeros(n)
    for _ in range(rounds):
        u = log_a - _lse(s + v[None], 1)
        v = c - _lse(s + u[:, None], 0)
    return np.exp(s + u[:, None] + v[None] - c)


def salad(local: DataFrame, scores, features=None, token=None, bin_score: float = 1.0, rounds: int = 3) -> DataFrame:
    """Optimal-transport pooling, one image a group. ``scores`` is a list of centres (dot products count) or a function of the vectors.

    An image's unit class vector (``is_cls``; the mean of its positions where there is none) comes first, through ``token`` where that is given,
    then each cluster's unit sum of ``features``. Rows without a vector, or with a null in it, are left out.
    """
    weights = None if callable(scores) else np.array(scores, np.float64)
    score = scores if callable(scores) else lambda x: x @ weights.T

    def pool(key, table):
        order = np.argsort(table.column("pos").to_numpy(), kind="stable")
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        x = flat.reshape(len(table), -1)[order]
        cls = table.column("is_cls").to_numpy(zero_copy_only=False)[order].astype(bool)
        own, places = (x[cls][:1] if cls.any() else x.mean(0, keepdims=True)), x[~cls]
        p = sinkhorn(score(places).T, bin_score, rounds)[:-1]
        out = p @ (features(places) if features else places)
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), V.EPS)
        own = (token(own) if token else own)[0]
        joined = np.concatenate((own / max(np.linalg.norm(own), V.EPS), out.ravel()))
        return pa.table({"image_id": pa.array([key[0].as_py()], pa.int64()), "v": pa.array([joined.tolist()], pa.list_(pa.float64()))})

    whole = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull())
    rows = local.filter(whole).select(F.col("image_id").cast("long").alias("image_id"), "pos", F.coalesce("is_cls", F.lit(False)).alias("is_cls"), V.as_vector("v").alias("v"))
    return rows.groupBy("image_id").applyInArrow(pool, "image_id long, v array<double>")


def _whole(vectors: DataFrame) -> DataFrame:
    return vectors.filter(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull()))


def moments(vectors: DataFrame) -> DataFrame:
    """``(i, j, cov)`` of the centred vectors over n - 1, and means; two passes, sums taken map-side. Vectors that are null or hold a null do not count."""
    vectors = _whole(vectors).select(V.as_vector("v").alias("v"))
    first = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    n, d = first["n"], first["d"] or 0
    mean = vectors.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))
    shift = np.zeros(d)
    for r in mean.collect():
        shift[r["i"]] = r["m"]

    def gram(batches):
        total = None
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) - shift
            total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "s"])

    sums = vectors.mapInArrow(gram, "i long, j long, s double").groupBy("i", "j").agg((F.sum("s") / F.lit(n - 1)).alias("cov"))
    means = vectors.sparkSession.createDataFrame([(i, float(m)) for i, m in enumerate(shift)], "i long, mean double")
    return sums.join(F.broadcast(means), "i")


def whitening(vectors: DataFrame, dim: int, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Rows of scaled principal axes and the bias that centres: what ``whiten`` applies and an encoder keeps as parameters."""
    rows = moments(vectors).collect()
    d = max(r["i"] for r in rows) + 1
    cov, mean = np.zeros((d, d)), np.zeros(d)
    for r in rows:
        cov[r["i"], r["j"]], mean[r["i"]] = r["cov"], r["mean"]
    values, axes = np.linalg.eigh(cov + ridge * np.eye(d))
    top = np.argsort(-values)[:dim]
    w = (axes[:, top] / np.sqrt(values[top])).T
    return w, -w @ mean


def whiten(vectors: DataFrame, dim: int, ridge: float = 1e-4) -> DataFrame:
    """Project on the leading ``dim`` principal axes, each at unit variance; eigenvectors of a D x D matrix on the driver."""
    w, bias = whitening(vectors, dim, ridge)

    def apply(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            y = x @ w.T + bias
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(y.tolist(), pa.list_(pa.float64()))], names=["id", "v"])

    return _whole(vectors).select(F.col("id").cast("long").alias("id"), V.as_vector("v").alias("v")).mapInArrow(apply, "id long, v array<double>")


def kmeans_centers(vectors: DataFrame, k: int, rounds: int = 25, seed: int = 42, normalize: bool = False, per_centre: int = 16384) -> DataFrame:
    """``(k, v)``: Lloyd rounds over ``(id, v)`` from the first ``k`` vectors by hashed id, ties to the smaller centre.

    At most ``k`` * ``per_centre`` vectors are used, the first by hashed id. Tasks send sums by centre, which are added up before the driver
    gets them: ``k`` vectors a round. A centre that loses all its vectors stays. Rounds after one that changes nothing are skipped.
    """
    rows = _whole(vectors).select(F.col("id").cast("long").alias("id"), (V.normalize(V.as_vector("v")) if normalize else V.as_vector("v")).alias("v"))
    order = [hashed(F.col("id"), seed), F.col("id")]
    if rows.count() > k * per_centre:
        rows = rows.orderBy(*order).limit(k * per_centre)
    rows = materialize(rows, "kmeans")
    centres = np.array([r["v"] for r in rows.orderBy(*order).limit(k).collect()], np.float64)
    found = len(centres)

    def sums(c: np.ndarray):
        def run(batches):
            for b in batches:
                if len(b):
                    x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
                    at = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
                    named = np.unique(at)
                    total = [np.append(x[at == j].sum(0), (at == j).sum()) for j in named]
                    yield pa.RecordBatch.from_arrays([pa.array(named, pa.int32()), pa.array([t.tolist() for t in total], pa.list_(pa.float64()))], names=["k", "v"])

        return run

    for _ in range(rounds if found else 0):
        moved = centres.copy()
        for r in V.vector_sum(rows.mapInArrow(sums(centres), "k int, v array<double>"), ["k"], "v").collect():
            moved[r["k"]] = np.array(r["v"][:-1]) / r["v"][-1]
        if np.array_equal(moved, centres):
            break
        centres = moved
    return vectors.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "k int, v array<double>")


def argmax_map(assigned: DataFrame) -> DataFrame:
    """The strongest centre of each position, and its weight."""
    return assigned.groupBy("image_id", "pos").agg(F.max_by("k", F.struct("a", -F.col("k"))).alias("k"), F.max("a").alias("a"))


def minmax_map(values: DataFrame) -> DataFrame:
    """``x`` of each image scaled to run from 0 to 1; a flat image is all zeros."""
    own = Window.partitionBy("image_id")
    low, high = F.min("x").over(own), F.max("x").over(own)
    return values.withColumn("x", F.when(high > low, (F.col("x") - low) / (high - low)).otherwise(F.lit(0.0)))


def attention_mass(values: DataFrame, keep: float = 0.5) -> DataFrame:
    """``(head, pos, x, kept)``: the positions that carry the upper ``keep`` of a head's mass."""
    own = Window.partitionBy("head")
    share = F.sum("x").over(own.orderBy("x", "pos").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("x").over(own)
    return values.withColumn("kept", share > (1 - keep))


def attention_map(q: DataFrame, k: DataFrame, dim: int, digits: int | None = None) -> DataFrame:
    """softmax over keys of q.k / sqrt(dim), within each image and head: ``(image_id, head, qpos, kpos, a)``, ``a`` rounded to ``digits`` if wanted.

    Images, heads and places are whole numbers. Queries meet the keys of their image block by block, and a query's row is finished in its task.
    """

    def softmax(image, place, places, sims):
        z = sims / float(dim) ** 0.5
        e = np.exp(z - z.max(initial=-np.inf))
        a = e / e.sum()
        return {"qpos": place, "kpos": places, "a": a if digits is None else rounded(a, digits)}

    sides = [t.select(F.col("pos").alias("id"), F.col("image_id").alias("g"), F.col("head").alias("mark"), "v") for t in (q, k)]
    rows = swept(*sides, by_row(softmax, itself=True), "g long, mark long, qpos long, kpos long, a double", "dot", within=True)
    kinds = [(q, "image_id", "g", "image_id"), (q, "head", "mark", "head"), (q, "pos", "qpos", "qpos"), (k, "pos", "kpos", "kpos")]
    return rows.select(*[F.col(c).cast(t.schema[n].dataType).alias(out) for t, n, c, out in kinds], "a")


def rotary(local: DataFrame, base: float = 100.0, height: int | None = None, width: int | None = None) -> DataFrame:
    """Vectors turned by their place: the first half of the pairs by the row, the second by the column.

    A row y of ``height`` lies at 2 (y + 1/2) / height - 1, a column likewise; where the grid's size is not
    given it is that of the image's places. Angles are 2 pi times that over base^(2 i / (D / 2)); each component
    i is paired with i + D / 2.
    """
    sizes = local.groupBy("image_id").agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))
    rows = local.join(sizes, "image_id") if height is None or width is None else local
    h, w = (F.col(c) if n is None else F.lit(n) for c, n in (("_h", height), ("_w", width)))
    d = F.size("v")
    half, quarter = F.floor(d / 2).cast("int"), F.floor(d / 4).cast("int")
    down, along = 2 * (F.col("y") + 0.5) / h - 1, 2 * (F.col("x") + 0.5) / w - 1

    def turned(i):
        j = i % half
        place = F.when(j < quarter, down).otherwise(along)
        angle = 2 * math.pi * place / F.pow(F.lit(base), (j % quarter) / quarter)
        other = F.when(i < half, -F.get("v", i + half)).otherwise(F.get("v", i - half))
        return F.get("v", i) * F.cos(angle) + other * F.sin(angle)

    return rows.withColumn("v", F.transform(F.sequence(F.lit(0), d - 1), turned)).select(*local.columns)


def combined_mass(values: DataFrame, keep: float = 0.5) -> DataFrame:
    """``attention_mass`` of the heads' sum: ``(pos, kept)`` from ``(head, pos, x)``."""
    summed = values.groupBy("pos").agg(F.sum("x").alias("x")).withColumn("head", F.lit(0))
    return attention_mass(summed, keep).select("pos", "kept")


def pixels(image: DataFrame, mean: tuple[float, ...] = (0.485, 0.456, 0.406), std: tuple[float, ...] = (0.229, 0.224, 0.225)) -> DataFrame:
    """``v`` of each pixel, a value a channel, from normalised values back to 0 to 255 (rounded down, kept within)."""
    m, s = (F.array(*[F.lit(float(x)) for x in c]) for c in (mean, std))
    raw = F.zip_with(F.zip_with("v", s, lambda x, y: x * y), m, lambda x, y: x + y)
    return image.withColumn("v", F.transform(raw, lambda x: F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")))
