"""Aggregators with fitted parameters, by name, and the rest of the encoder: batch norm, whitening, unit length.

Parameters are arrays of fixed size that a model brings along; ``read_parameters`` takes them from a table ``(name, row, v)``.
Positions are processed in Arrow batches and leave them as sums by image.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import pooling as PL
from .blocks import merged_peak
from .numbering import numbered

Parameters = dict[str, np.ndarray]


def read_parameters(table: DataFrame) -> Parameters:
    """Matrices by name from ``(name, row, v)``; a name with one row is a vector all the same a matrix of one row."""
    out: dict[str, list] = {}
    for r in table.orderBy("name", "row").collect():
        out.setdefault(r["name"], []).append(r["v"])
    return {n: np.array(rows, np.float64) for n, rows in out.items()}


def layers(params: Parameters, name: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """``name.0.w``, ``name.0.b``, ``name.1.w`` ... as (weight, bias) pairs."""
    found = []
    while f"{name}.{len(found)}.w" in params:
        at = len(found)
        w = np.atleast_2d(params[f"{name}.{at}.w"])
        found.append((w, np.ravel(params.get(f"{name}.{at}.b", np.zeros(len(w))))))
    return found


def mlp(x: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Linear layers with max(0, .) between them."""
    for at, (w, b) in enumerate(parts):
        x = x @ w.T + b
        if at + 1 < len(parts):
            x = np.maximum(x, 0.0)
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), V.EPS)


def layer_norm(x: np.ndarray, weight: np.ndarray | None = None, bias: np.ndarray | None = None, eps: float = 1e-5) -> np.ndarray:
    y = (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + eps)
    return y * (1.0 if weight is None else np.ravel(weight)) + (0.0 if bias is None else np.ravel(bias))


def attention(q: np.ndarray, x: np.ndarray, p: Parameters, name: str, heads: int) -> np.ndarray:
    """Attention of rows q over rows x: ``name.q``, ``.k``, ``.v``, ``.o`` with biases ``.bq`` and so on."""
    project = lambda rows, k: rows @ p[f"{name}.{k}"].T + np.ravel(p.get(f"{name}.b{k}", np.zeros(len(p[f"{name}.{k}"]))))
    split = lambda rows: rows.reshape(len(rows), heads, -1).transpose(1, 0, 2)
    a, b, v = split(project(q, "q")), split(project(x, "k")), split(project(x, "v"))
    out = softmax(a @ b.transpose(0, 2, 1) / np.sqrt(a.shape[-1])) @ v
    return project(out.transpose(1, 0, 2).reshape(len(q), -1), "o")


def encoder_layer(x: np.ndarray, p: Parameters, name: str, heads: int, gelu: bool = False) -> np.ndarray:
    """Self-attention and two linear layers, each added to its input and normalised."""
    x = layer_norm(x + attention(x, x, p, f"{name}.attn", heads), p.get(f"{name}.n1.w"), p.get(f"{name}.n1.b"))
    (w1, b1), (w2, b2) = layers(p, f"{name}.ff")
    h = x @ w1.T + b1
    if gelu:
        from math import erf

        h = h * 0.5 * (1 + np.vectorize(erf)(h / np.sqrt(2)))
    else:
        h = np.maximum(h, 0.0)
    return layer_norm(x + h @ w2.T + b2, p.get(f"{name}.n2.w"), p.get(f"{name}.n2.b"))


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x, np.float64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int64) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def mapped(df: DataFrame, f: Callable[[np.ndarray], np.ndarray], vec: str = "v") -> DataFrame:
    """``f`` of the rows of vectors, batch by batch; rows without a vector, or with a null in it, are left out."""
    names = [c for c in df.columns if c != vec]
    rows = df.filter(F.col(vec).isNotNull() & F.forall(vec, lambda x: x.isNotNull())).select(*names, V.as_vector(vec).alias(vec))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], _lists(f(_rows(b.columns[-1])))], names=b.schema.names)

    return rows.mapInArrow(run, rows.schema)


def soft_gate(p: Parameters) -> Callable[[np.ndarray], np.ndarray]:
    """Vectors scaled by 1 + alpha times a learned function of their length."""
    parts, alpha = layers(p, "softp"), float(np.ravel(p.get("softp.alpha", np.ones(1)))[0])
    return lambda x: x * (1 + alpha * sigmoid(mlp(np.linalg.norm(x, axis=-1, keepdims=True) + 1e-6, parts)))


def learned_vlad(local: DataFrame, p: Parameters, ghosts: int = 0, subtract: bool = True, normalize: bool = True) -> DataFrame:
    """Softmax assignment by ``assign.w`` and ``assign.b``, (residual) sums against ``centers``, unit length by cluster, in a row.

    With ``softp.*`` the learned gate takes the place of unit length at the input; with ``dpn.*`` sums are raised to a
    learned power first. The last ``ghosts`` clusters take part in the assignment alone. ``pooled`` sums leave the tasks: an image is never one group.
    """
    w, b = p["assign.w"], np.ravel(p.get("assign.b", np.zeros(len(p["assign.w"]))))
    kept = len(w) - ghosts
    gate = soft_gate(p) if layers(p, "softp") else unit if normalize else lambda x: x
    power, eps = layers(p, "dpn"), 1e-6

    def sums(x: np.ndarray) -> np.ndarray:
        x = gate(x)
        a = softmax(x @ w.T + b)[:, :kept]
        return np.hstack(((a[:, :, None] * x[:, None]).reshape(len(x), -1), a))

    def finish(s: np.ndarray) -> np.ndarray:
        v, a = s[:, :-kept].reshape(len(s), kept, -1), s[:, -kept:]
        if subtract:
            v = v - a[:, :, None] * p["centers"][:kept]
        if power:
            e = sigmoid(mlp(v.mean(1), power))[:, None]
            v = np.sign(v) * (np.abs(v) + eps) ** e + v
        return unit(v).reshape(len(s), -1)

    return mapped(V.vector_sum(mapped(local.select("image_id", "v"), sums), ["image_id"], "v"), finish)


def attention_pool(local: DataFrame, queries: np.ndarray, p: Parameters, name: str, heads: int) -> DataFrame:
    """``(image_id, query, v)``: learned queries attend to an image's positions.

    What is kept of positions is a peak, the sum of exp(logit - peak) and the values so weighed, for each image, query and head; two
    such parts make a third, so an image may lie in any number of tasks.
    """
    project = lambda rows, k: rows @ p[f"{name}.{k}"].T + np.ravel(p.get(f"{name}.b{k}", np.zeros(len(p[f"{name}.{k}"]))))
    q = project(queries, "q").reshape(len(queries), heads, -1)
    rows = local.filter(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull())).select(F.col("image_id").cast("long").alias("image_id"), V.as_vector("v").alias("v"))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, image = _rows(batch.column(1)), batch.column(0).to_numpy()
            k, v = (project(x, c).reshape(len(x), heads, -1) for c in "kv")
            z = np.einsum("qhd,nhd->nqh", q, k) / np.sqrt(q.shape[-1])
            order = np.argsort(image, kind="stable")
            starts = np.flatnonzero(np.diff(image[order], prepend=image[order][:1] - 1))
            z, v, count = z[order], v[order], np.diff(np.append(starts, len(x)))
            peak = np.maximum.reduceat(z, starts, axis=0)
            e = np.exp(z - np.repeat(peak, count, axis=0))
            held = np.add.reduceat(np.concatenate((e[..., None] * v[:, None], e[..., None]), -1), starts, axis=0)
            i, a, h = (c.ravel() for c in np.indices(peak.shape))
            yield pa.RecordBatch.from_arrays(
                [pa.array(image[order][starts][i]), pa.array(a, pa.int32()), pa.array(h, pa.int32()), pa.array(peak.ravel()), _lists(held.reshape(len(i), -1))], names=["image_id", "query", "head", "m", "v"]
            )

    keys = ["image_id", "query", "head"]
    held = merged_peak(rows.mapInArrow(parts, "image_id long, query int, head int, m double, v array<double>"), "m", keys)
    sums = V.vector_sum(held, keys, "v", F.exp(F.col("m") - F.col("_top")))
    each = mapped(sums, lambda s: s[:, :-1] / s[:, -1:])
    joined = each.groupBy("image_id", "query").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("head", "v"))), lambda s: s["v"])).alias("v"))
    return mapped(joined, lambda x: project(x, "o"))


def convolve(local: DataFrame, weight: np.ndarray, bias: np.ndarray) -> DataFrame:
    """3 by 3 convolution with zeros outside: ``weight`` is (3, 3, out, in) by row and column offset. ``(image_id, pos, x, y, v)``."""
    places = local.select("image_id", "pos", "x", "y")
    rows = local.filter(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull())).select("image_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), V.as_vector("v").alias("v"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, v = b.column(1).to_numpy(), b.column(2).to_numpy(), _rows(b.column(3))
            for dy in range(3):
                for dx in range(3):
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x + 1 - dx), pa.array(y + 1 - dy), _lists(v @ weight[dy, dx].T)], names=b.schema.names)

    summed = V.vector_sum(rows.mapInArrow(spread, rows.schema), ["image_id", "x", "y"], "v")
    return mapped(places.join(summed, ["image_id", "x", "y"]), lambda s: s + bias)


def _within(rows: DataFrame, keys: list[str], order: str, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``f`` of the vectors of a group in order; groups are images' positions or fixed batches of images."""
    own = rows.select(*keys, order, V.as_vector("v").alias("v"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order).combine_chunks()
        return table.set_column(table.schema.get_field_index("v"), "v", _lists(f(_rows(table.column("v").combine_chunks()))))

    return own.groupBy(*keys).applyInArrow(run, own.schema)


def query_bags(local: DataFrame, p: Parameters, heads: int, blocks: int) -> DataFrame:
    """Convolution, layer norm, then ``blocks`` times: an encoder layer over the image's positions, and learned queries that
    attend to them; a linear layer mixes the queries of all blocks. Output runs by component, then by mixed row."""
    side = p["conv.w"]
    width = side.shape[1] // 9
    w = side.reshape(len(side), 3, 3, width).transpose(1, 2, 0, 3)
    rows = mapped(convolve(local, w, np.ravel(p["conv.b"])), lambda x: layer_norm(x, p.get("norm.w"), p.get("norm.b")))
    found = None
    for at in range(blocks):
        name = f"block{at}"
        rows = _within(rows, ["image_id"], "pos", lambda x, n=name: encoder_layer(x, p, f"{n}.encoder", heads))
        q = p[f"{name}.queries"]
        q = layer_norm(q + attention(q, q, p, f"{name}.self", heads), p.get(f"{name}.nq.w"), p.get(f"{name}.nq.b"))
        out = attention_pool(rows, q, p, f"{name}.cross", heads)
        out = mapped(out, lambda x, n=name: layer_norm(x, p.get(f"{n}.no.w"), p.get(f"{n}.no.b"))).withColumn("query", F.col("query") + at * len(q))
        found = out if found is None else found.unionByName(out)
    mix, bias = p["fc.w"], np.ravel(p.get("fc.b", np.zeros(len(p["fc.w"]))))
    listed = found.groupBy("image_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("query", "v"))), lambda s: s["v"])).alias("v"))
    return mapped(listed, lambda x: (np.einsum("rq,nqd->ndr", mix, x.reshape(len(x), mix.shape[1], -1)) + bias).reshape(len(x), -1))


def region_tokens(local: DataFrame, width: int, height: int, p: float = 3.0, eps: float = 1e-6, normalize: bool = True) -> DataFrame:
    """``(image_id, token, v)``: the class vector as token 0, then generalized means over a 2 by 2 and a 3 by 3 grid, row by row."""
    patches = local.filter("not is_cls")
    if normalize:
        patches = mapped(patches, unit)
    tokens = PL.class_token(local).select("image_id", F.lit(0).alias("token"), "v")
    first = 1
    for n in (2, 3):
        cells = PL.grid_cell(patches, width, height, n, n).select("image_id", (F.lit(first) + F.col("j") * n + F.col("i")).cast("int").alias("token"), "v")
        raised = mapped(cells, lambda x: np.maximum(x, eps) ** p)
        tokens = tokens.unionByName(mapped(V.vector_mean(raised, ["image_id", "token"], "v"), lambda x: x ** (1 / p)))
        first += n * n
    return tokens


def across_images(local: DataFrame, p: Parameters, heads: int, blocks: int, width: int, height: int, batch: int = 64) -> DataFrame:
    """The fourteen region tokens, each encoded among the same token of the other images of its batch, in a row.

    Batches are ``batch`` images that follow each other by id, so a result depends on its batch and on nothing else.
    """
    tokens = region_tokens(local, width, height)
    order = numbered(tokens.select("image_id").distinct(), ["image_id"]).select("image_id", F.floor(F.col("number") / batch).alias("batch"))

    def encode(x: np.ndarray) -> np.ndarray:
        for at in range(blocks):
            x = encoder_layer(x, p, f"encoder{at}", heads, gelu=True)
        return x

    met = _within(tokens.join(order, "image_id"), ["batch", "token"], "image_id", encode)
    return met.groupBy("image_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("token", "v"))), lambda s: s["v"])).alias("v"))


def optimal_transport(local: DataFrame, p: Parameters, bin_score: float = 1.0, rounds: int = 3) -> DataFrame:
    """``salad`` with learned scores, features and class projection: ``score.*``, ``feature.*``, ``token.*``."""
    return PL.salad(local, lambda x: mlp(x, layers(p, "score")), lambda x: mlp(x, layers(p, "feature")), lambda x: mlp(x, layers(p, "token")), bin_score, rounds)


def linear_head(local: DataFrame, p: Parameters, power: float = 3.0, eps: float = 1e-6) -> DataFrame:
    """Unit local vectors, generalized mean with clamping, linear layer, unit length."""
    ((w, b),) = layers(p, "fc")
    pooled = PL.generalized_mean(mapped(local.select("image_id", "v"), unit), power, eps, clamp=True)
    return mapped(pooled, lambda x: unit(x @ w.T + b))


AGGREGATORS: dict[str, Callable[..., DataFrame]] = {
    "avg": lambda local, p: PL.average(local),
    "cls": lambda local, p: PL.class_token(local),
    "gem": lambda local, p, **o: PL.generalized_mean(local, **o),
    "cosplace": linear_head,
    "eigenplace": linear_head,
    "netvlad": learned_vlad,
    "ghostvlad": learned_vlad,
    "supervlad": lambda local, p, **o: learned_vlad(local, p, subtract=False, **o),
    "salad": optimal_transport,
    "boq": query_bags,
    "cricavpr": across_images,
}
#: Those that need a class token, and those to which the class token is no position.
NEED_CLASS_TOKEN = ("cls", "salad", "cricavpr")


def encode(name: str, local: DataFrame, params: Parameters | None = None, final_norm: bool = True, **options) -> DataFrame:
    """``(image_id, v)`` by a named aggregator, then what the parameters bring: ``bn.w``, ``bn.b``, ``bn.mean``, ``bn.var``;
    ``whiten.w`` (rows are axes) and ``whiten.b``; and unit length unless ``final_norm`` is off.

    ``local`` holds ``(image_id, pos, x, y, v)``, and ``is_cls`` where class tokens come along; aggregators that use none leave those rows out.
    """
    if name not in AGGREGATORS:
        raise ValueError(f"unknown aggregator {name!r}; known: {', '.join(sorted(AGGREGATORS))}")
    has_token = "is_cls" in local.columns
    if name in NEED_CLASS_TOKEN and not has_token:
        raise ValueError(f"{name} needs class tokens")
    p = params or {}
    out = AGGREGATORS[name](local if name in NEED_CLASS_TOKEN or not has_token else local.filter("not is_cls"), p, **options)

    def finish(x: np.ndarray) -> np.ndarray:
        if "bn.mean" in p:
            x = (x - p["bn.mean"]) / np.sqrt(p["bn.var"] + 1e-5) * p.get("bn.w", 1.0) + p.get("bn.b", 0.0)
        if "whiten.w" in p:
            x = x @ p["whiten.w"].T + p.get("whiten.b", 0.0)
        return unit(x) if final_norm else x

    return mapped(out.select("image_id", "v"), finish)
