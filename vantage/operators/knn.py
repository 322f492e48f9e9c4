"""Exact nearest-neighbour search in blocks, and ranks of stated pairs without a full ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.storage import materialize, measured
from .sweep import Rows, streamed

#: BLAS sums in another order than ours; what is this close is compared by our own sum.
_CLOSE = 1e-9


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _vectors(table: pa.Table, metric: str) -> np.ndarray:
    """Vectors as they are compared: at unit length for cosines, lengths summed from the first component on."""
    v = _matrix(table, "v")
    return v if metric != "cosine" else v / np.maximum(np.sqrt(_in_order(v, v, metric)), V.EPS)[:, None]


def _in_order(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Similarity of paired rows, summed from the first component on; distances count negative."""
    total = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]))
    for i in range(a.shape[-1]):
        d = a[..., i] * b[..., i] if metric == "cosine" else (a[..., i] - b[..., i]) ** 2
        total = total + d
    return total if metric == "cosine" else -np.sqrt(total)


def _rough(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        return q @ x.T
    return -np.sqrt(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * q @ x.T, 0))


def _order(q: np.ndarray, x: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """A number that falls as gallery rows get farther, by BLAS, and for each query how far off it may be. Distances stay squared,
    as the root of a small difference of large numbers would be off by far more."""
    if metric == "cosine":
        return q @ x.T, np.full(len(q), _CLOSE)
    lengths, others = (q * q).sum(1), (x * x).sum(1)
    return 2 * q @ x.T - lengths[:, None] - others[None], 1e-12 * (lengths + others.max(initial=0))


_NONE = np.iinfo(np.int64).max


def _first(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of each row, ties to smaller ids."""
    for values in (ids, None):
        order = np.argsort(-sims if values is None else values, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    return ids[:, :k], sims[:, :k]


def _best(q: np.ndarray, qid: np.ndarray, x: np.ndarray, gid: np.ndarray, k: int, metric: str, exclude_self: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids and similarities of the ``k`` best rows for each query, best first; places that stay empty hold -inf.

    BLAS products shortlist; what decides is summed in order. Only a query with more rows near the edge of its shortlist than fit is
    looked at on its own.
    """
    take = min(len(x), k + 1 + k // 2 + 8)
    step = max(1, min(1024, (1 << 22) // max(1, len(x), take * x.shape[1] // 8)))
    ids, sims = np.full((len(q), min(k, take)), _NONE), np.full((len(q), min(k, take)), -np.inf)
    for at in range(0, len(q), step):
        some, own = q[at : at + step], qid[at : at + step]
        rough, off = _order(some, x, metric)
        if exclude_self:
            rough[own[:, None] == gid[None]] = -np.inf
        near = np.argpartition(-rough, take - 1, axis=1)[:, :take] if take < len(x) else np.tile(np.arange(len(x)), (len(some), 1))
        exact = _in_order(some[:, None], x[near], metric)
        if exclude_self:
            exact[gid[near] == own[:, None]] = -np.inf
        ids[at : at + step], sims[at : at + step] = _first(gid[near], exact, k)
        if take < len(x):
            edge = np.take_along_axis(rough, near, 1).min(1) - 2 * off
            for r in np.flatnonzero((rough >= edge[:, None]).sum(1) > take):
                tied = np.flatnonzero(rough[r] >= edge[r])
                tied = tied[gid[tied] != own[r]] if exclude_self else tied
                i, s = _first(gid[tied][None], _in_order(some[r][None], x[tied], metric)[None], k)
                ids[at + r], sims[at + r] = _NONE, -np.inf
                ids[at + r, : i.shape[1]], sims[at + r, : i.shape[1]] = i[0], s[0]
    return ids, sims


def _better_yet(
    q: np.ndarray, qid: np.ndarray, x: np.ndarray, gid: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int, metric: str, exclude_self: bool
) -> tuple[np.ndarray, np.ndarray]:
    """``ids`` and ``sims``, the best so far, with those that are better among more rows. Only rows as near as a query's ``k``-th are compared exactly."""
    if ids.shape[1] < k:
        more = _best(q, qid, x, gid, k, metric, exclude_self)
        return _first(np.hstack((ids, more[0])), np.hstack((sims, more[1])), k)
    ids, sims, step = ids.copy(), sims.copy(), max(1, min(512, (1 << 22) // max(1, len(x))))
    for at in range(0, len(q), step):
        s = slice(at, at + step)
        rough, off = _order(q[s], x, metric)
        last = sims[s, -1]
        row, to = np.nonzero(rough >= ((last if metric == "cosine" else -last * last) - 2 * off)[:, None])
        if exclude_self:
            other = gid[to] != qid[s][row]
            row, to = row[other], to[other]
        if not len(row):
            continue
        counts = np.bincount(row, minlength=len(rough))
        if len(row) > 64 * len(rough) or counts.max() > 1024:  # many are as near
            more = _best(q[s], qid[s], x, gid, k, metric, exclude_self)
        else:
            place = np.arange(len(row)) - (np.cumsum(counts) - counts)[row]
            more = np.full((len(rough), counts.max()), _NONE), np.full((len(rough), counts.max()), -np.inf)
            more[0][row, place], more[1][row, place] = gid[to], _in_order(q[s][row], x[to], metric)
        some = np.flatnonzero(counts)
        ids[at + some], sims[at + some] = _first(np.hstack((ids[at + some], more[0][some])), np.hstack((sims[at + some], more[1][some])), k)
    return ids, sims


_FOUND = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("sim", pa.float64())])


def _listed(qid: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> list[pa.Array]:
    there = sims > -np.inf
    return [pa.array(np.broadcast_to(qid[:, None], ids.shape)[there]), pa.array(ids[there]), pa.array(sims[there])]


def _nearest(k: int, metric: str, exclude_self: bool):
    """The ``k`` best of a block of queries, of gallery rows that come a block at a time."""

    def fold(mine: Rows, others: Iterator[Rows]) -> dict[str, np.ndarray | pa.Array]:
        ids, sims = np.empty((len(mine.ids), 0), np.int64), np.empty((len(mine.ids), 0))
        for some in others:
            ids, sims = _better_yet(mine.v, mine.ids, some.v, some.ids, ids, sims, k, metric, exclude_self)
        return dict(zip(_FOUND.names, _listed(mine.ids, ids, sims)))

    return fold


def _in_blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches put together to tables of about ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if sum(map(len, held)):
        yield pa.Table.from_batches(held)


def _scan(asked: Broadcast, k: int, metric: str, exclude_self: bool, block: int):
    """One pass over a part of the gallery, which keeps the ``k`` best of each query as it goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = asked.value
        ids, sims = np.empty((len(qid), 0), np.int64), np.empty((len(qid), 0))
        for table in _in_blocks(batches, block):
            ids, sims = _better_yet(q, qid, _vectors(table, metric), table.column("id").to_numpy(), ids, sims, k, metric, exclude_self)
        yield pa.RecordBatch.from_arrays(_listed(qid, ids, sims), schema=_FOUND)

    return run


#: Query sets up to so many bytes go to every task whole; larger ones meet the gallery block by block.
BROADCAST_BYTES = 32 << 20


def _gathered(queries: DataFrame, metric: str, limit: int) -> tuple[int, tuple[np.ndarray, np.ndarray] | None]:
    """How many queries there are, and ids and matrix of a set that is small enough."""
    size = queries.agg(F.count("*").alias("n"), F.sum(F.size("v") + 1).alias("c")).first()
    if not size["n"] or 8 * size["c"] > limit:
        return size["n"], None
    table = queries.toArrow()
    return size["n"], (table.column("id").to_numpy(), _vectors(table, metric))


def _blocks(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
    dealt = df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n_own)))
    return dealt.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_other - 1).cast("long"))))


def prepare(df: DataFrame, id_col: str = "id", vec_col: str = "v") -> DataFrame:
    """``id`` and ``v``; rows with a null vector, or one with a null component, have no place in a search."""
    whole = F.col(vec_col).isNotNull() & F.forall(vec_col, lambda x: x.isNotNull())
    return df.filter(whole).select(F.col(id_col).cast("long").alias("id"), V.as_vector(vec_col).alias("v"))


def knn(
    queries: DataFrame, gallery: DataFrame, k: int, metric: str = "cosine", exclude_self: bool = False, block: int = 4096, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """``(src, rank, dst, sim)``: the ``k`` best gallery rows of each query, rank 1 best, ties to smaller ids.

    Both sides hold ``id`` and ``v``. Cosine normalises them; any other metric is Euclidean distance, ``sim``
    then being its negative. A query set of at most ``limit`` bytes, which is measured first, goes to all tasks, and the gallery
    is read once, where it lies. Of a larger one, each block meets the whole gallery block by block in one task, so both sides are
    shuffled once, however large they are. Either way a task keeps ``k`` rows a query, a window merges them, and no ranking is held whole.
    """
    metric = "cosine" if metric == "cosine" else "l2"
    qs, gs = prepare(queries), prepare(gallery)
    held = _gathered(qs, metric, limit)[1]
    if held:
        found = gs.mapInArrow(_scan(queries.sparkSession.sparkContext.broadcast(held), k, metric, exclude_self, block), "src long, dst long, sim double")
        return _ranked(found, k)
    sides = [t.select("id", F.lit(0).alias("g"), "v") for t in (qs, gs)]
    return _ranked(streamed(*sides, _nearest(k, metric, exclude_self), "src long, dst long, sim double", metric, block), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("sim"), "dst"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("src", "rank", "dst", "sim")


def knn_self(features: DataFrame, k: int, metric: str = "cosine", exclude_self: bool = False, block: int = 4096, limit: int = BROADCAST_BYTES) -> DataFrame:
    return knn(features, features, k, metric, exclude_self, block, limit)


def topk_neighbours(features: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """Exactly ``k`` neighbours of every row, itself not among them; a table of ``k`` rows or fewer is an error."""
    if features.limit(k + 1).count() <= k:
        raise ValueError(f"{k} neighbours need more than {k} rows")
    return knn_self(features, k, metric, exclude_self=True)


def _better(q: np.ndarray, qid: int, rough: np.ndarray, x: np.ndarray, gid: np.ndarray, by_id: np.ndarray, want: np.ndarray, sims: np.ndarray, metric: str, exclude_self: bool) -> np.ndarray:
    """How many gallery rows come before each stated one (``want``, ``sims``) of a query."""
    use = rough if not exclude_self else np.where(gid == qid, -np.inf, rough)
    order = np.sort(use)
    hi = np.searchsorted(order, sims + _CLOSE, side="right")
    lo = np.searchsorted(order, sims - _CLOSE, side="left")
    better = len(use) - hi
    at_id = by_id[np.minimum(np.searchsorted(gid, want, sorter=by_id), len(gid) - 1)]
    itself = (gid[at_id] == want) & (np.abs(use[at_id] - sims) <= _CLOSE)
    for i in np.flatnonzero(hi - lo > itself):  # others this close
        near = np.flatnonzero(np.abs(use - sims[i]) <= _CLOSE)
        near = near[gid[near] != want[i]]
        if len(near):
            s = _in_order(q[None], x[near], metric)
            better[i] += int(((s > sims[i]) | ((s == sims[i]) & (gid[near] < want[i]))).sum())
    return better


_COUNTED = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("better", pa.int64())])


def _beaten(metric: str, exclude_self: bool):
    def run(queries: pa.Table, gallery: pa.Table) -> pa.Table:
        if not len(queries) or not len(gallery):
            return _COUNTED.empty_table()
        q, x = _vectors(queries, metric), _vectors(gallery, metric)
        qid, gid = queries.column("id").to_numpy(), gallery.column("id").to_numpy()
        refs, parts = queries.column("refs").combine_chunks(), []
        by_id = np.argsort(gid, kind="stable")
        for at in range(0, len(q), 256):
            rough = _rough(q[at : at + 256], x, metric)
            for r in range(len(rough)):
                mine = refs[at + r].values
                want = mine.field("dst").to_numpy()
                better = _better(q[at + r], qid[at + r], rough[r], x, gid, by_id, want, mine.field("sim").to_numpy(), metric, exclude_self)
                parts.append((np.full(len(want), qid[at + r]), want, better))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], schema=_COUNTED)

    return run


def _stated_sims(asked: Broadcast, metric: str):
    """Similarities of gallery rows with the queries that name them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = asked.value
        by_id = np.argsort(qid, kind="stable")
        for batch in batches:
            table = pa.Table.from_batches([batch])
            lists, x = table.column("asked").combine_chunks(), _vectors(table, metric)
            src, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            at = by_id[np.minimum(np.searchsorted(qid, src, sorter=by_id), len(qid) - 1)]
            known = qid[at] == src
            src, row, at = src[known], row[known], at[known]
            for i in range(0, len(src), 65536):
                cut = slice(i, i + 65536)
                sims = _in_order(q[at[cut]], x[row[cut]], metric)
                yield pa.RecordBatch.from_arrays([pa.array(src[cut]), pa.array(table.column("id").to_numpy()[row[cut]]), pa.array(sims)], schema=_FOUND)

    return run


def _beaten_scan(asked: Broadcast, stated: Broadcast, metric: str, exclude_self: bool, block: int):
    """One pass over a part of the gallery, which counts for all stated pairs at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (qid, q), (src, dst, sims, starts) = asked.value, stated.value
        by_id = np.argsort(qid, kind="stable")
        row = by_id[np.searchsorted(qid, src[starts[:-1]], sorter=by_id)]
        better = np.zeros(len(dst), np.int64)
        for table in _in_blocks(batches, block):
            x, gid = _vectors(table, metric), table.column("id").to_numpy()
            order = np.argsort(gid, kind="stable")
            for at in range(0, len(row), 256):
                rough = _rough(q[row[at : at + 256]], x, metric)
                for r in range(len(rough)):
                    own = slice(starts[at + r], starts[at + r + 1])
                    better[own] += _better(q[row[at + r]], src[starts[at + r]], rough[r], x, gid, order, dst[own], sims[own], metric, exclude_self)
        yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(sims), pa.array(better)], names=["src", "dst", "sim", "better"])

    return run


def pair_ranks(
    queries: DataFrame, gallery: DataFrame, pairs: DataFrame, metric: str = "cosine", exclude_self: bool = False, block: int = 4096, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """``(src, dst, sim, rank)`` of the stated pairs: the rank of dst in the full ranking for src, 1 best.

    The ranking itself is never formed: each task counts how many of its gallery rows come before each stated one, and
    the counts are summed. Queries, and then stated pairs, of at most ``limit`` bytes go to all tasks, which read the
    gallery where it lies; larger sets meet it in blocks. Pairs whose rows are missing are left out; with
    ``exclude_self`` a query is no part of its own ranking.
    """
    metric = "cosine" if metric == "cosine" else "l2"
    qs, gs = prepare(queries), prepare(gallery)
    n, held = _gathered(qs, metric, limit)
    stated = pairs.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct()
    if exclude_self:
        stated = stated.filter("src <> dst")
    if held:
        sc = queries.sparkSession.sparkContext
        asked = sc.broadcast(held)
        by_row = stated.groupBy(F.col("dst").alias("id")).agg(F.collect_list("src").alias("asked"))  # no longer than the query set
        sims = gs.join(by_row, "id").select("id", "v", "asked").mapInArrow(_stated_sims(asked, metric), "src long, dst long, sim double")
        stated, seen = measured(sims, "stated", n=F.count(F.lit(1)))
        if 32 * seen["n"] <= limit:
            table = stated.toArrow().sort_by([("src", "ascending"), ("dst", "ascending")])
            src, dst, sim = (table.column(c).to_numpy() for c in ("src", "dst", "sim"))
            starts = np.append(np.flatnonzero(np.diff(src, prepend=src[:1] - 1)), len(src))
            given = sc.broadcast((src, dst, sim, starts))
            counts = gs.mapInArrow(_beaten_scan(asked, given, metric, exclude_self, block), "src long, dst long, sim double, better long")
            return counts.groupBy("src", "dst").agg(F.first("sim").alias("sim"), (F.sum("better") + 1).alias("rank"))
    else:
        unit = V.normalize(F.col("v")) if metric == "cosine" else F.col("v")
        sim = V.dot(F.col("qv"), F.col("gv")) if metric == "cosine" else -V.l2(F.col("qv"), F.col("gv"))
        stated = (
            stated.join(qs.select(F.col("id").alias("src"), unit.alias("qv")), "src")
            .join(gs.select(F.col("id").alias("dst"), unit.alias("gv")), "dst")
            .select("src", "dst", sim.alias("sim"))
        )
        stated = materialize(stated, "stated")
    nq, ng = max(1, -(-n // block)), max(1, -(-gs.count() // block))
    listed = stated.groupBy("src").agg(F.collect_list(F.struct("dst", "sim")).alias("refs"))
    q, g = _blocks(qs.join(listed.withColumnRenamed("src", "id"), "id"), "qb", nq, "gb", ng), _blocks(gs, "gb", ng, "qb", nq)
    counts = q.groupBy("qb", "gb").cogroup(g.groupBy("qb", "gb")).applyInArrow(_beaten(metric, exclude_self), "src long, dst long, better long")
    ranks = counts.groupBy("src", "dst").agg((F.sum("better") + 1).alias("rank"))
    return stated.join(ranks, ["src", "dst"]).select("src", "dst", "sim", "rank")


def neighbour_labels(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges with ``is_pos``: whether both ends carry the same label (``id``, ``label``)."""
    a = labels.select(F.col("id").alias("src"), F.col("label").alias("_a"))
    b = labels.select(F.col("id").alias("dst"), F.col("label").alias("_b"))
    return edges.join(a, "src").join(b, "dst").withColumn("is_pos", F.col("_a") == F.col("_b")).drop("_a", "_b")


def reciprocal(edges: DataFrame, window: int) -> DataFrame:
    """Edges of rank up to ``window`` whose reverse is one too."""
    inside = edges.filter(F.col("rank") <= window)
    back = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return inside.join(back, ["src", "dst"], "left_semi")


def neighbour_sequences(edges: DataFrame, features: DataFrame) -> DataFrame:
    """Each source's vector followed by its neighbours' vectors, best first."""
    f = features.select(F.col("id").alias("dst"), V.as_vector("v").alias("v"))
    rows = edges.select("src", "rank", "dst").unionByName(edges.select("src", F.lit(0).alias("rank"), F.col("src").alias("dst")).distinct()).join(f, "dst")
    seq = F.array_sort(F.collect_list(F.struct("rank", "dst", "v")))
    return rows.groupBy("src").agg(seq.alias("_s")).select("src", F.transform("_s", lambda s: s["dst"]).alias("ids"), F.transform("_s", lambda s: s["v"]).alias("sequence"))
