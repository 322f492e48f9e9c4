"""Overlap graphs of scenes: ``node(scene, idx)`` and ``edge(scene, u, v, w)``."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import rounded
from ..sources.storage import materialize
from .numbering import numbered
from .sweep import by_row, swept


class Overlaps:
    """The edges of a symmetric overlap graph, worked out where they are asked for: ``nodes(scene, idx, v)``, both whole numbers, and the
    cosine of two unit vectors ``v`` as weight, 1 at most, where it is ``least`` or more. No table of all edges is made unless it is the result.
    """

    def __init__(self, nodes: DataFrame, least: float):
        self.nodes, self.least = nodes.select("scene", "idx", "v"), least

    def each(self, f: Callable[[int, int, np.ndarray, np.ndarray], dict], schema: str, left: DataFrame | None = None, right: DataFrame | None = None) -> DataFrame:
        """``(scene, *schema)``: what ``f(scene, u, neighbours, weights)`` makes of each node, or of those of ``left`` with those of ``right``."""
        least = self.least

        def near(scene, u, ids, sims):
            kept = sims >= least
            return f(scene, u, ids[kept], np.clip(sims[kept], 0.0, 1.0))

        sides = [self.nodes if t is None else self.nodes.join(t.select("scene", "idx").distinct(), ["scene", "idx"], "left_semi") for t in (left, right)]
        sides = [t.select(F.col("idx").alias("id"), F.col("scene").alias("g"), "v") for t in sides]
        return swept(*sides, by_row(near, every=least == float("-inf")), f"g long, {schema}", "dot", within=True).withColumnRenamed("g", "scene")

    def edges(self, left: DataFrame | None = None, right: DataFrame | None = None, digits: int | None = None) -> DataFrame:
        """``(scene, u, v, w)``, all of them or those from ``left`` to ``right``; ``w`` rounded to ``digits`` if wanted."""
        return self.each(lambda scene, u, ids, w: {"u": u, "v": ids, "w": w if digits is None else rounded(w, digits)}, "u long, v long, w double", left, right)

    def degrees(self, threshold: float) -> DataFrame:
        """``(scene, idx, n_pos)`` of every node."""
        return self.each(lambda scene, u, ids, w: {"idx": u, "n_pos": int((w >= threshold).sum())}, "idx long, n_pos long")


def _some_edges(edges: DataFrame | Overlaps, left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """Edges that hold all those from ``left`` to ``right``; of a table, the table itself."""
    return edges.edges(left, right) if isinstance(edges, Overlaps) else edges


def symmetrize(edges: DataFrame) -> DataFrame:
    """Edges both ways, weights within 0 and 1, no self loops; of repeated edges, either way round, the largest weight."""
    e = edges.filter("u <> v").withColumn("w", F.least(F.greatest(F.col("w"), F.lit(0.0)), F.lit(1.0)))
    both = e.unionByName(e.select("scene", F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    return both.groupBy("scene", "u", "v").agg(F.max("w").alias("w"))


def neighbor_lists(nodes: DataFrame, edges: DataFrame, threshold: float, distinct: bool = True) -> DataFrame:
    """Sorted neighbours at ``threshold`` or more of every node; nodes without any get an empty list."""
    if isinstance(edges, Overlaps):
        lists = edges.each(lambda scene, u, ids, w: {"idx": u, "neighbors": [np.sort(ids[w >= threshold])]}, "idx long, neighbors array<bigint>", nodes)
        none = F.array().cast("array<bigint>")
        if set(nodes.columns) != {"scene", "idx"}:
            return nodes.join(lists, ["scene", "idx"], "left").withColumn("neighbors", F.coalesce("neighbors", none))
        found = lists.select(*[F.col(c).cast(nodes.schema[c].dataType).alias(c) for c in nodes.columns], "neighbors")  # lists are not dealt again
        return found.unionByName(nodes.join(edges.nodes.select("scene", "idx"), ["scene", "idx"], "left_anti").withColumn("neighbors", none))
    near = edges.filter(F.col("w") >= threshold).groupBy("scene", F.col("u").alias("idx"))
    lists = near.agg(F.array_sort(F.collect_set("v") if distinct else F.collect_list("v")).alias("neighbors"))
    return nodes.join(lists, ["scene", "idx"], "left").withColumn("neighbors", F.coalesce("neighbors", F.array().cast("array<bigint>")))


def subgraph(edges: DataFrame, chosen: DataFrame, add_self: bool = False) -> DataFrame:
    """Edges among the chosen nodes, renumbered from 0 within each scene; with ``add_self`` a unit diagonal."""
    at = chosen.withColumn("at", F.row_number().over(Window.partitionBy("scene").orderBy("idx")) - 1)
    a = at.select("scene", F.col("idx").alias("u"), F.col("at").alias("i"))
    b = at.select("scene", F.col("idx").alias("v"), F.col("at").alias("j"))
    out = _some_edges(edges, chosen, chosen).join(a, ["scene", "u"]).join(b, ["scene", "v"]).select("scene", "i", "j", "w")
    return out.unionByName(at.select("scene", F.col("at").alias("i"), F.col("at").alias("j"), F.lit(1.0).alias("w"))) if add_self else out


def fetch_nodes(nodes: DataFrame, edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """Every other node of an anchor's scene with the overlap, 0 where there is no edge; of repeated edges the largest."""
    w = _some_edges(edges, anchors).groupBy("scene", "u", "v").agg(F.max("w").alias("w"))
    pairs = anchors.select("scene", F.col("idx").alias("u")).join(nodes.select("scene", F.col("idx").alias("v")), "scene").filter("u <> v")
    return pairs.join(w, ["scene", "u", "v"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))


def degrees(nodes: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """Positives and strict negatives of every node."""
    if isinstance(edges, Overlaps):
        pos = edges.degrees(threshold)
    else:
        pos = edges.filter(F.col("w") >= threshold).groupBy("scene", F.col("u").alias("idx")).agg(F.countDistinct("v").alias("n_pos"))
    size = nodes.groupBy("scene").agg(F.count("*").alias("n"))
    rows = nodes.select("scene", "idx").join(pos, ["scene", "idx"], "left").fillna(0, ["n_pos"]).join(size, "scene")
    return rows.withColumn("n_neg", F.col("n") - 1 - F.col("n_pos"))


def eligible_anchors(nodes: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """Nodes with a positive and a strict negative, in scenes of three nodes or more."""
    return degrees(nodes, edges, threshold).filter("n >= 3 and n_pos >= 1 and n_neg >= 1")


def min_size(nodes: DataFrame, least: int) -> DataFrame:
    """Nodes of scenes with ``least`` images or more (0: all); none left is an error."""
    if not least:
        return nodes
    kept = nodes.join(nodes.groupBy("scene").count().filter(F.col("count") >= least).select("scene"), "scene", "left_semi")
    if kept.isEmpty():
        raise ValueError(f"no scene has {least} images")
    return kept


def positive_ratio(nodes: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """Share of unordered pairs of a scene that are positive."""
    n = F.col("n")
    size = nodes.groupBy("scene").agg(F.count("*").alias("n"))
    if isinstance(edges, Overlaps):
        pos = edges.degrees(threshold).groupBy("scene").agg((F.sum("n_pos") / 2).alias("p"))
    else:
        pos = edges.filter((F.col("w") >= threshold) & (F.col("u") < F.col("v"))).select("scene", "u", "v").distinct().groupBy("scene").agg(F.count("*").alias("p"))
    return size.join(pos, "scene", "left").select("scene", F.when(n > 1, F.coalesce("p", F.lit(0.0)) / (n * (n - 1) / 2)).otherwise(F.lit(0.0)).alias("ratio"))


def samples_of(n: Column, per_sample: int) -> Column:
    """How many samples a scene of n images gives: one, or 1.5 sqrt(n / per_sample) rounded up, eight at most."""
    s = F.ceil(1.5 * F.sqrt(n / F.lit(float(per_sample))))
    return F.when(n <= per_sample, F.lit(1)).otherwise(F.least(F.greatest(s, F.lit(1)), F.lit(8))).cast("int")


def hashed(id_col: Column, seed: int) -> Column:
    """A repeatable order of ids that other engines can compute too."""
    x, factor = id_col + F.lit(seed).cast("long"), F.lit(2654435761)
    low, high = x.bitwiseAND(65535) * factor, F.shiftleft((F.shiftright(x, 16).bitwiseAND(65535) * factor).bitwiseAND(65535), 16)
    return F.pmod(low + high, F.lit(2**32))  # the product modulo 2^32 in parts: no id is too large


def epoch_plan(nodes: DataFrame, per_sample: int, seed: int = 0) -> DataFrame:
    """``(scene, sample, position)``: each scene as often as its size asks, in a hashed order."""
    size = nodes.groupBy("scene").agg(F.count("*").alias("n"))
    rows = size.select("scene", F.explode(F.sequence(F.lit(1), samples_of(F.col("n"), per_sample))).alias("sample"))
    return numbered(rows, [hashed(F.col("scene") * 8 + F.col("sample"), seed), "scene", "sample"], "position")


def reshuffled(nodes: DataFrame, per_sample: int, seed: int, scenes: int | None = None, samples: int | None = None) -> DataFrame:
    """The epoch plan again with another seed: the first ``scenes`` scenes by hashed order alone, if given, and ``samples`` of each
    scene, which sets the number that its size asks for aside."""
    size = nodes.groupBy("scene").agg(F.count("*").alias("n"))
    if scenes is not None:
        size = size.orderBy(hashed(F.col("scene"), seed), "scene").limit(scenes)
    each = samples_of(F.col("n"), per_sample) if samples is None else F.lit(samples)
    rows = size.select("scene", F.explode(F.sequence(F.lit(1), each)).alias("sample"))
    return numbered(rows, [hashed(F.col("scene") * 8 + F.col("sample"), seed), "scene", "sample"], "position")


def tiled_plan(nodes: DataFrame, length: int) -> DataFrame:
    """Scenes over and over up to ``length`` samples."""
    scenes = nodes.select("scene").distinct()
    n = scenes.count()
    at = numbered(scenes, ["scene"], "at")
    turns = at.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(-(-length // max(1, n)) - 1))))
    return turns.withColumn("position", F.col("turn") * n + F.col("at")).filter(F.col("position") < length).select("position", "scene")


def uniform_sample(nodes: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` nodes of each scene by hashed order, or all of a smaller one."""
    rank = F.row_number().over(Window.partitionBy("scene").orderBy(hashed(F.col("idx"), seed), "idx"))
    return nodes.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")


def expand_anchors(nodes: DataFrame, edges: DataFrame, anchors: DataFrame, n: int, hops: int = 3, fan: int = 32, threshold: float = 0.0, seed: int = 0) -> DataFrame:
    """Breadth-first samples ``(scene, idx, hop)`` of at most ``n`` nodes around one anchor a scene.

    In each hop a node of the frontier offers its ``fan`` first neighbours by hashed order; what is
    short of ``n`` is filled from the scene by hashed order, as hop -1.
    """
    first = F.row_number().over(Window.partitionBy("scene", "u").orderBy(hashed(F.col("v"), seed), "v"))

    def offered(front: DataFrame) -> DataFrame:
        e = _some_edges(edges, front).filter(F.col("w") >= threshold).select("scene", "u", "v").distinct()
        return e.withColumn("_r", first).filter(F.col("_r") <= fan).drop("_r")

    seen = anchors.select("scene", "idx", F.lit(0).alias("hop"))
    front = seen
    for hop in range(1, hops + 1):
        if isinstance(edges, Overlaps):
            front = materialize(front, "front")  # at most fan times the one before
        new = offered(front).join(front.select("scene", F.col("idx").alias("u")), ["scene", "u"]).select("scene", F.col("v").alias("idx")).distinct()
        front = new.join(seen.select("scene", "idx"), ["scene", "idx"], "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(front)
    rest = nodes.select("scene", "idx").join(anchors.select("scene"), "scene", "left_semi").join(seen, ["scene", "idx"], "left_anti").withColumn("hop", F.lit(-1))
    order = Window.partitionBy("scene").orderBy(F.col("hop") < 0, "hop", hashed(F.col("idx"), seed), "idx")
    return seen.unionByName(rest).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).drop("_r")


def balanced_sample(nodes: DataFrame, edges: DataFrame, n: int, threshold: float, target: float = 0.5, slack: float = 0.05, seed: int = 0) -> DataFrame:
    """``n`` nodes of each scene, swapped greedily until about half of their pairs are positive.

    Starts from the hashed sample; a round tries the first twenty unused nodes by hashed order in place
    of each chosen one and takes the best swap that gains more than 0.01, up to min(50, scene size)
    rounds. The steps depend on each other, so they are one group; as no more than ``n`` nodes are chosen at any time, only
    the first ``n`` + 20 by hashed order are ever tried, and the group holds these and the edges among them alone.
    """
    own = Window.partitionBy("scene")
    ranked = nodes.select("scene", "idx").withColumn("h", hashed(F.col("idx"), seed))
    tried = ranked.withColumns({"r": F.row_number().over(own.orderBy("h", "idx")), "size": F.count("*").over(own)}).filter(F.col("r") <= n + 20).drop("r")
    ends = tried.select("scene", F.col("idx").alias("v"))
    among = _some_edges(edges, tried, tried).filter(F.col("w") >= threshold).join(ends, ["scene", "v"], "left_semi").join(ends.withColumnRenamed("v", "u"), ["scene", "u"], "left_semi")
    lists = among.groupBy("scene", F.col("u").alias("idx")).agg(F.collect_set("v").alias("near"))  # at most n + 20
    rows = tried.join(lists, ["scene", "idx"], "left")

    def choose(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["h", "idx"])
        order = [int(x) for x in df["idx"]]
        near = {int(i): set(map(int, x)) if x is not None else set() for i, x in zip(df["idx"], df["near"])}
        chosen, pairs = order[:n], max(1, min(n, len(order)) * (min(n, len(order)) - 1) // 2)
        positive = sum(b in near[a] for i, a in enumerate(chosen) for b in chosen[i + 1 :])
        for _ in range(min(50, int(df["size"].iloc[0]))):
            off = abs(positive / pairs - target)
            unused = [x for x in order if x not in set(chosen)][:20]
            if off <= slack or not unused:
                break
            best = (0.01, None, None, 0)
            for i, old in enumerate(chosen):
                rest = [x for x in chosen if x != old]
                lost = sum(x in near[old] for x in rest)
                for new in unused:
                    now = positive - lost + sum(x in near[new] for x in rest)
                    gain = off - abs(now / pairs - target)
                    if gain > best[0]:
                        best = (gain, i, new, now)
            if best[1] is None:
                break
            chosen[best[1]], positive = best[2], best[3]
        return pd.DataFrame({"scene": key[0], "idx": chosen})

    kind = nodes.schema["scene"].dataType.simpleString()
    return rows.groupBy("scene").applyInPandas(choose, f"scene {kind}, idx long")


def triplets(anchors: DataFrame, nodes: DataFrame, edges: DataFrame, threshold: float, n_pos: int = 1, n_neg: int = 1, seed: int = 0) -> DataFrame:
    """``(scene, anchor, kind, slot, idx)``: positives with replacement and strict negatives, by hashed order."""
    if isinstance(edges, Overlaps):
        return _triplets(anchors, edges, threshold, n_pos, n_neg, seed)
    a = anchors.select("scene", F.col("idx").alias("anchor"))
    pos = edges.filter(F.col("w") >= threshold).select("scene", F.col("u").alias("anchor"), F.col("v").alias("idx")).distinct()
    mine = a.join(pos, ["scene", "anchor"])
    other = a.join(nodes.select("scene", "idx"), "scene").filter("anchor <> idx").join(pos, ["scene", "anchor", "idx"], "left_anti")
    order = lambda: Window.partitionBy("scene", "anchor").orderBy(hashed(F.col("idx") + F.col("anchor") * 31, seed), "idx")
    listed = mine.withColumn("r", F.row_number().over(order())).groupBy("scene", "anchor").agg(F.array_sort(F.collect_list(F.struct("r", "idx"))).alias("l"))
    slots = listed.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n_pos - 1))))
    again = F.pmod(hashed(F.col("anchor") + F.col("slot") * 977, seed), F.size("l")).cast("int")
    p = slots.select("scene", "anchor", F.lit("positive").alias("kind"), "slot", F.get("l", again)["idx"].alias("idx"))
    q = other.withColumn("slot", F.row_number().over(order()) - 1).filter(F.col("slot") < n_neg).select("scene", "anchor", F.lit("negative").alias("kind"), "slot", "idx")
    return p.unionByName(q)


def _hashed(x: np.ndarray, seed: int) -> np.ndarray:
    """``hashed`` of an array."""
    x, factor = np.asarray(x, np.int64) + seed, 2654435761
    return ((x & 65535) * factor + (((x >> 16 & 65535) * factor & 65535) << 16)) % (1 << 32)


def _triplets(anchors: DataFrame, edges: Overlaps, threshold: float, n_pos: int, n_neg: int, seed: int) -> DataFrame:
    kinds = np.array(["positive", "negative"])

    def drawn(scene, u, ids, sims):
        order = np.lexsort((ids, _hashed(ids + u * 31, seed)))
        ids, near = ids[order], sims[order] >= max(threshold, least)
        pos, neg = ids[near], ids[~near][:n_neg]
        slots = np.arange(n_pos if len(pos) else 0)
        pos = pos[_hashed(u + slots * 977, seed) % len(pos)] if len(pos) else pos
        return {"anchor": u, "kind": np.repeat(kinds, (len(pos), len(neg))), "slot": np.concatenate((slots, np.arange(len(neg)))), "idx": np.concatenate((pos, neg))}

    least = edges.least
    every = Overlaps(edges.nodes, float("-inf"))  # a node without an edge is a negative
    return every.each(drawn, "anchor long, kind string, slot int, idx long", anchors)


def collate_labels(samples: DataFrame) -> DataFrame:
    """A sample's images carry its number; its last image a label that no sample has, -1 less that number."""
    last = F.max("slot").over(Window.partitionBy("sample"))
    return samples.withColumn("label", F.when(F.col("slot") == last, -1 - F.col("sample")).otherwise(F.col("sample")))


def scene_runs(rows: DataFrame, key: str, order: list[str], within: list[str] | None = None) -> DataFrame:
    """Rows with ``run``: the number of the stretch of equal keys they are in; a key that comes back starts a new one."""
    w = Window.partitionBy(*(within or [])).orderBy(*order)
    new = (~F.lag(key).over(w).eqNullSafe(F.col(key)) | (F.row_number().over(w) == 1)).cast("int")
    return rows.withColumn("_n", new).withColumn("run", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_n")


def scene_batches(runs: DataFrame, order: list[str], size: int, within: list[str] | None = None, drop_last: bool = False) -> DataFrame:
    """Rows with ``batch``, numbered within their run; ``drop_last`` leaves out short ones."""
    if size < 1:
        raise ValueError("a batch needs at least one row")
    keys = [*(within or []), "run"]
    out = runs.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) / size))
    if not drop_last:
        return out
    full = F.count("*").over(Window.partitionBy(*keys, "batch")) == size
    return out.withColumn("_f", full).filter("_f").drop("_f")


def drop_neighbours(edges: DataFrame, p: float = 0.3, seed: int = 0) -> DataFrame:
    """Neighbours dropped with chance ``p``, never rank 0; a hash of both ends decides, however the rows are dealt."""
    draw = hashed(hashed(F.col("src"), seed) * 31 + F.col("dst"), seed + 1) / F.lit(2.0**32)
    return edges.filter((F.col("rank") == 0) | (draw >= p))


def inverted_index(rows: DataFrame, key: str, position: str) -> DataFrame:
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(position)).alias("positions"))


def order_mismatches(base: DataFrame, other: DataFrame, key: str = "id", position: str = "pos") -> DataFrame:
    """How many places do not hold the same key in both."""
    a, b = base.select(position, F.col(key).alias("_a")), other.select(position, F.col(key).alias("_b"))
    return a.join(b, position, "full").agg(F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("mismatches"))


def gather_dedup(rows: DataFrame, index: str, order: list[str]) -> DataFrame:
    """Of rows with the same index, the first."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(index).orderBy(*order))).filter("_r = 1").drop("_r")


def cross_view(rows: DataFrame, view: str, views: list[str], key: str = "cls") -> DataFrame:
    """Rows of view ``views[1]`` whose class ``views[0]`` has too."""
    return rows.filter(F.col(view) == views[1]).join(rows.filter(F.col(view) == views[0]).select(key).distinct(), key, "left_semi")


def multi_view_sample(rows: DataFrame, anchor: str, others: list[str], n: int, seed: int = 0) -> DataFrame:
    """For each class of the anchor view: one image of it, and ``n`` of each other view with replacement; null where a view lacks the class."""
    keyed = rows.withColumn("_h", hashed(F.col("id"), seed))
    lists = keyed.groupBy("cls", "view").agg(F.transform(F.array_sort(F.collect_list(F.struct("_h", "id"))), lambda s: s["id"]).alias("l"))
    classes = rows.filter(F.col("view") == anchor).select("cls").distinct()
    plan = classes.select("cls", F.explode(F.array(*[F.struct(F.lit(v).alias("view"), F.lit(i).alias("slot")) for v, m in [(anchor, 1), *[(o, n) for o in others]] for i in range(m)])).alias("p"))
    at = F.pmod(hashed(F.col("cls") * 7 + F.col("p.slot"), seed), F.size("l")).cast("int")
    return plan.select("cls", "p.view", "p").join(lists, ["cls", "view"], "left").select("cls", "view", "p.slot", F.get("l", at).alias("id"))


def multi_view_collate(samples: DataFrame) -> DataFrame:
    """Images and labels of samples with lists of ids by view; missing views give no row."""
    return samples.select("cls", F.explode("ids").alias("id")).filter("id is not null")


def usable_scenes(nodes: DataFrame, edges: DataFrame, least: int = 1) -> DataFrame:
    """``(scene, n, status)`` of every scene of either table: ok, or why it is passed over.

    A scene needs ``least`` images, and its edges may name none that it does not have.
    """
    size = nodes.groupBy("scene").agg(F.count("*").alias("n"))
    top = edges.groupBy("scene").agg(F.max(F.greatest("u", "v")).alias("_top"), F.min(F.least("u", "v")).alias("_low"))
    rows = size.join(top, "scene", "full").withColumn("n", F.coalesce("n", F.lit(0)))
    outside = (F.col("_top") >= F.col("n")) | (F.col("_low") < 0)
    status = F.when(F.col("n") < least, "too few images").when(outside, "edge to no image").otherwise("ok")
    return rows.select("scene", "n", status.alias("status"))
