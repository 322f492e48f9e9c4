"""All pairs of rows within a group, met block by block, so that a large group is many tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import vectors as V
from ..functions.rounding import rounded
from ..sources.storage import join_once, materialize
from .numbering import numbered
from .sweep import by_row, swept

#: (similarity, overlap, whether the entry counts) of some anchors by their partners -> columns by anchor.
Fold = Callable[[np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]]


def _schema(text: str) -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(text))


def _rows(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class GroupPairs:
    """Pairs of different rows of a group: ``nodes(sample, i, v)``, and ``label`` where ``overlap`` asks for it.

    A group of n rows is cut into ceil(n / ``block``) blocks by a hash of ``i``; each two blocks, and each block with itself, are one
    task that takes one product. Where an anchor meets its whole group, ``metric`` "squared" gives squared distances in its place. ``overlap`` says how much two rows belong together: a function of the
    similarity matrix, ``"label"`` (1 where labels are equal, else 0; a null label equals none), or a table ``(sample, i, j, overlap)``
    of unordered pairs, others being 0, of which the largest counts. Rows without a vector have no pairs.
    """

    def __init__(self, nodes: DataFrame, overlap: Callable[[np.ndarray], np.ndarray] | str | DataFrame | None = None, block: int = 1024, metric: str = "dot"):
        if isinstance(overlap, str) and overlap != "label":
            raise ValueError("overlap is a function, a table or 'label'")
        self.block, self.overlap, self.metric = block, overlap, metric
        named = nodes.select("sample", F.col("i").cast("long").alias("i"), V.as_vector("v").alias("v"), *([F.col("label").cast("string").alias("label")] if overlap == "label" else []))
        named = named.filter(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull()))
        self.plain = named
        self.sizes = named.groupBy("sample").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block))
        own = join_once(named, self.sizes, "sample", "n").withColumn("own", self._block("i"))
        met = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        self.nodes = met.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")}).drop("other")
        self.kind = nodes.schema["sample"].dataType.simpleString()

    @staticmethod
    def _block(column: str):
        return F.pmod(F.xxhash64(column), F.col("blocks"))

    def _edges(self) -> DataFrame:
        e = self.overlap.select("sample", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("overlap").cast("double").alias("overlap"))
        e = join_once(e, self.sizes, "sample", "n")
        return e.withColumns({"a": F.least(self._block("i"), self._block("j")), "b": F.greatest(self._block("i"), self._block("j"))}).drop("blocks")

    @staticmethod
    def _matrices(overlap, nodes: pa.Table, edges: pa.Table | None, a: int, b: int) -> tuple:
        own = nodes.column("own").to_numpy()
        ids, v = nodes.column("i").to_numpy(), _rows(nodes, "v")
        left = np.flatnonzero(own == a)
        right = left if a == b else np.flatnonzero(own == b)
        sim = v[left] @ v[right].T
        if callable(overlap):
            over = overlap(sim)
        elif overlap is None:
            over = np.zeros_like(sim)
        elif edges is None:
            codes, known = np.unique(nodes.column("label").to_pandas().fillna("\0none").to_numpy(str), return_inverse=True)[1], nodes.column("label").is_valid().to_numpy()
            over = ((codes[left][:, None] == codes[right][None]) & known[left][:, None] & known[right][None]).astype(np.float64)
        else:
            over = np.zeros_like(sim)
            place = [dict(zip(ids[side].tolist(), range(len(side)))) for side in (left, right)]
            for i, j, w in zip(*(edges.column(c).to_pylist() for c in ("i", "j", "overlap"))):
                for x, y in ((i, j), (j, i)):
                    at, to = place[0].get(x), place[1].get(y)
                    if at is not None and to is not None and w is not None:
                        over[at, to] = max(over[at, to], w)
        return ids[left], ids[right], sim, over

    def _run(self, schema: str, work: Callable[[tuple, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool], Iterator[dict]], nodes: DataFrame | None = None) -> DataFrame:
        """``work`` on each two blocks, in each direction: group, anchors, partners, similarity, overlap, what counts, only block."""
        text = f"sample {self.kind}, {schema}"
        arrow = _schema(text)
        overlap = "table" if isinstance(self.overlap, DataFrame) else self.overlap

        def each(key: tuple, nodes: pa.Table, edges: pa.Table | None = None) -> pa.Table:
            if not len(nodes):
                return arrow.empty_table()
            sample, a, b = key
            i, j, sim, over = GroupPairs._matrices(overlap, nodes, edges, a.as_py(), b.as_py())
            counts = i[:, None] != j[None]
            only = nodes.column("blocks")[0].as_py() == 1
            parts = [*work(i, j, sim, over, counts, only)]
            if a.as_py() != b.as_py():
                parts += work(j, i, sim.T, over.T, counts.T, only)
            tables = []
            for part in parts:
                n = len(next(iter(part.values())))
                columns = {"sample": pa.array([sample.as_py()] * n, arrow.field("sample").type)} | part
                tables.append(pa.Table.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in arrow], schema=arrow))
            return pa.concat_tables(tables) if tables else arrow.empty_table()

        keys = ["sample", "a", "b"]
        if isinstance(self.overlap, DataFrame):
            return self.nodes.groupBy(*keys).cogroup(self._edges().groupBy(*keys)).applyInArrow(lambda key, n, e: each(key, n, e), text)
        return (self.nodes if nodes is None else nodes).groupBy(*keys).applyInArrow(lambda key, n: each(key, n), text)

    def rows(self, both: bool = True) -> DataFrame:
        """``(sample, i, j, overlap, sim)`` of all pairs; without ``both``, those with i below j."""

        def work(i, j, sim, over, counts, only):
            at, to = np.nonzero(counts if both else i[:, None] < j[None])
            yield {"i": i[at], "j": j[to], "overlap": over[at, to], "sim": sim[at, to]}

        return self._run("i long, j long, overlap double, sim double", work)

    def fold(self, f: Fold, schema: str) -> DataFrame:
        """``(sample, i, *schema)``: what ``f`` makes of each anchor and a block of its partners. No pair becomes a row."""

        def work(i, j, sim, over, counts, only):
            yield {"i": i} | f(sim, over, counts)

        return self._run(f"i long, {schema}", work)

    def spread(self, f: Callable, schema: str) -> DataFrame:
        """As ``fold``, for an ``f`` that gives columns with ``at``, the anchor's row, any number of times."""

        def work(i, j, sim, over, counts, only):
            out = f(sim, over, counts)
            yield {"i": i[out.pop("at")]} | out

        return self._run(f"i long, {schema}", work)

    def _whole(self, f: Callable[[int, int, np.ndarray, np.ndarray], dict], schema: str, groups: DataFrame | None = None, itself: bool = False, held: int | None = None) -> DataFrame:
        """``(sample, *schema)``: ``f(group, i, ids, sims)`` of each anchor and all its partners, of all groups or of those named; with ``itself`` it is one of them.

        Anchors meet their groups in one task, so nothing is shuffled but the nodes, each once.
        """
        rows = self.plain if groups is None else self.plain.join(groups, "sample", "left_semi")
        whole = self.kind in ("bigint", "int", "smallint", "tinyint")
        codes = None if whole else materialize(numbered(self.sizes.select("sample"), ["sample"], "g"), "codes")
        rows = rows.withColumn("g", F.col("sample")) if whole else rows.join(codes, "sample")
        side = rows.select(F.col("i").alias("id"), F.col("g").cast("long").alias("g"), "v")
        out = swept(side, side, by_row(f, itself), f"g long, {schema}", self.metric, within=True, held=held)
        out = out.withColumn("sample", F.col("g").cast(self.kind)) if whole else out.join(codes, "g")
        return out.select("sample", *[F.col(n) for n in _schema(schema).names])

    def by_anchor(self, f: Callable[[np.ndarray, np.ndarray, np.ndarray], dict], schema: str, groups: DataFrame | None = None) -> DataFrame:
        """``(sample, i, *schema)``: ``f`` of all an anchor's partners, their similarities and overlaps, giving any number of rows.

        Of all groups, or of those named. Only for an ``overlap`` that is a function.
        """
        overlap = self.overlap
        return self._whole(lambda group, i, ids, sims: {"i": i} | f(ids, sims, overlap(sims[None])[0]), f"i long, {schema}", groups)

    def anchors(self, f: Callable[[np.ndarray, np.ndarray], tuple], schema: str) -> DataFrame:
        """``(sample, i, *schema)``: ``f`` of all partners' similarities and overlaps of an anchor at once.

        Groups of one block are finished where their product is taken; anchors of larger ones meet their group in one task. Where ``overlap`` is
        no function, an anchor's lists meet instead: 16 bytes a partner.
        """
        kinds = _schema(schema)
        names = kinds.names

        def ready(i, j, sim, over, counts, only):
            if only:
                out = [f(sim[r][counts[r]], over[r][counts[r]]) for r in range(len(i))]
                yield {"i": i} | {n: [x[k] for x in out] for k, n in enumerate(names)}

        def lists(i, j, sim, over, counts, only):
            if not only:
                ends = pa.array(np.concatenate(([0], np.cumsum(counts.sum(1)))), pa.int32())
                yield {"i": i, "s": pa.ListArray.from_arrays(ends, pa.array(sim[counts])), "o": pa.ListArray.from_arrays(ends, pa.array(over[counts]))}

        def whole(batches):
            for b in batches:
                out = [f(s.values.to_numpy(zero_copy_only=False), o.values.to_numpy(zero_copy_only=False)) for s, o in zip(b.column(2), b.column(3))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array([x[k] for x in out], fld.type) for k, fld in enumerate(kinds)]], names=["sample", "i", *names])

        if callable(self.overlap):
            small = self._run(f"i long, {schema}", ready, self.nodes.filter("blocks = 1"))
            large = self.sizes.filter("blocks > 1").select("sample")
            if large.isEmpty():
                return small
            return small.unionByName(self.by_anchor(lambda ids, s, o: {n: np.array([x]) for n, x in zip(names, f(s, o))}, schema, large))
        met = self._run("i long, s array<double>, o array<double>", lists).groupBy("sample", "i").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("s", "o")])
        rest = met.select("sample", "i", "s", "o").mapInArrow(whole, f"sample {self.kind}, i long, {schema}")
        return self._run(f"i long, {schema}", ready).unionByName(rest)


def squared_distances(nodes: DataFrame, block: int | None = None, digits: int | None = None) -> DataFrame:
    """``(sample, i, j, d)``: squared distances of all ordered pairs of a group, each row with itself too, rounded to ``digits`` if wanted.

    A row is dealt once however large its group. A task holds ``block`` times ``block`` distances at once, if that is given.
    """

    def work(group, i, ids, d):
        return {"i": i, "j": ids, "d": d if digits is None else rounded(d, digits)}

    return GroupPairs(nodes, metric="squared")._whole(work, "i long, j long, d double", itself=True, held=None if block is None else block * block)


def merged_peak(parts: DataFrame, peak: str, keys: list[str]) -> DataFrame:
    """Rows with ``_top``, the largest ``peak`` of their keys; a later ``groupBy`` of the same keys needs no further shuffle."""
    return parts.withColumn("_top", F.max(peak).over(Window.partitionBy(*keys)))


def meet(left: DataFrame, right: DataFrame, key: str, block: int = 4096) -> DataFrame:
    """Inner join on ``key``, both sides cut into blocks by a hash of the row, so that a large key is many tasks."""
    counts = [t.groupBy(key).agg(F.count("*").alias(c)) for t, c in ((left, "_nl"), (right, "_nr"))]
    sizes = counts[0].join(counts[1], key).withColumns({"_bl": F.ceil(F.col("_nl") / block), "_br": F.ceil(F.col("_nr") / block)})
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda t, n: F.pmod(F.xxhash64(*t.columns), F.col(n))
    a = join_once(left, sizes.drop("_nr"), key, "_nl").withColumn("_a", own(left, "_bl")).withColumn("_b", every("_br")).drop("_bl", "_br")
    b = join_once(right, sizes.drop("_nl"), key, "_nr").withColumn("_b", own(right, "_br")).withColumn("_a", every("_bl")).drop("_bl", "_br")
    return a.join(b, [key, "_a", "_b"]).drop("_a", "_b")
