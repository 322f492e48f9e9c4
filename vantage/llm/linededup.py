"""Substring deduplication by hashing text units: lines, split again at sentence ends."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_once, materialize, row_key

#: A sentence ends with a word that holds one of these marks.
_END = re.compile(r"[.!?]\S*")
_ROWS = 200_000


def text_units(text: str, min_words: int) -> Iterator[tuple[int, int, int, bytes]]:
    """``(start, end, words, digest)`` of each unit of a text, in code points.

    A unit ends with a line, or within one after a sentence of at least ``min_words`` words; shorter
    sentences belong to the unit of what follows them in the line. So where units end depends on the words around
    alone, and a passage is cut alike wherever it stands. The digest is of the unit's lower-cased words
    joined by single spaces, no more and no less than what the unit spans.
    """
    base = 0
    for line in text.split("\n"):
        at = first = 0
        for stop in [*[m.end() for m in _END.finditer(line)], len(line)]:
            if stop == len(line) or len(line[at:stop].split()) >= min_words:
                part = line[first:stop]
                words = part.lower().split()
                if words:
                    yield base + stop - len(part.lstrip()), base + first + len(part.rstrip()), len(words), xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass"))
                first = stop
            at = stop
        base += len(line) + 1


def _units(min_words: int):
    names = ["d1", "d2", "doc_id", "k", "start", "end", "at", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, texts = (batch.column(i) for i in range(3))
            cols: list[list[int]] = [[] for _ in range(7)]

            def out():
                at = pa.array(cols[0], pa.int32())
                long, short = ([pa.array(c, t) for c in part] for part, t in ((cols[1:3], pa.int64()), (cols[3:], pa.int32())))
                return pa.RecordBatch.from_arrays([*long, ids.take(at), keys.take(at), *short], names=names)

            for i, text in enumerate(texts):
                for n, (start, end, words, digest) in enumerate(text_units(text.as_py() or "", min_words)):
                    high, low = int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)
                    for c, x in zip(cols, (i, high, low, start, end, n, words)):
                        c.append(x)
                    if len(cols[0]) >= _ROWS:
                        yield out()
                        cols = [[] for _ in range(7)]
            if cols[0]:
                yield out()

    return run


def removed_runs(again: list[tuple[int, int, int, int]], min_words: int, min_run: int) -> tuple[int, list[tuple[int, int]]]:
    """How many units go and in what spans, from the ``(at, start, end, words)`` of a text's repeated units.

    Neighbours are one span. With a ``min_run`` above 1 only runs go that have so many words together, from a unit of
    at least ``min_words`` words to another such one.
    """
    count, spans = 0, []
    run: list[tuple[int, int, int, int]] = []
    for unit in [*sorted(again), None]:
        if run and (unit is None or unit[0] != run[-1][0] + 1):
            if min_run > 1:
                while run and run[0][3] < min_words:
                    run.pop(0)
                while run and run[-1][3] < min_words:
                    run.pop()
            if run and sum(u[3] for u in run) >= min_run:
                count += len(run)
                spans.append((run[0][1], run[-1][2]))
            run = []
        if unit:
            run.append(unit)
    return count, spans


def _cut(min_words: int, min_run: int):
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, merged, kept = [], [], []
            for text, again in zip(batch.column(1), batch.column(2)):
                text, again = text.as_py(), again.as_py()
                n, spans = removed_runs([(u["at"], u["start"], u["end"], u["words"]) for u in again or []], min_words, min_run)
                if spans:
                    ends = [0, *[e for _, e in spans]]
                    starts = [*[s for s, _ in spans], len(text)]
                    text = "".join(text[a:b] for a, b in zip(ends, starts))
                counts.append(n)
                merged.append([{"start": s, "end": e} for s, e in spans])
                kept.append(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(merged, span), pa.array(kept, pa.string())], names=["doc_id", "n_removed", "removed", "kept_text"]
            )

    return run


def dedup_units(docs: DataFrame, min_words: int = 8, min_run: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every unit that an earlier place of the corpus has already.

    Units are lines, cut again after sentences of ``min_words`` words (see ``text_units``), compared by the
    digest of their normalised words. Places are ranked by (doc_id, content hash, start), null ids last; a unit
    is repeated if its digest has an earlier place, and goes, however short it is. A ``min_run`` above 1 spares common phrases, short lines
    and headings: then only runs of so many words go (see ``removed_runs``). What repeats inside a unit without being one is kept.

    All digests are grouped over the whole corpus: the smallest place is a partial aggregate, and only
    digests seen twice are joined back, those of very many places in parts, so a line that fills a third
    of the corpus is neither gathered nor paired.

    Returns doc_id, n_removed (units), removed (spans in code points of the original text) and
    kept_text, a row for each input row. A null text has no units and stays null. Rows with equal id
    and text are one place and get the same result. A text is read whole, however long; the list of its own repeated
    units is what one task holds of it. An empty table gives an empty table; other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumns(
        dict(zip(("k1", "k2"), row_key("doc_id", "text")))
    )
    id_type = rows.schema["doc_id"].dataType.simpleString()
    units = rows.select("doc_id", F.col("k1").alias("k"), "text").mapInArrow(
        _units(min_words), f"d1 long, d2 long, doc_id {id_type}, k long, start int, end int, at int, words int"
    )
    units = materialize(units, "units")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k", "start")
    first = units.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).filter("first <> last")
    first = materialize(first.drop("last"), "firsts")
    again = join_once(units, first, ["d1", "d2"], "n").filter(place != F.col("first"))
    cuts = again.groupBy("doc_id", "k").agg(F.collect_set(F.struct("at", "start", "end", "words")).alias("units"))
    joined = rows.alias("r").join(
        cuts.alias("c"), F.col("r.k1").eqNullSafe(F.col("c.k")) & F.col("r.doc_id").eqNullSafe(F.col("c.doc_id")), "left"
    )
    return joined.select("r.doc_id", "r.text", "c.units").mapInArrow(
        _cut(min_words, min_run), f"doc_id {id_type}, n_removed long, removed array<struct<start:int,end:int>>, kept_text string"
    )
