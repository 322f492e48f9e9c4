"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, row_key

_SCALE = 1000  # shingle weights are whole numbers, so sums do not depend on their order


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.col(text)), r"[\s]+"), "")


def _shingle(words: Column, at: Column, width: int) -> Column:
    return F.xxhash64(*[F.get(words, at + i) for i in range(width)])


def _positions(words: Column, width: int) -> Column:
    """0 .. n - width; null for fewer words."""
    return F.when(F.size(words) >= width, F.sequence(F.lit(0), F.size(words) - width))


def _shingle_counts(df: DataFrame, key: list[str], width: int) -> DataFrame:
    """``(key.., h, cnt)`` of the rows' column ``words``."""
    each = df.select(*key, "words", F.explode_outer(_positions(F.col("words"), width)).alias("at"))
    return each.select(*key, _shingle(F.col("words"), F.col("at"), width).alias("h")).groupBy(*key, "h").agg(F.count("*").alias("cnt"))


def _fingerprints(counts: DataFrame, key: list[str]) -> DataFrame:
    """Weighted SimHash of 64 bits, and the total weight, by key.

    A shingle counts by the root of its weight in the bag, so that the cosine of two bags is at least
    2s / (1 + s) where s is their weighted Jaccard similarity, however the weights are spread.
    """
    force = F.round(_SCALE * F.sqrt(F.col("cnt") * F.col("weight"))).cast("long")
    signed = [F.sum(F.when(F.col("h").bitwiseAND(F.lit(1 << b if b < 63 else -(1 << 63))) != 0, force).otherwise(-force)).alias(f"b{b}") for b in range(64)]
    sums = counts.groupBy(*key).agg(F.sum(F.col("cnt") * F.col("weight")).alias("total"), *signed)
    fp = F.lit(0).cast("long")
    for b in range(64):
        fp = fp.bitwiseOR(F.when(F.col(f"b{b}") > 0, F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return sums.select(*key, "total", fp.alias("fp"))


def _blocks(df: DataFrame, radius: int) -> DataFrame:
    """The fingerprint in ``radius`` + 1 blocks: within the radius, at least one block is untouched."""
    n = radius + 1
    cuts = [64 * i // n for i in range(n + 1)]
    parts = F.array(*[F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long")) for lo, hi in zip(cuts, cuts[1:])])
    return df.select("*", F.posexplode(parts).alias("block", "value"))


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = 5,
    threshold: float = 0.8,
    radius: int = 20,
    broadcast_bytes: int = 64 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Benchmark items found in documents: k1, k2 (the row's key), doc_id, item_id, start_word, similarity.

    Texts are lower-cased and parted by white space into words, and compared as bags of shingles of
    ``width`` words, each weighing 1 + ln(items / items that have it). A window holds as many words as
    the item. A row is returned for each document and item with a window within ``radius`` bits of
    the item's SimHash whose weighted Jaccard similarity is at least ``threshold``: the most similar
    one, the first of equals. At 0.8 a bit differs with a chance of 0.151 at most, so of 64 bits more
    than 20 do in less than one of a thousand windows.

    A window that has no shingle in common with an item has similarity zero, so windows are laid only
    where one is shared, aligned on it: on the first word of each run of words that the document and
    the item have in common. A run costs one row. Where two runs of an item are set off against each other by
    few words (an eighth of the item at most, more would end below 0.8), all starts between are tried.

    Items that are null or have fewer than ``width`` words take no part; null, empty or shorter texts
    have no windows. Documents shorter than an item are compared whole. Rows with equal id and text
    are one row here. Empty tables give an empty table; other columns are ignored. The benchmark's shingles are broadcast
    if they have at most ``broadcast_bytes``, and else joined by shuffle. A text is read whole, however long.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), _words(item_text_col).alias("words")).filter(F.size("words") >= width)
    items = materialize(items.dropDuplicates(), "items")
    item_counts = _shingle_counts(items.withColumn("ik", F.xxhash64("item_id", "words")), ["item_id", "ik"], width)
    n_items = F.lit(float(max(1, items.count())))
    weights = item_counts.groupBy("h").agg(F.round(_SCALE * (1 + F.log(n_items / F.count("*")))).cast("long").alias("weight"))
    weights = materialize(weights, "weights")
    heaviest = F.round(_SCALE * (1 + F.log(n_items))).cast("long")
    item_counts = materialize(item_counts.join(weights, "h"), "itemshingles")
    item_prints = _fingerprints(item_counts, ["item_id", "ik"])

    words = F.col("words")
    anchors = items.withColumn("ik", F.xxhash64("item_id", "words")).select("item_id", "ik", words.alias("iw"), F.posexplode(_positions(words, width)).alias("i", "j"))
    anchors = materialize(
        anchors.select("item_id", "ik", F.size("iw").alias("n"), "j", _shingle(F.col("iw"), F.col("j"), width).alias("h"), F.get("iw", F.col("j") - 1).alias("before")),
        "anchors",
    )
    size = anchors.agg(F.coalesce(F.sum(F.octet_length(F.coalesce("before", F.lit(""))) + 64), F.lit(0))).first()[0]
    anchors = F.broadcast(anchors) if size <= broadcast_bytes else anchors

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = rows.select("doc_id", *row_key("doc_id", "text"), _words("text").alias("words"))
    placed = texts.select("doc_id", "k1", "k2", "words", F.explode_outer(_positions(words, width)).alias("p"))
    hits = placed.withColumn("h", _shingle(words, F.col("p"), width)).join(anchors, "h")
    hits = hits.filter((F.col("p") == 0) | (F.col("j") == 0) | (F.get(words, F.col("p") - 1) != F.col("before")))
    start = F.greatest(F.lit(0), F.least(F.col("p") - F.col("j"), F.size("words") - F.col("n")))
    slack = F.floor(F.col("n") / 8).cast("int")
    reach = F.slice(words, start + 1, F.least(F.col("n") + slack, F.size("words")))
    aligned = hits.select("doc_id", "k1", "k2", "item_id", "ik", "n", start.alias("start"), reach.alias("reach")).dropDuplicates(["k1", "k2", "item_id", "ik", "start"])
    gap = F.lead("start").over(Window.partitionBy("k1", "k2", "item_id", "ik").orderBy("start")) - F.col("start")
    steps = aligned.withColumn("gap", gap).withColumn("step", F.explode(F.sequence(F.lit(0), F.when(F.col("gap") <= slack, F.col("gap") - 1).otherwise(0))))
    windows = steps.select("doc_id", "k1", "k2", "item_id", "ik", "n", (F.col("start") + F.col("step")).alias("start"), F.slice("reach", F.col("step") + 1, F.col("n")).alias("words"))
    windows = materialize(windows, "windows")

    key = ["k1", "k2", "n", "start"]
    counts = _shingle_counts(windows.dropDuplicates(key).select(*key, "words"), key, width)
    counts = materialize(counts.join(weights, "h", "left").withColumn("weight", F.coalesce("weight", heaviest)), "windowshingles")
    prints = _fingerprints(counts, key)

    sides = windows.select("doc_id", *key, "item_id", "ik").join(prints, key)
    left = _blocks(sides.withColumnRenamed("total", "window_total"), radius)
    right = _blocks(item_prints.select("item_id", "ik", F.col("total").alias("item_total"), "fp"), radius).withColumnRenamed("fp", "item_fp")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius
    pairs = left.join(right, ["item_id", "ik", "block", "value"]).filter(near)
    pairs = pairs.select("doc_id", *key, "item_id", "ik", "window_total", "item_total").distinct()
    common = (
        pairs.join(counts.select(*key, "h", "cnt"), key)
        .join(item_counts.select("item_id", "ik", "h", F.col("cnt").alias("item_cnt"), F.col("weight").alias("w")), ["item_id", "ik", "h"])
        .groupBy("doc_id", *key, "item_id", "window_total", "item_total")
        .agg(F.sum(F.col("w") * F.least("cnt", "item_cnt")).alias("shared"))
    )
    similarity = F.col("shared") / (F.col("window_total") + F.col("item_total") - F.col("shared"))
    best = common.withColumn("similarity", similarity).filter(F.col("similarity") >= threshold).groupBy("k1", "k2", "doc_id", "item_id")
    best = best.agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("start").alias("at"))).alias("b"))
    return best.select("k1", "k2", "doc_id", "item_id", F.col("b.at").alias("start_word"), (-F.col("b.s")).alias("similarity"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no benchmark item is found (see ``find_contamination``).

    Rows that are repeated, or have null or empty texts, stay or go like any other. An empty table gives an
    empty table; columns may have any names.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    bad = find_contamination(docs, benchmark, **options).select("k1", "k2").distinct()
    marked = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *row_key(id_col, text_col))
    return marked.join(bad, ["k1", "k2"], "left_anti").select("row.*")
