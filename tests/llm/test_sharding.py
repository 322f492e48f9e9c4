import math
import struct
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from vantage.llm.sharding import hash_tree_shards, tree_shard


def slow_shard(key, weights):
    """The shard whose draw is least, by hand."""
    best = []
    for s, w in enumerate(weights):
        h = xxhash.xxh64_intdigest(f"shard/{s}".encode(), 42)
        if key is not None:
            h = xxhash.xxh64_intdigest(struct.pack("<q", key), h)
        best.append((-math.log(((h >> 11) + 0.5) * 2.0**-53) / w, s))
    return min(best)[1]


def check(rows, got):
    want = sorted((d is None, d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), slow_shard(d, [1.0] * 8), slow_shard(d, [1.0] * 9)) for d, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    assert all(r.grown_shard in (r.shard, 8) for r in got)
    assert all(r.rack == r.shard // 2 and r.region == r.shard // 4 for r in got)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_documents(documents):
    check([(r.doc_id, r.text) for r in documents.collect()], hash_tree_shards(documents).collect())


def test_messy_and_empty(messy, messy_rows, empty):
    check([(d, t) for d, t, _ in messy_rows], hash_tree_shards(messy).collect())
    assert hash_tree_shards(empty).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 5, 9, 12])
def test_growth_moves_rows_only_into_the_new_shard(spark, n):
    weights = [1.0 + i % 3 for i in range(n)]
    ids = spark.range(20_000)
    row = ids.select(tree_shard(F.col("id"), weights)["shard"].alias("a"), tree_shard(F.col("id"), [*weights, 2.0])["shard"].alias("b")).collect()
    assert all(b in (a, n) for a, b in row)
    share = Counter(a for a, _ in row)
    assert all(abs(share[s] / 20_000 - w / sum(weights)) < 0.02 for s, w in enumerate(weights))


def test_more_weight_draws_rows_only_to_that_shard(spark):
    before, after = [1.0] * 8, [1.0] * 5 + [2.5] + [1.0] * 2
    rows = spark.range(10_000).select(tree_shard(F.col("id"), before)["shard"].alias("a"), tree_shard(F.col("id"), after)["shard"].alias("b")).collect()
    assert all(b in (a, 5) for a, b in rows) and any(a != b for a, b in rows)
