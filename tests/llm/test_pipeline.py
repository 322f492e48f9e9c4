import numpy as np
from test_dedup import slow_kept

import __spark_entry__ as entry
import corpus_pipeline
from vantage.llm.common import materialize
from vantage.llm.decontaminate import find_contamination
from vantage.llm.langid import identify_language
from vantage.llm.pii import base_spans


def test_every_query_is_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13


def test_stages_against_their_operators(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = (docs, docs := materialize(stage(spark, docs, small), name))
    before, after = out["language"]
    pred = {r.doc_id for r in identify_language(before).collect() if r.lang_pred != "und"}
    assert {r.doc_id for r in after.collect()} == pred and after.columns == columns
    before, after = out["near_dedup"]
    assert {r.doc_id for r in after.collect()} == slow_kept([(r.doc_id, r.text) for r in before.collect()]) and after.columns == columns
    before, after = out["decontaminate"]
    bad = {r.doc_id for r in find_contamination(before, spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - bad and after.columns == columns
    before, after = out["pii"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} and after.columns == columns
    assert not any(base_spans(r.text) for r in after.collect())
    before, after = out["packing"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
    assert np.all([r.offset + r.length <= 4096 for r in after.collect()])
    run = corpus_pipeline.run(spark, small)
    key = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(run) == key(after)
