"""Driver queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import decode_ids, encode_texts
from .brown import score_texts
from .centroids import cluster_vectors
from .common import table
from .crosspolytope import search
from .decontaminate import find_contamination
from .htmltext import extract_main_text
from .langid import identify_language
from .linededup import dedup_units
from .packing import pack_documents
from .pii import find_pii
from .sharding import hash_tree_shards
from .simhash import simhash_components
from .whitening import whiten_vectors


def op1_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_texts(table(spark, sf_dir, "documents"), stable=True)
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op2_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


def op3_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op5_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), 4096)


def op6_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start_word", "similarity")


def op7_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hash_tree_shards(table(spark, sf_dir, "documents"), shards=8)
    return out.withColumn("law", F.lit("key"))


def op8_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))


def op9_tree_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_units(table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"), k=8, dim=64, rounds=10)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten_vectors(table(spark, sf_dir, "embeddings"), components=16)


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decode_ids(encode_texts(table(spark, sf_dir, "documents")))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_brown, op2_cross_polytope, op3_weak_pii, op4_simhash, op5_best_fit, op6_simhash_windows, op7_hash_tree, op8_crf_language, op9_tree_extract, op10_line_dedup,
        op11_centroid_clustering, op12_embedding_whitening, op13_bpe,
    )
}
ORACLE_SQL: dict[str, str] = {}
