"""The registered queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, hamming, htmltext, neardup, packing, pii, quality, secrets, sharding, suffix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=8)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), capacity=2048)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=5, num=75, den=100)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.score_documents(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=100)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "embeddings").select("vec_id", hamming.sign_code(F.col("embedding")).alias("code"))
    return hamming.top_k(codes, codes.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "code"), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_sharding": op2_sharding,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op3_pii": op3_pii,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_hamming_top_k": op5_hamming_top_k,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_html_extraction": op8_html_extraction,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
}

#: SQL of the queries that SQL can express on whole tables.
ORACLE_SQL: dict[str, str] = {
    "op5_hamming_top_k": """
        WITH d AS (
            SELECT q.vec_id AS query_id, e.vec_id,
                   CAST(list_sum([CASE WHEN coalesce(q.embedding[i] > 0, false) <> coalesce(e.embedding[i] > 0, false) THEN 1 ELSE 0 END FOR i IN range(1, 65)]) AS BIGINT) AS distance
            FROM embeddings q, embeddings e
            WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
        SELECT query_id, CAST(rank AS BIGINT) AS rank, vec_id, distance FROM r WHERE rank <= 10
    """,
}
