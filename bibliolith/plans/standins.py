"""The test tables seen as bibliographic records: SQL that Spark and the checking engine both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

PAPERS = """
    SELECT CAST(p_partkey AS STRING) AS doi, p_name AS title, p_brand AS journal, CAST(p_size AS BIGINT) AS times_cited,
           CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 13 = 0 THEN concat('c', CAST(p_size AS STRING)) ELSE CAST(1990 + p_partkey % 35 AS STRING) END AS year,
           CASE WHEN p_partkey % 6 = 0 THEN 0.0e0 ELSE p_retailprice / 100 END AS impact_factor,
           CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat('Q', CAST(p_partkey % 5 AS STRING)) END AS quartile,
           CAST(p_partkey % 9 AS BIGINT) AS library_citations, p_partkey % 4 = 0 AS is_reference, CAST(p_partkey % 7 AS BIGINT) AS cluster,
           CASE WHEN p_partkey % 3 = 0 THEN 'wos_core' WHEN p_partkey % 3 = 1 THEN 'openalex' ELSE '' END AS source_main,
           CASE WHEN p_partkey % 10 = 3 THEN '' ELSE p_type END AS abstract, p_partkey % 8 = 1 AS is_cleaned, p_retailprice / 100000 AS paper_rank, p_type AS kind, p_partkey AS id
    FROM part
"""
EDGES = """
    SELECT DISTINCT CAST(s AS STRING) AS citing, CAST(d AS STRING) AS cited FROM (
        SELECT l_partkey AS s, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS d FROM lineitem WHERE l_returnflag = 'R') t
    WHERE d IS NOT NULL AND s <> d
"""
BIPARTITE = "SELECT DISTINCT CAST(l_orderkey AS STRING) AS citing, CAST(l_partkey AS STRING) AS cited FROM lineitem"

NAMES = ("part", "lineitem", "orders", "customer", "supplier", "nation", "region", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A query over the test tables, without leaving names behind in the session's catalogue."""
    at = re.compile(rf"\b(FROM|JOIN)\s+({'|'.join(NAMES)})\b")
    return spark.sql(at.sub(r"\1 {\2}", sql), **{n: table(spark, sf_dir, n) for _, n in at.findall(sql)})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, PAPERS)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, EDGES)


def bipartite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, BIPARTITE)
