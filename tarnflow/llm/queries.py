"""Registry of the training-data queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import embed_dedup, exact_dedup, language_id, minhash_dedup, packing, substring_dedup, token_planes, url_rules, warc, word_table
from .common import read_table


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"))


def op2_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_planes.token_file_digests(read_table(spark, sf_dir, "documents"))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(str(r) for r in url_rules.RULES) + " AS rules(verdict, host, path)")
    return url_rules.judge(read_table(spark, sf_dir, "pages"), rules)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digests(read_table(spark, sf_dir, "pages"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op8_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_table.word_table_digests(read_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passage_digests(read_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.train(docs))


QUERIES = {f.__name__: f for f in (op1_embedding_near_dedup, op2_token_planes, op3_url_rules, op4_exact_dedup, op5_minhash_near_dedup, op6_warc_revisits, op7_best_fit_packing, op8_word_table, op9_substring_dedup, op10_language_id)}
ORACLES = {"op1_embedding_near_dedup": embed_dedup.ORACLE_SQL, "op3_url_rules": url_rules.ORACLE_SQL, "op4_exact_dedup": exact_dedup.ORACLE_SQL, "op6_warc_revisits": warc.ORACLE_SQL}
