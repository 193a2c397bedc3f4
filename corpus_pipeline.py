"""A corpus from raw documents to packed sequences: five stages, each over all that the one before kept.

Defined cases, for every stage: rows with a null doc_id are documents of their own, which no stage can tell from
one another by id, so dedup keeps them; null texts have no letter and go with the first stage; rows that repeat a
doc_id share its fate; extra columns are dropped, also where their names clash with a stage's own; an empty table
stays empty. Each stage's operator states the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.llm import exact_dedup, language_id, minhash_dedup, packing, substring_dedup
from tarnflow.llm.common import by_id, discard, materialize, settled

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or with two languages too close to tell, go."""
    judged = language_id.predict(docs, language_id.train(docs), COLUMNS[1:])
    return judged.where("lang_pred <> 'und' and not ambiguous").select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return _without(docs, exact_dedup.exact_duplicates(docs), "exact-gone")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component the smallest doc_id stays."""
    return _without(docs, minhash_dedup.near_duplicates(docs), "near-gone")


def _without(docs: DataFrame, judged: DataFrame, tag: str) -> DataFrame:
    """docs but for those that a settled table doesn't keep. A null doc_id, which that can't name, stays."""
    gone = materialize(judged.where("not kept and doc_id is not null").select("doc_id").distinct(), tag)
    discard(judged)
    return by_id(docs.select(*COLUMNS), gone, "doc_id", "left_anti")


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; so do documents of which nothing is left."""
    out = substring_dedup.repeated_passages(docs, ("lang", "source", "n_chars"))
    out = out.where("n_removed = 0 or n_removed < n_words")
    return out.select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as token pieces in sequences."""
    return packing.pack(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("substring", substring), ("packing", packed)]
#: Classifiers, shingle components and packing are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's tables go once the next one's result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, settled(f"stage-{name}")(lambda d, stage=stage: stage(spark, d, sf_dir))(docs)
        discard(before)
    out = STAGES[-1][1](spark, docs, sf_dir)
    discard(docs)
    return out
