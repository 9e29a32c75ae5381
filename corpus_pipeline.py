"""The corpus pipeline: language ID, near-dedup, decontamination, secrets, packing.

Each stage works on all that the stage before kept. Rows are told apart by a number that is
written down once, so null and repeated doc_ids are rows like any other; the columns travel in
one struct, so no column's name can clash with a stage's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.llm import decontamination, language, packing, secrets, simhash
from sigspark.llm.common import documents, written

#: A document goes if it has no letter or if no language reaches this pooled probability.
LEAST_LANGUAGE_SCORE = 0.3


def numbered(docs: DataFrame) -> DataFrame:
    """row (all columns), rid: written, so that a number stays with its row."""
    return written(docs.select(F.struct("*").alias("row")).withColumn("rid", F.monotonically_increasing_id()))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language the network can tell; it learns from this stage's input."""
    whole = docs.select(F.struct("*").alias("row"), "text")
    found = language.identify(whole, language.fit(docs), keep=["row"])
    kept = (F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return found.filter(kept).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate component: the least doc_id, then the first row."""
    whole = numbered(docs)
    groups = simhash.near_duplicates(whole.select(F.col("rid").alias("doc_id"), F.col("row.text").alias("text")))
    groups = groups.select(F.col("doc_id").alias("rid"), F.col("component_id").alias("component"))
    order = F.struct(F.col("row.doc_id").isNull().alias("unnamed"), F.col("row.doc_id").alias("doc_id"), "rid")
    named = groups.join(whole.select("rid", order.alias("order")), "rid")
    kept = named.groupBy("component").agg(F.min("order").alias("o")).select(F.col("o.rid").alias("rid"))
    gone = written(groups.join(kept, "rid", "left_anti").select("rid"))
    return whole.join(gone, "rid", "left_anti").select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark passage."""
    whole = numbered(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.overlaps(whole.select("rid", F.col("row.text").alias("text")), benchmark, key="rid")
    gone = written(found.select("rid").distinct())
    return whole.join(gone, "rid", "left_anti").select("row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep all documents, with every secret replaced by its kind."""
    return secrets.redact(docs, length="n_chars" if "n_chars" in docs.columns else None)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 2048 tokens."""
    return packing.packed(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("redact_secrets", redact_secrets),
    ("pack", pack),
]

#: SQL can't express the network, the covering code or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = documents(spark, sf_dir)
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = written(docs)
    return docs
