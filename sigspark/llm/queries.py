"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.llm import decontamination, importance, language, licenses, line_crf, mixing, packing, product_codes, quality_rules, secrets, sharding, simhash, suffix_dedup
from sigspark.llm.common import documents, id_crc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the training fold."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    found = language.identify(docs, language.fit(docs))
    return found.select("doc_id", (id_crc() % 4 == 2).alias("held_out"), "lang_pred", "score", "n_votes")


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and confirmed secret spans of every document."""
    return secrets.scan(documents(spark, sf_dir))


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and the current policy's verdict of every document."""
    book = quality_rules.ledger(documents(spark, sf_dir))
    base = F.col("failed").bitwiseAND(F.lit(quality_rules.Policy("base", quality_rules.BASE).mask)) != 0
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & quality_rules.verdict(quality_rules.CURRENT)).alias("kept"), "failed"
    )


ORACLES["op5_quality_rules"] = quality_rules.ORACLE


@query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 2048 tokens."""
    return packing.packed(documents(spark, sf_dir))


@query
def op8_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under the ``bytes`` law."""
    found = sharding.assigned(documents(spark, sf_dir))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of 200-byte strings that occur twice or more, removed from every document."""
    found = suffix_dedup.deduplicated(documents(spark, sf_dir))
    removed = F.aggregate(F.zip_with("span_starts", "span_ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("span_starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op10_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document from its lines, learned from the training fold's labels."""
    docs = documents(spark, sf_dir)
    model = line_crf.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = line_crf.graded(docs, model)
    return found.select("doc_id", (id_crc() % 5 == 0).alias("held_out"), "score", F.when(F.col("score") >= line_crf.THRESHOLD, 1).otherwise(0).alias("predicted"))


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, with the item and the overlap."""
    return decontamination.overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices and grants in every document, with their coverage."""
    return licenses.scan(documents(spark, sf_dir))


@query
def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, at the sources' target weights."""
    return mixing.mixed(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op11_source_mix"] = mixing.ORACLE


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document, drawn towards the benchmark's distribution."""
    found = importance.resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


ORACLES["op12_importance_resampling"] = importance.ORACLE


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector, with the codebooks' digest."""
    found, book = product_codes.compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select("vec_id", "code", "error", "label_error", F.lit(product_codes.digest(book)).alias("codebooks_sha256"))


ORACLES["op13_vector_codes"] = product_codes.oracle()
