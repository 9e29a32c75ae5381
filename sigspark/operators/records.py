"""Frozen records: duplicates, conflicts, immutable merge, list comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def payload_hash(columns: list[str]):
    """SHA-256 over the named columns as sorted JSON."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def dedupe_records(rows: DataFrame, natural: list[str], payload: list[str], identity: str) -> DataFrame:
    """Natural keys with copies, a conflict flag and the kept identity.

    Same key and hash is a duplicate, another hash a conflict; an identity under two
    keys makes both conflict. Everything is counted on the whole input, before any gate,
    and only hashes travel: min and max of the hash stand in for a distinct count.
    """
    h = rows.withColumns({"_h": payload_hash(payload), "_k": F.sha2(F.to_json(F.struct(*natural)), 256)})
    ids = h.groupBy(identity).agg(F.min("_k").alias("_a"), F.max("_k").alias("_b")).filter("_a <> _b")
    bad_keys = h.join(ids.select(identity), identity, "left_semi").select("_k").distinct().withColumn("_bad", F.lit(True))
    g = h.groupBy("_k", *natural).agg(
        F.count(F.lit(1)).alias("copies"), F.min("_h").alias("_h1"), F.max("_h").alias("_h2"), F.min(identity).alias("kept_id"))
    return g.join(bad_keys, "_k", "left").select(
        *natural, "copies", "kept_id", ((F.col("_h1") != F.col("_h2")) | F.coalesce("_bad", F.lit(False))).alias("conflict"))


def merge_immutable(stored: DataFrame, incoming: DataFrame, key: list[str], frozen: list[str], outcome: list[str]) -> DataFrame:
    """Classify each incoming record against the stored one.

    INSERT when new, CONFLICT when a frozen field or a completed outcome differs,
    DUPLICATE when nothing differs, UPDATE when only open outcomes are filled.
    """
    left = stored.select(*key, F.lit(True).alias("_known"), payload_hash(frozen).alias("_sf"), *[F.col(c).alias(f"_s_{c}") for c in outcome])
    right = incoming.select(*key, payload_hash(frozen).alias("_if"), *outcome)
    d = right.join(left, key, "left")
    clash, fill = F.lit(False), F.lit(False)
    for c in outcome:
        s, i = F.col(f"_s_{c}"), F.col(c)
        clash = clash | (s.isNotNull() & ~s.eqNullSafe(i))
        fill = fill | (s.isNull() & i.isNotNull())
    kind = (F.when(F.col("_known").isNull(), "INSERT").when((F.col("_sf") != F.col("_if")) | clash, "CONFLICT")
            .when(fill, "UPDATE").otherwise("DUPLICATE"))
    return d.select(*key, kind.alias("action"))
