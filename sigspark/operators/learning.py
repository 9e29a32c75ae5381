"""Weights, calibration and similar-history evidence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.functions import stats as st


def bounded_weights(proposals: DataFrame, scope: str, step: float = 0.005) -> DataFrame:
    """Project each scope's few weights onto the bounded simplex around its previous weights.

    proposals: scope, criterion, weight, baseline (the previous weight of that criterion). A weight
    stays within ``step`` and half of its own baseline, and a scope's weights sum to what its
    baselines sum to, so a scope that lacks a criterion isn't stretched to 1. One scope holds one
    row per criterion, so a group is a handful of rows; the scopes are spread over the cluster.
    """
    def project(g: pd.DataFrame) -> pd.DataFrame:
        base = g["baseline"]
        low = pd.concat([base * 0.5, base - step], axis=1).max(axis=1)
        high = pd.concat([base * 1.5, base + step], axis=1).min(axis=1)
        a, b = -1.0, 1.0
        for _ in range(80):
            mid = (a + b) / 2
            w = (g["weight"] + mid).clip(lower=low, upper=high)
            a, b = (mid, b) if w.sum() < base.sum() else (a, mid)
        return g.assign(weight=w.round(12))

    return proposals.groupBy(scope).applyInPandas(project, proposals.schema)


def calibrated_score(rows: DataFrame, weights: DataFrame, flags: list[str], base: float, raw: str, gate: float, unsafe, cap: float = 3.0, by: str | None = None) -> DataFrame:
    """Raw score plus the capped weight delta of true, approved flags.

    The weights table has one row per criterion, so it is folded into one map row and
    every record is scored in place, without a shuffle of the records. With ``by`` (a column
    of both sides, such as the horizon) there is one map for each of its values.
    """
    entries = F.map_from_entries(F.collect_list(F.struct("criterion", "weight"))).alias("_m")
    d = rows.join(weights.groupBy(by).agg(entries), by, "left") if by else rows.crossJoin(weights.agg(entries))
    parts = [F.when(F.col(f), (F.coalesce(F.try_element_at("_m", F.lit(f)), F.lit(base)) - base) * 100).otherwise(0.0) for f in flags]
    delta = F.greatest(F.lit(-cap), F.least(F.lit(cap), sum(parts, F.lit(0.0))))
    delta = F.when(F.col(raw) < gate, 0.0).when(F.coalesce(unsafe, F.lit(False)), F.least(F.lit(0.0), delta)).otherwise(delta)
    return d.withColumn("delta", delta).withColumn("final", F.greatest(F.lit(0.0), F.least(F.lit(95.0), F.col(raw) + F.col("delta")))).drop("_m")


def masks(flags: list[str]) -> tuple:
    known = sum([F.when(F.col(f).isNotNull(), 1 << i).otherwise(0) for i, f in enumerate(flags)], F.lit(0)).cast("long")
    value = sum([F.when(F.col(f), 1 << i).otherwise(0) for i, f in enumerate(flags)], F.lit(0)).cast("long")
    return known, value


def similar_history(queries: DataFrame, history: DataFrame, flags: list[str], scope: list[str], shared: int = 5, equal: float = 0.7, per: tuple[str, ...] = ()) -> DataFrame:
    """Laplace success probability over history with enough equal known flags.

    ``per`` names columns, such as the horizon, that a query asks for and its history must equal.

    Both sides are first folded to flag patterns (known mask, value mask) per scope, so
    the inequality join compares patterns, whose number is set by the flags, not rows.
    """
    k, v = masks(flags)
    h = history.withColumns({"hk": k, "hv": v}).groupBy(*scope, *per, "hk", "hv").agg(
        F.count(F.lit(1)).alias("n"), st.count_if(F.col("status") == "SUCCESS").alias("s"), F.sum("directional_return").alias("r"))
    q = queries.withColumns({"qk": k, "qv": v})
    patterns = q.select(*scope, "qk", "qv").distinct()
    both = F.col("hk").bitwiseAND(F.col("qk"))
    n_both = F.bit_count(both)
    agree = n_both - F.bit_count(both.bitwiseAND(F.col("hv").bitwiseXOR(F.col("qv"))))
    m = patterns.join(h, scope).filter((n_both >= shared) & (agree >= equal * n_both)).groupBy(*scope, *per, "qk", "qv").agg(
        F.sum("n").alias("sample"), ((F.sum("s") + 1) / (F.sum("n") + 2) * 100).alias("probability"), (F.sum("r") / F.sum("n")).alias("mean_return"))
    return q.join(m, [*scope, *per, "qk", "qv"], "left").drop("qk", "qv")
