"""Learned adjustment of a ranked list from verified evidence per condition.

Evidence is looked up by horizon, the list's own history first and all signals after it at half
weight. Correlated indicators share one averaged family budget; a combination that is at least
as well supported as its parts replaces their families. The evidence table has one row for each
condition, a number fixed by the code, so it folds into one map and every candidate is adjusted
in place, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigspark.functions import stats as st
from sigspark.functions.scalars import first_match
from sigspark.operators.outcomes import evaluated
from sigspark.operators.reports import long_labels, signal_conditions

# Caps, weights of horizons, shares of win rate, mean and median, scales, families.
MOST, FAMILY_CAP, COMBINATION_CAP = 3.0, 0.75, 1.0
HORIZONS = {1: 0.80, 3: 0.15, 5: 0.05}
CONFIDENCE = {300: 1.0, 100: 0.60, 30: 0.25}
FALLBACK, WIN_SCALE, RETURN_SCALE = 0.5, 0.20, 2.0
EDGE = {"win": 0.4, "mean": 0.3, "median": 0.3}
FAMILIES = {
    "momentum": ("RSI", "MOMENTUM"), "trend": ("PRICE_SMA20", "PRICE_SMA50", "SMA_TREND"), "volume": ("VOLUME", "OBV"),
    "price_position": ("VWAP", "BOLLINGER", "BOLL_BREAKOUT"), "volatility": ("ATR", "BOLL_SQUEEZE"),
}
COMBOS = {"COMBO_RSI_VOLUME": ("momentum", "volume"), "COMBO_TREND_VOLUME": ("trend", "volume"), "COMBO_VWAP_OBV": ("price_position", "volume")}
LEAST = 30


def clip(x: Column, cap: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(-cap), F.least(F.lit(cap), x)))


def verified(prefix: str) -> Column:
    c = lambda n: F.col(f"{prefix}.{n}")
    return F.coalesce((c("completed_n") >= LEAST) & (c("positive") + c("negative") + c("neutral") == c("completed_n"))
                      & (F.abs(c("success_rate") - c("positive") / c("completed_n")) < 0.0001) & c("mean").isNotNull() & c("median").isNotNull(), F.lit(False))


def evidence(history: DataFrame, own: Column) -> DataFrame:
    """indicator, condition, edge, strength: history has the inputs of signal_conditions, horizon and outcome."""
    h = history.filter(F.col("horizon").isin(*HORIZONS)).withColumn("scope", F.explode(F.array_compact(F.array(F.lit("ALL"), F.when(own, F.lit("OWN"))))))
    keep = ["scope", "horizon", "reason", "directional_return", "return_pct", "mfe", "mae"]
    told = st.outcome_stats(long_labels(h, signal_conditions(), keep), ["indicator", "condition", "scope", "horizon"])
    base = st.outcome_stats(h.select(*keep), ["scope", "horizon"])
    cols = ["completed_n", "positive", "negative", "neutral", "success_rate", "mean", "median", "mean_mfe", "mean_mae"]
    x = told.select("indicator", "condition", "scope", "horizon", F.struct(*cols).alias("e")).join(base.select("scope", "horizon", F.struct(*cols).alias("b")), ["scope", "horizon"])
    x = x.filter(verified("e") & verified("b") & (F.col("e.completed_n") <= F.col("b.completed_n")))
    gap = lambda n, scale: clip((F.col(f"e.{n}") - F.col(f"b.{n}")) / scale, 1.0)
    edge = EDGE["win"] * gap("success_rate", WIN_SCALE) + EDGE["mean"] * gap("mean", RETURN_SCALE) + EDGE["median"] * gap("median", RETURN_SCALE)
    n = F.least("e.completed_n", "b.completed_n")
    trust = first_match(*[(n >= k, v) for k, v in CONFIDENCE.items()], default=0.0)
    risk = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("e.mean_mfe")) / F.greatest(F.lit(0.5), F.abs("e.mean_mae"))))
    risk = F.when((edge > 0) & F.col("e.mean_mfe").isNotNull() & F.col("e.mean_mae").isNotNull(), risk).otherwise(1.0)
    x = x.select("indicator", "condition", "horizon", F.struct((F.col("scope") == "OWN").alias("own"), (edge * trust * risk).alias("edge"), trust.alias("trust")).alias("r"))
    best = x.groupBy("indicator", "condition", "horizon").agg(F.max_by("r", "r.own").alias("r"))
    share = F.when(F.col("r.own"), 1.0).otherwise(FALLBACK)
    weight = F.create_map(*[F.lit(v) for kv in HORIZONS.items() for v in kv])[F.col("horizon")]
    g = best.groupBy("indicator", "condition").agg(F.sum(F.col("r.edge") * weight * share).alias("edge"), F.max(F.when(F.col("horizon") == 1, F.col("r.trust") * share)).alias("strength"))
    return g.filter("strength IS NOT NULL")  # longer horizons can't add anything alone


def adjusted(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Adds uncapped and adjustment to rows with the inputs of signal_conditions."""
    key = F.concat_ws("|", "indicator", "condition")
    model = table.agg(F.map_from_entries(F.collect_list(F.struct(key, F.struct("edge", "strength")))).alias("_m"))  # one row, a fixed number of conditions
    told = {n: c for n, c in signal_conditions().items() if n in COMBOS or any(n in f for f in FAMILIES.values())}
    d = evaluated(rows.crossJoin(model).withColumns({f"_{n}": F.try_element_at("_m", F.concat_ws("|", F.lit(n), F.coalesce(c, F.lit("?")))) for n, c in told.items()}))
    own = list(d.columns)
    names = {f: [n for n in members if n in told] for f, members in FAMILIES.items()}
    parts = {}
    for f, members in names.items():
        known = F.array_compact(F.array(*[F.col(f"_{n}.edge") for n in members]))
        parts[f"_f_{f}"] = F.when(F.size(known) > 0, clip(F.aggregate(known, F.lit(0.0), lambda a, b: a + b) / F.size(known) * FAMILY_CAP, FAMILY_CAP))
        parts[f"_s_{f}"] = F.coalesce(F.greatest(*[F.col(f"_{n}.strength") for n in members]), F.lit(0.0))
    d = evaluated(d.withColumns(parts))
    able = []
    for n, families in COMBOS.items():
        e, s = F.col(f"_{n}.edge"), F.col(f"_{n}.strength")
        able.append(F.when((e != 0) & (s >= F.greatest(*[F.col(f"_s_{f}") for f in families])), F.struct(F.abs(e).alias("size"), F.lit(n).alias("name"), e.alias("edge"))))
    d = evaluated(d.withColumn("_best", F.array_max(F.array_compact(F.array(*able)))))
    left = [F.when(F.coalesce(F.col("_best.name").isin(*[n for n, fs in COMBOS.items() if f in fs]), F.lit(False)), 0.0).otherwise(F.coalesce(F.col(f"_f_{f}"), F.lit(0.0))) for f in names]
    total = sum(left, F.lit(0.0)) + F.coalesce(clip(F.col("_best.edge") * COMBINATION_CAP, COMBINATION_CAP), F.lit(0.0))
    d = d.withColumn("uncapped", F.round(total, 6))
    return d.withColumn("adjustment", F.round(clip(F.col("uncapped"), MOST), 6)).drop("_m", "_best", *parts, *[c for c in own if c.startswith("_")])


def reranked(rows: DataFrame, group: str, base: str = "score", rank: str = "rank") -> DataFrame:
    """Adds final_score, learned_rank and rank_change: the same candidates, ties in their base order."""
    final = F.when(F.col("adjustment") != 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col(base) + F.col("adjustment")))).otherwise(F.col(base))
    d = rows.withColumn("final_score", F.round(final, 6))
    # One list of candidates a group: bounded by the universe.
    d = d.withColumn("learned_rank", F.row_number().over(W.partitionBy(group).orderBy(F.desc_nulls_last("final_score"), F.col(rank))))
    return d.withColumn("rank_change", F.col(rank) - F.col("learned_rank"))
