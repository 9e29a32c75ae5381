"""The composite score: seven weighted groups around 50, with confidence by coverage and age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.functions.scalars import clamp, first_match
from sigspark.operators.outcomes import evaluated

# The groups' weights and the decision thresholds.
WEIGHTS = {"technical": 0.70, "news": 0.12, "macro": 0.06, "sector": 0.04, "confirmation": 0.03, "history": 0.03, "regime": 0.02}
STRONG_BUY, BUY, SELL, STRONG_SELL = 82, 70, 35, 20
LEAST_HISTORY = 30


def news_effect(points: Column, confidence: Column, confirmed: Column, confirmation: Column, change: Column) -> tuple[Column, Column]:
    """Effect and price confirmation of one event: a positive event that price and volume don't
    confirm keeps 35 % of its points, and no positive confirmation."""
    alone = (points > 0) & ~F.coalesce(confirmed, F.lit(False))
    effect = points * clamp(confidence, 0, 100) / 100 * F.when(alone, 0.35).otherwise(1.0)
    held = F.least(confirmation, clamp(F.coalesce(change, F.lit(0.0)) / 2, -4, 0))
    return effect, F.when(alone, held).otherwise(confirmation)


def composite_score(df: DataFrame) -> DataFrame:
    """Adds the seven contributions (c_*), score, score_confidence and composite.

    Inputs: technical (0-100 or NULL), technical_age (minutes); news_effect, news_confirmation, news_id
    (NULL without an event); macro_points, sector_points, macro_id, sector_id, macro_age (minutes);
    history_n, history_k (similar earlier records and their successes); regime_points (-5..5 or NULL);
    the five covered inputs rsi, macd, volume_ratio_incl, support20, resistance20.
    """
    c = F.col
    yes = lambda x: F.coalesce(x, F.lit(False))
    macro, sector = F.coalesce(c("macro_points"), F.lit(0.0)), F.coalesce(c("sector_points"), F.lit(0.0))
    # One event counts once: not as macro and sector, and not again if the news already holds it.
    twin = yes(c("macro_id") == c("sector_id")) | (c("sector_id").isNull() & (macro == sector))
    decay = F.when(c("macro_age").isNotNull(), F.pow(F.lit(0.5), c("macro_age") / 1440)).otherwise(0.0)
    history = F.when(c("history_n") >= LEAST_HISTORY, (c("history_k") / c("history_n") - 0.5) * 100).otherwise(0.0)
    d = evaluated(df.withColumns({
        "news_value": clamp(F.coalesce(c("news_effect"), F.lit(0.0)), -10, 10),
        "macro_value": F.when(yes(c("macro_id") == c("news_id")), 0.0).otherwise(macro * decay),
        "sector_value": F.when(twin | yes(c("sector_id") == c("news_id")), 0.0).otherwise(sector * decay),
    }))
    w = WEIGHTS
    d = evaluated(d.withColumns({
        "c_technical": (F.coalesce(c("technical"), F.lit(50.0)) - 50) * w["technical"],
        "c_news": c("news_value") * 5 * w["news"],
        "c_macro": clamp(c("macro_value"), -10, 10) * 5 * w["macro"],
        "c_sector": clamp(c("sector_value"), -10, 10) * 5 * w["sector"],
        "c_confirmation": clamp(F.coalesce(c("news_confirmation"), F.lit(0.0)), -4, 4) * 12.5 * w["confirmation"],
        "c_history": history * w["history"],
        "c_regime": clamp(F.coalesce(c("regime_points"), F.lit(0.0)), -5, 5) * 10 * w["regime"],
    }))
    covered = sum([F.when(c(x).isNotNull(), 1).otherwise(0) for x in ("rsi", "macd", "volume_ratio_incl", "support20", "resistance20")], F.lit(0))
    ten = lambda x: F.when(x, 10).otherwise(0)
    sure = 30 + covered * 6.0 + ten(c("news_effect").isNotNull()) + ten(c("macro_points").isNotNull()) + ten(c("regime_points").isNotNull()) + ten(yes(c("history_n") >= LEAST_HISTORY))
    sure = F.when(c("technical").isNull(), F.least(sure, F.lit(20.0))).otherwise(sure)
    age = c("technical_age")
    sure = sure * first_match((age.isNull(), 0.5), (age > 20, 0.35), (age > 10, 0.7), default=1.0)
    d = evaluated(d.withColumns({"score": clamp(F.lit(50.0) + sum([c(f"c_{g}") for g in w], F.lit(0.0)), 0, 100), "score_confidence": clamp(sure, 0, 100)}))
    weak = (c("score_confidence") < 50) | (c("news_value") <= -5) | (c("macro_value") <= -5)
    return d.withColumn("composite", first_match(
        ((c("score") >= BUY) & weak, "WATCH"), (c("score") >= STRONG_BUY, "STRONG_BUY"), (c("score") >= BUY, "BUY"),
        (c("score") <= STRONG_SELL, "STRONG_SELL"), (c("score") <= SELL, "SELL"), default="WATCH"))
