"""The 36 tri-state evidence criteria of a frozen record, and their families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.operators.outcomes import evaluated

# The criteria by family.
FAMILIES = {
    "trend": ("SMA_TREND", "EMA_TREND", "MACD"),
    "momentum": ("RSI", "MOMENTUM"),
    "volume": ("VOLUME", "OBV_TREND", "OBV_BREAK", "OBV_POS_DIVERGENCE", "OBV_NEG_DIVERGENCE", "VOLUME_BREAKOUT"),
    "price_position": ("VWAP", "VWAP_RECLAIM", "BOLLINGER_SQUEEZE", "BOLLINGER_BREAK", "SUPPORT_RESISTANCE"),
    "volatility": ("ATR_NORMAL", "RISK_REWARD"),
    "market": ("MARKET_POSITIVE", "MARKET_NEGATIVE", "BREADTH_POSITIVE", "BREADTH_NEGATIVE"),
    "sector": ("SECTOR_STRONG", "SECTOR_WEAK"),
    "news": ("DISCLOSURE", "COMPANY_SITE", "NEWS_POSITIVE", "NEWS_NEGATIVE", "NEWS_PRICE_CONFIRMED"),
    "macro": ("MACRO_POSITIVE", "MACRO_NEGATIVE"),
    "decision": ("STRONG_BUY", "BUY", "WAIT", "SELL", "STRONG_SELL"),
}
CRITERIA = tuple(c for family in FAMILIES.values() for c in family)


def evidence_flags(known: Column) -> dict[str, Column]:
    """Criterion -> BOOLEAN, NULL where its input is unknown or the record is not ``known`` yet.

    Inputs: rsi, macd, macd_signal, sma20, sma50, ema9, ema21, close, prev_close, vwap20,
    prev_vwap20, obv_trend, obv_break, obv_divergence, bb_mid, bb_squeeze, bb_upper_break,
    momentum3, volume_ratio_incl, rr, support20, resistance20, atr14, breakout_level; market_score,
    breadth_score, market_confidence, sector_score, sector_confidence (scores around 0);
    news_source, news_confirmed, news_points, macro_points; final.
    """
    c = F.col
    volume = c("volume_ratio_incl") >= 150
    obv = c("obv_trend").isNotNull()
    sure = lambda score, confidence, test: F.when(F.coalesce(c(confidence), F.lit(0.0)) >= 50, test(c(score)))
    up, down = (lambda x: x > 0), (lambda x: x < 0)
    event = c("news_source").isNotNull()
    atr = c("atr14") / c("close") * 100
    flags = {
        "SMA_TREND": c("sma20") > c("sma50"),
        "EMA_TREND": c("ema9") > c("ema21"),
        "MACD": c("macd") > c("macd_signal"),
        "RSI": c("rsi").between(45, 65),
        "MOMENTUM": c("momentum3") > 0,
        "VOLUME": volume,
        "OBV_TREND": c("obv_trend") == "RISING",
        "OBV_BREAK": c("obv_break") == "UP",
        "OBV_POS_DIVERGENCE": F.when(obv, c("obv_divergence").eqNullSafe("POSITIVE")),
        "OBV_NEG_DIVERGENCE": F.when(obv, c("obv_divergence").eqNullSafe("NEGATIVE")),
        "VOLUME_BREAKOUT": F.when(volume.isNotNull() & (c("breakout_level") > 0), (c("close") >= c("breakout_level")) & volume),
        "VWAP": c("close") > c("vwap20"),
        "VWAP_RECLAIM": (c("prev_close") <= c("prev_vwap20")) & (c("close") > c("vwap20")),
        "BOLLINGER_SQUEEZE": F.when(c("bb_mid").isNotNull(), c("bb_squeeze")),
        "BOLLINGER_BREAK": F.when(c("bb_mid").isNotNull(), c("bb_upper_break")),
        "SUPPORT_RESISTANCE": (c("support20") <= c("close")) & (c("close") < c("resistance20")),
        "ATR_NORMAL": F.when(c("close") > 0, atr.between(0, 5)),
        "RISK_REWARD": c("rr") >= 1.5,
        "MARKET_POSITIVE": sure("market_score", "market_confidence", up),
        "MARKET_NEGATIVE": sure("market_score", "market_confidence", down),
        "BREADTH_POSITIVE": sure("breadth_score", "market_confidence", up),
        "BREADTH_NEGATIVE": sure("breadth_score", "market_confidence", down),
        "SECTOR_STRONG": sure("sector_score", "sector_confidence", up),
        "SECTOR_WEAK": sure("sector_score", "sector_confidence", down),
        "DISCLOSURE": F.when(event, c("news_source").contains("DISCLOSURE")),
        "COMPANY_SITE": F.when(event, c("news_source").contains("SITE")),
        "NEWS_POSITIVE": F.when(event, c("news_points") > 0),
        "NEWS_NEGATIVE": F.when(event, c("news_points") < 0),
        "NEWS_PRICE_CONFIRMED": F.when(event, c("news_confirmed")),
        "MACRO_POSITIVE": c("macro_points") > 0,
        "MACRO_NEGATIVE": c("macro_points") < 0,
        **{k: c("final") == k for k in FAMILIES["decision"]},
    }
    return {k: F.when(known, v) for k, v in flags.items()}

# How much of the weight a family may hold.
BUDGETS = {"trend": 0.15, "momentum": 0.15, "volume": 0.15, "price_position": 0.15, "volatility": 0.1, "market": 0.08, "sector": 0.06, "news": 0.1, "macro": 0.06, "decision": 0.0}
BASE_WEIGHT = {c: BUDGETS[family] / len(members) for family, members in FAMILIES.items() for c in members}


def controlled_score(df: DataFrame, weights: DataFrame, raw: str, valid: Column, unsafe: Column, cap: float = 2.0) -> DataFrame:
    """Adds a shadow score beside ``raw``: part_<family>, correction, shadow.

    df holds the criteria as columns; weights (criterion, weight) are the approved ones. They fold
    into one map row, so records are scored in place. A criterion that is true moves its family by
    its weight less its base, in points. The sum is capped; a model that isn't ``valid`` yet gives 0,
    an ``unsafe`` record keeps only a malus, and a record without a known criterion stays as it is.
    """
    model = weights.agg(F.map_from_entries(F.collect_list(F.struct("criterion", "weight"))).alias("_m"))  # at most one row a criterion
    d = df.crossJoin(model)
    zero = F.lit(0.0)

    def share(c: str) -> Column:
        return F.when(F.col(c), (F.coalesce(F.try_element_at("_m", F.lit(c)), F.lit(BASE_WEIGHT[c])) - BASE_WEIGHT[c]) * 100).otherwise(zero)

    parts = {f"part_{family}": F.when(valid, sum([share(c) for c in members], zero)).otherwise(zero) for family, members in FAMILIES.items()}
    d = evaluated(d.withColumns(parts))
    delta = F.greatest(F.lit(-cap), F.least(F.lit(cap), sum([F.col(p) for p in parts], zero)))
    known = F.exists(F.array(*[F.col(c).isNotNull() for c in CRITERIA]), lambda x: x)
    delta = F.when(~known, zero).when(F.coalesce(unsafe, F.lit(True)), F.least(zero, delta)).otherwise(delta)
    d = evaluated(d.withColumn("correction", delta).drop("_m"))
    return d.withColumn("shadow", F.greatest(zero, F.least(F.lit(100.0), F.col(raw) + F.col("correction"))))
