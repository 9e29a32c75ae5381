"""Price levels and news effects as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.functions.scalars import clamp, first_match

G, L, lit = F.greatest, F.least, F.lit


def daily_levels(df: DataFrame) -> DataFrame:
    """Entry band, two targets, stop and reward/risk from support, resistance and ATR."""
    p, a = F.col("close"), F.col("atr14")
    d = df.filter(a.isNotNull()).withColumns({
        "entry_low": G(F.col("support20"), p - a), "entry_high": L(p + a * 0.5, F.col("resistance20")),
        "target1": G(F.col("resistance20"), p + a * 1.5), "stop": G(lit(0.01), L(F.col("support20") - a * 0.25, p - a * 1.5)),
        "next_low": G(lit(0.01), p - L(a * 0.23, p * 0.022)), "next_take_profit": p + a * 0.5, "next_stop": G(lit(0.01), p - L(a * 0.5, p * 0.046)),
    })
    risk = p - F.col("stop")
    return d.withColumns({"target2": G(F.col("resistance60"), F.col("target1") + a), "next_high": G(F.col("next_low"), p + L(a * 0.03, p * 0.004)),
                          "level_rr": F.when(risk > 0, (F.col("target1") - p) / risk).otherwise(0.0)})


def intraday_levels(price: Column, vwap: Column, atr: Column, support: Column, resistance: Column) -> Column:
    """Struct of buy zone, stop, target and reward/risk; NULL when the structure is broken."""
    anchor = L(price, G(vwap, support))
    low, high = G(support, anchor - atr * 0.35), L(price, anchor + atr * 0.25)
    stop = L(support, low) - atr * 0.25
    target = F.when(resistance > high, L(resistance, high + atr * 2)).otherwise(high + atr * 2)
    entry = (low + high) / 2
    known = (price > 0) & (vwap > 0) & (atr > 0) & (support > 0) & (resistance > 0)
    ok = known & (stop > 0) & (stop < low) & (low <= high) & (high < target) & (entry > stop)
    return F.when(ok, F.struct(low.alias("zone_low"), high.alias("zone_high"), stop.alias("stop"), target.alias("target"),
                               ((target - entry) / (entry - stop)).alias("rr")))


def price_confirmation(news: Column, change: Column, volume: Column, above_vwap: Column, obv_up: Column) -> Column:
    """How far price, volume, VWAP side and OBV side agree with a news score, within +-4."""
    side = first_match((above_vwap, 1.0), (~above_vwap, -1.0), default=0.0) + first_match((obv_up, 0.8), (~obv_up, -0.8), default=0.0)
    up = (first_match((change > 0, L(lit(2.0), change / 2)), (change < -1, -L(lit(3.0), F.abs(change) / 1.5)), default=0.0)
          + first_match((volume >= 150, 1.5), (volume < 80, -0.5), default=0.0))
    down = (first_match((change < 0, -L(lit(2.0), F.abs(change) / 2)), (change > 1, L(lit(2.0), change / 2)), default=0.0)
            + F.when((volume >= 150) & (change < 0), -1.5).otherwise(0.0))
    return clamp(first_match((news > 0, up + side), (news < 0, down + side), default=0.0), -4, 4)


def news_blend(technical: Column, news: Column, confidence: Column) -> Column:
    return clamp(technical + clamp(news * clamp(confidence, 0, 100) / 100, -10, 10), 0, 100)


def final_score(technical: Column, news: Column, confidence: Column, sector: Column, macro: Column, confirmation: Column, regime: Column) -> Column:
    """Technical score plus the weighted side layers, which move it by 20 at most."""
    shift = (clamp(news, -10, 10) * clamp(confidence, 0, 100) / 100 * 1.2 + clamp(sector, -10, 10) * 0.7 + clamp(macro, -10, 10) * 0.5
             + clamp(confirmation, -4, 4) * 1.3 + clamp(regime, -5, 5) * 0.8)
    return clamp(clamp(technical, 0, 100) + clamp(shift, -20, 20), 0, 95)


def net_effect(news: Column, confidence: Column, confirmation: Column) -> Column:
    return clamp((clamp(news, -10, 10) * clamp(confidence, 0, 100) / 100 + clamp(confirmation, -4, 4)) / 14, -0.8, 0.8)


def dynamic_levels(price: Column, atr: Column, support: Column, resistance: Column, effect: Column) -> dict[str, Column]:
    """Levels moved by the net effect; a negative effect can only tighten them."""
    plus = G(lit(0.0), effect)
    k_stop = first_match((effect <= -0.35, 0.80), (effect < 0, 1.0), (effect >= 0.35, 1.45), default=1.25)
    k_target = first_match((effect <= -0.35, lit(0.85)), (effect < 0, lit(1.15)), default=1.70 + effect * 0.90)
    raw = price + atr * k_target
    target = F.when(resistance > price, first_match((effect < 0, L(raw, resistance, price + atr * 1.2)), (effect < 0.25, L(raw, resistance)),
                                                    default=L(raw, resistance + atr * 0.6))).otherwise(raw)
    return {"zone_low": price - atr * (0.65 - plus * 0.15), "zone_high": price + atr * (0.20 + plus * 0.10),
            "target": target, "stop": G(lit(0.0), price - atr * k_stop, support - atr * 0.2)}


def alarm_level(score: Column, confidence: Column, importance: Column) -> Column:
    return first_match(
        ((score >= 6) & (confidence >= 70) & (importance >= 70), "STRONG_POSITIVE"), ((score >= 3) & (score < 6) & (confidence >= 75) & (importance >= 60), "POSITIVE"),
        ((score <= -6) & (confidence >= 70) & (importance >= 70), "STRONG_NEGATIVE"), ((score <= -3) & (score > -6) & (confidence >= 75) & (importance >= 60), "NEGATIVE"), default="NONE")
