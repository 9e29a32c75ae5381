"""Additive scores, signal classes and rankings as Column expressions.

The rule tables are fixed values of the scoring model: a condition in ANSI SQL over the
wide indicator row and the points it adds. A rule whose inputs are unknown adds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sigspark.functions.scalars import first_match

# Daily buy and sell points.
BUY_RULES = (
    ("close > sma20", 12), ("sma20 > sma50", 10), ("rsi BETWEEN 45 AND 62", 12), ("macd > macd_signal", 12), ("macd_hist > 0", 8),
    ("cross_up", 8), ("volume_ratio_incl >= 150", 10), ("volume_ratio_incl >= 120 AND volume_ratio_incl < 150", 7), ("close > vwap20", 10),
    ("bb_zone = 'NEAR_LOWER'", 4), ("bb_zone = 'BELOW_LOWER'", 2), ("change_pct > 0 AND change_pct <= 3", 8),
    ("change_pct > 3 AND change_pct <= 5", 4), ("rr >= 2", 10), ("rr > 0 AND rr < 1", -5),
)
SELL_RULES = (
    ("close < sma20", 12), ("sma20 < sma50", 10), ("rsi >= 70", 12), ("rsi < 30", 5), ("macd < macd_signal", 12), ("macd_hist < 0", 8),
    ("cross_down AND NOT cross_up", 8), ("volume_ratio_incl > 0 AND volume_ratio_incl < 70", 7), ("close < vwap20", 10),
    ("bb_zone = 'BELOW_LOWER'", 4), ("bb_zone = 'NEAR_UPPER'", 4), ("bb_zone = 'ABOVE_UPPER'", 8), ("change_pct > 6", 8), ("change_pct < -3", 8),
)
# Next-session potential points.
TOMORROW_RULES = (
    ("close > sma20", 18), ("close <= sma20", -8), ("close > sma50", 12), ("close <= sma50", -6), ("sma20 > sma50", 10), ("sma20 <= sma50", -5),
    ("rsi >= 45 AND rsi <= 60", 15), ("(rsi >= 40 AND rsi < 45) OR (rsi > 60 AND rsi <= 64)", 10), ("rsi >= 35 AND rsi < 40", 5),
    ("rsi > 64 AND rsi < 68", 4), ("rsi >= 30 AND rsi < 35", 1), ("rsi >= 68 AND rsi < 70", -4), ("macd > macd_signal", 12),
    ("macd <= macd_signal", -6), ("macd_hist > 0", 8), ("macd_hist <= 0", -4), ("cross_up", 8), ("volume_ratio_incl >= 150", 10),
    ("volume_ratio_incl >= 120 AND volume_ratio_incl < 150", 7), ("volume_ratio_incl >= 100 AND volume_ratio_incl < 120", 4),
    ("volume_ratio_incl >= 80 AND volume_ratio_incl < 100", 1), ("volume_ratio_incl >= 70 AND volume_ratio_incl < 80", -3),
    ("change_pct > 0 AND change_pct <= 2.5", 8), ("change_pct > 2.5 AND change_pct <= 4", 6), ("change_pct > 4 AND change_pct <= 5", 3),
    ("change_pct > 5 AND change_pct <= 6", -8), ("change_pct > -1 AND change_pct <= 0", 1), ("change_pct > -2 AND change_pct <= -1", -5),
    ("change_pct > -3 AND change_pct <= -2", -10), ("room >= 7 AND room <= 25", 7), ("room >= 5 AND room < 7", 5), ("room >= 3 AND room < 5", 2),
    ("room > 0 AND room < 3", -7), ("room > 25 AND room <= 40", 2), ("room <= 0", -3), ("rr >= 3", 7), ("rr >= 2 AND rr < 3", 5),
    ("rr >= 1.5 AND rr < 2", 2), ("rr > 0 AND rr < 1", -6), ("close > sma20 AND sma20 > sma50 AND macd > macd_signal AND macd_hist > 0", 6),
    ("close > sma20 AND sma20 > sma50 AND rsi >= 45 AND rsi <= 64 AND volume_ratio_incl >= 100", 4), ("close < sma20 AND macd > macd_signal", -5),
)
# Hard exclusions of the next-session list, first match names the reason.
EXCLUSIONS = (
    ("change_pct <= -3", "HARD_FALL"), ("change_pct > 6", "EXTENDED_MOVE"), ("rsi < 30", "OVERSOLD"), ("rsi >= 70", "OVERBOUGHT"),
    ("volume_ratio_incl > 0 AND volume_ratio_incl < 70", "LOW_VOLUME"),
)
# Votes of the aggressive classes and of the oversold reaction.
CLASS_BUY = (
    ("macd > macd_signal", 2), ("macd_hist > 0", 2), ("cross_up", 3), ("close > sma20", 2), ("sma20 > sma50", 2), ("volume_ratio_incl >= 150", 2),
    ("volume_ratio_incl >= 120 AND volume_ratio_incl < 150", 1), ("close > open", 1), ("change_pct > 0 AND change_pct <= 4", 2), ("change_pct > 6", -4),
)
CLASS_SELL = (
    ("macd < macd_signal", 2), ("macd_hist < 0", 2), ("cross_down", 3), ("close < sma20", 2), ("sma20 < sma50", 2), ("volume_ratio_incl >= 150", 2),
    ("volume_ratio_incl >= 120 AND volume_ratio_incl < 150", 1), ("close < open", 1), ("change_pct >= -4 AND change_pct < 0", 2), ("change_pct < -6", -4),
)
REACTION = (
    ("prev_rsi > 0 AND rsi > prev_rsi", 1), ("macd_hist > prev_hist", 1), ("close > open", 1), ("close_position >= 40", 1),
    ("volume_ratio_incl >= 90", 1), ("macd > macd_signal", 1),
)


def rule_sum(rules) -> Column:
    return F.expr(" + ".join(f"(CASE WHEN {c} THEN {p} ELSE 0 END)" for c, p in rules))


def bounded(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def daily_scores(df: DataFrame) -> DataFrame:
    """Buy and sell points, the decision (65 / 60 with a lead of 20, RR 1.5) and confidence."""
    d = df.withColumns({"buy_score": bounded(rule_sum(BUY_RULES), 0, 100), "sell_score": bounded(rule_sum(SELL_RULES), 0, 100)})
    b, s = F.col("buy_score"), F.col("sell_score")
    return d.withColumns({
        "score_decision": first_match(((b >= 65) & (b - s >= 20) & (F.col("rr") >= 1.5), "BUY"), ((s >= 60) & (s - b >= 20), "SELL"), default="WATCH"),
        "score_confidence": F.greatest(b, s)})


def signal_class(df: DataFrame) -> Column:
    r, c, v = F.col("rsi"), F.col("change_pct"), F.col("volume_ratio_incl")
    hits = rule_sum(REACTION)
    reaction = (c > -4) & (c <= 4) & (v >= 50) & (hits >= 3) & (F.col("close_position") >= 35)
    return first_match(
        (r.isNull() | c.isNull() | (r <= 0) | (c >= 8) | (c <= -8), "NEUTRAL"), (r >= 70, "OVERBOUGHT"),
        ((r < 30) & reaction, "OVERSOLD_REACTION"), (r < 30, "NEUTRAL"),
        ((r >= 35) & (r < 68) & (rule_sum(CLASS_BUY) >= 9) & (c > -2), "AGGRESSIVE_BUY"),
        ((r >= 32) & (r < 68) & (rule_sum(CLASS_SELL) >= 9) & (c < 0), "AGGRESSIVE_SELL"), default="NEUTRAL")


def exclusion_reason() -> Column:
    return first_match(*[(F.expr(c), name) for c, name in EXCLUSIONS], default=None)


def tomorrow_score() -> Column:
    """NULL for excluded rows, else 0..95."""
    return F.when(exclusion_reason().isNull(), bounded(rule_sum(TOMORROW_RULES), 0, 95))


def top_k(df: DataFrame, k: int, *order: Column, group: tuple[str, ...] = ()) -> DataFrame:
    """Ranked top k per group with a full tie-break; a window limit is pushed into the partial step."""
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def news_decay(score: Column, minutes: Column, half_life: float = 180.0) -> Column:
    return score * F.pow(F.lit(0.5), F.greatest(F.lit(0.0), minutes) / half_life)


def decision_from_score(score: Column, news: Column, confirmation: Column) -> Column:
    return first_match(
        ((score >= 82) & (news >= -2) & (confirmation >= -1), "STRONG_BUY"), ((score >= 70) & (news >= -4), "BUY"),
        ((score <= 35) | (news <= -8), "SELL"), ((score <= 50) | (news <= -5), "RISKY_WATCH"), default="WATCH")


# Daily technical points around 50.
TECHNICAL_RULES = (
    ("close > sma20", 8), ("close <= sma20", -8), ("close > sma50", 8), ("close <= sma50", -8), ("sma20 > sma50", 7), ("sma20 <= sma50", -7),
    ("rsi >= 45 AND rsi < 70", 8), ("rsi < 30", 2), ("rsi >= 70", -7), ("macd > macd_signal", 8), ("macd <= macd_signal", -8), ("macd_hist > 0", 5),
    ("macd_hist <= 0", -5), ("cross_up", 8), ("cross_down", -8), ("volume_ratio_incl >= 130", 8), ("volume_ratio_incl >= 100 AND volume_ratio_incl < 130", 3),
    ("volume_ratio_incl < 100", -3), ("change_pct > 0", 3), ("change_pct < -3", -3), ("rr >= 2", 5),
)
# Quality points of the two aggressive classes.
QUALITY_VOLUME = (
    ("volume_ratio_incl >= 150", 20), ("volume_ratio_incl >= 120 AND volume_ratio_incl < 150", 16), ("volume_ratio_incl >= 100 AND volume_ratio_incl < 120", 12),
    ("volume_ratio_incl >= 80 AND volume_ratio_incl < 100", 7), ("volume_ratio_incl >= 70 AND volume_ratio_incl < 80", 3), ("volume_ratio_incl < 70", -10),
)
QUALITY_BUY = QUALITY_VOLUME + (
    ("close > sma20", 15), ("sma20 > sma50", 15), ("macd > macd_signal", 15), ("macd_hist > 0", 10), ("rsi BETWEEN 42 AND 62", 10),
    ("(rsi >= 35 AND rsi < 42) OR (rsi > 62 AND rsi < 68)", 4), ("change_pct > 0 AND change_pct <= 3", 10), ("change_pct > 3 AND change_pct <= 4.5", 5),
    ("change_pct > 4.5 AND change_pct <= 6", -5), ("rr >= 2", 5),
)
QUALITY_SELL = QUALITY_VOLUME + (
    ("close < sma20", 15), ("sma20 < sma50", 15), ("macd < macd_signal", 15), ("macd_hist < 0", 10), ("rsi BETWEEN 35 AND 55", 10),
    ("(rsi >= 30 AND rsi < 35) OR (rsi > 55 AND rsi < 68)", 4), ("change_pct >= -3 AND change_pct < 0", 10), ("change_pct >= -4.5 AND change_pct < -3", 5),
    ("change_pct >= -6 AND change_pct < -4.5", -5),
)
# Intraday points.
INTRADAY_RULES = (
    ("from_open BETWEEN 0.5 AND 3", 12), ("from_open > 3 AND from_open <= 5", 9), ("from_open > 5 AND from_open < 8", 4), ("from_open >= -1 AND from_open < 0.5", 2),
    ("from_low BETWEEN 1 AND 4", 10), ("from_low > 4 AND from_low <= 7", 7), ("from_low > 7", 3), ("to_high <= 0.5", 10), ("to_high > 0.5 AND to_high <= 1.5", 7),
    ("to_high > 1.5 AND to_high <= 3", 3), ("rsi BETWEEN 50 AND 68", 12), ("rsi >= 45 AND rsi < 50", 6), ("rsi > 68 AND rsi < 75", 4), ("rsi >= 80", -8), ("rsi < 30", -8),
    ("macd_hist > 0", 14), ("macd_hist > prev_hist", 5), ("volume3_ratio >= 200", 15), ("volume3_ratio >= 150 AND volume3_ratio < 200", 12),
    ("volume3_ratio >= 120 AND volume3_ratio < 150", 8), ("volume3_ratio < 60", -5), ("momentum3 BETWEEN 0.2 AND 1.5", 6), ("momentum3 > 1.5", 3), ("momentum3 <= -1", -5),
    ("momentum6 BETWEEN 0.3 AND 2.5", 6), ("momentum6 <= -1.5", -5),
)


def technical_score() -> Column:
    return bounded(50 + rule_sum(TECHNICAL_RULES), 0, 100)


def aggressive_quality(cls: Column) -> Column:
    return first_match((cls == "AGGRESSIVE_BUY", bounded(rule_sum(QUALITY_BUY), 0, 100)), (cls == "AGGRESSIVE_SELL", bounded(rule_sum(QUALITY_SELL), 0, 100)), default=None)


def reaction_score() -> Column:
    """Strength of a rebound: growth of RSI and histogram, volume, close position, move, reward."""
    part = lambda c, cap: F.least(F.lit(float(cap)), F.greatest(F.lit(0.0), c))
    c, rr = F.col("change_pct"), F.col("rr")
    return (part((F.col("rsi") - F.col("prev_rsi")) * 4, 25) + part((F.col("macd_hist") - F.col("prev_hist")) * 20, 20) + part(F.col("volume_ratio_incl") / 10, 20)
            + part(F.col("close_position") / 5, 20)
            + first_match(((c >= 0) & (c <= 2), 15), ((c > 2) & (c <= 3), 10), ((c > 3) & (c <= 4), 0), (c > 4, -10), default=3)
            + F.when(rr >= 2, F.least(F.lit(5.0), rr)).otherwise(0.0))


def strong_reaction() -> Column:
    return ((F.col("rsi") - F.col("prev_rsi") >= 0.5) & (F.col("macd_hist") > F.col("prev_hist")) & (F.col("volume_ratio_incl") >= 90) & (F.col("close_position") >= 50))


def intraday_exclusion() -> Column:
    return first_match((F.col("from_open") <= -7, "HARD_FALL"), (F.col("from_open") >= 9.5, "HARD_RISE"), default=None)


def intraday_score(breakout: Column, volume_breakout: Column) -> Column:
    extra = first_match((volume_breakout, 15), (breakout, 6), default=0)
    return F.when(intraday_exclusion().isNull(), bounded(rule_sum(INTRADAY_RULES) + extra, 0, 100))
