"""The plan for the next session: levels, eight confirmations, deductions and a status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.functions.scalars import first_match
from sigspark.operators import indicators as ind
from sigspark.operators.outcomes import evaluated

# Fixed values.
SESSIONS, VOLUME_CONFIRMED, EXTENSION_ATR, LEAST_RR, CRASH = 51, 130, 3, 1.2, -7 + 1e-9
LEVELS = ("buy_zone_low", "buy_zone_high", "take_profit_low", "take_profit_high", "stop_loss", "risk_reward_ratio", "entry_reference")
# What a shortcoming takes from the confidence; a lack of volume leaves three quarters of it.
DEDUCTIONS = {"NEAR_RESISTANCE": 15, "LOW_RISK_REWARD": 15, "RSI_HIGH": 10, "EXTENDED": 25}


def plan_levels(df: DataFrame, price: str, atr: str, support: str, resistance: str) -> DataFrame:
    """Adds LEVELS, all NULL where any input isn't positive or the levels don't lie in order.

    The buy zone is anchored at the nearer of the two averages between support and price; a close
    resistance limits it and the first target.
    """
    c, p, a, s, r = F.col, F.col(price), F.col(atr), F.col(support), F.col(resistance)
    inputs = (p, a, s, r, c("sma20"), c("ema21"))
    sound = (s < p) & (r > s)
    for x in inputs:
        sound = sound & F.coalesce((x > 0) & ~F.isnan(x), F.lit(False))
    anchor = F.least(p, F.greatest(s, F.least(c("sma20"), c("ema21"))))
    df = df.withColumns({
        "_low": F.greatest(s, anchor - a * 0.23), "_high": F.least(p, anchor + a * 0.03, r - a * 0.1), "_stop": s - a * 0.25,
        "_gain": F.least(r, p + a * 0.5), "_most": F.least(r + a * 0.25, p + a * 0.8), "_sound": F.coalesce(sound, F.lit(False))})
    ordered = c("_sound") & (c("_stop") > 0) & (c("_stop") < c("_low")) & (c("_low") <= c("_high")) & (c("_high") < c("_gain")) & (c("_gain") <= c("_most"))
    entry = (c("_low") + c("_high")) / 2
    values = (c("_low"), c("_high"), c("_gain"), c("_most"), c("_stop"), (c("_gain") - entry) / (entry - c("_stop")), entry)
    return df.withColumns({name: F.when(ordered, v) for name, v in zip(LEVELS, values, strict=True)}).drop("_low", "_high", "_stop", "_gain", "_most", "_sound")


def confirmations() -> dict[str, Column]:
    """The eight of them, each TRUE or FALSE (FALSE where its input is unknown)."""
    c = F.col
    rules = {
        "ABOVE_SMA20": c("close") > c("sma20"),
        "TREND_UP": c("sma20") > c("sma50"),
        "RSI_BALANCED": c("rsi").between(45, 70),
        "MACD_POSITIVE": c("macd_state") == "POSITIVE",
        "VOLUME": c("volume_ratio") >= VOLUME_CONFIRMED,
        "STRUCTURE": c("stop_loss").isNotNull(),
        "RISK_REWARD": c("risk_reward_ratio") >= LEAST_RR,
        "POSITIVE_BODY": c("close") > c("open"),
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in rules.items()}


def warnings() -> dict[str, Column]:
    c = F.col
    room = c("resistance") - c("close")
    rules = {
        "NO_VOLUME": c("volume_ratio").isNull(),
        "WEAK_VOLUME": c("volume_ratio") < VOLUME_CONFIRMED,
        "NEAR_RESISTANCE": (room > 0) & (room <= c("atr14") * 0.25),
        "NO_STRUCTURE": c("risk_reward_ratio").isNull(),
        "LOW_RISK_REWARD": c("risk_reward_ratio") < LEAST_RR,
        "RSI_HIGH": c("rsi") >= 70,
        "EXTENDED": F.abs(c("close") - c("ema21")) / c("atr14") > EXTENSION_ATR,
        "NEGATIVE_TREND": c("trend_state") == "NEGATIVE",
        "CRASH": c("change_pct") <= CRASH,
        "STALE": c("asked_no") > c("session_no"),
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in rules.items()}


def asked(df: DataFrame, bars: DataFrame, win: ind.BarWindow) -> DataFrame:
    """A row for every session of the market at which a bar is the symbol's newest: ``asked_no``.

    More than one only across a gap in the symbol's bars; the market's last session is one row.
    """
    df = df.withColumn("_next", F.lead(win.order).over(win.seq)).crossJoin(bars.agg(F.max(win.order).alias("_end")))
    until = F.coalesce(F.col("_next") - 1, F.col("_end"))
    return df.withColumn("asked_no", F.explode(F.sequence(F.col(win.order), until))).drop("_next", "_end")


def tomorrow_plan(bars: DataFrame) -> DataFrame:
    """One plan for each symbol and session asked at.

    bars: symbol, session_no (consecutive numbers of the market's sessions), open, high, low, close,
    volume. A plan needs 51 sessions without a gap and with sound prices, else its status is
    INSUFFICIENT and everything else NULL. It reads nothing after its own session. A plan that is
    blocked (negative trend, a fall of 7 %, overextended, stale, no valid levels) keeps no levels.
    All windows are those of the indicators: one partitioning by symbol.
    """
    win, c = ind.BarWindow("symbol"), F.col
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    good = (c("low") > 0) & (c("high") >= top) & (c("low") <= bottom)
    df = ind.indicator_frame(bars, win)
    df = df.withColumns({
        "support": F.min("low").over(win.rows(-5, -1)), "resistance": F.max("high").over(win.rows(-5, -1)), "_hist": win.lag("macd_hist"),
        "_good": F.sum(F.when(good, 1).otherwise(0)).over(win.rows(1 - SESSIONS)), "_since": win.lag("session_no", SESSIONS - 1)})
    ready = (c("_good") == SESSIONS) & (c("session_no") - c("_since") == SESSIONS - 1) & (c("atr14") > 0)
    df = asked(df.withColumn("ready", F.coalesce(ready, F.lit(False))), bars, win)
    hist, old = c("macd_hist"), c("_hist")
    macd = F.when(hist.isNotNull() & old.isNotNull(), first_match(((hist > 0) & (hist >= old), "POSITIVE"), (hist > old, "IMPROVING"), (hist > 0, "WEAKENING"), default="NEGATIVE"))
    trend = first_match(((c("close") > c("sma20")) & (c("sma20") > c("sma50")), "POSITIVE"), ((c("close") < c("sma20")) & (c("sma20") < c("sma50")), "NEGATIVE"), default="NEUTRAL")
    df = plan_levels(df.withColumns({"macd_state": macd, "trend_state": trend}), "close", "atr14", "support", "resistance")
    passed, failed = confirmations(), warnings()
    names = lambda rules: F.array_compact(F.array(*[F.when(v, k) for k, v in rules.items()]))
    df = evaluated(df.withColumns({"reasons": names(passed), "warnings": names(failed)}))
    warned = lambda k: F.array_contains("warnings", k)
    count = F.size("reasons")
    confidence = count / len(passed) * 100 * F.when(warned("NO_VOLUME"), 0.75).otherwise(1.0) - sum([F.when(warned(k), v).otherwise(0) for k, v in DEDUCTIONS.items()], F.lit(0))
    blocked = F.arrays_overlap("warnings", F.array(*map(F.lit, ("NEGATIVE_TREND", "CRASH", "EXTENDED", "STALE", "NO_STRUCTURE"))))
    capped = F.when(c("blocked"), F.least(c("confidence"), F.lit(35.0))).otherwise(c("confidence"))
    df = df.withColumns({"confirmation_count": count, "confidence": confidence, "blocked": blocked})
    df = df.withColumn("confidence", F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), capped)), 2))
    buyable = (c("confirmation_count") >= 6) & (c("confidence") >= 70) & (c("risk_reward_ratio") >= LEAST_RR) & c("volume_ratio").isNotNull()
    breakout = F.when(c("close") > c("resistance"), F.when(F.coalesce(c("volume_ratio") >= VOLUME_CONFIRMED, F.lit(False)) & (c("close") > c("open")), "CONFIRMED").otherwise("WEAK")).otherwise("WAITING")
    target = c("resistance") + c("atr14") * 0.6
    known = {
        "reference_price": c("close"), "support": c("support"), "resistance": c("resistance"), "macd_state": c("macd_state"), "trend_state": c("trend_state"),
        "breakout_status": breakout, "breakout_target": F.when((c("resistance") > 0) & (target > c("close")), target),
        **{k: F.when(~c("blocked"), c(k)) for k in LEVELS}, "confidence": c("confidence"), "reasons": c("reasons")}
    return df.select(
        "symbol", "asked_no", "session_no", (c("session_no") + 1).alias("plan_no"), *[F.when(c("ready"), v).alias(k) for k, v in known.items()],
        F.when(c("ready"), c("confirmation_count")).otherwise(0).alias("confirmation_count"),
        F.when(c("ready"), c("warnings")).otherwise(F.array(F.lit("DAILY_DATA"))).alias("warnings"),
        first_match((~c("ready"), "INSUFFICIENT"), (c("blocked"), "WAIT"), (F.coalesce(buyable, F.lit(False)), "BUYABLE"), default="CAUTIOUS").alias("plan_status"))
