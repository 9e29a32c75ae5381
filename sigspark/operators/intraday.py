"""Intraday votes, levels and same-session outcome labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sigspark.functions.scalars import first_match, float_change, float_side_return, pct_change
from sigspark.operators import outcomes as out

# The nine criteria and the family each belongs to.
FAMILIES = {"VWAP": "POSITION", "EMA": "TREND", "RSI": "MOMENTUM", "MACD": "MOMENTUM", "MOMENTUM": "MOMENTUM", "VOLUME": "FLOW",
            "OBV": "FLOW", "BOLLINGER": "POSITION", "CANDLE": "CANDLE"}
# When a criterion is known, votes buy, votes sell (ANSI SQL over the wide row).
VOTES = {
    "VWAP": ("vwap IS NOT NULL", "close > vwap", "close < vwap"),
    "EMA": ("ema9 IS NOT NULL", "ema9 > ema21", "ema9 < ema21"),
    "RSI": ("rsi IS NOT NULL", "rsi BETWEEN 45 AND 70", "rsi BETWEEN 30 AND 55"),
    "MACD": ("prev_hist IS NOT NULL", "macd_hist > 0 AND macd_hist > prev_hist", "macd_hist < 0 AND macd_hist < prev_hist"),
    "VOLUME": ("volume_ratio IS NOT NULL", "volume_ratio >= 130 AND close > open", "volume_ratio >= 130 AND close < open"),
    "OBV": ("obv_trend IS NOT NULL", "obv_trend = 'RISING'", "obv_trend = 'FALLING'"),
    "BOLLINGER": ("bb_mid IS NOT NULL", "close > bb_mid AND close <= bb_upper", "close < bb_mid AND close >= bb_lower"),
    "MOMENTUM": ("momentum3 IS NOT NULL", "momentum3 > 0.05", "momentum3 < -0.05"),
    "CANDLE": ("close_position IS NOT NULL", "close > open AND close_position >= 65", "close < open AND close_position <= 35"),
}


def vote(name: str):
    known, buy, sell = VOTES[name]
    return F.expr(f"CASE WHEN NOT ({known}) THEN 'MISSING' WHEN {buy} THEN 'BUY' WHEN {sell} THEN 'SELL' ELSE 'NEUTRAL' END")


def nine_votes(df: DataFrame, min_votes: int = 6, min_families: int = 3, min_confidence: float = 60) -> DataFrame:
    """Votes, side, confidence with extension penalty, and the gated signal."""
    d = out.evaluated(df.withColumns({f"v_{n.lower()}": vote(n) for n in VOTES}))
    v = {n: F.col(f"v_{n.lower()}") for n in VOTES}

    def count(side):
        return sum([F.when(c == side, 1).otherwise(0) for c in v.values()], F.lit(0))

    d = d.withColumns({"buy": count("BUY"), "sell": count("SELL"), "missing": count("MISSING")})
    d = d.withColumn("side", first_match((F.col("buy") > F.col("sell"), "BUY"), (F.col("sell") > F.col("buy"), "SELL"), default="WATCH"))
    fam = F.size(F.array_distinct(F.array_compact(F.array(*[F.when(c == F.col("side"), F.lit(FAMILIES[n])) for n, c in v.items()]))))
    top, low = F.greatest("buy", "sell"), F.least("buy", "sell")
    dist = F.when(F.col("atr14") > 0, F.abs(F.col("close") - F.col("vwap")) / F.col("atr14"))
    penalty = F.coalesce(F.least(F.lit(40.0), F.greatest(F.lit(0.0), dist - 3) * 10), F.lit(0.0))
    conf = F.greatest(F.lit(0.0), 100 * ((9 - F.col("missing")) / 9) * (top / 9) * (1 - low / 9) - penalty)
    d = d.withColumns({"votes": top, "families": fam, "penalty": penalty, "vote_confidence": conf})
    ok = (F.col("votes") >= min_votes) & (F.col("families") >= min_families) & (F.col("vote_confidence") >= min_confidence)
    return d.withColumn("signal", F.when(ok, F.col("side")).otherwise("WATCH"))


def buy_sell(df: DataFrame, least_rr: float = 1.4) -> DataFrame:
    """Buying and selling points of a bar, levels from its session's range so far, and the decision.

    Inputs: close, day_open, day_high, day_low (the session up to the bar), vwap, macd_hist, prev_hist,
    ema9, ema21, obv_trend, rsi, volume3_ratio, momentum3, momentum6, resistance20 (the highest high of
    the 20 bars before). An unknown input gives no points. To buy takes ``least_rr`` reward for a unit of
    risk and 20 points more than to sell; to sell takes 20 points more than to buy. Adds buy_points,
    sell_points, entry_low, entry_high, take_profit, stop_loss, risk_pct, reward_pct, reward_risk,
    decision_confidence and decision.
    """
    c, price, hist = F.col, F.col("close"), F.col("macd_hist")
    e9, e21, rsi, flow = c("ema9"), c("ema21"), c("rsi"), c("volume3_ratio")
    above, below = (price > e9) & (e9 > e21), (price < e9) & (e9 < e21)
    breakout = price > c("resistance20")
    buy = [
        [(price > c("vwap"), 18)],
        [(hist > 0, 15)],
        [((hist > 0) & (hist > c("prev_hist")), 12)],
        [(above, 12), (below, 0), (e9 > e21, 5)],
        [(c("obv_trend") == "RISING", 8)],
        [(rsi.between(50, 68), 12)],
        [(flow >= 150, 15), (flow >= 120, 9)],
        [((c("momentum3") > 0) & (c("momentum6") > 0), 12)],
        [(breakout & (flow >= 130), 16), (breakout, 7)],
    ]
    sell = [
        [(price < c("vwap"), 18)],
        [(hist <= 0, 15)],
        [((hist < 0) & (hist < c("prev_hist")), 12)],
        [(above, 0), (below, 12), (e9 < e21, 5)],
        [(c("obv_trend") == "FALLING", 8)],
        [(rsi >= 75, 12), (rsi < 35, 8)],
        [(flow < 60, 10)],
        [((c("momentum3") < 0) & (c("momentum6") < 0), 12)],
        [(pct_change(price, c("day_open")) > 6, 10)],
        [((c("day_high") - price) / c("day_high") * 100 > 4, 6)],
    ]
    total = lambda rules: F.least(F.lit(100), sum([first_match(*cases, default=0) for cases in rules], F.lit(0)))
    d = out.evaluated(df.withColumns({"buy_points": total(buy), "sell_points": total(sell), "_span": F.greatest(c("day_high") - c("day_low"), price * 0.005)}))
    d = out.evaluated(d.withColumns({"entry_low": F.greatest(c("day_low"), price - c("_span") * 0.18), "entry_high": price, "take_profit": F.greatest(c("day_high"), price + c("_span") * 0.35)}))
    d = out.evaluated(d.withColumn("stop_loss", F.greatest(F.lit(0.0), c("entry_low") - c("_span") * 0.22)).drop("_span"))
    share = lambda move: F.greatest(F.lit(0.0), move / price * 100)
    d = out.evaluated(d.withColumns({"risk_pct": share(price - c("stop_loss")), "reward_pct": share(c("take_profit") - price)}))
    d = out.evaluated(d.withColumn("reward_risk", F.when(c("risk_pct") > 0, c("reward_pct") / c("risk_pct")).otherwise(0.0)))
    up, down = c("buy_points"), c("sell_points")
    decision = first_match(((up >= 65) & (up >= down + 20) & (c("reward_risk") >= least_rr), "BUY"), ((down >= 60) & (down >= up + 20), "SELL"), default="WATCH")
    return d.withColumns({"decision_confidence": F.greatest(up, down), "decision": decision})


def label_session(signals: DataFrame, bars: DataFrame, horizons: dict[str, int], last_slot: int = 23) -> DataFrame:
    """Same-session outcome per signal and horizon; every expected bar must be there.

    The horizon SESSION ends with the session; any other that would run past it is rejected.

    The bars of one symbol and day are one short array, so the label is one equi-join.
    """
    bar = F.struct(F.col("slot").alias("no"), "open", "high", "low", "close")
    days = bars.groupBy("symbol", "day").agg(F.array_sort(F.collect_list(bar)).alias("_bars"))
    d = signals.join(days, ["symbol", "day"], "left")
    base, t, s = F.col("price"), F.col("target"), F.col("stop")
    d = d.withColumn("short", F.col("decision") == "SELL")
    d = out.evaluated(d.withColumn("_path", F.filter("_bars", lambda b: b["no"] > F.col("slot"))).drop("_bars"))
    ordered = F.when(F.col("short"), (t < base) & (base < s)).otherwise((s < base) & (base < t))
    d = out.touches(d).withColumn("levels_ok", F.coalesce(ordered, F.lit(False)))
    hz = F.array(*[F.struct(F.lit(n).alias("horizon"), F.lit(h).alias("h")) for n, h in horizons.items()])
    d = d.withColumn("_h", F.explode(hz))
    due = F.when(F.col("_h.horizon") == "SESSION", last_slot).otherwise(F.col("slot") + F.col("_h.h"))
    d = out.evaluated(d.withColumns({"horizon": F.col("_h.horizon"), "due": due}).drop("_h"))
    d = d.withColumns({"_w": F.filter("_path", lambda b: b["no"] <= F.col("due")), "_tk": F.when(F.col("_tk") <= F.col("due"), F.col("_tk")),
                       "_sk": F.when(F.col("_sk") <= F.col("due"), F.col("_sk"))})
    d = out.evaluated(d.drop("_path"))
    d = out.evaluated(d.withColumns({"_n": F.size("_w"), "_hi": F.array_max(F.transform("_w", lambda b: b["high"])),
                                     "_lo": F.array_min(F.transform("_w", lambda b: b["low"])), "_exit": F.get("_w", F.size("_w") - 1)["close"]}).drop("_w"))
    need = F.col("due") - F.col("slot")
    beyond = F.col("due") > last_slot
    done = (need > 0) & ~beyond & (F.col("_n") == need)
    short = F.col("short")
    return d.withColumns({
        "completed": done,
        "reason": first_match((need <= 0, "NO_POST_SIGNAL_BAR"), (beyond, "HORIZON_EXCEEDS_SESSION"), (~done, "MISSING_BAR"), default=None),
        "return_pct": F.when(done, float_change(F.col("_exit"), base)),
        "side_return": F.when(done, float_side_return(base, F.col("_exit"), short)),
        "side_mfe": F.when(done, F.greatest(F.lit(0.0), float_side_return(base, F.when(short, F.col("_lo")).otherwise(F.col("_hi")), short))),
        "side_mae": F.when(done, F.least(F.lit(0.0), float_side_return(base, F.when(short, F.col("_hi")).otherwise(F.col("_lo")), short))),
        "touch": F.when(done, F.coalesce(out.first_touch(use_open_rule=False), F.lit("NEITHER"))),
    }).drop("_tk", "_sk", "_n", "_hi", "_lo", "_exit", "_open", "_mfs", "_mat")


#: Horizons of a signal: bars of its session (None: to the session's end), then daily bars.
SIGNAL_HORIZONS = {"1H": (1, 0), "2H": (2, 0), "4H": (4, 0), "SESSION": (None, 0), "D1": (None, 1), "D3": (None, 3)}
DAILY = 100  # place of the first daily bar in a path, after every slot of a session


def label_path(signals: DataFrame, bars: DataFrame, horizons=None, last_slot: int = 23) -> DataFrame:
    """Outcome over a path of two resolutions: the rest of the signal's session, then whole days.

    Every expected bar must be there. Long and short sides; touches of target and stop; entry to
    the buying zone (zone_low, zone_high; long signals only) and the best and worst move in the bars
    after the bar of entry, whose own extremes may be older than the entry. The bars of a session
    and the days that follow it stand in one row for each symbol and day, so the label is one equi-join.
    """
    horizons = SIGNAL_HORIZONS if horizons is None else horizons
    most = max(n for _, n in horizons.values())
    bar = F.struct(F.col("slot").cast("int").alias("no"), "open", "high", "low", "close")
    days = bars.groupBy("symbol", "day").agg(
        F.array_sort(F.collect_list(bar)).alias("_bars"),  # one session's slots
        F.struct(F.col("day").alias("of"), F.min_by("open", "slot").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "slot").alias("close")).alias("_daily"))
    w = W.partitionBy("symbol").orderBy("day")
    later = []
    for i in range(1, most + 1):
        x = F.lead("_daily", i).over(w)
        later.append(F.when(F.datediff(x["of"], F.col("day")) == i, F.struct(F.lit(DAILY + i - 1).alias("no"), x["open"].alias("open"), x["high"].alias("high"), x["low"].alias("low"), x["close"].alias("close"))))
    days = days.withColumn("_later", F.array(*later)).drop("_daily")
    d = signals.join(days, ["symbol", "day"], "left").withColumns({"short": F.col("decision") == "SELL", "price": F.when(F.col("price") > 0, F.col("price"))})
    span = F.array(*[F.struct(F.lit(n).alias("horizon"), F.lit(h).cast("int").alias("h"), F.lit(k).alias("n")) for n, (h, k) in horizons.items()])
    d = d.withColumn("_h", F.explode(span))
    d = out.evaluated(d.withColumns({"horizon": F.col("_h.horizon"), "_due": F.coalesce(F.col("slot") + F.col("_h.h"), F.lit(last_slot)), "_n": F.col("_h.n")}).drop("_h"))
    session = F.filter("_bars", lambda b: (b["no"] > F.col("slot")) & (b["no"] <= F.col("_due")))
    ahead = F.array_compact(F.slice(F.coalesce("_later", F.array().cast(days.schema["_later"].dataType)), F.lit(1), F.col("_n")))
    d = out.evaluated(d.withColumns({"_session": session, "_ahead": ahead}).drop("_bars", "_later"))
    need = F.col("_due") - F.col("slot")
    reason = first_match((F.col("_due") > last_slot, "HORIZON_EXCEEDS_SESSION"), (need <= 0, "NO_POST_SIGNAL_BAR"), (F.coalesce(F.size("_session") != need, F.lit(True)), "MISSING_BAR"),
                         (F.size("_ahead") != F.col("_n"), "MISSING_DAILY_BAR"), (F.col("price").isNull(), "INVALID_SOURCE"), default=None)
    d = out.evaluated(d.withColumns({"reason": reason, "_path": F.concat("_session", "_ahead")}).drop("_session", "_ahead"))
    base, t, s, short, path = F.col("price"), F.col("target"), F.col("stop"), F.col("short"), F.col("_path")
    done = F.col("reason").isNull()
    ordered = F.when(short, (t < base) & (base < s)).otherwise((s < base) & (base < t))
    zone = ~short & F.coalesce((F.col("zone_low") > 0) & (F.col("zone_low") <= F.col("zone_high")), F.lit(False))
    entry = F.when(zone, F.get(F.filter(path, lambda b: (b["low"] <= F.col("zone_high")) & (b["high"] >= F.col("zone_low"))), 0)["no"])
    high, low = (lambda p: F.array_max(F.transform(p, lambda b: b["high"]))), (lambda p: F.array_min(F.transform(p, lambda b: b["low"])))
    d = out.touches(d).withColumns({"levels_ok": F.coalesce(ordered, F.lit(False)), "_entry": entry, "_hi": high(path), "_lo": low(path), "_exit": F.get(path, F.size(path) - 1)["close"]})
    d = out.evaluated(d)
    rest = F.filter(path, lambda b: b["no"] > F.col("_entry"))
    d = out.evaluated(d.withColumns({"_phi": high(rest), "_plo": low(rest)}))
    known = F.col("zone_low").isNotNull() & F.col("zone_high").isNotNull()
    return d.withColumns({
        "completed": done,
        "return_pct": F.when(done, float_change(F.col("_exit"), base)),
        "side_return": F.when(done, float_side_return(base, F.col("_exit"), short)),
        "side_mfe": F.when(done, F.greatest(F.lit(0.0), float_side_return(base, F.when(short, F.col("_lo")).otherwise(F.col("_hi")), short))),
        "side_mae": F.when(done, F.least(F.lit(0.0), float_side_return(base, F.when(short, F.col("_hi")).otherwise(F.col("_lo")), short))),
        "touch": F.when(done, F.coalesce(out.first_touch(use_open_rule=False), F.lit("NEITHER"))),
        "target_hit": F.when(done & F.col("levels_ok"), F.col("_tk").isNotNull()), "stop_hit": F.when(done & F.col("levels_ok"), F.col("_sk").isNotNull()),
        "zone_entered": F.when(done & known, F.col("_entry").isNotNull()), "zone_entry_no": F.when(done, F.col("_entry")),
        "post_entry_mfe": F.when(done & F.col("_phi").isNotNull(), F.greatest(F.lit(0.0), float_change(F.col("_phi"), base))),
        "post_entry_mae": F.when(done & F.col("_plo").isNotNull(), F.least(F.lit(0.0), float_change(F.col("_plo"), base))),
    }).drop("_due", "_n", "_path", "_entry", "_hi", "_lo", "_exit", "_phi", "_plo", "_tk", "_sk", "_open", "_mfs", "_mat")
