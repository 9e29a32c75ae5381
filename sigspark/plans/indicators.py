"""Indicator queries over the weekly and hourly fixture bars."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sigspark.operators import indicators as ind
from sigspark.plans.registry import fragment, query
from sigspark.sources import fixtures as fx

W1 = "WINDOW w AS (PARTITION BY symbol ORDER BY session_no)"


def rows(n, end=0):
    a = f"{n} PRECEDING"
    b = "CURRENT ROW" if end == 0 else f"{-end} PRECEDING"
    return f"(PARTITION BY symbol ORDER BY session_no ROWS BETWEEN {a} AND {b})"


def full(fn, x, n, end=0):
    w = rows(n - 1 - end, end)
    return f"CASE WHEN count({x}) OVER {w} = {n} THEN {fn}({x}) OVER {w} END"


fragment("ind1_", f"""
 SELECT *, lag(close) OVER w AS prev_close, lag(open) OVER w AS prev_open, lag(close,3) OVER w AS close3,
        lag(close,6) OVER w AS close6, row_number() OVER w AS bar_count
 FROM bars {W1}""")
fragment("ind2_", """
 SELECT *, CASE WHEN prev_close IS NOT NULL THEN greatest(close-prev_close,0) END AS gain_,
        CASE WHEN prev_close IS NOT NULL THEN greatest(prev_close-close,0) END AS loss_,
        greatest(high-low, abs(high-prev_close), abs(low-prev_close)) AS tr_,
        CASE WHEN close>prev_close THEN volume WHEN close<prev_close THEN -volume ELSE 0 END AS signed_,
        (high+low+close)/3*volume AS pv_
 FROM ind1_""")
fragment("ind3_", f"""
 SELECT *, {full('avg','close',5)} AS sma5, {full('avg','close',10)} AS sma10, {full('avg','close',20)} AS sma20,
        {full('avg','close',50)} AS sma50, {full('stddev_samp','close',20)} AS sd20_,
        {full('avg','gain_',14)} AS ag_, {full('avg','loss_',14)} AS al_, {full('avg','tr_',14)} AS atr14,
        sum(signed_) OVER (PARTITION BY symbol ORDER BY session_no ROWS UNBOUNDED PRECEDING) AS obv,
        CASE WHEN count(pv_) OVER {rows(19)}=20 THEN sum(pv_) OVER {rows(19)}/nullif(sum(volume) OVER {rows(19)},0) END AS vwap20,
        {full('avg','volume',20,-1)} AS v20prev_, {full('avg','volume',20)} AS v20_, {full('avg','volume',3)} AS v3_,
        {full('avg','volume',4)} AS v4_,
        {full('max','high',20,-1)} AS high20_prev, {full('min','low',20,-1)} AS low20_prev,
        min(low) OVER {rows(19)} AS support20, max(high) OVER {rows(19)} AS resistance20,
        min(low) OVER {rows(59)} AS support60, max(high) OVER {rows(59)} AS resistance60,
        (close/close3-1)*100 AS momentum3, (close/close6-1)*100 AS momentum6, (close/prev_close-1)*100 AS change_pct
 FROM ind2_""")
fragment("ind4_", """
 SELECT *, volume/v20prev_*100 AS volume_ratio, volume/v20_*100 AS volume_ratio_incl, v3_/v20prev_*100 AS volume3_ratio,
        CASE WHEN al_<>0 THEN 100-100/(1+ag_/al_) END AS rsi_legacy,
        CASE WHEN al_=0 AND ag_>0 THEN 100.0 WHEN al_=0 AND ag_=0 THEN 50.0 ELSE 100-100/(1+ag_/al_) END AS rsi,
        sma20 AS bb_mid, sma20+2*sd20_ AS bb_upper, sma20-2*sd20_ AS bb_lower, 4*sd20_/sma20*100 AS bb_width,
        atr14/close*100 AS atr_pct
 FROM ind3_""")
fragment("ind5_", f"""
 SELECT *, lag(bb_upper) OVER w AS up1_, lag(bb_lower) OVER w AS lo1_, lag(bb_width) OVER w AS wd1_,
        lag(obv,3) OVER w AS obv3_, lag(momentum3) OVER w AS momentum_prev,
        {full('max','obv',20,-1)} AS obvmax_, {full('min','obv',20,-1)} AS obvmin_,
        sma20-lag(sma20,3) OVER w AS sma20_slope,
        CASE WHEN bar_count>=40 THEN median(atr_pct) OVER {rows(60,-1)} END AS atr_baseline,
        CASE WHEN session_no-lag(session_no,1) OVER w=1 THEN (close/lag(close,1) OVER w-1)*100 END AS return_1d,
        CASE WHEN session_no-lag(session_no,5) OVER w=5 THEN (close/lag(close,5) OVER w-1)*100 END AS return_5d,
        CASE WHEN session_no-lag(session_no,20) OVER w=20 THEN (close/lag(close,20) OVER w-1)*100 END AS return_20d
 FROM ind4_ {W1}""")
fragment("ind", """
 SELECT *, bb_width<=5 AS bb_squeeze, bb_width>wd1_*1.1 AS bb_expansion,
        CASE WHEN up1_ IS NOT NULL THEN close>bb_upper AND prev_close<=up1_ END AS bb_upper_break,
        CASE WHEN up1_ IS NOT NULL THEN close<bb_lower AND prev_close>=lo1_ END AS bb_lower_break,
        CASE WHEN up1_ IS NOT NULL THEN close BETWEEN bb_lower AND bb_upper AND (prev_close>up1_ OR prev_close<lo1_) END AS bb_return_inside,
        CASE WHEN bar_count>=4 THEN (obv-obv3_)/3 END AS obv_slope,
        CASE WHEN bar_count<4 THEN NULL WHEN obv-obv3_>v4_*0.005 THEN 'RISING' WHEN obv-obv3_<-v4_*0.005 THEN 'FALLING' ELSE 'FLAT' END AS obv_trend,
        CASE WHEN bar_count<21 THEN NULL WHEN obv>obvmax_ THEN 'UP' WHEN obv<obvmin_ THEN 'DOWN' ELSE 'NONE' END AS obv_break,
        CASE WHEN bar_count<4 THEN NULL WHEN close<close3 AND obv-obv3_>v4_*0.005 THEN 'POSITIVE'
             WHEN close>close3 AND obv-obv3_<-v4_*0.005 THEN 'NEGATIVE' ELSE 'NONE' END AS obv_divergence,
        momentum3-momentum_prev AS acceleration,
        CASE WHEN momentum_prev IS NULL THEN NULL WHEN momentum3>0.05 THEN 'UP' WHEN momentum3<-0.05 THEN 'DOWN' ELSE 'NEUTRAL' END AS momentum_direction,
        CASE WHEN momentum_prev IS NULL THEN NULL WHEN momentum3-momentum_prev>0.05 THEN 'STRENGTHENING'
             WHEN momentum3-momentum_prev<-0.05 THEN 'WEAKENING' ELSE 'NEUTRAL' END AS momentum_state,
        CASE WHEN momentum_prev IS NOT NULL THEN momentum_prev<=0 AND momentum3>0 END AS positive_turn,
        CASE WHEN momentum_prev IS NOT NULL THEN momentum_prev>=0 AND momentum3<0 END AS negative_turn,
        CASE WHEN wd1_ IS NOT NULL AND volume_ratio IS NOT NULL AND momentum3 IS NOT NULL THEN
             wd1_<=5 AND close>bb_upper AND prev_close<=up1_ AND volume_ratio>=130 AND momentum3>0 END AS squeeze_break,
        CASE WHEN close>open THEN 'POSITIVE' WHEN close<open THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS body,
        CASE WHEN high>low THEN (close-low)/(high-low)*100 END AS close_position,
        CASE WHEN prev_close IS NOT NULL THEN prev_close<prev_open AND close>open AND open<=prev_close AND close>=prev_open END AS bullish_engulfing,
        CASE WHEN bb_upper>bb_lower THEN CASE WHEN close>bb_upper THEN 'ABOVE_UPPER' WHEN close<bb_lower THEN 'BELOW_LOWER'
             WHEN (close-bb_lower)/(bb_upper-bb_lower)*100>=80 THEN 'NEAR_UPPER'
             WHEN (close-bb_lower)/(bb_upper-bb_lower)*100<=20 THEN 'NEAR_LOWER' ELSE 'INSIDE' END END AS bb_zone
 FROM ind5_""")
fragment("nb_", "SELECT symbol, session, close, row_number() OVER (PARTITION BY symbol ORDER BY session_no) AS rn FROM bars")
fragment("ema_", """
 SELECT symbol, session, rn, close AS ema9, close AS ema12, close AS ema21, close AS ema26, 0.0::DOUBLE AS macd_signal,
        NULL::DOUBLE AS prev_macd, NULL::DOUBLE AS prev_signal
 FROM nb_ WHERE rn=1
 UNION ALL
 SELECT b.symbol, b.session, b.rn, 0.2*b.close+0.8*e.ema9, 2.0/13*b.close+11.0/13*e.ema12, 2.0/22*b.close+20.0/22*e.ema21,
        2.0/27*b.close+25.0/27*e.ema26,
        0.2*((2.0/13*b.close+11.0/13*e.ema12)-(2.0/27*b.close+25.0/27*e.ema26))+0.8*e.macd_signal,
        e.ema12-e.ema26, e.macd_signal
 FROM ema_ e JOIN nb_ b ON b.symbol=e.symbol AND b.rn=e.rn+1""")
fragment("emas", "SELECT *, ema12-ema26 AS macd, ema12-ema26-macd_signal AS macd_hist FROM ema_")


@lru_cache(maxsize=16)
def wide(spark, sf, ema=False):
    """Logical plan of the wide frame; projections below prune what they do not need."""
    return ind.indicator_frame(fx.weekly_bars(spark, sf), ema=ema)


@lru_cache(maxsize=16)
def ema_frame(spark, sf):
    return ind.with_ema(fx.weekly_bars(spark, sf), ind.BarWindow("symbol", order="session_no"))


def weekly(spark, sf, *cols, ema=False):
    d = ema_frame(spark, sf) if ema else wide(spark, sf)
    return d.select("symbol", "session", *cols)


def simple(name: str, cols: str, doubles: str = "", ema: bool = False):
    """An indicator query that projects columns of the wide frame."""
    names = cols.split()
    if ema:
        body = f"SELECT i.symbol, CAST(i.session AS VARCHAR) AS session, {', '.join(names)} FROM ind i JOIN emas e ON i.symbol=e.symbol AND i.session=e.session"
        if not any(n in ("close",) for n in names):
            body = f"SELECT symbol, CAST(session AS VARCHAR) AS session, {', '.join(names)} FROM emas"
    else:
        body = f"SELECT symbol, CAST(session AS VARCHAR) AS session, {', '.join(names)} FROM ind"
    query(name, body, f=doubles or cols)(lambda spark, sf: weekly(spark, sf, *names, ema=ema))


simple("sma", "sma5 sma10 sma20 sma50")
simple("ema", "ema9 ema12 ema21 ema26", ema=True)
simple("rsi", "rsi rsi_legacy")
simple("macd", "macd macd_signal macd_hist", ema=True)
simple("bollinger", "bb_mid bb_upper bb_lower bb_width bb_squeeze bb_expansion bb_upper_break bb_lower_break bb_return_inside",
       "bb_mid bb_upper bb_lower bb_width")
simple("bollinger_position", "bb_zone", " ")
simple("obv", "obv")
simple("obv_trend", "obv_slope obv_trend obv_break obv_divergence", "obv_slope")
simple("rolling_vwap", "vwap20")
simple("momentum", "momentum3 momentum6 acceleration momentum_direction momentum_state positive_turn negative_turn",
       "momentum3 momentum6 acceleration")
simple("atr", "atr14 atr_pct")
simple("atr_baseline", "atr_baseline")
simple("volume_ratio", "volume_ratio volume_ratio_incl")
simple("volume3_ratio", "volume3_ratio")
simple("donchian", "high20_prev low20_prev")
simple("support_resistance_20_60", "support20 resistance20 support60 resistance60")
simple("session_returns", "return_1d return_5d return_20d")
simple("close_vs_prev", "prev_close change_pct")
simple("candle_features", "body close_position bullish_engulfing", "close_position")
simple("squeeze_breakout_combo", "squeeze_break", " ")


@query("crossovers", """
 SELECT symbol, CAST(session AS VARCHAR) AS session,
        prev_macd<=prev_signal AND macd>macd_signal AS cross_up, prev_macd>=prev_signal AND macd<macd_signal AS cross_down
 FROM emas WHERE rn>1""")
def crossovers(spark, sf):
    return ema_frame(spark, sf).filter("prev_macd IS NOT NULL").selectExpr(
        "symbol", "session", "prev_macd <= prev_signal AND macd > macd_signal AS cross_up",
        "prev_macd >= prev_signal AND macd < macd_signal AS cross_down")


fragment("hv1_", """
 SELECT *, sum((high+low+close)/3*volume) OVER w AS pv_, sum(volume) OVER w AS vol_, min(slot) OVER w AS first_,
        count(*) OVER w AS n_, lag(close) OVER (PARTITION BY symbol, day ORDER BY slot) AS pclose_
 FROM hours WINDOW w AS (PARTITION BY symbol, day ORDER BY slot ROWS UNBOUNDED PRECEDING)""")
fragment("hv2_", "SELECT *, pv_/vol_ AS vwap, lag(pv_/vol_) OVER (PARTITION BY symbol, day ORDER BY slot) AS pvwap_, n_>=2 AND first_=0 AND slot-first_+1=n_ AS contiguous FROM hv1_")
fragment("hvwap", """
 SELECT *, CASE WHEN contiguous THEN (close/vwap-1)*100 END AS vwap_distance,
   CASE WHEN contiguous THEN CASE WHEN abs((close/vwap-1)*100)<=0.1 THEN 'NEAR' WHEN close>vwap THEN 'ABOVE' ELSE 'BELOW' END END AS vwap_position,
   CASE WHEN contiguous THEN CASE WHEN pclose_<=pvwap_ AND close>vwap THEN 'RECLAIM' WHEN pclose_>=pvwap_ AND close<vwap THEN 'LOSS' ELSE 'NONE' END END AS vwap_transition,
   CASE WHEN contiguous THEN vwap-pvwap_ END AS vwap_slope
 FROM hv2_""")


@query("session_vwap", """
 SELECT symbol, strftime(bar_start,'%Y-%m-%d %H:%M:%S') AS bar_start, vwap, vwap_distance, vwap_position, vwap_transition, vwap_slope
 FROM hvwap""", f="vwap vwap_distance vwap_slope")
def session_vwap(spark, sf):
    return ind.session_vwap(fx.hourly_bars(spark, sf)).select(
        "symbol", "bar_start", "vwap", "vwap_distance", "vwap_position", "vwap_transition", "vwap_slope")


fragment("hshape", """
 SELECT *, (close/day_open-1)*100 AS from_open, (close/day_low-1)*100 AS from_low, (day_high/close-1)*100 AS to_high FROM (
 SELECT *, first_value(open) OVER w AS day_open, max(high) OVER w AS day_high, min(low) OVER w AS day_low
 FROM hours WINDOW w AS (PARTITION BY symbol, day ORDER BY slot ROWS UNBOUNDED PRECEDING)) AS x""")


@query("intraday_shape", """
 SELECT symbol, strftime(bar_start,'%Y-%m-%d %H:%M:%S') AS bar_start, from_open, from_low, to_high FROM hshape""",
       f="from_open from_low to_high")
def intraday_shape(spark, sf):
    return ind.intraday_shape(fx.hourly_bars(spark, sf)).select("symbol", "bar_start", "from_open", "from_low", "to_high")


fragment("hlev_", """
 SELECT *, max(high) OVER (PARTITION BY symbol, day ORDER BY slot ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS l_ FROM hours""")


@query("volume_breakout_first", """
 WITH f AS (SELECT h.*, l_ AS level, lag(close) OVER w AS pc, count(*) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS n,
        avg(volume) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS v
   FROM hlev_ h WINDOW w AS (PARTITION BY symbol, day ORDER BY slot)),
 g AS (SELECT *, pc<=level AND close>level AS crossed, pc<=level AND close>level AND n>=3 AND volume>=1.3*v AS strong FROM f)
 SELECT symbol, CAST(day AS VARCHAR) AS day, arg_min(level, slot) FILTER (WHERE strong) AS level, min(slot) FILTER (WHERE strong) AS break_slot,
        arg_min(close, slot) FILTER (WHERE strong) AS break_price, arg_min(volume/v*100, slot) FILTER (WHERE strong) AS break_volume_ratio,
        CASE WHEN bool_or(strong) THEN 'BREAKOUT' WHEN bool_or(crossed) THEN 'WEAK' ELSE 'WAITING' END AS state
 FROM g GROUP BY symbol, day""", f="level break_price break_volume_ratio")
def volume_breakout_first(spark, sf):
    h = fx.hourly_bars(spark, sf)
    before = W.partitionBy("symbol", "day").orderBy("slot").rowsBetween(-12, -1)  # what was known when the bar began
    return ind.volume_breakout_first(h.withColumn("level", F.max("high").over(before)), "level")


SNAP = """
 SELECT symbol, CAST(session AS VARCHAR) AS session, bar_count,
   CASE WHEN bar_count>=4 THEN 'OK' ELSE 'UNKNOWN' END AS obv_status, obv_trend,
   CASE WHEN bar_count>=20 THEN 'OK' ELSE 'UNKNOWN' END AS bollinger_status, bb_squeeze,
   CASE WHEN bar_count>=5 THEN 'OK' ELSE 'UNKNOWN' END AS momentum_status, momentum_state,
   session_no < mx AS stale,
   CASE WHEN bar_count<4 THEN 0 WHEN session_no<mx THEN 35 ELSE 100 END AS confidence,
   volume_ratio, sma20, sma50, rsi, return_1d, return_5d, return_20d, atr_pct
 FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session_no DESC) AS z_,
        max(session_no) OVER () AS mx FROM ind) AS t WHERE z_=1"""


@query("technical_snapshot", SNAP, f="volume_ratio sma20 sma50 rsi return_1d return_5d return_20d atr_pct")
def technical_snapshot(spark, sf):
    from sigspark.operators.snapshot import technical_snapshot as snap
    s = snap(wide(spark, sf))
    return s.selectExpr(
        "symbol", "session", "bar_count", "obv.status AS obv_status", "obv.trend AS obv_trend",
        "bollinger.status AS bollinger_status", "bollinger.squeeze AS bb_squeeze", "momentum.status AS momentum_status",
        "momentum.state AS momentum_state", "stale", "confidence", "volume_ratio", "closing.sma20 AS sma20",
        "closing.sma50 AS sma50", "closing.rsi AS rsi", "closing.return_1d AS return_1d",
        "closing.return_5d AS return_5d", "closing.return_20d AS return_20d", "closing.atr_pct AS atr_pct")


FLAG_SQL = """
 SELECT symbol, CAST(session AS VARCHAR) AS session,
   CASE WHEN bar_count>=4 THEN obv_trend='RISING' END AS obv_rising, CASE WHEN obv_break IS NOT NULL THEN obv_break='UP' END AS obv_breakout,
   CASE WHEN bar_count>=4 THEN obv_divergence='POSITIVE' END AS obv_positive_divergence,
   CASE WHEN bar_count>=4 THEN obv_divergence='NEGATIVE' END AS obv_negative_divergence,
   squeeze_break, bb_return_inside AS band_return,
   CASE WHEN momentum_state IS NOT NULL THEN momentum_state='STRENGTHENING' END AS momentum_strengthening,
   CASE WHEN momentum_state IS NOT NULL THEN momentum_state='WEAKENING' END AS momentum_weakening FROM ind"""


@query("criteria_flags", FLAG_SQL)
def criteria_flags(spark, sf):
    from sigspark.operators.snapshot import technical_flags
    d = technical_flags(wide(spark, sf))
    return d.select("symbol", "session", "obv_rising", "obv_breakout", "obv_positive_divergence",
                    "obv_negative_divergence", "squeeze_break", "band_return", "momentum_strengthening",
                    "momentum_weakening")


@query("technical_reasons", f"""
 WITH f AS ({FLAG_SQL}) SELECT symbol, session,
   concat_ws('|', CASE WHEN obv_rising THEN 'OBV rising' END, CASE WHEN obv_positive_divergence THEN 'Positive OBV divergence' END,
     CASE WHEN squeeze_break THEN 'Break out of a Bollinger squeeze on volume' END, CASE WHEN momentum_strengthening THEN 'Short momentum strengthening' END) AS positive,
   concat_ws('|', CASE WHEN obv_falling THEN 'OBV weakening' END, CASE WHEN obv_negative_divergence THEN 'Negative OBV divergence' END,
     CASE WHEN momentum_weakening THEN 'Momentum turning down' END) AS negative
 FROM (SELECT f.*, i.obv_trend='FALLING' AS obv_falling FROM f JOIN ind i ON f.symbol=i.symbol AND f.session=CAST(i.session AS VARCHAR)) AS q""")
def technical_reasons(spark, sf):
    from sigspark.operators.snapshot import technical_flags, technical_reasons as reasons
    d = technical_flags(wide(spark, sf))
    return reasons(d).select("symbol", "session", "positive", "negative")


# The same indicators for the market index (one synthetic symbol: per-session means).
fragment("ibars", """
 SELECT 'INDEX' AS symbol, 'INDEX' AS sector, session, avg(open) AS open, avg(high) AS high, avg(low) AS low, avg(close) AS close,
        sum(volume) AS volume, session_no FROM bars GROUP BY session, session_no""")
for _n in ("ind1_", "ind2_", "ind3_", "ind4_", "ind5_", "ind"):
    from sigspark.plans.registry import FRAGMENTS
    import re

    _s = re.sub(r"\bbars\b", "ibars", FRAGMENTS[_n])
    fragment("x" + _n, re.sub(r"\b(ind\d_)", r"x\1", _s))


@lru_cache(maxsize=16)
def index_frame(spark, sf):
    from sigspark.operators.context import index_bars

    return ind.indicator_frame(index_bars(fx.weekly_bars(spark, sf)), ema=False)
