"""Intraday, learning, tracking and list queries."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sigspark.functions import stats as st
from sigspark.functions.scalars import first_match
from sigspark.operators import context as cx
from sigspark.operators import indicators as ind
from sigspark.operators import intraday as iy
from sigspark.operators import learning as ln
from sigspark.operators import outcomes as out
from sigspark.operators import reports as rp
from sigspark.operators import scoring as sc
from sigspark.plans import sqlkit as k
from sigspark.plans.records_fixture import FLAGS, examples, predictions
from sigspark.plans.registry import FRAGMENTS, fragment, query
from sigspark.plans.reports import FAMILY, crit_sql, ok
from sigspark.plans.scoring import scored
from sigspark.plans.streams import signals
from sigspark.sources import fixtures as fx

# --- intraday: the daily indicator fragments over hourly bars -------------------------------
fragment("hbars", "SELECT symbol, symbol AS sector, bar_start AS session, open, high, low, close, volume, bar_no AS session_no FROM hours")
_ren = lambda s: re.sub(r"\bnb_\b", "hnb_", re.sub(r"\bema_\b", "hema_", re.sub(r"\b(ind\d_)", r"h\1", re.sub(r"\bbars\b", "hbars", s))))
for _n, _m in (("ind1_", "hind1_"), ("ind2_", "hind2_"), ("ind3_", "hind3_"), ("ind4_", "hind4_"), ("ind5_", "hind5_"), ("ind", "hind"), ("nb_", "hnb_"), ("ema_", "hema_"), ("emas", "hemas")):
    fragment(_m, _ren(FRAGMENTS[_n]))
fragment("hwide", """
 SELECT i.*, e.macd_hist, e.ema9, e.ema21, e.prev_macd-e.prev_signal AS prev_hist, CASE WHEN v.contiguous THEN v.vwap END AS vwap FROM hind i JOIN hemas e ON i.symbol=e.symbol AND i.session=e.session JOIN hvwap v ON i.symbol=v.symbol AND i.session=v.bar_start""")


@lru_cache(maxsize=8)
def hourly_wide(s, d):
    h = fx.hourly_bars(s, d)
    v = ind.session_vwap(h).select("symbol", F.col("bar_no").alias("session_no"), F.when(F.col("contiguous"), F.col("vwap")).alias("vwap"))
    b = h.select("symbol", F.col("symbol").alias("sector"), F.col("bar_start").alias("session"), "open", "high", "low", "close", "volume", F.col("bar_no").alias("session_no"))
    f = ind.indicator_frame(b, ind.BarWindow("symbol", order="session_no")).withColumn("prev_hist", F.col("prev_macd") - F.col("prev_signal"))
    need = ["symbol", "session", "session_no", "open", "close", "rsi", "macd_hist", "prev_hist", "ema9", "ema21", "volume_ratio", "volume3_ratio", "obv_trend", "bb_mid", "bb_upper", "bb_lower", "momentum3", "close_position", "atr14"]
    return f.select(*need).join(v, ["symbol", "session_no"])


_vs = ", ".join(f"CASE WHEN NOT ({a}) THEN 'MISSING' WHEN {b} THEN 'BUY' WHEN {c} THEN 'SELL' ELSE 'NEUTRAL' END" for a, b, c in iy.VOTES.values())
_fs = ", ".join(f"'{iy.FAMILIES[n]}'" for n in iy.VOTES)
query("nine_vote_signal", f"""
 WITH v AS (SELECT *, [{_vs}] AS vs, [{_fs}] AS fs FROM hwide), c AS (SELECT *, len(list_filter(vs, lambda x: x='BUY')) AS buy, len(list_filter(vs, lambda x: x='SELL')) AS sell, len(list_filter(vs, lambda x: x='MISSING')) AS missing FROM v),
 s AS (SELECT *, CASE WHEN buy>sell THEN 'BUY' WHEN sell>buy THEN 'SELL' ELSE 'WATCH' END AS side FROM c),
 f AS (SELECT *, len(list_distinct(list_filter(list_transform(range(1,10), lambda i: CASE WHEN vs[i]=side THEN fs[i] END), lambda x: x IS NOT NULL))) AS families, coalesce(least(40,greatest(0,abs(close-vwap)/atr14-3)*10),0)*CASE WHEN vwap IS NULL OR atr14 IS NULL THEN 0 ELSE 1 END AS penalty FROM s),
 g AS (SELECT *, greatest(buy,sell) AS votes, greatest(0,100*((9-missing)/9.0::DOUBLE)*(greatest(buy,sell)/9.0::DOUBLE)*(1-least(buy,sell)/9.0::DOUBLE)-penalty) AS vote_confidence FROM f)
 SELECT symbol, session_no AS bar_no, buy, sell, missing, side, votes, families, vote_confidence, CASE WHEN votes>=6 AND families>=3 AND vote_confidence>=60 THEN side ELSE 'WATCH' END AS signal FROM g""", f="vote_confidence")(
    lambda s, d: iy.nine_votes(hourly_wide(s, d), 6, 3, 60).select("symbol", F.col("session_no").alias("bar_no"), "buy", "sell", "missing", "side", "votes", "families", "vote_confidence", "signal"))

fragment("hsess", """
 SELECT symbol, bar_no, first_value(open) OVER w AS day_open, max(high) OVER w AS day_high, min(low) OVER w AS day_low, CASE WHEN count(*) OVER r=20 THEN max(high) OVER r END AS top20, (close/lag(close,6) OVER (PARTITION BY symbol ORDER BY bar_no)-1)*100 AS m6
 FROM hours WINDOW w AS (PARTITION BY symbol, day ORDER BY slot), r AS (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
query("intraday_buy_sell", """
 WITH x AS (SELECT h.symbol, h.session_no AS bar_no, h.close, s.day_open, s.day_high, s.day_low, greatest(s.day_high-s.day_low, h.close*0.005) AS span,
   CASE WHEN h.close>h.vwap THEN 18 ELSE 0 END+CASE WHEN h.macd_hist>0 THEN 15 ELSE 0 END+CASE WHEN h.macd_hist>0 AND h.macd_hist>h.prev_hist THEN 12 ELSE 0 END
   +CASE WHEN h.close>h.ema9 AND h.ema9>h.ema21 THEN 12 WHEN h.ema9>h.ema21 THEN 5 ELSE 0 END+CASE WHEN h.obv_trend='RISING' THEN 8 ELSE 0 END+CASE WHEN h.rsi BETWEEN 50 AND 68 THEN 12 ELSE 0 END
   +CASE WHEN h.volume3_ratio>=150 THEN 15 WHEN h.volume3_ratio>=120 THEN 9 ELSE 0 END+CASE WHEN h.momentum3>0 AND s.m6>0 THEN 12 ELSE 0 END
   +CASE WHEN h.close>s.top20 AND h.volume3_ratio>=130 THEN 16 WHEN h.close>s.top20 THEN 7 ELSE 0 END AS b,
   CASE WHEN h.close<h.vwap THEN 18 ELSE 0 END+CASE WHEN h.macd_hist<=0 THEN 15 ELSE 0 END+CASE WHEN h.macd_hist<0 AND h.macd_hist<h.prev_hist THEN 12 ELSE 0 END
   +CASE WHEN h.close<h.ema9 AND h.ema9<h.ema21 THEN 12 WHEN h.ema9<h.ema21 THEN 5 ELSE 0 END+CASE WHEN h.obv_trend='FALLING' THEN 8 ELSE 0 END+CASE WHEN h.rsi>=75 THEN 12 WHEN h.rsi<35 THEN 8 ELSE 0 END
   +CASE WHEN h.volume3_ratio<60 THEN 10 ELSE 0 END+CASE WHEN h.momentum3<0 AND s.m6<0 THEN 12 ELSE 0 END
   +CASE WHEN (h.close/s.day_open-1)*100>6 THEN 10 ELSE 0 END+CASE WHEN (s.day_high-h.close)/s.day_high*100>4 THEN 6 ELSE 0 END AS v
   FROM hwide h JOIN hsess s ON h.symbol=s.symbol AND h.session_no=s.bar_no),
 y AS (SELECT *, CAST(least(100,b) AS BIGINT) AS buy_points, CAST(least(100,v) AS BIGINT) AS sell_points, greatest(day_low, close-span*0.18) AS entry_low, greatest(day_high, close+span*0.35) AS take_profit FROM x),
 z AS (SELECT *, greatest(0, entry_low-span*0.22) AS stop_loss FROM y), q AS (SELECT *, greatest(0,(close-stop_loss)/close*100) AS risk, greatest(0,(take_profit-close)/close*100) AS reward FROM z),
 g AS (SELECT *, CASE WHEN risk>0 THEN reward/risk ELSE 0 END AS reward_risk FROM q)
 SELECT symbol, bar_no, buy_points, sell_points, entry_low, close AS entry_high, take_profit, stop_loss, reward_risk, greatest(buy_points,sell_points) AS decision_confidence,
  CASE WHEN buy_points>=65 AND buy_points>=sell_points+20 AND reward_risk>=1.4 THEN 'BUY' WHEN sell_points>=60 AND sell_points>=buy_points+20 THEN 'SELL' ELSE 'WATCH' END AS decision FROM g""", f="entry_low entry_high take_profit stop_loss reward_risk")(
    lambda s, d: iy.buy_sell(hourly_wide(s, d).join(_session_range(s, d), ["symbol", "session_no"])).select(
        "symbol", F.col("session_no").alias("bar_no"), "buy_points", "sell_points", "entry_low", "entry_high", "take_profit", "stop_loss", "reward_risk", "decision_confidence", "decision"))


def _session_range(s, d):
    """The session up to each hour bar, its six-bar momentum and the highest high of the 20 bars before."""
    bars = W.partitionBy("symbol").orderBy("bar_no")
    before, day = bars.rowsBetween(-20, -1), W.partitionBy("symbol", "day").orderBy("slot").rowsBetween(W.unboundedPreceding, 0)
    return fx.hourly_bars(s, d).select(
        "symbol", F.col("bar_no").alias("session_no"), F.when(F.count(F.lit(1)).over(before) == 20, F.max("high").over(before)).alias("resistance20"),
        ((F.col("close") / F.lag("close", 6).over(bars) - 1) * 100).alias("momentum6"),
        F.first("open").over(day).alias("day_open"), F.max("high").over(day).alias("day_high"), F.min("low").over(day).alias("day_low"))


fragment("isig", "SELECT symbol||'-'||CAST(bar_no AS VARCHAR) AS signal_id, h.symbol, h.day, h.slot, h.bar_no, h.close AS price, s.signal AS decision, s.score, CASE s.signal WHEN 'BUY' THEN h.close*1.5 ELSE h.close*0.6 END AS target, CASE s.signal WHEN 'BUY' THEN h.close*0.7 ELSE h.close*1.4 END AS stop FROM hours h JOIN (SELECT symbol AS sy, slot AS sl, day AS dy, signal, score FROM hsig) s ON h.symbol=s.sy AND h.slot=s.sl AND h.day=s.dy WHERE s.signal<>'WATCH'")
fragment("iout", """
 SELECT x.*, CASE WHEN need<=0 THEN 'NO_POST_SIGNAL_BAR' WHEN slot+need>23 THEN 'HORIZON_EXCEEDS_SESSION' WHEN n<>need THEN 'MISSING_BAR' END AS reason, need>0 AND slot+need<=23 AND n=need AS completed FROM (
  SELECT i.signal_id, i.symbol, i.day, i.slot, z.horizon, any_value(i.decision) AS decision, any_value(i.score) AS score, any_value(i.price) AS price, any_value(i.target) AS target, any_value(i.stop) AS stop, CASE WHEN z.horizon='SESSION' THEN 23-i.slot ELSE z.h END AS need, count(b.slot) AS n,
   arg_max(b.close,b.slot) AS xc, max(b.high) AS hi, min(b.low) AS lo, min(b.slot) FILTER (WHERE CASE i.decision WHEN 'SELL' THEN b.low<=i.target ELSE b.high>=i.target END) AS tk, min(b.slot) FILTER (WHERE CASE i.decision WHEN 'SELL' THEN b.high>=i.stop ELSE b.low<=i.stop END) AS sk
  FROM isig i CROSS JOIN (VALUES ('1H',1),('2H',2),('4H',4),('SESSION',24)) AS z(horizon,h) LEFT JOIN hours b ON b.symbol=i.symbol AND b.day=i.day AND b.slot>i.slot AND b.slot<=CASE WHEN z.horizon='SESSION' THEN 23 ELSE i.slot+z.h END GROUP BY i.signal_id, i.symbol, i.day, i.slot, z.horizon, z.h) AS x""")
fragment("ires", """
 SELECT *, CASE WHEN completed THEN (xc/price-1)*100 END AS return_pct, CASE WHEN completed THEN CASE decision WHEN 'SELL' THEN (price/xc-1)*100 ELSE (xc/price-1)*100 END END AS side_return,
  CASE WHEN completed THEN greatest(0,CASE decision WHEN 'SELL' THEN (price/lo-1)*100 ELSE (hi/price-1)*100 END) END AS side_mfe, CASE WHEN completed THEN least(0,CASE decision WHEN 'SELL' THEN (price/hi-1)*100 ELSE (lo/price-1)*100 END) END AS side_mae,
  CASE WHEN completed THEN CASE WHEN tk IS NULL AND sk IS NULL THEN 'NEITHER' WHEN tk=sk THEN 'AMBIGUOUS' WHEN sk IS NULL OR tk<sk THEN 'TARGET' ELSE 'STOP' END END AS touch FROM iout""")
HZ = {"1H": 1, "2H": 2, "4H": 4, "SESSION": 24}


@lru_cache(maxsize=8)
def intraday_outcomes(s, d):
    h = fx.hourly_bars(s, d)
    buy = F.col("signal") == "BUY"
    sig = h.join(signals(s, d).select("symbol", "day", "slot", "signal", "score"), ["symbol", "day", "slot"]).filter("signal <> 'WATCH'").select(
        F.concat_ws("-", "symbol", F.col("bar_no").cast("string")).alias("signal_id"), "symbol", "day", "slot", F.col("close").alias("price"), F.col("signal").alias("decision"), "score",
        F.when(buy, F.col("close") * 1.5).otherwise(F.col("close") * 0.6).alias("target"), F.when(buy, F.col("close") * 0.7).otherwise(F.col("close") * 1.4).alias("stop"))
    return out.evaluated(iy.label_session(sig, h, HZ))


query("label_intraday_outcomes", "SELECT signal_id, horizon, completed, reason, return_pct, touch FROM ires", f="return_pct")(
    lambda s, d: intraday_outcomes(s, d).select("signal_id", "horizon", "completed", "reason", "return_pct", "touch"))
# Signal labels: the rest of the session, then daily bars; the buying zone ends 2 % under the price.
_sz = ", ".join(f"('{n}',{'NULL::BIGINT' if h is None else h},{m})" for n, (h, m) in iy.SIGNAL_HORIZONS.items())
fragment("sigday", "SELECT symbol, day, arg_min(open,slot) AS open, max(high) AS high, min(low) AS low, arg_max(close,slot) AS close FROM hours GROUP BY symbol, day")
fragment("sigpath", f"""
 WITH z(horizon,h,m) AS (VALUES {_sz}), i AS (SELECT isig.*, z.*, coalesce(slot+h,23) AS due FROM isig CROSS JOIN z)
 SELECT i.signal_id, i.horizon, b.slot AS seq, b.high, b.low, b.close FROM i JOIN hours b ON b.symbol=i.symbol AND b.day=i.day AND b.slot>i.slot AND b.slot<=i.due
 UNION ALL SELECT i.signal_id, i.horizon, 99+date_diff('day',i.day,b.day), b.high, b.low, b.close FROM i JOIN sigday b ON b.symbol=i.symbol AND b.day>i.day AND date_diff('day',i.day,b.day)<=i.m""")
fragment("siglab", f"""
 WITH z(horizon,h,m) AS (VALUES {_sz}), i AS (SELECT isig.*, z.*, coalesce(slot+h,23) AS due, price*0.9 AS zl, price*0.98 AS zh FROM isig CROSS JOIN z),
 p AS (SELECT p.*, min(seq) FILTER (WHERE i.decision='BUY' AND p.low<=zh AND p.high>=zl) OVER (PARTITION BY signal_id, horizon) AS ez FROM sigpath p JOIN i USING (signal_id, horizon)),
 g AS (SELECT i.signal_id, i.horizon, any_value(i.decision) AS decision, any_value(i.price) AS price, any_value(due) AS due, any_value(i.slot) AS slot, any_value(m) AS m, count(seq) FILTER (WHERE seq<99) AS nh, count(seq) FILTER (WHERE seq>=99) AS nd, arg_max(p.close,seq) AS xc, max(p.high) AS hi, min(p.low) AS lo,
  min(seq) FILTER (WHERE CASE i.decision WHEN 'SELL' THEN p.low<=i.target ELSE p.high>=i.target END) AS tk, min(seq) FILTER (WHERE CASE i.decision WHEN 'SELL' THEN p.high>=i.stop ELSE p.low<=i.stop END) AS sk, any_value(ez) AS ez, max(p.high) FILTER (WHERE seq>ez) AS phi, min(p.low) FILTER (WHERE seq>ez) AS plo
  FROM i LEFT JOIN p ON p.signal_id=i.signal_id AND p.horizon=i.horizon GROUP BY i.signal_id, i.horizon)
 SELECT *, CASE WHEN due>23 THEN 'HORIZON_EXCEEDS_SESSION' WHEN due<=slot THEN 'NO_POST_SIGNAL_BAR' WHEN nh<>due-slot THEN 'MISSING_BAR' WHEN nd<>m THEN 'MISSING_DAILY_BAR' WHEN price<=0 THEN 'INVALID_SOURCE' END AS reason FROM g""")
query("label_signal_outcomes", """
 SELECT signal_id, horizon, reason, CASE WHEN ok THEN (xc/price-1)*100 END AS return_pct, CASE WHEN ok THEN CASE WHEN sell THEN (price/xc-1)*100 ELSE (xc/price-1)*100 END END AS side_return,
  CASE WHEN ok THEN greatest(0,CASE WHEN sell THEN (price/lo-1)*100 ELSE (hi/price-1)*100 END) END AS side_mfe, CASE WHEN ok THEN least(0,CASE WHEN sell THEN (price/hi-1)*100 ELSE (lo/price-1)*100 END) END AS side_mae,
  CASE WHEN ok THEN CASE WHEN tk IS NULL AND sk IS NULL THEN 'NEITHER' WHEN tk=sk THEN 'AMBIGUOUS' WHEN sk IS NULL OR tk<sk THEN 'TARGET' ELSE 'STOP' END END AS touch, CASE WHEN ok THEN tk IS NOT NULL END AS target_hit, CASE WHEN ok THEN sk IS NOT NULL END AS stop_hit,
  CASE WHEN ok THEN ez IS NOT NULL END AS zone_entered, CASE WHEN ok THEN ez END AS zone_entry_no, CASE WHEN ok AND phi IS NOT NULL THEN greatest(0,(phi/price-1)*100) END AS post_entry_mfe, CASE WHEN ok AND plo IS NOT NULL THEN least(0,(plo/price-1)*100) END AS post_entry_mae
 FROM (SELECT *, reason IS NULL AS ok, decision='SELL' AS sell FROM siglab) AS q""", f="return_pct side_return side_mfe side_mae post_entry_mfe post_entry_mae")(lambda s, d: _signal_labels(s, d))


def _signal_labels(s, d):
    rows = intraday_outcomes(s, d).filter("horizon = '1H'").select("signal_id", "symbol", "day", "slot", "price", "decision", "target", "stop", (F.col("price") * 0.9).alias("zone_low"), (F.col("price") * 0.98).alias("zone_high"))
    return iy.label_path(rows, fx.hourly_bars(s, d)).select(
        "signal_id", "horizon", "reason", "return_pct", "side_return", "side_mfe", "side_mae", "touch", "target_hit", "stop_hit", "zone_entered", "zone_entry_no", "post_entry_mfe", "post_entry_mae")


query("intraday_signal_performance", f"""
 SELECT decision, horizon, min_score, n, mean, median, positive::DOUBLE/n AS success_rate FROM (SELECT decision, horizon, min_score, count(*) FILTER (WHERE side_return>0) AS positive FROM (SELECT *, unnest([0,20,40,60,80]) AS min_score FROM ires WHERE completed) AS q WHERE score>=min_score GROUP BY ALL) AS a
 JOIN ({k.robust("SELECT * FROM (SELECT *, unnest([0,20,40,60,80]) AS min_score FROM ires WHERE completed) AS q WHERE score>=min_score", "decision, horizon, min_score", "side_return")}) AS b USING (decision, horizon, min_score)""", f="mean median success_rate")(lambda s, d: _iperf(s, d))


def _iperf(s, d):
    x = intraday_outcomes(s, d).filter("completed").withColumn("min_score", F.explode(F.array_compact(F.array(*[F.when(F.col("score") >= t, t) for t in (0, 20, 40, 60, 80)]))))
    key = ["decision", "horizon", "min_score"]
    g = x.groupBy(*key).agg(st.count_if(F.col("side_return") > 0).alias("positive"))
    return g.join(st.robust(x, key, "side_return"), key).select(*key, "n", "mean", "median", (F.col("positive") / F.col("n")).alias("success_rate"))


query("intraday_daily_summary", "SELECT CAST(day AS VARCHAR) AS day, horizon, count(*) AS n, avg(side_return) AS mean_return, arg_max(signal_id, (side_return, signal_id)) AS best, arg_min(signal_id, (side_return, signal_id)) AS worst FROM ires WHERE completed GROUP BY day, horizon", f="mean_return")(
    lambda s, d: intraday_outcomes(s, d).filter("completed").groupBy("day", "horizon").agg(F.count(F.lit(1)).alias("n"), F.avg("side_return").alias("mean_return"), F.max_by("signal_id", F.struct("side_return", "signal_id")).alias("best"), F.min_by("signal_id", F.struct("side_return", "signal_id")).alias("worst")))
query("record_status", "SELECT signal_id, CASE WHEN bool_or(touch='TARGET') AND NOT bool_or(touch='STOP') THEN 'TARGET' WHEN bool_or(touch='STOP') THEN 'STOP' WHEN bool_or(horizon='SESSION' AND completed) THEN 'ENDED' ELSE 'OPEN' END AS status FROM ires GROUP BY signal_id")(
    lambda s, d: intraday_outcomes(s, d).groupBy("signal_id").agg(F.max(F.when(F.col("touch") == "TARGET", 1)).alias("t"), F.max(F.when(F.col("touch") == "STOP", 1)).alias("x"), F.max(F.when((F.col("horizon") == "SESSION") & F.col("completed"), 1)).alias("e"))
    .select("signal_id", first_match(((F.col("t") == 1) & F.col("x").isNull(), "TARGET"), (F.col("x") == 1, "STOP"), (F.col("e") == 1, "ENDED"), default="OPEN").alias("status")))
query("attention_candidates", "SELECT symbol, bar_no, rank FROM (SELECT symbol, session_no AS bar_no, row_number() OVER (PARTITION BY session_no ORDER BY round(abs(momentum3),9) DESC, symbol) AS rank FROM hind WHERE momentum3 IS NOT NULL) AS q WHERE rank<=30")(
    lambda s, d: sc.top_k(hourly_wide(s, d).filter("momentum3 IS NOT NULL").select("symbol", F.col("session_no").alias("bar_no"), "momentum3"), 30, F.round(F.abs("momentum3"), 9).desc(), F.col("symbol"), group=("bar_no",)).select("symbol", "bar_no", "rank"))

# --- learning ------------------------------------------------------------------------------
fragment("trainend", "SELECT CAST(floor(min(session_no)+(max(session_no)-min(session_no))*0.4) AS BIGINT) AS training_end FROM bars")


def training_end(s, d, share=0.4):
    """One row: the session that ends the models' training, at a share of the recorded range."""
    lo, hi = F.min("session_no"), F.max("session_no")
    return fx.weekly_bars(s, d).agg(F.floor(lo + (hi - lo) * share).cast("long").alias("training_end"))


def _after(s, d, rows, when):
    return rows.crossJoin(training_end(s, d)).filter(when)


_mk = lambda a: "+".join(f"CASE WHEN {f} IS NULL THEN 0 ELSE {1 << i} END" for i, f in enumerate(FLAGS))
_mv = "+".join(f"CASE WHEN {f} THEN {1 << i} ELSE 0 END" for i, f in enumerate(FLAGS))
query("similar_history", f"""
 WITH h AS (SELECT regime, {_mk(0)} AS hk, {_mv} AS hv, count(*) AS n, count(*) FILTER (WHERE status='SUCCESS') AS s, sum(directional_return) AS r, horizon FROM okx WHERE due_no<(SELECT training_end FROM trainend) GROUP BY ALL),
 q AS (SELECT signal_id, regime, unnest([{', '.join(map(str, out.DAILY_HORIZONS))}]) AS horizon, {_mk(0)} AS qk, {_mv} AS qv FROM preds WHERE session_no>=(SELECT training_end FROM trainend))
 SELECT q.signal_id, q.horizon, m.sample, m.probability, m.mean_return FROM q LEFT JOIN (SELECT p.regime, h.horizon, qk, qv, sum(n)::BIGINT AS sample, (sum(s)+1)*100.0::DOUBLE/(sum(n)+2) AS probability, sum(r)/sum(n) AS mean_return FROM (SELECT DISTINCT regime, qk, qv FROM q) p JOIN h ON p.regime=h.regime AND bit_count(hk & qk)>=5 AND bit_count(hk & qk)-bit_count((hk & qk) & xor(hv,qv))>=0.7*bit_count(hk & qk) GROUP BY p.regime, h.horizon, qk, qv) m
 ON q.regime=m.regime AND q.horizon=m.horizon AND q.qk=m.qk AND q.qv=m.qv""", f="probability mean_return")(
    lambda s, d: ln.similar_history(_after(s, d, predictions(s, d), "session_no >= training_end").select("signal_id", "regime", F.explode(F.array(*map(F.lit, out.DAILY_HORIZONS))).alias("horizon"), *FLAGS), _after(s, d, ok(s, d), "due_no < training_end"), list(FLAGS), ["regime"], per=("horizon",)).select("signal_id", "horizon", "sample", "probability", "mean_return"))
query("calibrated_score", f"""
 WITH a AS (SELECT horizon, criterion, 1/6.0::DOUBLE+CASE direction WHEN 'UP' THEN 0.0025 WHEN 'DOWN' THEN -0.0025 ELSE 0 END AS weight FROM ({crit_sql('SELECT * FROM okl', 'horizon')}) AS c WHERE enough AND direction<>'SAME'),
 p AS (SELECT *, unnest([{', '.join(map(str, out.DAILY_HORIZONS))}]) AS horizon FROM preds WHERE score IS NOT NULL), f AS (SELECT signal_id AS sid, unnest([{', '.join(repr(f) for f in FLAGS)}]) AS criterion, unnest([{', '.join(FLAGS)}]) AS flag FROM preds),
 x AS (SELECT p.signal_id, p.horizon, any_value(p.score) AS raw, any_value(p.rsi) AS rsi, coalesce(sum(CASE WHEN f.flag THEN (a.weight-1/6.0::DOUBLE)*100 END),0) AS dl FROM p JOIN f ON f.sid=p.signal_id LEFT JOIN a ON a.criterion=f.criterion AND a.horizon=p.horizon GROUP BY p.signal_id, p.horizon),
 y AS (SELECT *, CASE WHEN raw<55 THEN 0 WHEN rsi>=64 THEN least(0,greatest(-3,least(3,dl))) ELSE greatest(-3,least(3,dl)) END AS delta FROM x) SELECT signal_id, horizon, delta, greatest(0,least(95,raw+delta)) AS final FROM y""", f="delta final")(lambda s, d: _calibrated(s, d))


def _weights(s, d):
    r = rp.criterion_report(ok(s, d), list(FLAGS), ["horizon"]).filter("enough AND direction <> 'SAME'")
    return r.select("horizon", "criterion", (1 / 6 + F.when(F.col("direction") == "UP", 0.0025).otherwise(-0.0025)).alias("weight"))


def _calibrated(s, d):
    p = predictions(s, d).filter("score IS NOT NULL").withColumn("horizon", F.explode(F.array(*map(F.lit, out.DAILY_HORIZONS))))
    return ln.calibrated_score(p, _weights(s, d), list(FLAGS), 1 / 6, "score", 55, F.col("rsi") >= 64, by="horizon").select("signal_id", "horizon", "delta", "final")


query("bounded_weights")(lambda s, d: ln.bounded_weights(st.long_flags(ok(s, d), list(FLAGS), ["sector", "horizon", "status"]).filter("flag").groupBy(F.concat_ws("|", "sector", "horizon").alias("scope"), "criterion")
    .agg((1 / 6 + 0.01 * (F.avg(F.when(F.col("status") == "SUCCESS", 1.0).otherwise(0.0)) - 0.5)).alias("weight")).withColumn("baseline", F.lit(1 / 6)), "scope"))
query("history_success", "SELECT symbol, regime, horizon, n, success_rate, CASE WHEN n>=30 THEN greatest(-5,least(5,(success_rate-0.5)*10)) ELSE 0 END AS effect FROM (SELECT symbol, regime, horizon, count(*) AS n, avg(CASE WHEN status='SUCCESS' THEN 1.0 ELSE 0 END) AS success_rate FROM okx GROUP BY symbol, regime, horizon) AS q", f="success_rate effect")(
    lambda s, d: ok(s, d).groupBy("symbol", "regime", "horizon").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("status") == "SUCCESS", 1.0).otherwise(0.0)).alias("success_rate"))
    .withColumn("effect", F.when(F.col("n") >= 30, F.greatest(F.lit(-5.0), F.least(F.lit(5.0), (F.col("success_rate") - 0.5) * 10))).otherwise(0.0)))
_bh = k.evidence("SELECT * FROM okx", "sector, horizon")
query("best_horizon", f"WITH e AS ({_bh}), b AS (SELECT sector, arg_max(horizon,(success_rate,median,-horizon)) AS best, bool_and(sufficient) AS sufficient FROM e GROUP BY sector) SELECT b.sector, b.best AS best_horizon, b.sufficient, bool_and(e.horizon=b.best OR x.success_low>e.success_high) AS conclusive FROM b JOIN e ON b.sector=e.sector JOIN e x ON x.sector=b.sector AND x.horizon=b.best GROUP BY b.sector, b.best, b.sufficient")(lambda s, d: _best(s, d))


def _best(s, d):
    e = st.evidence_stats(ok(s, d), ["sector", "horizon"])
    top = F.max(F.struct("success_rate", "median", (-F.col("horizon")).alias("h"), "success_low"))
    b = e.groupBy("sector").agg(top.alias("b"), F.bool_and("sufficient").alias("sufficient"), F.collect_list(F.struct("horizon", "success_high")).alias("all"))  # six horizons
    clear = F.forall("all", lambda x: (x["horizon"] == -F.col("b.h")) | (F.col("b.success_low") > x["success_high"]))
    return b.select("sector", (-F.col("b.h")).alias("best_horizon"), "sufficient", clear.alias("conclusive"))


query("missed_winners", "SELECT signal_id, rank, return_pct FROM ex WHERE horizon=1 AND reason IS NULL AND return_pct>=2 AND rank>10", f="return_pct")(
    lambda s, d: examples(s, d).filter("horizon = 1 AND reason IS NULL AND return_pct >= 2 AND rank > 10").select("signal_id", "rank", "return_pct"))
query("continuation_report", f"SELECT bucket, sample, success_rate, median, sufficient FROM ({k.evidence("SELECT *, CASE WHEN rank<=5 THEN '1-5' WHEN rank<=10 THEN '6-10' WHEN rank<=20 THEN '11-20' ELSE '21-30' END AS bucket FROM okx WHERE horizon=1", 'bucket')}) AS q", f="success_rate median")(
    lambda s, d: st.evidence_stats(ok(s, d).filter("horizon = 1").withColumn("bucket", first_match((F.col("rank") <= 5, "1-5"), (F.col("rank") <= 10, "6-10"), (F.col("rank") <= 20, "11-20"), default="21-30")), ["bucket"]).select("bucket", "sample", "success_rate", "median", "sufficient"))
query("shadow_vs_main", "SELECT horizon, CASE WHEN model='TOMORROW_SHADOW' THEN 'SHADOW' ELSE 'MAIN' END AS cohort, count(*) AS n, avg(directional_return) AS mean_return FROM ex CROSS JOIN trainend WHERE completed AND due_no>training_end AND session_no>=training_end GROUP BY 1,2", f="mean_return")(
    lambda s, d: _after(s, d, examples(s, d), "completed AND due_no > training_end AND session_no >= training_end").groupBy("horizon", F.when(F.col("model") == "TOMORROW_SHADOW", "SHADOW").otherwise("MAIN").alias("cohort")).agg(F.count(F.lit(1)).alias("n"), F.avg("directional_return").alias("mean_return")))
query("news_type_performance", "SELECT regime AS news_kind, horizon, count(*) AS n, avg(CASE WHEN status='SUCCESS' THEN 1.0 ELSE 0 END) AS success_rate FROM okx WHERE model='NEWS' GROUP BY regime, horizon", f="success_rate")(
    lambda s, d: ok(s, d).filter("model = 'NEWS'").groupBy(F.col("regime").alias("news_kind"), "horizon").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("status") == "SUCCESS", 1.0).otherwise(0.0)).alias("success_rate")))

# --- lists, tracking, as-of models -----------------------------------------------------------
query("baseline_shadow_lists", "SELECT session_no, list, symbol, rank FROM (SELECT session_no, 'RAW' AS list, symbol, row_number() OVER (PARTITION BY session_no ORDER BY tscore DESC, symbol) AS rank FROM tsc WHERE tscore IS NOT NULL UNION ALL SELECT session_no, 'SHADOW', symbol, row_number() OVER (PARTITION BY session_no ORDER BY tscore+CASE WHEN momentum3>0 THEN 2 ELSE 0 END DESC, symbol) FROM tsc WHERE tscore IS NOT NULL) AS q WHERE rank<=10")(lambda s, d: _bslists(s, d))


def _bslists(s, d):
    x = scored(s, d).filter("tscore IS NOT NULL")
    one = lambda name, score: sc.top_k(x.withColumn("list", F.lit(name)), 10, score.desc(), F.col("symbol"), group=("session_no",)).select("session_no", "list", "symbol", "rank")
    return one("RAW", F.col("tscore")).unionByName(one("SHADOW", F.col("tscore") + F.when(F.col("momentum3") > 0, 2).otherwise(0)))


query("opportunity_pool_ranks", "SELECT session_no, symbol, row_number() OVER (PARTITION BY session_no ORDER BY tscore DESC NULLS LAST, symbol) AS rank, CASE WHEN tscore>=30 THEN row_number() OVER (PARTITION BY session_no, tscore>=30 ORDER BY tscore DESC NULLS LAST, symbol) END AS eligible_rank FROM tsc")(
    lambda s, d: scored(s, d).select("session_no", "symbol", F.row_number().over(W.partitionBy("session_no").orderBy(F.desc_nulls_last("tscore"), "symbol")).alias("rank"),
        F.when(F.col("tscore") >= 30, F.row_number().over(W.partitionBy("session_no", F.col("tscore") >= 30).orderBy(F.desc_nulls_last("tscore"), "symbol"))).alias("eligible_rank")))
query("asof_model", "WITH m AS (SELECT session_no AS version, CAST(DATE '1990-01-01' + CAST(session_no*7 AS INTEGER) AS TIMESTAMP) AS created_at FROM (SELECT DISTINCT session_no FROM bars WHERE session_no%25=0) AS q) SELECT p.signal_id, m.version FROM preds p ASOF LEFT JOIN m ON p.signal_at>=m.created_at")(
    lambda s, d: _model_at(s, d))


def _model_at(s, d):
    """Versions are few: the newest one is carried over the weekly calendar, and records join by week."""
    week = lambda at: F.floor((F.unix_timestamp(at) - F.unix_timestamp(F.lit("1990-01-01").cast("timestamp"))) / 604800).cast("int")
    p = predictions(s, d).select("signal_id", week("signal_at").alias("week"))
    versions = fx.weekly_bars(s, d).filter("session_no % 25 = 0").select(F.col("session_no").alias("week"), F.col("session_no").alias("v")).distinct()
    calendar = p.agg(F.min("week").alias("lo"), F.max("week").alias("hi")).join(versions.agg(F.min("v").alias("first"))).select(
        F.explode(F.sequence(F.least("lo", "first"), "hi")).alias("week"))
    carried = calendar.join(versions, "week", "left").select("week", F.last("v", ignorenulls=True).over(W.orderBy("week")).alias("version"))  # one row a week
    return p.join(carried, "week", "left").select("signal_id", "version")


query("split_record", "SELECT signal_id, sha256(symbol||'|'||CAST(session_no AS VARCHAR)||'|'||decision) AS frozen_hash, score IS NOT NULL AS has_state FROM preds")(
    lambda s, d: predictions(s, d).select("signal_id", F.sha2(F.concat_ws("|", "symbol", F.col("session_no").cast("string"), "decision"), 256).alias("frozen_hash"), F.col("score").isNotNull().alias("has_state")))
query("append_learning_examples", "SELECT e.event_type AS model, strftime(time_bucket(INTERVAL 5 MINUTE, ts),'%Y-%m-%d %H:%M:%S') AS bucket, min(event_id) AS event_id, CASE WHEN hour(time_bucket(INTERVAL 5 MINUTE, ts)) BETWEEN 10 AND 17 THEN 'TRAINING' ELSE 'REFERENCE' END AS tag FROM events e WHERE NOT EXISTS (SELECT 1 FROM events k WHERE k.event_id%5=0 AND k.event_type=e.event_type AND time_bucket(INTERVAL 5 MINUTE,k.ts)=time_bucket(INTERVAL 5 MINUTE,e.ts)) GROUP BY e.event_type, time_bucket(INTERVAL 5 MINUTE, ts)")(lambda s, d: _append(s, d))


def _append(s, d):
    q = fx.quotes(s, d).withColumn("bucket", F.window("event_time", "5 minutes")["start"])
    known = q.filter("quote_id % 5 = 0").select("symbol", "bucket").distinct()
    return q.join(known, ["symbol", "bucket"], "left_anti").groupBy(F.col("symbol").alias("model"), "bucket").agg(F.min("quote_id").alias("event_id")).withColumn("tag", F.when(F.hour("bucket").between(10, 17), "TRAINING").otherwise("REFERENCE"))


query("scan_partition", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN rsi IS NULL THEN 'TEMPORARY_ERROR' WHEN change_pct<=-7 OR change_pct>=9.5 THEN 'FILTERED' ELSE 'ANALYSED' END AS status FROM ind) AS q GROUP BY status")(
    lambda s, d: scored(s, d).select(first_match((F.col("rsi").isNull(), "TEMPORARY_ERROR"), ((F.col("change_pct") <= -7) | (F.col("change_pct") >= 9.5), "FILTERED"), default="ANALYSED").alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n")))
query("report_filter_limit", "SELECT signal_id, decision, confidence FROM preds WHERE decision='BUY' AND confidence>=60 ORDER BY round(confidence,9) DESC, signal_id LIMIT 1000", f="confidence")(
    lambda s, d: predictions(s, d).filter("decision = 'BUY' AND confidence >= 60").select("signal_id", "decision", "confidence").orderBy(F.round("confidence", 9).desc(), "signal_id").limit(1000))  # top-k is the feature
