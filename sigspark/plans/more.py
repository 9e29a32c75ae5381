"""Levels, flags, tracking, sinks and scalar queries."""

from __future__ import annotations

import os
from functools import lru_cache
from hashlib import sha256

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sigspark.functions import stats as st
from sigspark.functions.scalars import clamp, first_match, side_return, stable_id, weighted_available
from sigspark.operators import context as cx
from sigspark.operators import levels as lv
from sigspark.operators import news as nw
from sigspark.operators import outcomes as out
from sigspark.operators import scoring as sc
from sigspark.plans import sqlkit as k
from sigspark.plans.bars import _lists, _paired
from sigspark.plans.context import measurement, sectors
from sigspark.plans.learning import intraday_outcomes
from sigspark.plans.news import lexed
from sigspark.plans.records_fixture import FLAGS, examples, frame, labelled, last_session, predictions
from sigspark.plans import decision as mac
from sigspark.plans.registry import fragment, query
from sigspark.plans.reports import ok
from sigspark.session import complete, shared_dir
from sigspark.sources import fixtures as fx

# --- levels and news effects ---------------------------------------------------------------
LV = "entry_low entry_high target1 target2 stop next_low next_high next_take_profit next_stop level_rr"
query("daily_levels", """
 SELECT symbol, session_no, greatest(support20,close-atr14) AS entry_low, least(close+atr14*0.5,resistance20) AS entry_high, t1 AS target1, greatest(resistance60,t1+atr14) AS target2, st AS stop, nl AS next_low,
  greatest(nl,close+least(atr14*0.03,close*0.004)) AS next_high, close+atr14*0.5 AS next_take_profit, greatest(0.01,close-least(atr14*0.5,close*0.046)) AS next_stop, CASE WHEN close>st THEN (t1-close)/(close-st) ELSE 0 END AS level_rr
 FROM (SELECT *, greatest(resistance20,close+atr14*1.5) AS t1, greatest(0.01,least(support20-atr14*0.25,close-atr14*1.5)) AS st, greatest(0.01,close-least(atr14*0.23,close*0.022)) AS nl FROM ind WHERE atr14 IS NOT NULL) AS q""", f=LV)(
    lambda s, d: lv.daily_levels(frame(s, d)).select("symbol", "session_no", *LV.split()))

query("intraday_levels", """
 WITH a AS (SELECT symbol, session_no, close AS p, vwap20 AS v, atr14*0.01 AS t, low20_prev AS s, high20_prev AS r FROM ind WHERE vwap20 IS NOT NULL AND low20_prev IS NOT NULL), b AS (SELECT *, least(p,greatest(v,s)) AS an FROM a),
 c AS (SELECT *, greatest(s,an-t*0.35) AS lo, least(p,an+t*0.25) AS hi FROM b), e AS (SELECT *, least(s,lo)-t*0.25 AS st, CASE WHEN r>hi THEN least(r,hi+t*2) ELSE hi+t*2 END AS tg, (lo+hi)/2 AS en FROM c)
 SELECT symbol, session_no, lo AS zone_low, hi AS zone_high, st AS stop, tg AS target, (tg-en)/(en-st) AS rr FROM e WHERE st>0 AND st<lo AND lo<=hi AND hi<tg AND en>st""", f="zone_low zone_high stop target rr", digits=10)(
    lambda s, d: frame(s, d).filter("vwap20 IS NOT NULL AND low20_prev IS NOT NULL").select("symbol", "session_no", lv.intraday_levels(F.col("close"), F.col("vwap20"), F.col("atr14") * 0.01, F.col("low20_prev"), F.col("high20_prev")).alias("l")).filter("l IS NOT NULL").select("symbol", "session_no", "l.*"))

fragment("nfx", """
 SELECT symbol, session_no, close, atr14, support20, resistance20, bb_mid, news, conf, greatest(-4,least(4, CASE WHEN news>0 THEN CASE WHEN change_pct>0 THEN least(2,change_pct/2) WHEN change_pct<-1 THEN -least(3,abs(change_pct)/1.5) ELSE 0 END+CASE WHEN volume_ratio_incl>=150 THEN 1.5 WHEN volume_ratio_incl<80 THEN -0.5 ELSE 0 END+sd
   WHEN news<0 THEN CASE WHEN change_pct<0 THEN -least(2,abs(change_pct)/2) WHEN change_pct>1 THEN least(2,change_pct/2) ELSE 0 END+CASE WHEN volume_ratio_incl>=150 AND change_pct<0 THEN -1.5 ELSE 0 END+sd ELSE 0 END))::DOUBLE AS confirmation
 FROM (SELECT *, (session_no%21)-10.0 AS news, (session_no%101)*1.0 AS conf, CASE WHEN close>vwap20 THEN 1.0 WHEN close<=vwap20 THEN -1.0 ELSE 0 END+CASE WHEN obv_trend='RISING' THEN 0.8 WHEN obv_trend IS NOT NULL THEN -0.8 ELSE 0 END AS sd FROM ind WHERE change_pct IS NOT NULL AND atr14 IS NOT NULL) AS q""")


@lru_cache(maxsize=8)
def nfx(s, d):
    x = frame(s, d).filter("change_pct IS NOT NULL AND atr14 IS NOT NULL").withColumns({"news": (F.col("session_no") % 21) - 10.0, "conf": (F.col("session_no") % 101) * 1.0})
    return x.withColumn("confirmation", lv.price_confirmation(F.col("news"), F.col("change_pct"), F.col("volume_ratio_incl"), F.col("close") > F.col("vwap20"), F.col("obv_trend") == "RISING"))


query("price_confirmation", "SELECT symbol, session_no, confirmation FROM nfx", f="confirmation")(lambda s, d: nfx(s, d).select("symbol", "session_no", "confirmation"))
query("news_blend", "SELECT symbol, session_no, greatest(0,least(100,60+greatest(-10,least(10,news*conf/100)))) AS blended, greatest(0,least(95,60+greatest(-20,least(20,news*conf/100*1.2+confirmation*1.3)))) AS final FROM nfx", f="blended final")(
    lambda s, d: nfx(s, d).select("symbol", "session_no", lv.news_blend(F.lit(60.0), F.col("news"), F.col("conf")).alias("blended"), lv.final_score(F.lit(60.0), F.col("news"), F.col("conf"), F.lit(0.0), F.lit(0.0), F.col("confirmation"), F.lit(0.0)).alias("final")))
DL = """SELECT symbol, session_no, confirmation, news, conf, e AS effect, close-atr14*(0.65-greatest(0,e)*0.15) AS zone_low, close+atr14*(0.20+greatest(0,e)*0.10) AS zone_high, greatest(0,close-atr14*CASE WHEN e<=-0.35 THEN 0.8 WHEN e<0 THEN 1.0 WHEN e>=0.35 THEN 1.45 ELSE 1.25 END, support20-atr14*0.2) AS stop,
  CASE WHEN resistance20>close THEN CASE WHEN e<0 THEN least(raw,resistance20,close+atr14*1.2) WHEN e<0.25 THEN least(raw,resistance20) ELSE least(raw,resistance20+atr14*0.6) END ELSE raw END AS target
 FROM (SELECT *, close+atr14*CASE WHEN e<=-0.35 THEN 0.85 WHEN e<0 THEN 1.15 ELSE 1.7+e*0.9 END AS raw FROM (SELECT *, greatest(-0.8::DOUBLE,least(0.8::DOUBLE,(news*conf/100+confirmation)/14)) AS e FROM nfx) AS a) AS b"""


def dyn(s, d):
    x = nfx(s, d).withColumn("effect", lv.net_effect(F.col("news"), F.col("conf"), F.col("confirmation")))
    return x.withColumns(lv.dynamic_levels(F.col("close"), F.col("atr14"), F.col("support20"), F.col("resistance20"), F.col("effect")))


query("dynamic_levels", k.cols(DL, "symbol", "session_no", "effect", "zone_low", "zone_high", "stop", "target"), f="effect zone_low zone_high stop target", digits=9)(
    lambda s, d: dyn(s, d).select("symbol", "session_no", "effect", "zone_low", "zone_high", "stop", "target"))
_fs = "greatest(0,least(95,60+greatest(-20,least(20,nd*conf/100*1.2+confirmation*1.3))))"
query("news_pipeline", f"SELECT symbol, session_no, fs AS final, CASE WHEN fs>=82 AND nd>=-2 AND confirmation>=-1 THEN 'STRONG_BUY' WHEN fs>=70 AND nd>=-4 THEN 'BUY' WHEN fs<=35 OR nd<=-8 THEN 'SELL' WHEN fs<=50 OR nd<=-5 THEN 'RISKY_WATCH' ELSE 'WATCH' END AS decision, target, stop FROM (SELECT *, {_fs} AS fs FROM (SELECT *, news*pow(0.5,(session_no%60)/180.0) AS nd FROM ({DL}) AS a) AS b) AS c", f="final target stop")(
    lambda s, d: dyn(s, d).withColumn("nd", sc.news_decay(F.col("news"), (F.col("session_no") % 60).cast("double"))).withColumn("final", lv.final_score(F.lit(60.0), F.col("nd"), F.col("conf"), F.lit(0.0), F.lit(0.0), F.col("confirmation"), F.lit(0.0)))
    .select("symbol", "session_no", "final", sc.decision_from_score(F.col("final"), F.col("nd"), F.col("confirmation")).alias("decision"), "target", "stop"))
query("news_alarm_level", "SELECT news_id, CASE WHEN score>=6 AND confidence>=70 AND importance>=70 THEN 'STRONG_POSITIVE' WHEN score>=3 AND score<6 AND confidence>=75 AND importance>=60 THEN 'POSITIVE' WHEN score<=-6 AND confidence>=70 AND importance>=70 THEN 'STRONG_NEGATIVE' WHEN score<=-3 AND score>-6 AND confidence>=75 AND importance>=60 THEN 'NEGATIVE' ELSE 'NONE' END AS level FROM nlex")(
    lambda s, d: lexed(s, d).select("news_id", lv.alarm_level(F.col("score"), F.col("confidence"), F.col("importance")).alias("level")))

# --- shadow scores and flags ------------------------------------------------------------------
SH = "CASE obv_trend WHEN 'RISING' THEN 0.25 WHEN 'FALLING' THEN -0.25 ELSE 0 END + CASE WHEN squeeze_break THEN 0.25 WHEN bb_lower_break THEN -0.25 ELSE 0 END + CASE WHEN momentum_state='STRENGTHENING' AND momentum_direction='UP' THEN 0.25 WHEN momentum_state='WEAKENING' THEN -0.25 ELSE 0 END"
UNS = "coalesce(rsi>=70 OR change_pct<-3.5 OR change_pct>4,false)"
query("shadow_score", f"SELECT symbol, session_no, {UNS} AS unsafe, CASE WHEN {UNS} THEN least(0,greatest(-2,least(2,{SH}))) ELSE greatest(-2,least(2,{SH})) END::DOUBLE AS correction FROM ind", f="correction")(lambda s, d: _shadow(s, d))


def _shadow(s, d):
    unsafe = F.coalesce((F.col("rsi") >= 70) | (F.col("change_pct") < -3.5) | (F.col("change_pct") > 4), F.lit(False))
    total = clamp(F.expr(SH).cast("double"), -2, 2)
    return frame(s, d).select("symbol", "session_no", unsafe.alias("unsafe"), F.when(unsafe, F.least(F.lit(0.0), total)).otherwise(total).alias("correction"))


LC = {"rsi_band": "rsi>=30 AND rsi<=65", "sma_trend": "sma20>sma50", "volume": "volume_ratio_incl>=150", "vwap": "close>vwap20", "obv": "obv_trend='RISING'", "bollinger": "bb_zone='INSIDE'", "momentum": "momentum3>0", "levels": "support20<resistance20"}
query("legacy_criteria", f"SELECT symbol, session_no, {', '.join(f'({e}) AS {n}' for n, e in LC.items())} FROM ind")(lambda s, d: frame(s, d).select("symbol", "session_no", *[F.expr(e).alias(n) for n, e in LC.items()]))
TF = {"rsi_band": "rsi>=45 AND rsi<=64", "sma_trend": "sma20>sma50", "volume": "volume_ratio_incl>=150", "momentum": "change_pct>0 AND change_pct<=4", "room": "(resistance20/close-1)*100>=3 AND (resistance20/close-1)*100<=25"}
query("tomorrow_flags", f"SELECT symbol, session_no, {', '.join(f'({e}) AS {n}' for n, e in TF.items())} FROM ind")(lambda s, d: frame(s, d).select("symbol", "session_no", *[F.expr(e).alias(n) for n, e in TF.items()]))
IF = {"rsi_band": "rsi>=45 AND rsi<=68", "volume": "volume_ratio>=150", "momentum": "momentum3>0", "vwap": "close>vwap", "ema": "ema9>ema21", "macd": "macd_hist>0"}
query("intraday_flags", f"SELECT symbol, session_no AS bar_no, {', '.join(f'({e}) AS {n}' for n, e in IF.items())} FROM hwide")(lambda s, d: _iflags(s, d))


def _iflags(s, d):
    from sigspark.plans.learning import hourly_wide

    return hourly_wide(s, d).select("symbol", F.col("session_no").alias("bar_no"), *[F.expr(e).alias(n) for n, e in IF.items()])


query("intraday_conditions", "SELECT signal_id, CASE WHEN score<10 THEN '<10' WHEN score<30 THEN '10-30' ELSE '30+' END AS score_bucket, decision||'_'||CASE WHEN slot<12 THEN 'MORNING' ELSE 'AFTERNOON' END AS combo FROM isig")(
    lambda s, d: intraday_outcomes(s, d).filter("horizon = '1H'").select("signal_id", first_match((F.col("score") < 10, "<10"), (F.col("score") < 30, "10-30"), default="30+").alias("score_bucket"), F.concat_ws("_", "decision", F.when(F.col("slot") < 12, "MORNING").otherwise("AFTERNOON")).alias("combo")))
query("verified_stat", f"SELECT horizon, sector, completed_n>=30 AND positive+negative+neutral=completed_n AND abs(success_rate-positive::DOUBLE/completed_n)<0.0001 AND mean IS NOT NULL AS verified FROM ({k.outcome_stats('SELECT * FROM ex', 'horizon, sector')}) AS q")(
    lambda s, d: st.outcome_stats(examples(s, d), ["horizon", "sector"]).select("horizon", "sector", ((F.col("completed_n") >= 30) & (F.col("positive") + F.col("negative") + F.col("neutral") == F.col("completed_n")) & (F.abs(F.col("success_rate") - F.col("positive") / F.col("completed_n")) < 0.0001) & F.col("mean").isNotNull()).alias("verified")))
query("signal_source_reason", "SELECT signal_id, CASE WHEN score IS NULL THEN 'MISSING_SCORE' WHEN feature_at>signal_at THEN 'FUTURE_DATA' WHEN decision='HOLD' THEN 'NO_SIDE' WHEN target IS NULL THEN 'MISSING_LEVELS' WHEN (target-price)*CASE decision WHEN 'BUY' THEN 1 ELSE -1 END<=0 THEN 'SIDE_LEVEL_MISMATCH' END AS reason FROM preds")(
    lambda s, d: predictions(s, d).select("signal_id", first_match((F.col("score").isNull(), "MISSING_SCORE"), (F.col("feature_at") > F.col("signal_at"), "FUTURE_DATA"), (F.col("decision") == "HOLD", "NO_SIDE"), (F.col("target").isNull(), "MISSING_LEVELS"),
        ((F.col("target") - F.col("price")) * F.when(F.col("decision") == "BUY", 1).otherwise(-1) <= 0, "SIDE_LEVEL_MISMATCH"), default=None).alias("reason")))
query("record_defaults", "SELECT signal_id, coalesce(target, price) AS target, coalesce(CAST(score AS VARCHAR),'x')<>'x' AS has_score, CASE WHEN price>0 THEN 'OK' ELSE 'INSUFFICIENT' END AS quality FROM preds", f="target")(
    lambda s, d: predictions(s, d).select("signal_id", F.coalesce("target", "price").alias("target"), F.col("score").isNotNull().alias("has_score"), F.when(F.col("price") > 0, "OK").otherwise("INSUFFICIENT").alias("quality")))
query("legacy_record", "SELECT 'L_'||substr(sha256(symbol||chr(31)||CAST(session_no AS VARCHAR)||chr(31)||decision),1,24) AS record_id, decision, price FROM preds WHERE decision<>'HOLD'", f="price")(
    lambda s, d: predictions(s, d).filter("decision <> 'HOLD'").select(F.concat(F.lit("L_"), F.substring(stable_id("", "symbol", "session_no", "decision"), 1, 24)).alias("record_id"), "decision", "price"))
query("stable_id", "SELECT signal_id, 'S_'||sha256(symbol||chr(31)||CAST(session_no AS VARCHAR)) AS id FROM preds")(lambda s, d: predictions(s, d).select("signal_id", stable_id("S_", "symbol", "session_no").alias("id")))
query("read_time_degrade", "SELECT session_no, regime, CASE WHEN last_no-session_no>0 THEN 0 ELSE regime_confidence END AS confidence, CASE WHEN last_no-session_no>0 THEN 'STALE' ELSE 'FRESH' END AS state FROM mmeas CROSS JOIN lastno", f="confidence")(
    lambda s, d: measurement(s, d).crossJoin(last_session(fx.weekly_bars(s, d))).select("session_no", "regime", F.when(F.col("last_no") > F.col("session_no"), 0.0).otherwise(F.col("regime_confidence")).alias("confidence"), F.when(F.col("last_no") > F.col("session_no"), "STALE").otherwise("FRESH").alias("state")))

# --- joins and tracking ---------------------------------------------------------------------
query("live_tracking", "SELECT signal_id, horizon, now_pct, high_pct, low_pct, CASE WHEN target_hit THEN true WHEN NOT completed THEN NULL ELSE target_hit END AS target_touched FROM (SELECT signal_id, horizon, completed, target_hit, return_pct AS now_pct, max_rise AS high_pct, max_drop AS low_pct FROM outc) AS q", f="now_pct high_pct low_pct")(
    lambda s, d: labelled(s, d).select("signal_id", "horizon", F.col("return_pct").alias("now_pct"), F.col("max_rise").alias("high_pct"), F.col("max_drop").alias("low_pct"), F.when(F.col("target_hit"), True).when(~F.col("completed"), None).otherwise(F.col("target_hit")).alias("target_touched")))
query("latest_price_outcome", "WITH l AS (SELECT symbol, arg_max(close,session_no) AS last FROM bars GROUP BY symbol) SELECT signal_id, CASE WHEN decision='BUY' AND last>=target THEN 'SUCCESS' WHEN decision='BUY' AND last<=stop THEN 'STOP' WHEN decision='SELL' AND last<=target THEN 'SUCCESS' WHEN decision='SELL' AND last>=stop THEN 'STOP' ELSE 'OPEN' END AS result FROM preds p JOIN l ON p.symbol=l.symbol WHERE decision<>'HOLD'")(lambda s, d: _latest(s, d))


def _latest(s, d):
    l = fx.weekly_bars(s, d).groupBy("symbol").agg(F.max_by("close", "session_no").alias("last"))
    b, x, t, p = F.col("decision") == "BUY", F.col("last"), F.col("target"), F.col("stop")
    return predictions(s, d).filter("decision <> 'HOLD'").join(l, "symbol").select("signal_id", first_match((b & (x >= t), "SUCCESS"), (b & (x <= p), "STOP"), (~b & (x <= t), "SUCCESS"), (~b & (x >= p), "STOP"), default="OPEN").alias("result"))


query("merge_quotes_from_bars", "WITH a AS (SELECT symbol, session_no, close*1.01 AS price FROM bars WHERE session_no%2=0), b AS (SELECT symbol, session_no, close AS price, open FROM bars WHERE session_no%3=0) SELECT coalesce(a.symbol,b.symbol) AS symbol, coalesce(a.session_no,b.session_no) AS session_no, coalesce(b.price,a.price) AS price, (b.price/b.open-1)*100 AS from_open FROM a FULL JOIN b ON a.symbol=b.symbol AND a.session_no=b.session_no", f="price from_open")(lambda s, d: _mergeq(s, d))


def _mergeq(s, d):
    b = fx.weekly_bars(s, d)
    a = b.filter("session_no % 2 = 0").select("symbol", "session_no", (F.col("close") * 1.01).alias("ap"))
    c = b.filter("session_no % 3 = 0").select("symbol", "session_no", F.col("close").alias("bp"), F.col("open").alias("bo"))
    return a.join(c, ["symbol", "session_no"], "full_outer").select("symbol", "session_no", F.coalesce("bp", "ap").alias("price"), ((F.col("bp") / F.col("bo") - 1) * 100).alias("from_open"))


# A macro event is a document: its sector scores reach every symbol of every sector they name.
# Sectors of the macro rules have no column in the given tables; a nation's number deals them out.
fragment("macrodim", f"SELECT 'N'||lpad(CAST(n_nationkey AS VARCHAR),2,'0') AS symbol, [{', '.join(repr(x) for x in mac.SECTORS)}][n_nationkey%{len(mac.SECTORS)}+1] AS sector FROM nation")
query("macro_fanout", f"SELECT doc_id AS event_no, symbol, d.sector, score FROM (SELECT doc_id, unnest([{', '.join(repr(x) for x in mac.SECTORS)}]) AS sector, unnest([{', '.join(x.lower() for x in mac.SECTORS)}]) AS score FROM ({mac.SQL}) AS m) AS e JOIN macrodim d ON d.sector=e.sector WHERE score IS NOT NULL", f="score")(lambda s, d: _fanout(s, d))


def _fanout(s, d):
    sector = F.element_at(F.array(*map(F.lit, mac.SECTORS)), (F.col("n_nationkey") % len(mac.SECTORS) + 1).cast("int"))
    members = fx.table(s, d, "nation").select(F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("symbol"), sector.alias("sector"))
    effects = F.array(*[F.struct(F.lit(x).alias("sector"), F.col(x.lower()).alias("score")) for x in mac.SECTORS])
    events = mac.macro_rules_score(s, d).select(F.col("doc_id").alias("event_no"), F.inline(effects)).filter("score IS NOT NULL")
    return events.join(members, "sector").select("event_no", "symbol", "sector", "score")


query("macro_lookup", "SELECT p.signal_id, coalesce(m.regime_score,0) AS macro_score, coalesce(x.rs_score,0) AS sector_score FROM preds p LEFT JOIN mmeas m ON p.session_no=m.session_no AND m.final LEFT JOIN smeas x ON p.session_no=x.session_no AND p.sector=x.sector", f="macro_score sector_score")(
    lambda s, d: predictions(s, d).join(measurement(s, d).filter("final").select("session_no", "regime_score"), "session_no", "left").join(sectors(s, d).select("session_no", "sector", "rs_score"), ["session_no", "sector"], "left")
    .select("signal_id", F.coalesce("regime_score", F.lit(0.0)).alias("macro_score"), F.coalesce("rs_score", F.lit(0.0)).alias("sector_score")))
query("backfill_list_flags", "WITH l AS (SELECT *, row_number() OVER (PARTITION BY session_no ORDER BY score+CASE WHEN coalesce(f_trend,false) THEN 3 ELSE 0 END DESC, symbol) AS lrank FROM preds) SELECT signal_id, rank<=10 AS in_base, lrank<=10 AS in_learned, CASE WHEN lrank<=10 THEN lrank END AS list_rank FROM l")(
    lambda s, d: _lists(predictions(s, d)).select("signal_id", (F.col("rank") <= 10).alias("in_base"), (F.col("lrank") <= 10).alias("in_learned"), F.when(F.col("lrank") <= 10, F.col("lrank")).alias("list_rank")))
query("asof_intraday_enrich", "WITH e AS (SELECT user_id, ts, value FROM events WHERE event_type='purchase'), l AS (SELECT event_id, user_id, ts FROM events WHERE event_type<>'purchase') SELECT l.event_id, CASE WHEN epoch_us(l.ts)-epoch_us(e.ts)<=1200*1000000 THEN e.value END AS value FROM l ASOF LEFT JOIN e ON l.user_id=e.user_id AND l.ts>=e.ts", f="value")(lambda s, d: _enrich(s, d))


def _enrich(s, d):
    """The account's last purchase price, for every other event of the account within 20 minutes."""
    q = fx.table(s, d, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("event_time"))
    left = q.filter("event_type <> 'purchase'").select("event_id", "user_id", "event_time")
    right = q.filter("event_type = 'purchase'").select("user_id", F.col("event_time").alias("known"), "value")
    return cx.asof_rows(left, right, ["user_id"], "event_time", "known", ["value"], 1200, 1200).select("event_id", "value")


# News of a symbol (the kinds of event in turn), asked about at every hour that has a bar, for six hours.
fragment("refnews", "SELECT doc_id AS news_id, ['click','error','purchase','signup','view'][doc_id%5+1] AS symbol, TIMESTAMP '2024-01-01'+doc_id*INTERVAL 1 MINUTE AS published_at FROM documents")
query("asof_news_reference_price", """
 WITH f AS (SELECT n.*, e.ts AS seen_at, e.value AS price FROM refnews n ASOF LEFT JOIN (SELECT event_type, ts, value FROM events) e ON e.event_type=n.symbol AND e.ts>=n.published_at)
 SELECT f.symbol, news_id, strftime(h.bar_start,'%Y-%m-%d %H:%M:%S') AS asked_at, CASE WHEN seen_at<h.bar_start THEN price END AS reference_price FROM f JOIN hours h ON h.symbol=f.symbol AND h.bar_start>=published_at AND epoch_us(h.bar_start)-epoch_us(published_at)<6*3600*1000000::BIGINT""", f="reference_price")(lambda s, d: _reference(s, d))


def _reference(s, d):
    names = F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view")))
    news = fx.news(s, d).select("news_id", F.element_at(names, (F.col("news_id") % 5 + 1).cast("int")).alias("symbol"), "published_at")
    quotes = fx.quotes(s, d).select("symbol", "price", F.col("event_time").cast("timestamp").alias("event_time"))
    asks = fx.hourly_bars(s, d).select("symbol", F.col("bar_start").cast("timestamp").alias("asked_at"))
    return nw.reference_prices(news, quotes, asks).select("symbol", "news_id", "asked_at", "reference_price")


query("events_to_records", "SELECT 'NEWS_'||CAST(news_id AS VARCHAR)||'_'||symbol AS record_id, symbol, CASE WHEN score>0 THEN 'BUY' WHEN score<0 THEN 'SELL' ELSE 'WATCH' END AS decision FROM nlex WHERE news_id%4<>0")(lambda s, d: _ev2rec(s, d))


def _ev2rec(s, d):
    x = lexed(s, d)
    r = x.select(F.concat(F.lit("NEWS_"), F.col("news_id").cast("string"), F.lit("_"), "symbol").alias("record_id"), "news_id", "symbol", first_match((F.col("score") > 0, "BUY"), (F.col("score") < 0, "SELL"), default="WATCH").alias("decision"))
    known = fx.news(s, d).filter("news_id % 4 = 0").select("news_id")
    return r.join(known, "news_id", "left_anti").select("record_id", "symbol", "decision")


# The universe: the benchmark's short words in capitals stand in for ticker codes.
query("mention_symbols", r"""
 WITH u AS (SELECT DISTINCT upper(w) AS symbol FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM benchmark) AS q WHERE length(w) BETWEEN 3 AND 6),
 m AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS w FROM documents) AS q WHERE regexp_full_match(w, '[A-Z][A-Z0-9]{2,5}') AND w IN (SELECT symbol FROM u))
 SELECT doc_id, w AS symbol FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w) AS k FROM m) AS q WHERE k<=10""")(lambda s, d: _mention(s, d))


def _mention(s, d):
    """Explicit codes in the original case, whole words only; the first ten of an item in order of code."""
    words = lambda t, p: F.explode(F.array_distinct(F.regexp_extract_all(t, F.lit(p), F.lit(0))))
    universe = fx.table(s, d, "benchmark").select(words("text", "[A-Za-z]+").alias("w")).filter(F.length("w").between(3, 6)).select(F.upper("w").alias("symbol")).distinct()
    found = fx.table(s, d, "documents").select("doc_id", words("text", r"\b[A-Z][A-Z0-9]{2,5}\b").alias("symbol")).join(universe, "symbol", "left_semi")
    listed = found.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_set("symbol")), 1, 10).alias("all"))  # codes of one item
    return listed.select("doc_id", F.explode("all").alias("symbol"))


# --- lists, metrics, sinks --------------------------------------------------------------------
query("paired_list_metrics", "SELECT session_no, horizon, count(*) AS n, avg(return_pct) AS mean_return, median(return_pct) AS median_return, avg(return_pct) FILTER (WHERE rank<=3) AS top3, max(mfe) AS max_mfe, min(mae) AS worst_mae FROM ex WHERE completed AND rank<=10 GROUP BY session_no, horizon", f="mean_return median_return top3 max_mfe worst_mae")(
    lambda s, d: examples(s, d).filter("completed AND rank <= 10").groupBy("session_no", "horizon").agg(F.count(F.lit(1)).alias("n"), F.avg("return_pct").alias("mean_return"), F.median("return_pct").alias("median_return"),  # ten rows a group
        F.avg(F.when(F.col("rank") <= 3, F.col("return_pct"))).alias("top3"), F.max("mfe").alias("max_mfe"), F.min("mae").alias("worst_mae")))
query("recent_comparisons", """
 WITH l AS (SELECT *, row_number() OVER (PARTITION BY session_no ORDER BY score+CASE WHEN coalesce(f_trend,false) THEN 3 ELSE 0 END DESC, symbol) AS lrank FROM preds) SELECT session_no, count(*) FILTER (WHERE rank<=10 AND o.completed) AS nb FROM l JOIN outc o ON l.signal_id=o.signal_id WHERE o.horizon=1 GROUP BY session_no ORDER BY session_no DESC LIMIT 100""")(
    lambda s, d: labelled(s, d).filter("horizon = 1").groupBy("session_no").agg(st.count_if((F.col("rank") <= 10) & F.col("completed")).alias("nb")).orderBy(F.desc("session_no")).limit(100))  # newest 100 is the feature
query("baseline_shadow_pairs", """
 WITH l AS (SELECT *, row_number() OVER (PARTITION BY session_no ORDER BY score+CASE WHEN coalesce(f_trend,false) THEN 3 ELSE 0 END DESC, symbol) AS lrank FROM preds),
 a AS (SELECT l.session_no, avg(return_pct) FILTER (WHERE rank<=10) AS b, avg(return_pct) FILTER (WHERE lrank<=10) AS g, count(*) FILTER (WHERE rank<=10 AND completed)=10 AND count(*) FILTER (WHERE lrank<=10 AND completed)=10 AS whole FROM l JOIN outc o ON l.signal_id=o.signal_id WHERE o.horizon=1 GROUP BY l.session_no)
 SELECT session_no, b AS base_mean, g AS learned_mean FROM a WHERE whole ORDER BY session_no DESC LIMIT 20""", f="base_mean learned_mean")(
    lambda s, d: _paired(s, d).filter("horizon = 1 AND status <> 'INSUFFICIENT'").select("session_no", "base_mean", "learned_mean").orderBy(F.desc("session_no")).limit(20))


def publish(df, name, key):
    """The report's version for ``key``: an existing one is read, else it is written once; a pointer
    table names the current version, and readers go through it, so they never see half of one."""
    spark, top = df.sparkSession, os.path.join(shared_dir(df.sparkSession), "reports", name)
    version = f"v-{sha256(key.encode()).hexdigest()[:24]}"
    if not complete(spark, f"{top}/{version}"):
        df.write.mode("overwrite").parquet(f"{top}/{version}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").parquet(f"{top}/current")
    current = spark.read.schema("version string").parquet(f"{top}/current").first()["version"]
    return spark.read.schema(df.schema).parquet(f"{top}/{current}")


query("publish_report", "SELECT horizon, count(*) AS n, avg(directional_return) AS mean_return FROM okx GROUP BY horizon", f="mean_return")(
    lambda s, d: publish(ok(s, d).groupBy("horizon").agg(F.count(F.lit(1)).alias("n"), F.avg("directional_return").alias("mean_return")), "signal", d))
query("json_record_census", "SELECT event_type AS category, count(*) AS lines, 0 AS errors FROM events GROUP BY event_type")(
    lambda s, d: fx.table(s, d, "events").select("event_type", F.from_json("props", "k BIGINT, _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("j"))
    .groupBy(F.col("event_type").alias("category")).agg(F.count(F.lit(1)).alias("lines"), st.count_if(F.col("j._corrupt").isNotNull()).alias("errors")))

# --- scalars ------------------------------------------------------------------------------------
query("clamp", "SELECT event_id, CASE WHEN value IS NOT NULL THEN greatest(5,least(15,value)) END AS v FROM events", f="v")(lambda s, d: fx.table(s, d, "events").select("event_id", clamp("value", 5, 15).alias("v")))
query("to_local_ts", "SELECT event_id, strftime(ts + INTERVAL 3 HOUR,'%Y-%m-%d %H:%M:%S') AS local_ts FROM events")(
    lambda s, d: fx.table(s, d, "events").select("event_id", F.convert_timezone(F.lit("UTC"), F.lit("Europe/Istanbul"), F.col("ts")).alias("local_ts")))
query("direction_return", "SELECT signal_id, horizon, CASE WHEN short THEN (price/exit_price-1)*100 ELSE (exit_price/price-1)*100 END AS side, CASE WHEN short THEN -(exit_price/price-1)*100 ELSE (exit_price/price-1)*100 END AS negated FROM ex WHERE completed", f="side negated")(
    lambda s, d: examples(s, d).filter("completed").select("signal_id", "horizon", side_return("price", "exit_price", F.col("short")).alias("side"), F.when(F.col("short"), -F.col("return_pct")).otherwise(F.col("return_pct")).alias("negated")))
for _n, _e in (("return_pct", "return_pct"), ("risk_pct", "risk_pct"), ("reward_pct", "reward_pct"), ("rr", "rr")):
    query(_n, f"SELECT signal_id, horizon, {_e} FROM ex WHERE levels_ok AND completed", f=_e)(lambda s, d, c=_e: examples(s, d).filter("levels_ok AND completed").select("signal_id", "horizon", c))
query("rrg_quadrant", "SELECT session_no, sector, quadrant FROM smeas WHERE quadrant IS NOT NULL")(lambda s, d: sectors(s, d).filter("quadrant IS NOT NULL").select("session_no", "sector", "quadrant"))
query("risk_class", "SELECT session_no, risk_state FROM mmeas")(lambda s, d: measurement(s, d).select("session_no", "risk_state"))
query("weighted_available", "SELECT signal_id, (coalesce(rsi*0.5,0)+coalesce(volume_ratio*0.3,0)+coalesce(score*0.2,0))/nullif(CASE WHEN rsi IS NULL THEN 0 ELSE 0.5 END+CASE WHEN volume_ratio IS NULL THEN 0 ELSE 0.3 END+CASE WHEN score IS NULL THEN 0 ELSE 0.2 END,0) AS v FROM preds", f="v")(
    lambda s, d: predictions(s, d).select("signal_id", weighted_available({"a": (F.col("rsi"), 0.5), "b": (F.col("volume_ratio"), 0.3), "c": (F.col("score"), 0.2)}).alias("v")))
query("prefer_newer_price", "SELECT user_id, arg_max(value, ts) AS price FROM events WHERE value>0 GROUP BY user_id", f="price")(
    lambda s, d: fx.table(s, d, "events").filter("value > 0").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("price")))
query("explain_lists", "SELECT session_no, concat_ws('|', CASE WHEN conflict THEN 'Index and breadth disagree' END, CASE WHEN NOT enough THEN 'Low coverage' END, CASE WHEN index_volatility IN ('HIGH','EXTREME') THEN 'High volatility' END, CASE WHEN breadth_score<40 THEN 'Weak participation' END) AS warnings FROM mmeas")(
    lambda s, d: measurement(s, d).select("session_no", F.array_compact(F.array(F.when(F.col("conflict"), F.lit("Index and breadth disagree")), F.when(~F.col("enough"), F.lit("Low coverage")),
        F.when(F.col("index_volatility").isin("HIGH", "EXTREME"), F.lit("High volatility")), F.when(F.col("breadth_score") < 40, F.lit("Weak participation")))).alias("warnings")))
query("record_guard_counts", "SELECT CASE WHEN feature_at>signal_at THEN 'REJECTED_FUTURE' WHEN session_no+5>last_no THEN 'PENDING' ELSE 'READY' END AS state, count(*) AS n FROM preds CROSS JOIN lastno GROUP BY 1")(
    lambda s, d: predictions(s, d).crossJoin(last_session(fx.weekly_bars(s, d))).groupBy(first_match((F.col("feature_at") > F.col("signal_at"), "REJECTED_FUTURE"), (F.col("session_no") + 5 > F.col("last_no"), "PENDING"), default="READY").alias("state")).agg(F.count(F.lit(1)).alias("n")))


def keep_moved(g: pd.DataFrame) -> pd.DataFrame:
    """First event of a symbol's day and each one 10 points away from the last kept."""
    kept, last = [], None
    for i, v in zip(g.sort_values("slot").index, g.sort_values("slot")["score"]):
        if last is None or abs(v - last) >= 10:
            kept.append(i)
            last = v
    return g.loc[kept]


fragment("cfo_", "SELECT symbol, day, slot, score, row_number() OVER (PARTITION BY symbol, day ORDER BY slot) AS rn FROM hsig")
fragment("cfr_", """
 SELECT symbol, day, slot, score, rn, score AS last, true AS kept FROM cfo_ WHERE rn=1
 UNION ALL SELECT o.symbol, o.day, o.slot, o.score, o.rn, CASE WHEN abs(o.score-r.last)>=10 THEN o.score ELSE r.last END, abs(o.score-r.last)>=10 FROM cfr_ r JOIN cfo_ o ON o.symbol=r.symbol AND o.day=r.day AND o.rn=r.rn+1""")


@query("continuation_filter", "SELECT symbol, CAST(day AS VARCHAR) AS day, slot, score FROM cfr_ WHERE kept", f="score")
def continuation_filter(s, d):
    from sigspark.plans.streams import signals

    # A group is one symbol's slots of one day: bounded by the session grid.
    return signals(s, d).select("symbol", "day", "slot", "score").groupBy("symbol", "day").applyInPandas(keep_moved, "symbol string, day date, slot int, score double")
