"""Frozen predictions derived from the weekly bars, and their labels."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sigspark.operators import indicators as ind
from sigspark.operators import outcomes as out
from sigspark.plans.registry import fragment
from sigspark.sources import fixtures as fx

fragment("preds", """
 SELECT *, row_number() OVER (PARTITION BY session_no ORDER BY score DESC, symbol) AS rank FROM (
 SELECT 'P'||symbol||CAST(session AS VARCHAR) AS signal_id, symbol, sector, session, session_no,
   CAST(session AS TIMESTAMP) + INTERVAL 18 HOUR AS signal_at,
   CAST(session AS TIMESTAMP) + CASE WHEN session_no%47=0 THEN INTERVAL 19 HOUR ELSE INTERVAL 17 HOUR END AS feature_at,
   close AS price,
   CASE WHEN session_no%41=0 THEN NULL WHEN close>sma20 THEN close*1.05 ELSE close*0.95 END AS target,
   CASE WHEN close>sma20 THEN close*0.97 ELSE close*1.03 END AS stop,
   CASE WHEN session_no%53=0 THEN 'HOLD' WHEN close>sma20 THEN 'BUY' ELSE 'SELL' END AS decision,
   CASE WHEN session_no%43=0 THEN 'TOMORROW_SHADOW' WHEN close>sma20 AND session_no%2=0 THEN 'TOMORROW_TOP10'
        WHEN session_no%3=0 THEN 'NEWS' ELSE 'COMMON' END AS model,
   CASE WHEN session_no%37=0 THEN 'REFERENCE' ELSE 'TRAINING' END AS training_state,
   CASE WHEN session_no%5=0 THEN 'STREAM' ELSE 'DAILY_SCAN' END AS source,
   least(100.0, greatest(0.0, 50+momentum3/4)) AS score, rsi AS confidence,
   CASE WHEN sma50 IS NULL THEN 'UNCERTAIN' WHEN sma20>sma50 THEN 'RISING' ELSE 'FALLING' END AS regime,
   rsi, sma20, sma50, volume_ratio, momentum3, atr14, obv_trend, bb_zone, bb_squeeze, bb_upper_break, vwap20, volume,
   CAST(rsi>=30 AND rsi<=65 AS BOOLEAN) AS f_rsi, sma20>sma50 AS f_trend, volume_ratio>=150 AS f_volume,
   momentum3>0 AS f_momentum, obv_trend='RISING' AS f_obv, bb_zone='INSIDE' AS f_bollinger
 FROM ind WHERE sma20 IS NOT NULL AND close<>sma20) AS q""")

fragment("lastno", "SELECT max(session_no) AS last_no FROM bars")
fragment("hz", "SELECT unnest([1,3,5,10,20,60]) AS horizon")
fragment("oj_", """
 SELECT p.signal_id, h.horizon, b.session_no AS no, b.open, b.high, b.low, b.close,
   p.price, p.target, p.stop, (p.decision='SELL' AND p.model NOT LIKE 'TOMORROW%') AS short
 FROM preds p CROSS JOIN hz h JOIN lastno l ON p.session_no+h.horizon<=l.last_no
 LEFT JOIN bars b ON b.symbol=p.symbol AND b.session_no BETWEEN p.session_no+1 AND p.session_no+h.horizon""")
fragment("ot_", """
 SELECT *, min(CASE WHEN CASE WHEN short THEN low<=target ELSE high>=target END THEN no END) OVER (PARTITION BY signal_id,horizon) AS tk,
        min(CASE WHEN CASE WHEN short THEN high>=stop ELSE low<=stop END THEN no END) OVER (PARTITION BY signal_id,horizon) AS sk
 FROM oj_""")
fragment("og_", """
 SELECT signal_id, horizon, any_value(short) AS short, any_value(price) AS base, any_value(target) AS tgt, any_value(stop) AS stp, count(no) AS n,
   any_value(tk) AS tk, any_value(sk) AS sk, arg_max(close,no) AS xc, max(high) AS hi, min(low) AS lo,
   max(CASE WHEN no=least(tk,sk) THEN open END) AS fo,
   max(CASE WHEN no<sk THEN high END) AS hi_s, min(CASE WHEN no<sk THEN low END) AS lo_s,
   max(CASE WHEN no<tk THEN high END) AS hi_t, min(CASE WHEN no<tk THEN low END) AS lo_t
 FROM ot_ GROUP BY signal_id, horizon""")
fragment("oc_", """
 SELECT *, n=horizon AND base>0 AS completed,
   coalesce(CASE WHEN short THEN tgt<base AND base<stp ELSE stp<base AND base<tgt END, false) AS levels_ok,
   (xc/base-1)*100 AS change, (hi/base-1)*100 AS rise, (lo/base-1)*100 AS fall,
   greatest(0, coalesce(CASE WHEN short THEN (base-lo)/base*100 ELSE (hi-base)/base*100 END,0)) AS mfe_,
   least(0, coalesce(CASE WHEN short THEN (base-hi)/base*100 ELSE (lo-base)/base*100 END,0)) AS mae_,
   CASE WHEN sk IS NOT NULL THEN greatest(0, coalesce(CASE WHEN short THEN (base-lo_s)/base*100 ELSE (hi_s-base)/base*100 END,0)) END AS mfs_,
   CASE WHEN tk IS NOT NULL THEN least(0, coalesce(CASE WHEN short THEN (base-hi_t)/base*100 ELSE (lo_t-base)/base*100 END,0)) END AS mat_
 FROM og_""")
fragment("od_", """
 SELECT *, CASE WHEN short THEN -change ELSE change END AS dir, CASE WHEN levels_ok THEN abs(base-stp)/base*100 END AS risk_pct,
   CASE WHEN levels_ok THEN abs(tgt-base)/base*100 END AS reward_pct,
   CASE WHEN levels_ok THEN CASE WHEN least(tk,sk) IS NULL THEN NULL
     WHEN CASE WHEN short THEN fo<=tgt ELSE fo>=tgt END THEN 'TARGET'
     WHEN CASE WHEN short THEN fo>=stp ELSE fo<=stp END THEN 'STOP'
     WHEN tk=sk THEN 'AMBIGUOUS' WHEN tk=least(tk,sk) THEN 'TARGET' ELSE 'STOP' END END AS ft_
 FROM oc_""")
fragment("outc", """
 SELECT signal_id, horizon, short, completed, levels_ok, risk_pct, reward_pct, reward_pct/risk_pct AS rr,
   CASE WHEN NOT completed THEN 'INSUFFICIENT' WHEN ft_='STOP' THEN 'STOP' WHEN ft_='AMBIGUOUS' OR NOT levels_ok THEN 'INSUFFICIENT'
        WHEN ft_='TARGET' THEN 'SUCCESS'
        WHEN dir>=risk_pct AND CASE WHEN short THEN greatest(0,rise) ELSE abs(least(0,fall)) END < risk_pct THEN 'SUCCESS'
        WHEN dir>0 AND dir>=risk_pct*0.5 THEN 'PARTIAL' ELSE 'FAIL' END AS status,
   CASE WHEN NOT completed THEN 'MISSING_SESSION' END AS missing_reason,
   CASE WHEN completed THEN xc END AS exit_price, CASE WHEN completed THEN change END AS return_pct,
   CASE WHEN completed THEN dir END AS directional_return, CASE WHEN completed THEN rise END AS max_rise, CASE WHEN completed THEN fall END AS max_drop,
   CASE WHEN completed THEN ft_ END AS first_touch,
   CASE WHEN completed AND levels_ok THEN tk IS NOT NULL END AS target_hit, CASE WHEN completed AND levels_ok THEN sk IS NOT NULL END AS stop_hit,
   CASE WHEN completed THEN mfe_ END AS mfe, CASE WHEN completed THEN mae_ END AS mae,
   CASE WHEN completed THEN mfs_ END AS mfe_before_stop, CASE WHEN completed THEN mat_ END AS mae_before_target,
   CASE WHEN completed AND CASE WHEN short THEN tgt<base ELSE tgt>base END THEN mfe_/(abs(tgt-base)/base*100) END AS approach_ratio
 FROM od_""")
fragment("ex", """
 SELECT p.*, o.* EXCLUDE (signal_id), p.session_no+o.horizon AS due_no,
   CASE WHEN training_state='REFERENCE' THEN 'UNVERIFIED' WHEN model LIKE '%SHADOW%' THEN 'NON_LIVE' WHEN feature_at>signal_at THEN 'FUTURE_FEATURES'
        WHEN price IS NULL OR price<=0 THEN 'MISSING_BASE_PRICE' WHEN target IS NULL OR target<=0 THEN 'MISSING_TARGET_PRICE'
        WHEN decision='HOLD' THEN 'UNKNOWN_DIRECTION' WHEN (target-price)*(CASE decision WHEN 'BUY' THEN 1 ELSE -1 END)<=0 THEN 'INVALID_TARGET_DIRECTION'
        WHEN NOT completed THEN 'PENDING' WHEN exit_price IS NULL OR exit_price<=0 THEN 'INVALID_RESULT_PRICE' END AS reason
 FROM preds p JOIN outc o ON p.signal_id=o.signal_id""")


@lru_cache(maxsize=16)
def frame(spark: SparkSession, sf: str) -> DataFrame:
    """The logical plan only (built once per session and folder); nothing is cached as data."""
    return ind.indicator_frame(fx.weekly_bars(spark, sf), ema=False)


def predictions_of(f: DataFrame) -> DataFrame:
    """One frozen record per bar with a known 20-session mean."""
    no, c, m = F.col("session_no"), F.col("close"), F.col("sma20")
    up = c > m
    at = F.col("session").cast("timestamp")
    d = f.filter(m.isNotNull() & (c != m)).select(
        F.concat(F.lit("P"), "symbol", F.col("session").cast("string")).alias("signal_id"),
        "symbol", "sector", "session", "session_no",
        (at + F.expr("INTERVAL 18 HOURS")).alias("signal_at"),
        F.when(no % 47 == 0, at + F.expr("INTERVAL 19 HOURS")).otherwise(at + F.expr("INTERVAL 17 HOURS")).alias("feature_at"),
        c.alias("price"),
        F.when(no % 41 == 0, None).when(up, c * 1.05).otherwise(c * 0.95).alias("target"),
        F.when(up, c * 0.97).otherwise(c * 1.03).alias("stop"),
        F.when(no % 53 == 0, "HOLD").when(up, "BUY").otherwise("SELL").alias("decision"),
        F.when(no % 43 == 0, "TOMORROW_SHADOW").when(up & (no % 2 == 0), "TOMORROW_TOP10")
        .when(no % 3 == 0, "NEWS").otherwise("COMMON").alias("model"),
        F.when(no % 37 == 0, "REFERENCE").otherwise("TRAINING").alias("training_state"),
        F.when(no % 5 == 0, "STREAM").otherwise("DAILY_SCAN").alias("source"),
        F.least(F.lit(100.0), F.greatest(F.lit(0.0), 50 + F.col("momentum3") / 4)).alias("score"),
        F.col("rsi").alias("confidence"),
        F.when(F.col("sma50").isNull(), "UNCERTAIN").when(m > F.col("sma50"), "RISING").otherwise("FALLING").alias("regime"),
        "rsi", "sma20", "sma50", "volume_ratio", "momentum3", "atr14", "obv_trend", "bb_zone", "bb_squeeze",
        "bb_upper_break", "vwap20", "volume",
        ((F.col("rsi") >= 30) & (F.col("rsi") <= 65)).alias("f_rsi"),
        (m > F.col("sma50")).alias("f_trend"),
        (F.col("volume_ratio") >= 150).alias("f_volume"),
        (F.col("momentum3") > 0).alias("f_momentum"),
        (F.col("obv_trend") == "RISING").alias("f_obv"),
        (F.col("bb_zone") == "INSIDE").alias("f_bollinger"),
    )
    by_day = W.partitionBy("session_no").orderBy(F.desc("score"), "symbol")  # at most one row per symbol
    return out.evaluated(d.withColumn("rank", F.row_number().over(by_day)))


@lru_cache(maxsize=16)
def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return predictions_of(frame(spark, sf))


def last_session(bars: DataFrame) -> DataFrame:
    return bars.agg(F.max("session_no").alias("last_no"))


@lru_cache(maxsize=16)
def labelled(spark: SparkSession, sf: str, horizons=out.DAILY_HORIZONS) -> DataFrame:
    bars = fx.weekly_bars(spark, sf)
    return out.label_daily_outcomes(predictions(spark, sf), bars, last_session(bars), horizons)


@lru_cache(maxsize=16)
def examples(spark: SparkSession, sf: str, horizons=out.DAILY_HORIZONS) -> DataFrame:
    return out.evaluated(labelled(spark, sf, horizons).withColumn("reason", out.quality_reason()))


FLAGS = ("f_rsi", "f_trend", "f_volume", "f_momentum", "f_obv", "f_bollinger")
