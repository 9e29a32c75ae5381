"""Composite score and the full error taxonomy."""

from functools import lru_cache

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sigspark.functions import stats as st
from sigspark.operators import composite as cp
from sigspark.operators import flags as fl
from sigspark.operators import levels as lv
from sigspark.operators import reports as rp
from sigspark.operators import scoring as sc
from sigspark.operators.outcomes import evaluated
from sigspark.plans.flags import RULES, evidence_inputs
from sigspark.plans.registry import fragment, query
from sigspark.plans.reports import ok
from sigspark.plans.scoring import rows, sql_sum

# --- composite score: the record's inputs of plans/flags.py, its own history, and event ids -------
# Event ids, ages and the sector's points follow the session, as the tables hold no news ledger.
fragment("hist5", "SELECT symbol, due_no AS no, count(*) AS n, count(*) FILTER (WHERE status='SUCCESS') AS k FROM okx WHERE horizon=5 GROUP BY symbol, due_no")
fragment("hrun", "SELECT symbol, no, sum(n) OVER w AS hn, sum(k) OVER w AS hk, rec FROM (SELECT symbol, no, n, k, false AS rec FROM hist5 UNION ALL SELECT symbol, session_no, 0, 0, true FROM preds) AS q WINDOW w AS (PARTITION BY symbol ORDER BY no RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
fragment("csin", f"""
 SELECT e.*, greatest(0,least(100,50+{sql_sum(sc.TECHNICAL_RULES)})) AS technical, (e.session_no%25)::DOUBLE AS technical_age, (e.session_no%101)::DOUBLE AS news_conf, change_pct>0 AND volume_ratio_incl>=100 AS backed,
  (e.session_no%9)-4.0 AS sector_points, e.session_no%7 AS macro_id, CASE WHEN e.session_no%8<>0 THEN e.session_no%5 END AS sector_id, CASE WHEN e.session_no%11=0 THEN e.session_no%7 ELSE 1000+e.session_no END AS ev_id,
  (e.session_no%50)*60.0 AS macro_age, CASE WHEN market_confidence>=50 THEN greatest(-5,least(5,market_score/10)) END AS regime_points, h.hn, h.hk FROM evin e LEFT JOIN hrun h ON h.rec AND h.symbol=e.symbol AND h.no=e.session_no""")
_side = "CASE WHEN close>vwap20 THEN 1.0 WHEN close<=vwap20 THEN -1.0 ELSE 0 END+CASE WHEN obv_trend='RISING' THEN 0.8 WHEN obv_trend IS NOT NULL THEN -0.8 ELSE 0 END"
fragment("cs1_", f"""
 SELECT *, news_source IS NOT NULL AS ev, news_points>0 AND NOT coalesce(backed,false) AS alone, greatest(-4,least(4, CASE WHEN news_points>0 THEN CASE WHEN change_pct>0 THEN least(2,change_pct/2) WHEN change_pct<-1 THEN -least(3,abs(change_pct)/1.5) ELSE 0 END
   +CASE WHEN volume_ratio_incl>=150 THEN 1.5 WHEN volume_ratio_incl<80 THEN -0.5 ELSE 0 END+{_side} WHEN news_points<0 THEN CASE WHEN change_pct<0 THEN -least(2,abs(change_pct)/2) WHEN change_pct>1 THEN least(2,change_pct/2) ELSE 0 END
   +CASE WHEN volume_ratio_incl>=150 AND change_pct<0 THEN -1.5 ELSE 0 END+{_side} ELSE 0 END)) AS pc FROM csin""")
fragment("cs2_", """
 SELECT *, CASE WHEN ev THEN greatest(-10,least(10,news_points*least(100,news_conf)/100*CASE WHEN alone THEN 0.35 ELSE 1 END)) ELSE 0 END AS nv, CASE WHEN ev THEN CASE WHEN alone THEN least(pc,greatest(-4,least(0,coalesce(change_pct,0)/2))) ELSE pc END ELSE 0 END AS cv,
  CASE WHEN ev AND macro_id=ev_id THEN 0 ELSE coalesce(macro_points,0)*pow(0.5,macro_age/1440) END AS mv,
  CASE WHEN coalesce(macro_id=sector_id,false) OR (sector_id IS NULL AND coalesce(macro_points,0)=sector_points) OR coalesce(ev AND sector_id=ev_id,false) THEN 0 ELSE sector_points*pow(0.5,macro_age/1440) END AS sv FROM cs1_""")
fragment("cs3_", """
 SELECT *, (technical-50)*0.70 AS c_technical, nv*5*0.12 AS c_news, greatest(-10,least(10,mv))*5*0.06 AS c_macro, greatest(-10,least(10,sv))*5*0.04 AS c_sector, cv*12.5*0.03 AS c_confirmation, CASE WHEN hn>=30 THEN (hk/hn-0.5)*100*0.03 ELSE 0 END::DOUBLE AS c_history,
  coalesce(regime_points,0)*10*0.02 AS c_regime, (30+6*((rsi IS NOT NULL)::INT+(macd IS NOT NULL)::INT+(volume_ratio_incl IS NOT NULL)::INT+(support20 IS NOT NULL)::INT+(resistance20 IS NOT NULL)::INT)+CASE WHEN ev THEN 10 ELSE 0 END
   +CASE WHEN macro_points IS NOT NULL THEN 10 ELSE 0 END+CASE WHEN regime_points IS NOT NULL THEN 10 ELSE 0 END+CASE WHEN hn>=30 THEN 10 ELSE 0 END)*CASE WHEN technical_age>20 THEN 0.35 WHEN technical_age>10 THEN 0.7 ELSE 1.0 END AS score_confidence FROM cs2_""")
fragment("cs4_", "SELECT *, greatest(0,least(100,50+c_technical+c_news+c_macro+c_sector+c_confirmation+c_history+c_regime)) AS score FROM cs3_")
PARTS = [f"c_{g}" for g in cp.WEIGHTS]
query("composite_score", f"""
 SELECT signal_id, {', '.join(PARTS)}, score, score_confidence, CASE WHEN score>=70 AND (score_confidence<50 OR nv<=-5 OR mv<=-5) THEN 'WATCH' WHEN score>=82 THEN 'STRONG_BUY' WHEN score>=70 THEN 'BUY' WHEN score<=20 THEN 'STRONG_SELL' WHEN score<=35 THEN 'SELL' ELSE 'WATCH' END AS composite FROM cs4_""",
      f=" ".join([*PARTS, "score", "score_confidence"]))(lambda s, d: composite(s, d).select("signal_id", *PARTS, "score", "score_confidence", "composite"))


def composite(s, d):
    n = F.col("session_no")
    bar = rows(s, d).select("symbol", "session_no", "change_pct", sc.technical_score().cast("double").alias("technical"))
    x = evidence_inputs(s, d).join(bar, ["symbol", "session_no"])
    # Evidence known before the record: one row a due session, summed up to the session before.
    due = ok(s, d).filter("horizon = 5").groupBy("symbol", F.col("due_no").alias("no")).agg(F.count(F.lit(1)).alias("n"), st.count_if(F.col("status") == "SUCCESS").alias("k"), F.lit(False).alias("rec"))
    both = due.unionByName(x.select("symbol", n.alias("no"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("k"), F.lit(True).alias("rec")))
    w = W.partitionBy("symbol").orderBy("no").rangeBetween(W.unboundedPreceding, -1)  # one symbol's calendar
    past = both.select("symbol", F.col("no").alias("session_no"), F.sum("n").over(w).alias("history_n"), F.sum("k").over(w).alias("history_k"), "rec").filter("rec").drop("rec")
    event = F.col("news_source").isNotNull()
    change, volume = F.col("change_pct"), F.col("volume_ratio_incl")
    held = lv.price_confirmation(F.col("news_points"), change, volume, F.col("close") > F.col("vwap20"), F.col("obv_trend") == "RISING")
    effect, confirmation = cp.news_effect(F.col("news_points"), (n % 101).cast("double"), (change > 0) & (volume >= 100), held, change)
    x = evaluated(x.join(past, ["symbol", "session_no"], "left").withColumns({
        "technical_age": (n % 25).cast("double"), "news_effect": F.when(event, effect), "news_confirmation": F.when(event, confirmation),
        "news_id": F.when(event, F.when(n % 11 == 0, n % 7).otherwise(1000 + n)), "sector_points": (n % 9) - 4.0, "macro_id": n % 7, "sector_id": F.when(n % 8 != 0, n % 5),
        "macro_age": (n % 50) * 60.0, "regime_points": F.when(F.col("market_confidence") >= 50, F.greatest(F.lit(-5.0), F.least(F.lit(5.0), F.col("market_score") / 10)))}))
    return cp.composite_score(x)


# --- twelve failure types ---------------------------------------------------------------------------
_f = lambda k: f"coalesce(CASE WHEN known THEN {RULES[k]} END, false)"
_no = lambda k: f"coalesce(NOT CASE WHEN known THEN {RULES[k]} END, false)"
fragment("errs", f"""
 SELECT signal_id, horizon, source, CASE WHEN failed OR stale THEN list_filter([CASE WHEN stale THEN 'STALE_DATA_ERROR' END, CASE WHEN failed THEN CASE WHEN short THEN 'FALSE_SELL' WHEN decision='BUY' THEN 'FALSE_BUY' ELSE 'UNKNOWN' END END,
  CASE WHEN NOT short AND {_f('MARKET_NEGATIVE')} THEN 'MARKET_CONTEXT_MISSED' END, CASE WHEN NOT short AND {_f('SECTOR_WEAK')} THEN 'SECTOR_CONTEXT_MISSED' END,
  CASE WHEN {_f('NEWS_POSITIVE')} AND {_no('NEWS_PRICE_CONFIRMED')} THEN 'NEWS_FALSE_POSITIVE' END, CASE WHEN ({_f('BOLLINGER_BREAK')} OR {_f('VOLUME_BREAKOUT')}) AND {_no('VOLUME')} THEN 'VOLUME_FALSE_BREAKOUT' END,
  CASE WHEN abs(price-stop)<atr*0.75 THEN 'STOP_TOO_TIGHT' END, CASE WHEN abs(target-price)>atr*4 AND NOT target_hit THEN 'TARGET_TOO_AGGRESSIVE' END, CASE WHEN entry_age>20 THEN 'LATE_ENTRY' END, CASE WHEN entry_unconfirmed THEN 'EARLY_ENTRY' END], lambda x: x IS NOT NULL) END AS types
 FROM (SELECT e.*, o.horizon, o.source, o.short, o.decision, o.price, o.stop, o.target, o.target_hit, o.atr14 AS atr, o.status IN ('STOP','FAIL') AS failed, o.session_no%29=0 AS stale, o.session_no%31 AS entry_age, o.session_no%17=0 AS entry_unconfirmed
  FROM okx o JOIN evin e ON e.signal_id=o.signal_id) AS q""")
query("error_taxonomy", "SELECT signal_id, horizon, array_to_string(types,'|') AS types, types[len(types)] AS primary_type FROM errs WHERE types IS NOT NULL")(
    lambda s, d: errors(s, d).select("signal_id", "horizon", "types", F.element_at("types", -1).alias("primary_type")))
query("error_counts", "SELECT source, t AS error_type, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, t) AS rank FROM (SELECT source, unnest(types) AS t FROM errs WHERE types IS NOT NULL) AS q GROUP BY source, t")(
    lambda s, d: errors(s, d).select("source", F.explode("types").alias("error_type")).groupBy("source", "error_type").agg(F.count(F.lit(1)).alias("n"))
    .withColumn("rank", F.row_number().over(W.partitionBy("source").orderBy(F.desc("n"), "error_type"))))  # ten types a source


@lru_cache(maxsize=8)
def errors(s, d):
    """Staleness and entry timing follow the session, as the tables don't record them."""
    need = ("MARKET_NEGATIVE", "SECTOR_WEAK", "NEWS_POSITIVE", "NEWS_PRICE_CONFIRMED", "BOLLINGER_BREAK", "VOLUME_BREAKOUT", "VOLUME")
    marks = fl.evidence_flags(F.col("known"))
    e = evidence_inputs(s, d).select("signal_id", *[marks[k].alias(k) for k in need])
    n = F.col("session_no")
    x = ok(s, d).drop("volume").join(e, "signal_id").withColumns({"stale": n % 29 == 0, "entry_age": n % 31, "entry_confirmed": F.when(n % 17 == 0, False)})
    return x.withColumn("types", rp.error_types()).filter("types IS NOT NULL").select("signal_id", "horizon", "source", "types")
