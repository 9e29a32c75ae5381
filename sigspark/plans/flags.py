"""All evidence criteria of the frozen records."""

from functools import lru_cache

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sigspark.functions import stats as st
from sigspark.operators import flags as fl
from sigspark.plans.context import EXPECTED, measurement, sectors, with_expected
from sigspark.plans.decision import _final
from sigspark.plans.indicators import wide
from sigspark.plans.records_fixture import predictions
from sigspark.plans.registry import ORACLES, fragment, query
from sigspark.plans.scoring import rows

# The tables hold no company news: sessions stand in for a record's news and macro points.
fragment("fdec", ORACLES["final_decision"])
fragment("evin", f"""
 SELECT p.signal_id, p.feature_at<=p.signal_at AS known, w.*, w.pv AS prev_vwap20, m.regime_score-50 AS market_score, m.breadth_score-50 AS breadth_score, m.regime_confidence AS market_confidence,
  x.rs_score-50 AS sector_score, x.sector_confidence, f.final,
  CASE WHEN p.session_no%4<>0 THEN CASE p.session_no%3 WHEN 0 THEN 'DISCLOSURE' WHEN 1 THEN 'SITE' ELSE 'PRESS' END END AS news_source, p.session_no%5=0 AS news_confirmed,
  (p.session_no%21)-10.0 AS news_points, CASE WHEN p.session_no%6<>0 THEN (p.session_no%13)-6.0 END AS macro_points
 FROM (SELECT *, {EXPECTED} AS due FROM preds) AS p JOIN (SELECT *, lag(vwap20) OVER (PARTITION BY symbol ORDER BY session_no) AS pv, high20_prev AS lvl FROM wrow) AS w ON p.symbol=w.symbol AND p.session_no=w.session_no
 LEFT JOIN fdec f ON f.symbol=p.symbol AND f.session_no=p.session_no LEFT JOIN (SELECT * FROM mmeas WHERE final) AS m ON m.session_no=p.due LEFT JOIN (SELECT * FROM smeas WHERE enough) AS x ON x.session_no=p.due AND x.sector=p.sector""")
# Written out once more in SQL, so that a wrong rule on either side shows.
RULES = {
    "SMA_TREND": "sma20>sma50", "EMA_TREND": "ema9>ema21", "MACD": "macd-macd_signal>0", "RSI": "rsi>=45 AND rsi<=65", "MOMENTUM": "momentum3>0", "VOLUME": "volume_ratio_incl>=150",
    "OBV_TREND": "obv_trend='RISING'", "OBV_BREAK": "obv_break='UP'",
    "OBV_POS_DIVERGENCE": "CASE WHEN obv_trend IS NOT NULL THEN obv_divergence IS NOT NULL AND obv_divergence='POSITIVE' END",
    "OBV_NEG_DIVERGENCE": "CASE WHEN obv_trend IS NOT NULL THEN obv_divergence IS NOT NULL AND obv_divergence='NEGATIVE' END",
    "VOLUME_BREAKOUT": "CASE WHEN volume_ratio_incl IS NOT NULL AND lvl>0 THEN close>=lvl AND volume_ratio_incl>=150 END",
    "VWAP": "close>vwap20", "VWAP_RECLAIM": "prev_close<=pv AND close>vwap20",
    "BOLLINGER_SQUEEZE": "CASE WHEN bb_mid IS NOT NULL THEN bb_squeeze END", "BOLLINGER_BREAK": "CASE WHEN bb_mid IS NOT NULL THEN bb_upper_break END",
    "SUPPORT_RESISTANCE": "support20<=close AND close<resistance20", "ATR_NORMAL": "CASE WHEN close>0 THEN atr14/close*100>=0 AND atr14/close*100<=5 END", "RISK_REWARD": "rr>=1.5",
    "MARKET_POSITIVE": "CASE WHEN market_confidence>=50 THEN market_score>0 END", "MARKET_NEGATIVE": "CASE WHEN market_confidence>=50 THEN market_score<0 END",
    "BREADTH_POSITIVE": "CASE WHEN market_confidence>=50 THEN breadth_score>0 END", "BREADTH_NEGATIVE": "CASE WHEN market_confidence>=50 THEN breadth_score<0 END",
    "SECTOR_STRONG": "CASE WHEN sector_confidence>=50 THEN sector_score>0 END", "SECTOR_WEAK": "CASE WHEN sector_confidence>=50 THEN sector_score<0 END",
    "DISCLOSURE": "news_source='DISCLOSURE'", "COMPANY_SITE": "news_source='SITE'", "NEWS_POSITIVE": "CASE WHEN news_source IS NOT NULL THEN news_points>0 END",
    "NEWS_NEGATIVE": "CASE WHEN news_source IS NOT NULL THEN news_points<0 END", "NEWS_PRICE_CONFIRMED": "CASE WHEN news_source IS NOT NULL THEN news_confirmed END",
    "MACRO_POSITIVE": "macro_points>0", "MACRO_NEGATIVE": "macro_points<0",
    "STRONG_BUY": "final='STRONG_BUY'", "BUY": "final='BUY'", "WAIT": "final='WAIT'", "SELL": "final='SELL'", "STRONG_SELL": "final='STRONG_SELL'",
}


@lru_cache(maxsize=8)
def evidence_inputs(s, d):
    """One row per record: its bar, its contexts of the expected session, its decision, its news."""
    n = F.col("session_no")
    w = W.partitionBy("symbol").orderBy("session_no")  # one symbol's calendar
    extra = wide(s, d).select("symbol", "session_no", "obv_trend", "obv_break", "obv_divergence", "bb_mid", "bb_squeeze", "bb_upper_break", "support20", "resistance20", F.col("high20_prev").alias("breakout_level"))
    bar = rows(s, d).withColumn("prev_vwap20", F.lag("vwap20").over(w)).join(extra, ["symbol", "session_no"])
    keep = ["symbol", "session_no", "close", "prev_close", "sma20", "sma50", "ema9", "ema21", "macd", "macd_signal", "rsi", "momentum3", "volume_ratio_incl", "vwap20", "prev_vwap20", "rr", "atr14", *extra.columns[2:]]
    p = with_expected(predictions(s, d).select("signal_id", "symbol", "sector", "session_no", "signal_at", (F.col("feature_at") <= F.col("signal_at")).alias("known")))
    p = p.withColumns({
        "news_source": F.when(n % 4 != 0, F.when(n % 3 == 0, "DISCLOSURE").when(n % 3 == 1, "SITE").otherwise("PRESS")), "news_confirmed": n % 5 == 0,
        "news_points": (n % 21) - 10.0, "macro_points": F.when(n % 6 != 0, (n % 13) - 6.0)})
    m = measurement(s, d).filter("final").select(n.alias("ctx_no"), (F.col("regime_score") - 50).alias("market_score"), (F.col("breadth_score") - 50).alias("breadth_score"), F.col("regime_confidence").alias("market_confidence"))
    x = sectors(s, d).filter("enough").select(n.alias("ctx_no"), "sector", (F.col("rs_score") - 50).alias("sector_score"), "sector_confidence")
    return (p.join(bar.select(*keep), ["symbol", "session_no"]).join(_final(s, d).select("symbol", "session_no", "final"), ["symbol", "session_no"], "left")
            .join(m, "ctx_no", "left").join(x, ["ctx_no", "sector"], "left"))


query("evidence_flags", f"SELECT * FROM (SELECT signal_id, unnest([{', '.join(repr(k) for k in RULES)}]) AS criterion, unnest([{', '.join(f'CASE WHEN known THEN {v} END' for v in RULES.values())}]) AS flag FROM evin) AS q")(
    lambda s, d: st.long_flags(evidence_inputs(s, d), fl.evidence_flags(F.col("known")), ["signal_id"]))

# --- controlled shadow score -------------------------------------------------------------------------
# The approved weights of the fixture's model: two of three criteria, moved by up to 0.2 points.
PROPOSED = {c: fl.BASE_WEIGHT[c] + ((i % 5) - 2) * 0.001 for i, c in enumerate(fl.CRITERIA) if i % 3}
FAMILY_OF = {c: family for family, members in fl.FAMILIES.items() for c in members}
_long = f"SELECT signal_id, session_no, rr, unnest([{', '.join(repr(k) for k in RULES)}]) AS criterion, unnest([{', '.join(f'CASE WHEN known THEN {v} END' for v in RULES.values())}]) AS flag FROM evin"
_model = ", ".join(f"('{c}', '{FAMILY_OF[c]}', {w - fl.BASE_WEIGHT[c]!r}::DOUBLE)" for c, w in PROPOSED.items())
_fam = ", ".join(f"coalesce(sum(moved) FILTER (WHERE family='{f}'),0)*100 AS part_{f}" for f in fl.FAMILIES)
_all = "+".join(f"part_{f}" for f in fl.FAMILIES)
query("controlled_score", f"""
 WITH l AS ({_long}), m(criterion, family, moved) AS (VALUES {_model}),
 a AS (SELECT l.signal_id, l.session_no>t.training_end AS valid, bool_or(flag IS NOT NULL) AS known, any_value(rr) AS rr, {_fam} FROM l CROSS JOIN trainend t LEFT JOIN m ON m.criterion=l.criterion AND l.flag GROUP BY l.signal_id, l.session_no, t.training_end),
 b AS (SELECT *, CASE WHEN NOT known OR NOT valid THEN 0 ELSE greatest(-2,least(2,{_all})) END::DOUBLE AS delta FROM a),
 c AS (SELECT *, CASE WHEN rr IS NULL OR rr<1.5 THEN least(0,delta) ELSE delta END::DOUBLE AS correction FROM b)
 SELECT c.signal_id, {', '.join(f'CASE WHEN valid THEN part_{f} ELSE 0 END::DOUBLE AS part_{f}' for f in fl.FAMILIES)}, correction, greatest(0,least(100,p.score+correction)) AS shadow FROM c JOIN preds p ON p.signal_id=c.signal_id""",
      f=" ".join([*(f"part_{f}" for f in fl.FAMILIES), "correction", "shadow"]))(lambda s, d: _controlled(s, d))


def _controlled(s, d):
    from sigspark.plans.learning import training_end

    marks = fl.evidence_flags(F.col("known"))
    x = evidence_inputs(s, d).crossJoin(training_end(s, d))
    x = x.select("signal_id", "rr", (F.col("session_no") > F.col("training_end")).alias("valid"), *[v.alias(k) for k, v in marks.items()])
    x = x.join(predictions(s, d).select("signal_id", F.col("score").alias("raw")), "signal_id")
    weights = s.range(1).select(F.explode(F.create_map(*[F.lit(v) for kv in PROPOSED.items() for v in kv])).alias("criterion", "weight"))
    out = fl.controlled_score(x, weights, "raw", F.col("valid"), F.col("rr").isNull() | (F.col("rr") < 1.5))
    return out.select("signal_id", *[f"part_{f}" for f in fl.FAMILIES], "correction", "shadow")
