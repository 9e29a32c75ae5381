"""Score and ranking queries."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from sigspark.operators import indicators as ind
from sigspark.operators import scoring as sc
from sigspark.operators.outcomes import evaluated
from sigspark.plans.registry import fragment, query
from sigspark.sources import fixtures as fx


def sql_sum(rules):
    return " + ".join(f"(CASE WHEN {c} THEN {p} ELSE 0 END)" for c, p in rules)


fragment("wrow", """
 SELECT i.*, e.macd, e.macd_signal, e.macd_hist, e.ema9, e.ema21, coalesce(prev_macd<=prev_signal AND e.macd>macd_signal,false) AS cross_up, coalesce(prev_macd>=prev_signal AND e.macd<macd_signal,false) AS cross_down,
  prev_macd-prev_signal AS prev_hist, lag(rsi) OVER (PARTITION BY i.symbol ORDER BY i.session_no) AS prev_rsi,
  (resistance20-i.close)/nullif(i.close-support20,0) AS rr, (resistance20/i.close-1)*100 AS room
 FROM ind i JOIN emas e ON i.symbol=e.symbol AND i.session=e.session""")


@lru_cache(maxsize=8)
def rows(s, d):
    win = ind.BarWindow("symbol", order="session_no")
    f = ind.indicator_frame(fx.weekly_bars(s, d), win)
    return evaluated(f.withColumns({
        "cross_up": F.coalesce((F.col("prev_macd") <= F.col("prev_signal")) & (F.col("macd") > F.col("macd_signal")), F.lit(False)),
        "cross_down": F.coalesce((F.col("prev_macd") >= F.col("prev_signal")) & (F.col("macd") < F.col("macd_signal")), F.lit(False)),
        "prev_hist": F.col("prev_macd") - F.col("prev_signal"), "prev_rsi": win.lag("rsi"),
        "rr": F.try_divide(F.col("resistance20") - F.col("close"), F.col("close") - F.col("support20")),
        "room": (F.col("resistance20") / F.col("close") - 1) * 100}).select(
            "symbol", "sector", "session", "session_no", "open", "close", "prev_close", "change_pct", "sma20", "sma50", "rsi", "prev_rsi", "macd", "macd_signal", "macd_hist", "prev_hist",
            "cross_up", "cross_down", "volume_ratio_incl", "volume3_ratio", "vwap20", "bb_zone", "close_position", "rr", "room", "momentum3", "atr14", "ema9", "ema21"))


BUYS, SELLS = f"greatest(0,least(100,{sql_sum(sc.BUY_RULES)}))", f"greatest(0,least(100,{sql_sum(sc.SELL_RULES)}))"
query("daily_buy_sell_scores", f"""
 SELECT symbol, session_no, buy_score, sell_score, CASE WHEN buy_score>=65 AND buy_score-sell_score>=20 AND rr>=1.5 THEN 'BUY' WHEN sell_score>=60 AND sell_score-buy_score>=20 THEN 'SELL' ELSE 'WATCH' END AS score_decision,
  greatest(buy_score,sell_score) AS score_confidence FROM (SELECT *, {BUYS} AS buy_score, {SELLS} AS sell_score FROM wrow) AS q""", f="buy_score sell_score score_confidence")(
    lambda s, d: sc.daily_scores(rows(s, d)).select("symbol", "session_no", *[F.col(c).cast("double").alias(c) for c in ("buy_score", "sell_score")], "score_decision", F.col("score_confidence").cast("double").alias("score_confidence")))

query("signal_class", f"""
 SELECT symbol, session_no, CASE WHEN rsi IS NULL OR change_pct IS NULL OR rsi<=0 OR change_pct>=8 OR change_pct<=-8 THEN 'NEUTRAL' WHEN rsi>=70 THEN 'OVERBOUGHT'
  WHEN rsi<30 AND change_pct>-4 AND change_pct<=4 AND volume_ratio_incl>=50 AND ({sql_sum(sc.REACTION)})>=3 AND close_position>=35 THEN 'OVERSOLD_REACTION' WHEN rsi<30 THEN 'NEUTRAL'
  WHEN rsi>=35 AND rsi<68 AND ({sql_sum(sc.CLASS_BUY)})>=9 AND change_pct>-2 THEN 'AGGRESSIVE_BUY' WHEN rsi>=32 AND rsi<68 AND ({sql_sum(sc.CLASS_SELL)})>=9 AND change_pct<0 THEN 'AGGRESSIVE_SELL' ELSE 'NEUTRAL' END AS signal_class FROM wrow""")(
    lambda s, d: rows(s, d).select("symbol", "session_no", sc.signal_class(None).alias("signal_class")))

EXC = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for c, n in sc.EXCLUSIONS) + " END"
query("hard_exclusions", f"SELECT symbol, session_no, {EXC} AS reason FROM wrow")(
    lambda s, d: rows(s, d).select("symbol", "session_no", sc.exclusion_reason().alias("reason")))
fragment("tsc", f"SELECT symbol, sector, session_no, volume_ratio_incl, rr, momentum3, volume3_ratio, CASE WHEN ({EXC}) IS NULL THEN greatest(0,least(95,{sql_sum(sc.TOMORROW_RULES)})) END AS tscore FROM wrow")


@lru_cache(maxsize=8)
def scored(s, d):
    return evaluated(rows(s, d).withColumn("tscore", sc.tomorrow_score().cast("double")))


query("tomorrow_score", "SELECT symbol, session_no, tscore::DOUBLE AS tscore FROM tsc", f="tscore")(
    lambda s, d: scored(s, d).select("symbol", "session_no", "tscore"))
query("tomorrow_top10", "SELECT session_no, symbol, tscore::DOUBLE AS tscore, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_no ORDER BY tscore DESC, round(volume_ratio_incl,6) DESC, round(rr,6) DESC NULLS LAST, symbol) AS rank FROM tsc WHERE tscore>=55) AS q WHERE rank<=10", f="tscore")(
    lambda s, d: sc.top_k(scored(s, d).filter("tscore >= 55"), 10, F.desc("tscore"), F.round("volume_ratio_incl", 6).desc(), F.round("rr", 6).desc_nulls_last(), F.col("symbol"), group=("session_no",)).select("session_no", "symbol", "tscore", "rank"))
query("news_decay", "SELECT doc_id, n_chars/100.0 * pow(0.5, (doc_id%720)/180.0) AS decayed FROM documents", f="decayed")(
    lambda s, d: fx.table(s, d, "documents").select("doc_id", sc.news_decay(F.col("n_chars") / 100.0, (F.col("doc_id") % 720).cast("double")).alias("decayed")))
query("decision_from_score", "SELECT signal_id, CASE WHEN score>=82 AND momentum3/100>=-2 AND rsi/50-1>=-1 THEN 'STRONG_BUY' WHEN score>=70 AND momentum3/100>=-4 THEN 'BUY' WHEN score<=35 OR momentum3/100<=-8 THEN 'SELL' WHEN score<=50 OR momentum3/100<=-5 THEN 'RISKY_WATCH' ELSE 'WATCH' END AS decision FROM preds")(
    lambda s, d: _decision(s, d))


def _decision(s, d):
    from sigspark.plans.records_fixture import predictions
    return predictions(s, d).select("signal_id", sc.decision_from_score(F.col("score"), F.col("momentum3") / 100, F.col("rsi") / 50 - 1).alias("decision"))
