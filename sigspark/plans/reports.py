"""Report queries over labelled fixture predictions."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sigspark.functions import stats as st
from sigspark.functions.quantiles import robust
from sigspark.functions.scalars import first_match, ratio
from sigspark.operators import reports as rp
from sigspark.plans import sqlkit as k
from sigspark.plans.records_fixture import FLAGS, examples, last_session, predictions
from sigspark.plans.registry import fragment, query
from sigspark.sources import fixtures as fx

FAMILY = {"f_rsi": "momentum", "f_momentum": "momentum", "f_trend": "trend", "f_volume": "volume", "f_obv": "volume", "f_bollinger": "price_position"}

fragment("okx", f"SELECT * FROM ex WHERE reason IS NULL AND {k.LAB}")
fragment("okl", "SELECT *, unnest(['f_rsi','f_trend','f_volume','f_momentum','f_obv','f_bollinger']) AS criterion, unnest([f_rsi,f_trend,f_volume,f_momentum,f_obv,f_bollinger]) AS flag FROM okx")


@lru_cache(maxsize=8)
def ok(s, d):
    return examples(s, d).filter(F.col("reason").isNull() & F.col("status").isin(*st.LABELS))


query("robust_stats", k.robust("SELECT * FROM okx", "horizon", "return_pct"), f="mean median trimmed_mean")(
    lambda s, d: robust(ok(s, d), ["horizon"], "return_pct"))

query("wilson_interval", f"SELECT horizon, decision, s, n, {k.w_lo('s', 'n')} AS low, {k.w_hi('s', 'n')} AS high FROM (SELECT horizon, decision, count(*) AS n, count(*) FILTER (WHERE status='SUCCESS') AS s FROM okx GROUP BY horizon, decision) AS q", f="low high")(
    lambda s, d: ok(s, d).groupBy("horizon", "decision").agg(F.count(F.lit(1)).alias("n"), st.count_if(F.col("status") == "SUCCESS").alias("s"))
    .select("horizon", "decision", "s", "n", st.wilson(F.col("s"), F.col("n"))[0].alias("low"), st.wilson(F.col("s"), F.col("n"))[1].alias("high")))

query("pearson_guarded", "SELECT horizon, sector, CASE WHEN count(*)>=3 THEN corr(score, return_pct) END AS corr, count(*) AS n FROM okx WHERE score IS NOT NULL GROUP BY horizon, sector", f="corr")(
    lambda s, d: ok(s, d).filter("score IS NOT NULL").groupBy("horizon", "sector").agg(st.corr_guarded("score", "return_pct").alias("corr"), F.count(F.lit(1)).alias("n")))

query("summarize_outcomes", k.cols(k.summary("SELECT * FROM ex", "horizon"), "horizon", *k.SUMMARY), f=k.SUMMARY_F)(
    lambda s, d: st.summarize(examples(s, d), ["horizon"]).select("horizon", *k.SUMMARY))

query("horizon_report", f"""
 SELECT h.horizon, t.expected, coalesce(evaluated,0) AS evaluated, t.expected-coalesce(evaluated,0) AS pending, coalesce(evaluated,0)::DOUBLE/t.expected AS completion_rate,
  CASE WHEN evaluated>0 THEN 'READY' ELSE 'WAITING' END AS data_state, median, success_rate FROM hz h CROSS JOIN (SELECT count(*) AS expected FROM preds WHERE model='TOMORROW_TOP10') t
 LEFT JOIN ({k.summary("SELECT * FROM ex WHERE model='TOMORROW_TOP10'", "horizon")}) s ON h.horizon=s.horizon""", f="completion_rate median success_rate")(lambda s, d: _horizon(s, d))


def _horizon(s, d):
    top = F.col("model") == "TOMORROW_TOP10"
    expected = predictions(s, d).filter(top).agg(F.count(F.lit(1)).alias("expected"))
    hz = s.range(1).select(F.explode(F.array(*[F.lit(h) for h in (1, 3, 5, 10, 20, 60)])).alias("horizon"))
    j = hz.crossJoin(expected).join(st.summarize(examples(s, d).filter(top), ["horizon"]), "horizon", "left")
    e = F.coalesce("evaluated", F.lit(0))
    return j.select("horizon", "expected", e.alias("evaluated"), (F.col("expected") - e).alias("pending"), (e / F.col("expected")).alias("completion_rate"),
                    F.when(e > 0, "READY").otherwise("WAITING").alias("data_state"), "median", "success_rate")


query("daily_list_report", """
 WITH l AS (SELECT *, row_number() OVER (PARTITION BY session_no ORDER BY score DESC, symbol) AS hs, count(*) OVER (PARTITION BY session_no) AS n FROM ex WHERE horizon=1 AND completed AND rank<=10 AND score IS NOT NULL)
 SELECT session_no, count(*) AS evaluated, avg(return_pct) FILTER (WHERE rank<=3) AS top3, avg(return_pct) FILTER (WHERE rank<=5) AS top5, avg(return_pct) AS top10,
  CASE WHEN count(*)>=3 THEN corr(score, return_pct) END AS score_corr, CASE WHEN count(*)>=3 THEN corr(rank, return_pct) END AS rank_corr,
  arg_max(symbol, return_pct) AS best_symbol, arg_min(symbol, return_pct) AS worst_symbol,
  avg(return_pct) FILTER (WHERE hs<=floor(n/2)) AS high_half, avg(return_pct) FILTER (WHERE hs>floor(n/2)) AS low_half FROM l GROUP BY session_no""",
      f="top3 top5 top10 score_corr rank_corr high_half low_half")(lambda s, d: _daily_list(s, d))


def _daily_list(s, d):
    e = examples(s, d).filter("horizon = 1 AND completed AND rank <= 10 AND score IS NOT NULL")  # at most ten rows per session
    w = W.partitionBy("session_no")
    e = e.withColumns({"hs": F.row_number().over(w.orderBy(F.desc("score"), "symbol")), "n": F.count(F.lit(1)).over(w)})
    r, rk = F.col("return_pct"), F.col("rank")
    return e.groupBy("session_no").agg(
        F.count(F.lit(1)).alias("evaluated"), F.avg(F.when(rk <= 3, r)).alias("top3"), F.avg(F.when(rk <= 5, r)).alias("top5"), F.avg(r).alias("top10"),
        st.corr_guarded("score", "return_pct").alias("score_corr"), st.corr_guarded("rank", "return_pct").alias("rank_corr"),
        F.max_by("symbol", "return_pct").alias("best_symbol"), F.min_by("symbol", "return_pct").alias("worst_symbol"),
        F.avg(F.when(F.col("hs") <= F.floor(F.col("n") / 2), r)).alias("high_half"), F.avg(F.when(F.col("hs") > F.floor(F.col("n") / 2), r)).alias("low_half"))


def crit_sql(src, keys, minimum=40, days=5):
    kk = f"{keys}, criterion"
    s = k.summary(f"SELECT * FROM ({src}) AS f_ WHERE flag IS NOT NULL", kk + ", flag")
    return f"""SELECT *, yes_success_rate-no_success_rate AS difference, yes_success_low-no_success_high AS low, yes_success_high-no_success_low AS high,
   coalesce(yes_evaluated>={minimum} AND no_evaluated>={minimum} AND yes_days>={days} AND no_days>={days},false) AS enough,
   CASE WHEN yes_evaluated>={minimum} AND no_evaluated>={minimum} AND yes_days>={days} AND no_days>={days} AND yes_success_low-no_success_high>0 AND yes_median>no_median+0.25 THEN 'UP'
        WHEN yes_evaluated>={minimum} AND no_evaluated>={minimum} AND yes_days>={days} AND no_days>={days} AND yes_success_high-no_success_low<0 AND yes_median<no_median-0.25 THEN 'DOWN' ELSE 'SAME' END AS direction
  FROM (SELECT {kk}, {', '.join(f'max({c}) FILTER (WHERE flag) AS yes_{c}, max({c}) FILTER (WHERE NOT flag) AS no_{c}' for c in ('evaluated','days','success_rate','success_low','success_high','median'))}, any_value(unknown) AS unknown
   FROM (SELECT * FROM ({s}) AS a_ JOIN (SELECT {kk}, flag, count(DISTINCT session_no) AS days FROM ({src}) AS d_ WHERE flag IS NOT NULL AND completed GROUP BY {kk}, flag) AS b_ USING ({kk}, flag)
     JOIN (SELECT {kk}, count(*) FILTER (WHERE flag IS NULL) AS unknown FROM ({src}) AS u_ GROUP BY {kk}) AS c_ USING ({kk})) AS m_ GROUP BY {kk}) AS p_"""


CR = "criterion yes_evaluated no_evaluated yes_success_rate no_success_rate yes_median no_median difference low high enough direction unknown".split()
CR_F = "yes_success_rate no_success_rate yes_median no_median difference low high"
query("criterion_report", k.cols(crit_sql("SELECT * FROM okl", "horizon"), "horizon", *CR), f=CR_F)(
    lambda s, d: rp.criterion_report(ok(s, d), list(FLAGS), ["horizon"]).select("horizon", *CR))

query("outcome_stats", k.cols(k.outcome_stats("SELECT * FROM ex", "horizon"), "horizon", *k.STATS), f=k.STATS_F)(
    lambda s, d: st.outcome_stats(examples(s, d), ["horizon"]).select("horizon", *k.STATS))

BAND = "CASE WHEN {0} IS NULL OR {0}<0 OR {0}>100 THEN NULL WHEN {0}<50 THEN '0-49' WHEN {0}>=90 THEN '90-100' ELSE CAST(CAST(floor({0}/10)*10 AS BIGINT) AS VARCHAR)||'-'||CAST(CAST(floor({0}/10)*10+9 AS BIGINT) AS VARCHAR) END"
BUCKETS = {
    "RSI": "CASE WHEN rsi<30 THEN '<30' WHEN rsi<50 THEN '30-49' WHEN rsi<70 THEN '50-69' WHEN rsi<=100 THEN '70+' END",
    "VOLUME": "CASE WHEN volume_ratio<100 THEN '<100' WHEN volume_ratio<150 THEN '100-149' WHEN volume_ratio IS NOT NULL THEN '150+' END",
    "SMA_TREND": "CASE WHEN sma20>sma50 THEN 'ABOVE' WHEN sma50 IS NOT NULL THEN 'BELOW_OR_EQUAL' END", "OBV": "obv_trend",
    "MOMENTUM": "CASE WHEN momentum3>0 THEN 'POSITIVE' WHEN momentum3 IS NOT NULL THEN 'NEGATIVE_OR_ZERO' END", "CONFIDENCE": BAND.format("confidence"),
}
SIG = "CASE WHEN model='TOMORROW_TOP10' THEN 'TOMORROW_TOP10' ELSE decision END"
_pairs = [("'overall'", "'ALL'"), ("'signals'", SIG), ("'scores'", BAND.format("score"))] + [("'criteria'", f"'{n}:'||{e}") for n, e in BUCKETS.items()]
fragment("sperf_", f"""
 SELECT * FROM (SELECT *, unnest([{', '.join(a for a, _ in _pairs)}]) AS kind, unnest([{', '.join(b for _, b in _pairs)}]) AS name FROM
  (SELECT e.*, unnest(['7','30','90','ALL']) AS period, unnest([7,30,90,100000]) AS span_, last_no-session_no AS age_ FROM ex e CROSS JOIN lastno) AS p WHERE age_ BETWEEN 0 AND span_) AS q WHERE name IS NOT NULL""")
query("signal_performance", k.cols(k.outcome_stats("SELECT * FROM sperf_", "period, kind, name, horizon"), "period", "kind", "name", "horizon", *k.STATS), f=k.STATS_F)(
    lambda s, d: rp.signal_performance(examples(s, d), last_session(fx.weekly_bars(s, d))).select("period", "kind", "name", "horizon", *k.STATS))

SIDE = lambda a, b: f"CASE WHEN {a}>{b} THEN 'ABOVE' WHEN {a}<{b} THEN 'BELOW' WHEN {a}={b} THEN 'EQUAL' END"
YN = lambda a: f"CASE WHEN {a} THEN 'YES' WHEN NOT {a} THEN 'NO' END"
CONF = lambda c: f"CASE WHEN {c} THEN 'CONFIRMED' WHEN NOT ({c}) THEN 'NOT_CONFIRMED' END"
KNOWN = lambda c, *n: f"CASE WHEN {' AND '.join(x + ' IS NOT NULL' for x in n)} THEN CASE WHEN {c} THEN 'CONFIRMED' ELSE 'NOT_CONFIRMED' END END"
CONDS = {
    "RSI": "CASE WHEN rsi<30 THEN '0-29' WHEN rsi<40 THEN '30-39' WHEN rsi<50 THEN '40-49' WHEN rsi<60 THEN '50-59' WHEN rsi<70 THEN '60-69' WHEN rsi<=100 THEN '70-100' END",
    "VOLUME": "CASE WHEN volume_ratio<80 THEN '<80' WHEN volume_ratio<120 THEN '80-119' WHEN volume_ratio<150 THEN '120-149' WHEN volume_ratio<200 THEN '150-199' WHEN volume_ratio IS NOT NULL THEN '200+' END",
    "PRICE_SMA20": SIDE("price", "sma20"), "PRICE_SMA50": SIDE("price", "sma50"), "SMA_TREND": SIDE("sma20", "sma50"), "VWAP": SIDE("price", "vwap20"),
    "OBV": "CASE obv_trend WHEN 'RISING' THEN 'POSITIVE' WHEN 'FALLING' THEN 'NEGATIVE' WHEN 'FLAT' THEN 'NEUTRAL' END", "BOLLINGER": "bb_zone",
    "BOLL_SQUEEZE": YN("bb_squeeze"), "BOLL_BREAKOUT": YN("bb_upper_break"), "ATR": "CASE WHEN 100*atr14/price<2 THEN '<2%' WHEN 100*atr14/price<4 THEN '2-4%' WHEN atr14 IS NOT NULL THEN '4%+' END",
    "MOMENTUM": "CASE WHEN momentum3>0 THEN 'POSITIVE' WHEN momentum3<0 THEN 'NEGATIVE' WHEN momentum3=0 THEN 'ZERO' END",
    "COMBO_RSI_VOLUME": KNOWN("rsi>=30 AND rsi<70 AND volume_ratio>=150", "rsi", "volume_ratio"), "COMBO_VWAP_OBV": KNOWN("price>vwap20 AND obv_trend='RISING'", "vwap20", "obv_trend"),
    "COMBO_TREND_VOLUME": KNOWN("sma20>sma50 AND volume_ratio>=150", "sma50", "volume_ratio"),
}


def conds_sql(src):
    return f"SELECT * FROM (SELECT *, unnest([{', '.join(repr(n) for n in CONDS)}]) AS indicator, unnest([{', '.join(CONDS.values())}]) AS condition FROM {src}) AS c_ WHERE condition IS NOT NULL"


query("signal_conditions", f"SELECT signal_id, indicator, condition FROM ({conds_sql('preds')}) AS q")(
    lambda s, d: rp.long_labels(predictions(s, d), rp.signal_conditions(), ["signal_id"]))
_bl = ", ".join(f"{e} AS {n.lower()}_bucket" for n, e in BUCKETS.items())
query("buckets", f"SELECT signal_id, {_bl} FROM preds")(
    lambda s, d: predictions(s, d).select("signal_id", *[c.alias(f"{n.lower()}_bucket") for n, c in rp.buckets().items()]))
query("score_band", f"SELECT signal_id, {BAND.format('score')} AS band FROM preds")(
    lambda s, d: predictions(s, d).select("signal_id", rp.score_band(F.col("score")).alias("band")))
query("indicator_condition_performance", k.cols(k.outcome_stats(f"SELECT *, unnest(['ALL', {SIG}]) AS signal_type FROM ({conds_sql('ex')}) AS u_", "indicator, condition, signal_type, horizon"),
      "indicator", "condition", "signal_type", "horizon", *k.STATS), f=k.STATS_F)(
    lambda s, d: rp.indicator_condition_performance(examples(s, d)).select("indicator", "condition", "signal_type", "horizon", *k.STATS))

query("evidence_stats", k.cols(k.evidence("SELECT * FROM okx", "horizon, regime"), "horizon", "regime", *k.EV), f=k.EV_F)(
    lambda s, d: st.evidence_stats(ok(s, d), ["horizon", "regime"]).select("horizon", "regime", *k.EV))
query("suppressed_stats", k.cols(k.suppressed(k.evidence("SELECT * FROM okx", "horizon, symbol, model")), "horizon", "symbol", "model", *k.EV), f=k.EV_F)(
    lambda s, d: st.suppress(st.evidence_stats(ok(s, d), ["horizon", "symbol", "model"])).select("horizon", "symbol", "model", *k.EV))


def ev_report_sql(src, keys, crit="criterion", minimum=40, days=5):
    kk = f"{keys}, {crit}"
    return f"""SELECT *, yes_success_rate-no_success_rate AS difference, yes_success_low-no_success_high AS low, yes_success_high-no_success_low AS high, coalesce(yes_sufficient AND no_sufficient,false) AS enough,
  CASE WHEN yes_sufficient AND no_sufficient AND yes_success_low-no_success_high>0 AND yes_median>no_median+0.25 THEN 'UP' WHEN yes_sufficient AND no_sufficient AND yes_success_high-no_success_low<0 AND yes_median<no_median-0.25 THEN 'DOWN' ELSE 'SAME' END AS direction
 FROM (SELECT {kk}, {', '.join(f'max({c}) FILTER (WHERE flag) AS yes_{c}, max({c}) FILTER (WHERE NOT flag) AS no_{c}' for c in ('sample','days','success_rate','success_low','success_high','median'))},
  bool_or(sufficient) FILTER (WHERE flag) AS yes_sufficient, bool_or(sufficient) FILTER (WHERE NOT flag) AS no_sufficient
  FROM ({k.evidence(f"SELECT * FROM ({src}) AS f_ WHERE flag IS NOT NULL", kk + ", flag", minimum, days)}) AS e_ GROUP BY {kk}) AS p_"""


ER = "criterion yes_sample no_sample yes_success_rate no_success_rate yes_median no_median difference low high enough direction".split()
query("evidence_report", k.cols(ev_report_sql("SELECT * FROM okl", "horizon"), "horizon", *ER), f=CR_F)(
    lambda s, d: rp.evidence_report(ok(s, d), list(FLAGS), ["horizon"]).select("horizon", *ER))
query("scoped_calibration", k.cols(crit_sql("SELECT * FROM okl", "sector, regime, horizon"), "sector", "regime", "horizon", *CR), f=CR_F)(
    lambda s, d: rp.criterion_report(ok(s, d), list(FLAGS), ["sector", "regime", "horizon"]).select("sector", "regime", "horizon", *CR))
query("approved_adjustments", f"SELECT horizon, criterion, CASE direction WHEN 'UP' THEN 0.0025 WHEN 'DOWN' THEN -0.0025 ELSE 0.0 END::DOUBLE AS adjustment FROM ({crit_sql('SELECT * FROM okl', 'horizon')}) AS q WHERE enough", f="adjustment")(
    lambda s, d: rp.criterion_report(ok(s, d), list(FLAGS), ["horizon"]).filter("enough").select(
        "horizon", "criterion", first_match((F.col("direction") == "UP", 0.0025), (F.col("direction") == "DOWN", -0.0025), default=0.0).alias("adjustment")))
query("weight_votes", f"""
 SELECT criterion, count(*) FILTER (WHERE direction='UP') AS ups, count(*) FILTER (WHERE direction='DOWN') AS downs,
  CASE WHEN count(*) FILTER (WHERE direction='UP')>=2 AND count(*) FILTER (WHERE direction='DOWN')=0 THEN 'UP' WHEN count(*) FILTER (WHERE direction='DOWN')>=2 AND count(*) FILTER (WHERE direction='UP')=0 THEN 'DOWN' ELSE 'NONE' END AS agreed,
  coalesce(0.0025*avg(CASE direction WHEN 'UP' THEN 1 WHEN 'DOWN' THEN -1 END),0) AS shift FROM ({crit_sql('SELECT * FROM okl', 'horizon')}) AS q GROUP BY criterion""", f="shift")(lambda s, d: _votes(s, d))


def _votes(s, d):
    r = rp.criterion_report(ok(s, d), list(FLAGS), ["horizon"])
    up, dn = st.count_if(F.col("direction") == "UP"), st.count_if(F.col("direction") == "DOWN")
    return r.groupBy("criterion").agg(up.alias("ups"), dn.alias("downs"),
        first_match(((up >= 2) & (dn == 0), "UP"), ((dn >= 2) & (up == 0), "DOWN"), default="NONE").alias("agreed"),
        F.coalesce(0.0025 * F.avg(first_match((F.col("direction") == "UP", 1.0), (F.col("direction") == "DOWN", -1.0), default=None)), F.lit(0.0)).alias("shift"))


_cmb = rp.combos(FAMILY)
_bits = {f: 1 << i for i, f in enumerate(FAMILY)}
_cv = ", ".join(f"('{'+'.join(c)}', {len(c)}, {sum(_bits[x] for x in c)})" for c in _cmb)
_mask = "+".join(f"CASE WHEN {f} IS NULL THEN 0 ELSE {b} END" for f, b in _bits.items())
query("combination_catalog", f"""
 WITH cov AS (SELECT c.combo, c.size, count(*) AS coverage FROM (SELECT {_mask} AS m FROM okx WHERE horizon=1) r JOIN (VALUES {_cv}) AS c(combo,size,need) ON (r.m & c.need)=c.need GROUP BY c.combo, c.size),
 rk AS (SELECT *, row_number() OVER (PARTITION BY size ORDER BY coverage DESC, combo) AS rank FROM cov)
 SELECT combo, size, coverage, rank FROM rk WHERE (size=3 AND rank<=16) OR (size=2 AND rank<=64-(SELECT least(count(*),16) FROM rk WHERE size=3))""")(
    lambda s, d: rp.combination_catalog(ok(s, d).filter("horizon = 1"), FAMILY).select("combo", "size", "coverage", "rank"))

_cn = ", ".join("'" + "+".join(c) + "'" for c in _cmb)
_cf = ", ".join("CASE WHEN " + " AND ".join(f"{x} IS NOT NULL" for x in c) + " THEN " + " AND ".join(c) + " END" for c in _cmb)
query("combination_report", f"""
 SELECT horizon, criterion, yes_sample, no_sample, yes_median, no_median, enough, CASE direction WHEN 'UP' THEN 0.25 WHEN 'DOWN' THEN -0.25 ELSE 0.0 END::DOUBLE AS contribution
 FROM ({ev_report_sql(f"SELECT *, unnest([{_cn}]) AS criterion, unnest([{_cf}]) AS flag FROM okx", "horizon", minimum=50, days=7)}) AS q""", f="yes_median no_median contribution")(
    lambda s, d: rp.combination_report(ok(s, d), FAMILY, ["horizon"]).select("horizon", "criterion", "yes_sample", "no_sample", "yes_median", "no_median", "enough", "contribution"))

query("error_rates", """
 SELECT horizon, regime, count(*) AS sample, count(*) FILTER (WHERE status IN ('STOP','FAIL')) AS failures, count(DISTINCT session_no) AS days,
  CASE WHEN count(*)>=40 AND count(DISTINCT session_no)>=5 THEN count(*) FILTER (WHERE status IN ('STOP','FAIL'))::DOUBLE/count(*) END AS error_rate,
  CASE WHEN count(*) FILTER (WHERE decision='BUY')>=40 AND count(DISTINCT session_no) FILTER (WHERE decision='BUY')>=5 THEN count(*) FILTER (WHERE decision='BUY' AND status IN ('STOP','FAIL'))::DOUBLE/count(*) FILTER (WHERE decision='BUY') END AS false_buy_rate,
  CASE WHEN count(*) FILTER (WHERE short)>=40 AND count(DISTINCT session_no) FILTER (WHERE short)>=5 THEN count(*) FILTER (WHERE short AND status IN ('STOP','FAIL'))::DOUBLE/count(*) FILTER (WHERE short) END AS false_sell_rate
 FROM okx GROUP BY horizon, regime""", f="error_rate false_buy_rate false_sell_rate")(lambda s, d: rp.error_rates(ok(s, d), ["horizon", "regime"]))

LQ = {"mfe": "mfe", "mae": "mae", "mfe_before_stop": "mfe_before_stop", "mae_before_target": "mae_before_target", "approach_ratio": "approach_ratio", "stop_atr": "abs(price-stop)/atr14", "target_atr": "abs(target-price)/atr14"}
query("level_quality", f"""
 SELECT horizon, metric, count(v) AS n, median(v) AS median, avg(CASE WHEN metric='stop_atr' THEN CASE WHEN v<0.75 THEN 1.0 ELSE 0 END WHEN metric='target_atr' THEN CASE WHEN v>4 AND NOT target_hit THEN 1.0 ELSE 0 END END) AS bad_rate
 FROM (SELECT horizon, target_hit, unnest([{', '.join(repr(x) for x in LQ)}]) AS metric, unnest([{', '.join(LQ.values())}]) AS v FROM okx) AS q WHERE v IS NOT NULL GROUP BY horizon, metric""", f="median bad_rate")(lambda s, d: _level_quality(s, d))


def _level_quality(s, d):
    e = ok(s, d).withColumns({"stop_atr": ratio(F.abs(F.col("price") - F.col("stop")), F.col("atr14")), "target_atr": ratio(F.abs(F.col("target") - F.col("price")), F.col("atr14"))})
    items = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("v")) for n in LQ])
    x = e.select("horizon", "target_hit", F.explode(items).alias("i")).select("horizon", "target_hit", "i.*").filter("v IS NOT NULL")
    bad = first_match((F.col("metric") == "stop_atr", F.when(F.col("v") < 0.75, 1.0).otherwise(0.0)),
                      (F.col("metric") == "target_atr", F.when((F.col("v") > 4) & ~F.col("target_hit"), 1.0).otherwise(0.0)), default=None)
    g = x.groupBy("horizon", "metric").agg(F.avg(bad).alias("bad_rate"))
    return g.join(robust(x, ["horizon", "metric"], "v"), ["horizon", "metric"]).select("horizon", "metric", "n", "median", "bad_rate")


CB = "CASE WHEN confidence<50 THEN '0-49' WHEN confidence<60 THEN '50-60' WHEN confidence<70 THEN '60-70' WHEN confidence<80 THEN '70-80' WHEN confidence IS NOT NULL THEN '80+' END"
_cal = k.evidence(f"SELECT *, {CB} AS band FROM okx WHERE confidence IS NOT NULL", "horizon, band")
query("calibration_report", f"""
 WITH b AS ({_cal}), o AS (SELECT *, lag(success_rate) OVER w AS lr, lag(success_low) OVER w AS ll, lag(band) OVER w AS lb FROM b WHERE sufficient WINDOW w AS (PARTITION BY horizon ORDER BY band))
 SELECT b.horizon, b.band, b.sample, b.success_rate, b.median, b.sufficient, coalesce(o.success_rate<=o.lr,false) AS no_improvement, coalesce(o.success_rate<=o.lr AND o.success_high<o.ll,false) AS clear FROM b LEFT JOIN o ON b.horizon=o.horizon AND b.band=o.band""", f="success_rate median")(lambda s, d: _calib(s, d))


def _calib(s, d):
    b = st.evidence_stats(ok(s, d).withColumn("band", rp.confidence_band()).filter("band IS NOT NULL"), ["horizon", "band"])
    w = W.partitionBy("horizon", "sufficient").orderBy("band")  # at most five bands
    p = b.withColumns({"lr": F.lag("success_rate").over(w), "ll": F.lag("success_low").over(w)})
    worse = F.coalesce(F.col("sufficient") & (F.col("success_rate") <= F.col("lr")), F.lit(False))
    return p.select("horizon", "band", "sample", "success_rate", "median", "sufficient", worse.alias("no_improvement"), F.coalesce(worse & (F.col("success_high") < F.col("ll")), F.lit(False)).alias("clear"))


query("algorithm_health", f"""
 WITH e AS (SELECT * FROM okx WHERE horizon=1 AND model NOT IN ('NEWS','MACRO')), m AS ({k.evidence('SELECT * FROM e', '')}),
 o AS (SELECT avg(CASE WHEN status='INSUFFICIENT' THEN 1.0 ELSE 0 END) AS missing_rate, avg(CASE WHEN feature_at>signal_at THEN 1.0 ELSE 0 END) AS stale_rate FROM ex WHERE horizon=1 AND model NOT IN ('NEWS','MACRO')),
 c AS ({k.evidence("SELECT *, CASE WHEN last_no-session_no<20 THEN 'RECENT' WHEN last_no-session_no<80 THEN 'PREVIOUS' END AS part FROM e CROSS JOIN lastno WHERE last_no-session_no<80", "part")}),
 r AS (SELECT max(success_high) FILTER (WHERE part='RECENT') AS rh, max(success_low) FILTER (WHERE part='PREVIOUS') AS pl, max(median) FILTER (WHERE part='RECENT') AS rm, max(median) FILTER (WHERE part='PREVIOUS') AS pm, bool_and(sufficient) AS both_ok FROM c)
 SELECT sample, success_rate, stop_hit_rate, target_hit_rate, missing_rate, stale_rate, coalesce(both_ok AND rh<pl AND rm<pm-0.25,false) AS drift,
  100*(0.4*success_rate+0.2*(1-stop_hit_rate)+0.15*target_hit_rate+0.15*(1-missing_rate)+0.1*(1-stale_rate))-CASE WHEN coalesce(both_ok AND rh<pl AND rm<pm-0.25,false) THEN 15 ELSE 0 END AS health_score FROM m CROSS JOIN o CROSS JOIN r""",
      f="success_rate stop_hit_rate target_hit_rate missing_rate stale_rate health_score")(lambda s, d: _health(s, d))


def _health(s, d):
    live = (F.col("horizon") == 1) & ~F.col("model").isin("NEWS", "MACRO")
    e = ok(s, d).filter(live)
    m = st.evidence_stats(e, [])
    o = examples(s, d).filter(live).agg(F.avg(F.when(F.col("status") == "INSUFFICIENT", 1.0).otherwise(0.0)).alias("missing_rate"),
                                        F.avg(F.when(F.col("feature_at") > F.col("signal_at"), 1.0).otherwise(0.0)).alias("stale_rate"))
    age = F.col("last_no") - F.col("session_no")
    p = e.crossJoin(last_session(fx.weekly_bars(s, d))).filter(age < 80).withColumn("part", F.when(age < 20, "RECENT").otherwise("PREVIOUS"))
    c = st.evidence_stats(p, ["part"])
    pick = lambda c_, v: F.max(F.when(F.col("part") == v, F.col(c_)))
    r = c.agg(pick("success_high", "RECENT").alias("rh"), pick("success_low", "PREVIOUS").alias("pl"), pick("median", "RECENT").alias("rm"), pick("median", "PREVIOUS").alias("pm"), F.bool_and("sufficient").alias("both"))
    x = m.crossJoin(o).crossJoin(r)
    drift = F.coalesce(F.col("both") & (F.col("rh") < F.col("pl")) & (F.col("rm") < F.col("pm") - 0.25), F.lit(False))
    score = 100 * (0.4 * F.col("success_rate") + 0.2 * (1 - F.col("stop_hit_rate")) + 0.15 * F.col("target_hit_rate") + 0.15 * (1 - F.col("missing_rate")) + 0.1 * (1 - F.col("stale_rate")))
    return x.select("sample", "success_rate", "stop_hit_rate", "target_hit_rate", "missing_rate", "stale_rate", drift.alias("drift"), (score - F.when(drift, 15).otherwise(0)).alias("health_score"))


query("decision_report", f"""
 SELECT kind, name, horizon, sample, success_rate, median FROM ({k.evidence(f"SELECT *, unnest(['decision','confidence']) AS kind, unnest([decision, {CB}]) AS name FROM okx", "kind, name, horizon")}) AS q WHERE name IS NOT NULL""", f="success_rate median")(
    lambda s, d: st.evidence_stats(rp.long_labels(ok(s, d), {"decision": F.col("decision"), "confidence": rp.confidence_band()},
        ["horizon", "session_no", "status", "directional_return", "target_hit", "stop_hit", "decision", "max_rise", "max_drop"], "kind", "name"), ["kind", "name", "horizon"])
    .select("kind", "name", "horizon", "sample", "success_rate", "median"))

query("technical_criteria_report", k.cols(crit_sql("SELECT *, unnest(['BAND_INSIDE','OBV_RISING','MOMENTUM_UP']) AS criterion, unnest([f_bollinger,f_obv,f_momentum]) AS flag FROM okx WHERE model='TOMORROW_TOP10'", "horizon"), "horizon", *CR), f=CR_F)(
    lambda s, d: rp.criterion_report(ok(s, d).filter("model = 'TOMORROW_TOP10'"), {"BAND_INSIDE": F.col("f_bollinger"), "OBV_RISING": F.col("f_obv"), "MOMENTUM_UP": F.col("f_momentum")}, ["horizon"]).select("horizon", *CR))

query("learned_key_weights", f"""
 SELECT decision, key, n, wins, CASE WHEN n>=30 THEN greatest(-15,least(15,(wins*100.0/n-50)*0.3)) ELSE 0 END AS weight FROM (SELECT decision, indicator||':'||condition AS key, count(*) AS n, count(*) FILTER (WHERE status='SUCCESS') AS wins
 FROM ({conds_sql('okx')}) AS c WHERE horizon=1 GROUP BY decision, indicator, condition) AS q""", f="weight")(
    lambda s, d: rp.long_labels(ok(s, d).filter("horizon = 1"), rp.signal_conditions(), ["decision", "status"]).groupBy("decision", F.concat_ws(":", "indicator", "condition").alias("key"))
    .agg(F.count(F.lit(1)).alias("n"), st.count_if(F.col("status") == "SUCCESS").alias("wins"))
    .withColumn("weight", F.when(F.col("n") >= 30, F.greatest(F.lit(-15.0), F.least(F.lit(15.0), (F.col("wins") * 100.0 / F.col("n") - 50) * 0.3))).otherwise(0.0)))

query("learning_summary", """
 SELECT coalesce(model,'*') AS model, coalesce(decision,'*') AS decision, coalesce(status,'*') AS status, count(*) AS n, 100.0*count(*) FILTER (WHERE status='SUCCESS')/count(*) AS success_pct
 FROM ex WHERE horizon=1 GROUP BY GROUPING SETS ((model),(decision),(status),())""", f="success_pct")(lambda s, d: _learning(s, d))


def _learning(s, d):
    # Four small groupings from one pre-aggregated pass.
    base = examples(s, d).filter("horizon = 1").groupBy("model", "decision", "status").agg(F.count(F.lit(1)).alias("c"))
    g = base.groupingSets([[F.col("model")], [F.col("decision")], [F.col("status")], []], "model", "decision", "status").agg(
        F.sum("c").alias("n"), (100.0 * F.sum(F.when(F.col("status") == "SUCCESS", F.col("c")).otherwise(0)) / F.sum("c")).alias("success_pct"))
    return g.select(*[F.coalesce(c, F.lit("*")).alias(c) for c in ("model", "decision", "status")], "n", "success_pct")


query("model_breakdowns", f"""
 SELECT 'model' AS field, model AS value, horizon, evaluated, success_rate, median FROM ({k.summary('SELECT * FROM ex', 'model, horizon')}) UNION ALL
 SELECT 'sector', sector, horizon, evaluated, success_rate, median FROM ({k.summary('SELECT * FROM ex', 'sector, horizon')}) UNION ALL
 SELECT 'regime', regime, horizon, evaluated, success_rate, median FROM ({k.summary('SELECT * FROM ex', 'regime, horizon')}) UNION ALL
 SELECT 'source', source, horizon, evaluated, success_rate, median FROM ({k.summary('SELECT * FROM ex', 'source, horizon')})""", f="success_rate median")(
    lambda s, d: st.summarize(rp.long_labels(examples(s, d).withColumn("m_", F.col("model")), {c: F.col(c) for c in ("model", "sector", "regime", "source")},
        ["horizon", "completed", "return_pct", "status", "target_hit", "stop_hit", "decision", "m_"], "field", "value").withColumnRenamed("m_", "model"), ["field", "value", "horizon"])
    .select("field", "value", "horizon", "evaluated", "success_rate", "median"))

query("scope_and_bucket_reports", f"SELECT kind, name, horizon, sample, success_rate, median, sufficient FROM ({k.evidence(f'''SELECT *, unnest(['regime','sector','decision_band']) AS kind, unnest([regime, sector, decision||'/'||coalesce({CB},'?')]) AS name FROM okx''', 'kind, name, horizon')}) AS q", f="success_rate median")(
    lambda s, d: st.evidence_stats(rp.long_labels(ok(s, d), {"regime": F.col("regime"), "sector": F.col("sector"), "decision_band": F.concat_ws("/", "decision", F.coalesce(rp.confidence_band(), F.lit("?")))},
        ["horizon", "session_no", "status", "directional_return", "target_hit", "stop_hit", "decision", "max_rise", "max_drop"], "kind", "name"), ["kind", "name", "horizon"])
    .select("kind", "name", "horizon", "sample", "success_rate", "median", "sufficient"))

query("last20_summary", f"""
 WITH c AS (SELECT session_no FROM ex WHERE horizon=1 AND rank<=10 GROUP BY session_no HAVING bool_and(completed)), l AS (SELECT session_no FROM c ORDER BY session_no DESC LIMIT 20),
 d AS (SELECT session_no, avg(return_pct) FILTER (WHERE rank<=3) AS top3, avg(return_pct) AS top10, CASE WHEN count(score)>=3 THEN corr(score, return_pct) END AS cr FROM ex WHERE horizon=1 AND rank<=10 AND session_no IN (SELECT session_no FROM l) GROUP BY session_no)
 SELECT count(*) AS lists, avg(top3) AS top3_mean, median(top3) AS top3_median, avg(top10) AS top10_mean, median(top10) AS top10_median, avg(cr) AS corr_mean FROM d""", f="top3_mean top3_median top10_mean top10_median corr_mean")(lambda s, d: _last20(s, d))


def _last20(s, d):
    e = examples(s, d).filter("horizon = 1 AND rank <= 10")
    day = e.groupBy("session_no").agg(F.bool_and("completed").alias("whole"), F.avg(F.when(F.col("rank") <= 3, F.col("return_pct"))).alias("top3"),
                                      F.avg("return_pct").alias("top10"), st.corr_guarded("score", "return_pct").alias("cr"))
    last = day.filter("whole").orderBy(F.desc("session_no")).limit(20)  # the feature is the last twenty sessions
    return last.agg(F.count(F.lit(1)).alias("lists"), F.avg("top3").alias("top3_mean"), F.median("top3").alias("top3_median"), F.avg("top10").alias("top10_mean"),
                    F.median("top10").alias("top10_median"), F.avg("cr").alias("corr_mean"))


# Indicator evidence: one family per model, per direction and horizon.
_IST = lambda src, keys: f"""SELECT g_.*, r_.median, wins::DOUBLE/nullif(eligible,0) AS success_rate, least(100,100.0*eligible/(eligible+100))*eligible/sample*(0.75+0.25*coalesce(full_,0)) AS confidence,
  CASE WHEN eligible>=300 THEN 'STRONG_SAMPLE' WHEN eligible>=100 THEN 'USABLE' WHEN eligible>=30 THEN 'EARLY' ELSE 'INSUFFICIENT' END AS data_status
 FROM (SELECT {keys}, count(*) AS sample, count(*) FILTER (WHERE reason IS NULL) AS eligible, count(*) FILTER (WHERE reason IS NULL AND directional_return>0) AS wins, avg(directional_return) FILTER (WHERE reason IS NULL) AS avg_return,
  avg(greatest(-10,least(10,directional_return))) FILTER (WHERE reason IS NULL) AS clipped, avg(CASE WHEN mfe IS NOT NULL AND mae IS NOT NULL THEN 1.0 ELSE 0 END) FILTER (WHERE reason IS NULL) AS full_ FROM ({src}) AS q_ GROUP BY {keys}) AS g_
 LEFT JOIN ({k.robust(f"SELECT * FROM ({src}) AS w_ WHERE reason IS NULL", keys, 'directional_return')}) AS r_ USING ({keys})"""  # noqa: E731
fragment("inde", "SELECT *, unnest(['f_rsi','f_trend','f_volume','f_momentum','f_obv','f_bollinger']) AS indicator, unnest([f_rsi,f_trend,f_volume,f_momentum,f_obv,f_bollinger]) AS active FROM ex WHERE reason IS NULL OR reason='PENDING'")
IK = ["signal_family", "decision", "horizon"]


def _ind_rows(s, d):
    e = examples(s, d).filter("reason IS NULL OR reason = 'PENDING'").withColumn("signal_family", F.col("model"))
    return st.long_flags(e, list(FLAGS), [*IK, "regime", "session_no", *rp.KEEP[1:]]).withColumnsRenamed({"criterion": "indicator", "flag": "active"})


query("indicator_evidence", f"""
 SELECT scope, value, indicator, active, decision, horizon, sample, eligible, wins, success_rate, avg_return, clipped, median, confidence, data_status FROM ({_IST("SELECT *, unnest(['ALL','REGIME']) AS scope, unnest(['ALL',regime]) AS value FROM inde WHERE active IS NOT NULL", "scope, value, indicator, active, decision, horizon")}) AS q""",
      f="success_rate avg_return clipped median confidence")(lambda s, d: rp.indicator_stats(
    _ind_rows(s, d).filter("active IS NOT NULL").withColumn("_s", F.explode(F.array(F.struct(F.lit("ALL").alias("scope"), F.lit("ALL").alias("value")), F.struct(F.lit("REGIME").alias("scope"), F.col("regime").alias("value")))))
    .withColumns({"scope": F.col("_s.scope"), "value": F.col("_s.value")}), ["scope", "value", "indicator", "active", "decision", "horizon"])
    .select("scope", "value", "indicator", "active", "decision", "horizon", "sample", "eligible", "wins", "success_rate", "avg_return", "clipped", "median", "confidence", "data_status"))

_EFF = "(0.6*(a.success_rate-b.success_rate)+0.25*(a.clipped-b.clipped)/20+0.15*(greatest(-10,least(10,a.median))-greatest(-10,least(10,b.median)))/20)"
query("indicator_weight_candidate", f"""
 WITH t AS ({_IST("SELECT * FROM inde WHERE active IS NOT NULL", "indicator, active, decision, horizon")}),
 c AS (SELECT a.indicator, a.decision, a.horizon, a.eligible AS n, b.eligible AS m, greatest(-1,least(1,{_EFF}*(a.eligible/(a.eligible+100.0))*(b.eligible/(b.eligible+100.0))*least(a.confidence,b.confidence)/100*(0.5+0.5*least(1,abs(a.median)/greatest(1,abs(a.clipped)))))) AS cand
   FROM t a JOIN t b ON a.indicator=b.indicator AND a.decision=b.decision AND a.horizon=b.horizon WHERE a.active AND NOT b.active AND a.eligible>=30 AND b.eligible>=30)
 SELECT indicator, decision, horizon, n, m, cand*CASE WHEN count(DISTINCT sign(cand)) OVER w>1 THEN 0.5 ELSE 1 END*CASE WHEN count(*) OVER w<2 THEN 0.5 ELSE 1 END AS weight, CASE WHEN least(n,m)>=100 THEN 'CANDIDATE' ELSE 'EARLY' END AS weight_status
 FROM c WINDOW w AS (PARTITION BY indicator, decision)""", f="weight")(lambda s, d: _weights(s, d))


def _weights(s, d):
    t = rp.indicator_stats(_ind_rows(s, d).filter("active IS NOT NULL"), ["indicator", "active", "decision", "horizon"])
    vals = ["eligible", "success_rate", "clipped", "median", "confidence"]
    p = t.groupBy("indicator", "decision", "horizon").agg(*[F.max(F.when(F.col("active") == v, F.col(c))).alias(f"{n}_{c}") for n, v in (("a", True), ("b", False)) for c in vals])
    p = p.filter("a_eligible >= 30 AND b_eligible >= 30")
    n, m = F.col("a_eligible"), F.col("b_eligible")
    quality = F.least(F.lit(1.0), F.abs("a_median") / F.greatest(F.lit(1.0), F.abs("a_clipped")))
    raw = rp.candidate_effect("a_", "b_") * (n / (n + 100)) * (m / (m + 100)) * F.least("a_confidence", "b_confidence") / 100 * (0.5 + 0.5 * quality)
    p = p.withColumn("cand", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)))
    w = W.partitionBy("indicator", "decision")  # at most one row per horizon
    signs = F.size(F.collect_set(F.signum("cand")).over(w))
    return p.select("indicator", "decision", "horizon", n.alias("n"), m.alias("m"),
                    (F.col("cand") * F.when(signs > 1, 0.5).otherwise(1.0) * F.when(F.count(F.lit(1)).over(w) < 2, 0.5).otherwise(1.0)).alias("weight"),
                    F.when(F.least(n, m) >= 100, "CANDIDATE").otherwise("EARLY").alias("weight_status"))


_FIVE = (("f_rsi", "f_momentum"), ("f_momentum", "f_volume"), ("f_trend", "f_obv"), ("f_rsi", "f_bollinger"), ("f_trend", "f_volume"))
query("indicator_combos", f"""
 SELECT combo, decision, horizon, eligible, success_rate, median FROM ({_IST(f"SELECT *, unnest([{', '.join(repr('+'.join(c)) for c in _FIVE)}]) AS combo, unnest([{', '.join(' AND '.join(c) for c in _FIVE)}]) AS hit FROM ex WHERE reason IS NULL OR reason='PENDING'", "combo, hit, decision, horizon")}) AS q WHERE hit AND eligible>=30""", f="success_rate median")(
    lambda s, d: rp.indicator_stats(st.long_flags(examples(s, d).filter("reason IS NULL OR reason = 'PENDING'"), {"+".join(c): F.col(c[0]) & F.col(c[1]) for c in _FIVE}, ["decision", "horizon", *rp.KEEP[1:]])
    .filter("flag").withColumnRenamed("criterion", "combo"), ["combo", "decision", "horizon"]).filter("eligible >= 30").select("combo", "decision", "horizon", "eligible", "success_rate", "median"))

query("export_examples", "SELECT signal_id, symbol, horizon, decision, rsi, volume_ratio, sma20, return_pct, directional_return, mfe, mae FROM ex WHERE reason IS NULL", f="rsi volume_ratio sma20 return_pct directional_return mfe mae")(
    lambda s, d: examples(s, d).filter("reason IS NULL").select("signal_id", "symbol", "horizon", "decision", "rsi", "volume_ratio", "sma20", "return_pct", "directional_return", "mfe", "mae"))
query("evidence_gate", "SELECT signal_id, horizon, due_no FROM okx CROSS JOIN lastno WHERE due_no<=last_no-10 AND first_touch IS DISTINCT FROM 'AMBIGUOUS' AND feature_at<=signal_at")(
    lambda s, d: ok(s, d).crossJoin(last_session(fx.weekly_bars(s, d))).filter("due_no <= last_no - 10 AND NOT (first_touch <=> 'AMBIGUOUS') AND feature_at <= signal_at").select("signal_id", "horizon", "due_no"))
query("first_signal_per_day", """
 SELECT signal_id, model, sector, session_no FROM (SELECT *, row_number() OVER (PARTITION BY sector, session_no, model ORDER BY signal_at, signal_id) AS rn FROM preds) AS q WHERE rn=1""")(
    lambda s, d: predictions(s, d).groupBy("sector", "session_no", "model").agg(F.min_by("signal_id", F.struct("signal_at", "signal_id")).alias("signal_id")).select("signal_id", "model", "sector", "session_no"))
query("last_n_sessions", "SELECT p.signal_id, n.n FROM preds p CROSS JOIN lastno CROSS JOIN (SELECT unnest([5,20,60]) AS n) n WHERE last_no-session_no<n.n")(
    lambda s, d: predictions(s, d).crossJoin(last_session(fx.weekly_bars(s, d))).select("signal_id", F.explode(F.array_compact(F.array(*[F.when(F.col("last_no") - F.col("session_no") < n, n) for n in (5, 20, 60)]))).alias("n")))
query("recent_n", "SELECT signal_id, sector, rk FROM (SELECT signal_id, sector, row_number() OVER (PARTITION BY sector ORDER BY session_no DESC, signal_id) AS rk FROM preds) AS q WHERE rk<=50")(
    lambda s, d: _recent(s, d))


def _recent(s, d):
    """Last 50 per sector in two steps: per (sector, session) first, so no task sees a whole sector."""
    p = predictions(s, d).select("signal_id", "sector", "session_no")
    w1 = W.partitionBy("sector", F.floor(F.col("session_no") / 64)).orderBy(F.desc("session_no"), "signal_id")
    p = p.withColumn("_r", F.row_number().over(w1)).filter("_r <= 50").drop("_r")
    return p.withColumn("rk", F.row_number().over(W.partitionBy("sector").orderBy(F.desc("session_no"), "signal_id"))).filter("rk <= 50").select("signal_id", "sector", "rk")
