"""Evidence look-up, resignal, opportunity and page extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigspark.functions import stats as st
from sigspark.functions.scalars import first_match
from sigspark.operators import learning as ln
from sigspark.operators import reports as rp
from sigspark.operators.scoring import bounded
from sigspark.plans import sqlkit as k
from sigspark.plans.learning import intraday_outcomes
from sigspark.plans.records_fixture import FLAGS, examples, frame, predictions
from sigspark.plans.registry import fragment, query
from sigspark.plans.reports import SIG, conds_sql, ok
from sigspark.operators.outcomes import DAILY_HORIZONS as HORIZONS
from sigspark.plans.streams import middle
from sigspark.sources import fixtures as fx
from sigspark.streaming import stateful as sf

# --- evidence with fallback -------------------------------------------------------------------
_ev = f"SELECT horizon, indicator, condition, signal_type, count(*) AS n, avg(CASE WHEN directional_return>0 THEN 1.0 ELSE 0 END) AS rate FROM (SELECT *, unnest(['ALL', {SIG}]) AS signal_type FROM ({conds_sql('ex')}) AS u_ WHERE reason IS NULL) AS q GROUP BY ALL HAVING count(*)>=30"
query("evidence_lookup_fallback", f"""
 WITH e AS ({_ev}), p AS (SELECT signal_id, {SIG} AS sig, indicator, condition, horizon FROM ({conds_sql('preds')}) AS c CROSS JOIN (SELECT unnest([{', '.join(map(str, HORIZONS))}]) AS horizon) AS z)
 SELECT p.signal_id, p.horizon, p.indicator, p.condition, coalesce(o.rate,a.rate) AS rate, CASE WHEN o.rate IS NOT NULL THEN 1.0 WHEN a.rate IS NOT NULL THEN 0.5 END::DOUBLE AS weight FROM p LEFT JOIN e o ON o.horizon=p.horizon AND o.indicator=p.indicator AND o.condition=p.condition AND o.signal_type=p.sig
 LEFT JOIN e a ON a.horizon=p.horizon AND a.indicator=p.indicator AND a.condition=p.condition AND a.signal_type='ALL'""", f="rate weight")(lambda s, d: _lookup(s, d))


def _lookup(s, d):
    x = rp.long_labels(examples(s, d).filter("reason IS NULL").withColumn("sig", rp.signal_name()), rp.signal_conditions(), ["sig", "horizon", "directional_return"])
    e = x.withColumn("signal_type", F.explode(F.array(F.lit("ALL"), F.col("sig")))).groupBy("horizon", "indicator", "condition", "signal_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("directional_return") > 0, 1.0).otherwise(0.0)).alias("rate")).filter("n >= 30")
    # Two look-ups folded into one small table keyed by horizon and condition.
    table = e.groupBy("horizon", "indicator", "condition").agg(F.map_from_entries(F.collect_list(F.struct("signal_type", "rate"))).alias("m"))  # a handful of signal types
    p = rp.long_labels(predictions(s, d).withColumn("sig", rp.signal_name()), rp.signal_conditions(), ["signal_id", "sig"])
    p = p.withColumn("horizon", F.explode(F.array(*map(F.lit, HORIZONS))))
    j = p.join(table, ["horizon", "indicator", "condition"], "left")
    own, every = F.try_element_at("m", F.col("sig")), F.try_element_at("m", F.lit("ALL"))
    return j.select("signal_id", "horizon", "indicator", "condition", F.coalesce(own, every).alias("rate"), first_match((own.isNotNull(), 1.0), (every.isNotNull(), 0.5), default=None).alias("weight"))


# --- resignal: keep an event only when it differs enough from the last kept one ----------------
fragment("mro_", "SELECT i.symbol, i.day, i.slot, i.price, i.decision, i.score, i.target, i.stop, row_number() OVER (PARTITION BY i.symbol, i.day ORDER BY i.slot) AS rn FROM isig i")
fragment("mrr_", """
 SELECT symbol, day, slot, price, decision, score, target, stop, rn, price AS lp, decision AS ld, score AS ls, target AS lt, stop AS lx, true AS kept FROM mro_ WHERE rn=1
 UNION ALL SELECT symbol, day, slot, price, decision, score, target, stop, rn, CASE WHEN k THEN price ELSE lp END, CASE WHEN k THEN decision ELSE ld END, CASE WHEN k THEN score ELSE ls END, CASE WHEN k THEN target ELSE lt END, CASE WHEN k THEN stop ELSE lx END, k
 FROM (SELECT o.*, r.lp, r.ld, r.ls, r.lt, r.lx, o.decision<>r.ld OR abs(o.price/r.lp-1)>=0.01 OR abs(o.score-r.ls)>=5 OR abs(o.target/r.lt-1)>=0.01 OR abs(o.stop/r.lx-1)>=0.01
  OR CASE r.ld WHEN 'BUY' THEN o.price>=r.lt OR o.price<=r.lx ELSE o.price<=r.lt OR o.price>=r.lx END AS k FROM mrr_ r JOIN mro_ o ON o.symbol=r.symbol AND o.day=r.day AND o.rn=r.rn+1) AS q""")
query("meaningful_resignal", "SELECT symbol, strftime(day+slot*INTERVAL 1 HOUR,'%Y-%m-%d %H:%M:%S') AS at, price, decision, score FROM mrr_ WHERE kept", f="price score")(lambda s, d: _resignal(s, d))


def _resignal(s, d):
    at = F.unix_micros(F.col("day").cast("timestamp")) + F.col("slot") * 3_600_000_000
    rows = intraday_outcomes(s, d).filter("horizon = '1H'").select("symbol", at.alias("at"), "price", "decision", "score", "target", "stop")
    job = sf.Job(s, "symbol string, at long, price double, decision string, score double, target double, stop double", lambda x: sf.keyed(x, "symbol", sf.Resignal()), {"kept": "true"})
    return sf.in_two_parts(job, rows, f"at < {middle(rows, 'at')}").read("kept").select("symbol", F.timestamp_micros("at").alias("at"), "price", "decision", "score")


# --- opportunity: early move, staying power, penalty -------------------------------------------
# Points of the three parts over the wide daily row.
EARLY = (("volume > prev_volume", 15), ("obv_break = 'UP'", 15), ("positive_turn", 15), ("acceleration > 0", 10), ("squeeze_break", 10))
STAY = (("volume_ratio_incl >= 100", 15), ("acceleration > 0", 10), ("obv_trend = 'RISING'", 10), ("sma20 > sma50", 10), ("room >= 3", 10), ("rsi >= 68", -15))
PENALTY = (("change_pct >= 5", 8), ("change_pct >= 6", 12), ("change_pct >= 7", 25), ("rsi >= 68", 15), ("room < 2", 10), ("momentum3 > 10", 10), ("volume < 0.8 * prev_volume", 10))


def points(rules):
    return " + ".join(f"(CASE WHEN {c} THEN {p} ELSE 0 END)" for c, p in rules)


query("opportunity_score", f"""
 WITH b AS (SELECT *, lag(volume) OVER (PARTITION BY symbol ORDER BY session_no) AS prev_volume, (resistance20/close-1)*100 AS room FROM ind), e AS (SELECT symbol, session_no, change_pct, atr_pct, least(100,20+{points(EARLY)}) AS early, greatest(0,least(100,25+{points(STAY)})) AS sustain, least(80,{points(PENALTY)}) AS penalty FROM b)
 SELECT symbol, session_no, early::DOUBLE AS early, sustain::DOUBLE AS sustain, penalty::DOUBLE AS penalty, greatest(10,least(90,25+0.3*sustain+0.25*early-penalty*0.5))::DOUBLE AS probability, CASE WHEN penalty>=25 OR coalesce(atr_pct,100)>5 THEN 'HIGH' WHEN sustain>=65 THEN 'LOW' ELSE 'MEDIUM' END AS risk,
  concat_ws('|', CASE WHEN change_pct>=7 THEN 'EXTENDED_MOVE_HARD_GATE' END, CASE WHEN change_pct<=-7 THEN 'HARD_FALL' END, CASE WHEN sustain<50 THEN 'QUALITY_THRESHOLD' END) AS blocks FROM e""", f="early sustain penalty probability")(lambda s, d: _opportunity(s, d))


def _opportunity(s, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("symbol").orderBy("session_no")
    x = frame(s, d).withColumns({"prev_volume": F.lag("volume").over(w), "room": (F.col("resistance20") / F.col("close") - 1) * 100})
    x = x.select("symbol", "session_no", "change_pct", "atr_pct", bounded(F.lit(20) + F.expr(points(EARLY)), -1e9, 100).cast("double").alias("early"),
                 bounded(F.lit(25) + F.expr(points(STAY)), 0, 100).cast("double").alias("sustain"), bounded(F.expr(points(PENALTY)), -1e9, 80).cast("double").alias("penalty"))
    prob = bounded(25 + 0.3 * F.col("sustain") + 0.25 * F.col("early") - F.col("penalty") * 0.5, 10, 90)
    return x.select("symbol", "session_no", "early", "sustain", "penalty", prob.alias("probability"),
                    first_match(((F.col("penalty") >= 25) | (F.coalesce("atr_pct", F.lit(100.0)) > 5), "HIGH"), (F.col("sustain") >= 65, "LOW"), default="MEDIUM").alias("risk"),
                    F.array_compact(F.array(F.when(F.col("change_pct") >= 7, F.lit("EXTENDED_MOVE_HARD_GATE")), F.when(F.col("change_pct") <= -7, F.lit("HARD_FALL")), F.when(F.col("sustain") < 50, F.lit("QUALITY_THRESHOLD")))).alias("blocks"))


query("closing_inputs_pit", "SELECT signal_id, CASE WHEN feature_at<=signal_at THEN rsi END AS rsi, CASE WHEN feature_at<=signal_at THEN score END AS score, concat_ws('|', CASE WHEN feature_at>signal_at THEN 'LATE_INPUT' END, CASE WHEN sma50 IS NULL THEN 'TECHNICAL_DATA_MISSING' END, CASE WHEN price*volume<3000 THEN 'LOW_LIQUIDITY' END) AS quality FROM preds", f="rsi score")(
    lambda s, d: predictions(s, d).select("signal_id", *[F.when(F.col("feature_at") <= F.col("signal_at"), F.col(c)).alias(c) for c in ("rsi", "score")],
        F.array_compact(F.array(F.when(F.col("feature_at") > F.col("signal_at"), F.lit("LATE_INPUT")), F.when(F.col("sma50").isNull(), F.lit("TECHNICAL_DATA_MISSING")), F.when(F.col("price") * F.col("volume") < 3000, F.lit("LOW_LIQUIDITY")))).alias("quality")))
query("capture_features")(lambda s, d: predictions(s, d).select("signal_id", F.to_json(F.create_map(*[x for f in FLAGS for x in (F.lit(f), F.struct(F.col(f).isNotNull().alias("available"), F.col(f).alias("active"), F.col("regime").alias("state")))])).alias("features")))

# --- intraday calibration ---------------------------------------------------------------------
IFLAG = {"strong_score": "score >= 20", "morning": "slot < 12"}


def _iweights(s, d):
    x = intraday_outcomes(s, d).filter("horizon = '1H' AND completed AND decision = 'BUY'")
    f = st.long_flags(x, {n: F.expr(e) for n, e in IFLAG.items()}, ["symbol", "side_return"]).filter("flag")
    return f.groupBy("criterion").agg((F.lit(0.5) + F.when(F.avg("side_return") > 0, 0.0025).otherwise(-0.0025)).alias("weight"))


query("intraday_calibrated_score", """
 WITH w AS (SELECT avg(side_return) FILTER (WHERE score>=20) AS a, avg(side_return) FILTER (WHERE slot<12) AS b FROM ires WHERE horizon='1H' AND completed AND decision='BUY'),
 x AS (SELECT i.signal_id, least(95.0,45+i.score/4) AS raw, (CASE WHEN i.score>=20 THEN CASE WHEN w.a>0 THEN 0.25 ELSE -0.25 END ELSE 0 END+CASE WHEN i.slot<12 THEN CASE WHEN w.b>0 THEN 0.25 ELSE -0.25 END ELSE 0 END)::DOUBLE AS dl, i.decision='SELL' AS unsafe FROM isig i CROSS JOIN w),
 y AS (SELECT *, CASE WHEN unsafe THEN least(0,dl) ELSE dl END AS delta FROM x) SELECT signal_id, delta, greatest(0,least(95,raw+delta)) AS final FROM y""", f="delta final")(
    lambda s, d: ln.calibrated_score(intraday_outcomes(s, d).filter("horizon = '1H'").withColumns({**{n: F.expr(e) for n, e in IFLAG.items()}, "raw": F.least(F.lit(95.0), 45 + F.col("score") / 4)}), _iweights(s, d), list(IFLAG), 0.5, "raw", 45, F.col("decision") == "SELL").select("signal_id", "delta", "final"))
query("intraday_weight_refresh")(lambda s, d: ln.bounded_weights(_iweights(s, d).withColumn("scope", F.lit("INTRADAY")).withColumn("baseline", F.lit(0.5)).select("scope", "criterion", "weight", "baseline"), "scope"))

# --- landed pages -------------------------------------------------------------------------------
LINK = r"<li><a href=\"([^\"]*)\">([^<]*)</a>"
query("extract_announcements", """
 SELECT page_id, regexp_extract(m, '<li><a href="([^"]*)">([^<]*)</a>', 1) AS link, regexp_extract(m, '<li><a href="([^"]*)">([^<]*)</a>', 2) AS title, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a>')) AS m FROM pages) AS q GROUP BY ALL""")(
    lambda s, d: fx.table(s, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<li><a href="[^"]*">[^<]*</a>'), F.lit(0))).alias("m"))
    .select("page_id", F.regexp_extract("m", LINK, 1).alias("link"), F.regexp_extract("m", LINK, 2).alias("title")).groupBy("page_id", "link", "title").agg(F.count(F.lit(1)).alias("n")))
