"""Context queries."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sigspark.operators import context as cx
from sigspark.operators.outcomes import evaluated
from sigspark.plans.indicators import index_frame
from sigspark.plans.records_fixture import frame, predictions
from sigspark.plans.registry import fragment, query
from sigspark.sources import fixtures as fx

UNI = "(SELECT count(*)::DOUBLE FROM symdim)"  # the universe's size, from its dimension
LEAST = f"ceil(0.6*{UNI})"  # observations a market-wide measure needs
MEM = 3  # members a sector needs; the fixture's sectors have five


@lru_cache(maxsize=8)
def universe(s, d):
    """Symbols of the dimension, and how many of them a market-wide measure needs."""
    n = fx.symbol_dim(s, d).count()
    return n, -(-6 * n // 10)


fragment("memb", "SELECT sector, count(*) AS expected FROM symdim GROUP BY sector")
fragment("brd", f"""
 SELECT *, valid-rising-falling AS unchanged, valid/{UNI} AS coverage, valid>={LEAST} AND valid/{UNI}>=0.6 AS enough,
   CASE WHEN valid>={LEAST} THEN 100.0*(rising-falling)/valid END AS score,
   CASE WHEN valid<{LEAST} THEN 'UNCERTAIN' WHEN 100.0*(rising-falling)/valid>=55 THEN 'VERY_POSITIVE' WHEN 100.0*(rising-falling)/valid>=20 THEN 'POSITIVE'
        WHEN 100.0*(rising-falling)/valid<=-55 THEN 'VERY_NEGATIVE' WHEN 100.0*(rising-falling)/valid<=-20 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS label,
   CASE WHEN valid>={LEAST} THEN valid*100.0/{UNI} ELSE least(40.0, valid*100.0/{UNI}) END AS confidence
 FROM (SELECT session_no, count(*) AS valid, count(*) FILTER (WHERE change_pct>0.01) AS rising, count(*) FILTER (WHERE change_pct<-0.01) AS falling,
   count(*) FILTER (WHERE change_pct>=3) AS strong_rising, count(*) FILTER (WHERE change_pct<=-3) AS strong_falling,
   count(*) FILTER (WHERE change_pct>0.01 AND volume_ratio>=120) AS supported_up, count(*) FILTER (WHERE change_pct<-0.01 AND volume_ratio>=120) AS supported_down
   FROM ind WHERE change_pct IS NOT NULL GROUP BY session_no) AS q""")


@lru_cache(maxsize=8)
def breadth(s, d):
    return cx.market_breadth(frame(s, d), *universe(s, d))


query("market_breadth", "SELECT session_no, valid, rising, falling, unchanged, strong_rising, strong_falling, supported_up, supported_down, coverage, enough, score, label, confidence FROM brd",
      f="coverage score confidence")(
    lambda s, d: breadth(s, d).select("session_no", "valid", "rising", "falling", "unchanged", "strong_rising", "strong_falling",
                                      "supported_up", "supported_down", "coverage", "enough", "score", "label", "confidence"))

fragment("secl", f"""
 SELECT q.*, rel AS relative_return, CASE WHEN ok THEN greatest(-100,least(100,rel*25)) END AS rs_score, ok AS enough,
   CASE WHEN NOT ok THEN 'NEUTRAL' WHEN rel*25>=50 THEN 'VERY_STRONG' WHEN rel*25>=15 THEN 'STRONG' WHEN rel*25<=-50 THEN 'VERY_WEAK' WHEN rel*25<=-15 THEN 'WEAK' ELSE 'NEUTRAL' END AS label,
   CASE WHEN ok THEN 100.0*n/expected ELSE 0 END AS confidence
 FROM (SELECT g.*, m.expected, n>={MEM} AND n/expected>=0.6 AS ok, CASE WHEN n>={MEM} AND n/expected>=0.6 THEN median_return-x.change_pct END AS rel
  FROM (SELECT session_no, sector, count(*) AS n, median(change_pct) AS median_return, avg(change_pct) AS mean_return,
    avg(CASE WHEN change_pct>0 THEN 1.0 ELSE 0 END) AS positive_share, avg(CASE WHEN volume_ratio>=120 THEN 1.0 WHEN volume_ratio IS NOT NULL THEN 0 END) AS volume_support,
    100*avg(CASE WHEN sma20 IS NOT NULL THEN sign(close-sma20) END) AS trend_score FROM ind WHERE change_pct IS NOT NULL GROUP BY session_no, sector) g
  JOIN memb m ON g.sector=m.sector JOIN xind x ON g.session_no=x.session_no) AS q""")


@lru_cache(maxsize=8)
def members(s, d):
    return fx.symbol_dim(s, d).groupBy("sector").agg(F.count(F.lit(1)).alias("expected"))


@lru_cache(maxsize=8)
def sectors_live(s, d):
    return cx.sector_live(frame(s, d), index_frame(s, d), members(s, d), MEM)


SL = "session_no sector n median_return mean_return positive_share volume_support trend_score relative_return rs_score label confidence enough".split()
query("sector_live", f"SELECT {', '.join(SL)} FROM secl", f="median_return mean_return positive_share volume_support trend_score relative_return rs_score confidence")(
    lambda s, d: sectors_live(s, d).select(*SL))

query("market_regime_live", f"""
 WITH m AS (SELECT session_no, CASE WHEN count(sma20)>={LEAST} THEN 100*avg(CASE WHEN sma20 IS NOT NULL THEN sign(close-sma20) END) END AS st,
   CASE WHEN count(sma50)>={LEAST} THEN 100*avg(CASE WHEN sma50 IS NOT NULL THEN sign(close-sma50) END) END AS lt,
   CASE WHEN count(momentum3)>={LEAST} THEN greatest(-100,least(100,median(momentum3)*50)) END AS mo, count(volume_ratio) AS nv FROM ind WHERE change_pct IS NOT NULL GROUP BY session_no),
 s AS (SELECT session_no, CASE WHEN count(*)>=3 THEN 100*avg(sign(median_return)) END AS sp FROM secl WHERE enough GROUP BY session_no),
 p AS (SELECT b.*, greatest(-100,least(100,x.change_pct/3*100)) AS ix, st, lt, mo, CASE WHEN nv>={LEAST} THEN 100.0*(supported_up-supported_down)/nv END AS vo, sp
   FROM brd b JOIN m ON b.session_no=m.session_no LEFT JOIN s ON b.session_no=s.session_no LEFT JOIN xind x ON b.session_no=x.session_no),
 l AS (SELECT session_no, any_value(enough) AS enough, any_value(confidence) AS confidence, count(v) AS k, sum(v*w)/sum(CASE WHEN v IS NOT NULL THEN w END) AS sc,
    bool_or(v IS NOT NULL AND nm IN ('ix','st','lt')) AS anchor
  FROM (SELECT session_no, enough, confidence, unnest(['ix','br','st','lt','mo','vo','sp']) AS nm, unnest([ix,score,st,lt,mo,vo,sp]) AS v, unnest([0.25,0.25,0.12,0.12,0.10,0.08,0.08]) AS w FROM p) AS u GROUP BY session_no),
 r AS (SELECT session_no, k AS components, CASE WHEN enough AND k>=3 AND anchor THEN sc END AS regime_score,
   CASE WHEN enough AND k>=3 AND anchor THEN confidence*(0.7+0.3*k/7) ELSE least(confidence,25) END AS regime_confidence FROM l)
 SELECT *, CASE WHEN regime_score IS NULL OR regime_confidence<50 THEN 'UNCERTAIN' WHEN regime_score>=55 THEN 'STRONG_RISE' WHEN regime_score>=20 THEN 'RISE'
   WHEN regime_score<=-55 THEN 'STRONG_FALL' WHEN regime_score<=-20 THEN 'FALL' ELSE 'FLAT' END AS regime FROM r""", f="regime_score regime_confidence")(
    lambda s, d: cx.market_regime_live(frame(s, d), index_frame(s, d), breadth(s, d), sectors_live(s, d), *universe(s, d)).select(
        "session_no", "components", "regime_score", "regime_confidence", "regime"))

fragment("xobs", """
 SELECT session_no, session, CASE WHEN sma20 IS NULL OR sma50 IS NULL THEN NULL WHEN close>sma20 AND sma20>sma50 THEN 'POSITIVE' WHEN close<sma20 AND sma20<sma50 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS index_trend,
   CASE WHEN nv>=2 THEN CASE WHEN sv/nv>=0.5 THEN 'POSITIVE' WHEN sv/nv<=-0.5 THEN 'NEGATIVE' ELSE 'NEUTRAL' END END AS index_momentum,
   CASE WHEN rr<0.75 THEN 'LOW' WHEN rr<=1.5 THEN 'NORMAL' WHEN rr<=2.5 THEN 'HIGH' WHEN rr IS NOT NULL THEN 'EXTREME' END AS index_volatility,
   return_1d AS index_return_1d, return_5d AS index_return_5d, return_20d AS index_return_20d
 FROM (SELECT *, atr_pct/atr_baseline AS rr, (CASE WHEN momentum3 IS NULL THEN 0 ELSE 1 END)+(CASE WHEN sma20_slope IS NULL THEN 0 ELSE 1 END)+(CASE WHEN rsi IS NULL THEN 0 ELSE 1 END) AS nv,
   coalesce(sign(momentum3),0)+coalesce(sign(sma20_slope),0)+CASE WHEN rsi>55 THEN 1 WHEN rsi<45 THEN -1 ELSE 0 END AS sv FROM xind) AS q""")
fragment("mm1_", """
 SELECT session_no, count(*) AS n, count(*) FILTER (WHERE close>prev_close) AS advancing, count(*) FILTER (WHERE close<prev_close) AS declining,
   count(sma20) AS n20, count(sma50) AS n50, 100.0*count(*) FILTER (WHERE close>sma20)/nullif(count(sma20),0) AS above_sma20_pct,
   100.0*count(*) FILTER (WHERE close>sma50)/nullif(count(sma50),0) AS above_sma50_pct, count(high20_prev) AS nhl,
   count(*) FILTER (WHERE high>high20_prev) AS new_high, count(*) FILTER (WHERE low<low20_prev) AS new_low, sum(volume) AS vol,
   coalesce(sum(volume) FILTER (WHERE close>prev_close),0) AS upv, coalesce(sum(volume) FILTER (WHERE close<prev_close),0) AS dnv
 FROM ind WHERE prev_close IS NOT NULL GROUP BY session_no""")
fragment("mm2_", f"""
 SELECT m.*, x.index_trend, x.index_momentum, x.index_volatility, 100*upv/nullif(vol,0) AS up_volume_pct, n/{UNI} AS coverage,
   100*(advancing+0.5*(n-advancing-declining))/n AS v1, above_sma20_pct AS v2, above_sma50_pct AS v3, 50+50.0*(new_high-new_low)/nullif(nhl,0) AS v4, 50+50*(upv-dnv)/nullif(vol,0) AS v5
 FROM mm1_ m LEFT JOIN xobs x ON m.session_no=x.session_no""")
fragment("mm3_", f"""
 SELECT *, (coalesce(v1*.3,0)+coalesce(v2*.2,0)+coalesce(v3*.2,0)+coalesce(v4*.15,0)+coalesce(v5*.15,0))/
   (CASE WHEN v1 IS NULL THEN 0 ELSE .3 END+CASE WHEN v2 IS NULL THEN 0 ELSE .2 END+CASE WHEN v3 IS NULL THEN 0 ELSE .2 END+CASE WHEN v4 IS NULL THEN 0 ELSE .15 END+CASE WHEN v5 IS NULL THEN 0 ELSE .15 END) AS breadth_score,
   CASE WHEN v1 IS NULL THEN 0 ELSE .3 END+CASE WHEN v2 IS NULL THEN 0 ELSE .2*n20/n END+CASE WHEN v3 IS NULL THEN 0 ELSE .2*n50/n END+CASE WHEN v4 IS NULL THEN 0 ELSE .15*nhl/n END+CASE WHEN v5 IS NULL THEN 0 ELSE .15 END AS cc,
   (v1 IS NOT NULL)::INT+(v2 IS NOT NULL)::INT+(v3 IS NOT NULL)::INT+(v4 IS NOT NULL)::INT+(v5 IS NOT NULL)::INT AS nvals, n>={LEAST} AND coverage>=0.6 AS enough,
   CASE index_trend WHEN 'POSITIVE' THEN 100.0 WHEN 'NEUTRAL' THEN 50 WHEN 'NEGATIVE' THEN 0 END AS r2, CASE index_momentum WHEN 'POSITIVE' THEN 100.0 WHEN 'NEUTRAL' THEN 50 WHEN 'NEGATIVE' THEN 0 END AS r3,
   CASE index_volatility WHEN 'LOW' THEN 100.0 WHEN 'NORMAL' THEN 75 WHEN 'HIGH' THEN 25 WHEN 'EXTREME' THEN 0 END AS r4 FROM mm2_""")
fragment("mm4_", """
 SELECT *, (breadth_score*.5+coalesce(r2*.25,0)+coalesce(r3*.15,0)+coalesce(r4*.1,0))/(.5+CASE WHEN r2 IS NULL THEN 0 ELSE .25 END+CASE WHEN r3 IS NULL THEN 0 ELSE .15 END+CASE WHEN r4 IS NULL THEN 0 ELSE .1 END) AS regime_score,
   1+(r2 IS NOT NULL)::INT+(r3 IS NOT NULL)::INT+(r4 IS NOT NULL)::INT AS nreg,
   coalesce((index_trend='POSITIVE' AND breadth_score<40) OR (index_trend='NEGATIVE' AND breadth_score>=60), false) AS conflict,
   (CASE WHEN r2 IS NULL THEN 0 ELSE .25 END+CASE WHEN r3 IS NULL THEN 0 ELSE .15 END+CASE WHEN r4 IS NULL THEN 0 ELSE .1 END)/0.5 AS ic FROM mm3_""")
fragment("mm5_", """
 SELECT *, CASE WHEN enough THEN 100*coverage*cc*(0.5+0.5*ic)*CASE WHEN conflict THEN 0.75 ELSE 1 END ELSE least(35, 100*coverage*cc*(0.5+0.5*ic)*CASE WHEN conflict THEN 0.75 ELSE 1 END) END AS regime_confidence FROM mm4_""")
fragment("mmeas", """
 SELECT *, enough AND nvals>=2 AND nreg>=2 AND regime_confidence>=50 AS final,
   CASE WHEN enough AND nvals>=2 AND nreg>=2 AND regime_confidence>=50 THEN CASE WHEN regime_score>=80 THEN 'STRONG_BULL' WHEN regime_score>=60 THEN 'BULL' WHEN regime_score>=40 THEN 'NEUTRAL' WHEN regime_score>=20 THEN 'BEAR' ELSE 'STRONG_BEAR' END END AS regime,
   CASE WHEN enough AND nvals>=2 THEN CASE WHEN breadth_score>=80 THEN 'VERY_STRONG' WHEN breadth_score>=60 THEN 'STRONG' WHEN breadth_score>=40 THEN 'NEUTRAL' WHEN breadth_score>=20 THEN 'WEAK' ELSE 'VERY_WEAK' END END AS breadth_state,
   CASE WHEN NOT enough THEN NULL WHEN index_volatility='EXTREME' OR (breadth_score<20 AND 100.0*declining/n>=80) THEN 'EXTREME'
     WHEN index_volatility='HIGH' OR breadth_score<40 OR (index_momentum='NEGATIVE' AND 100.0*declining/n>=60) THEN 'HIGH'
     WHEN index_volatility='LOW' AND breadth_score>=60 AND index_momentum='POSITIVE' THEN 'LOW' ELSE 'NORMAL' END AS risk_state,
   CASE WHEN enough AND index_trend IS NOT NULL AND nvals=5 AND cc>=0.8 THEN 'GOOD' ELSE 'LIMITED' END AS data_status FROM mm5_""")


@lru_cache(maxsize=8)
def index_obs(s, d):
    return cx.index_observation(index_frame(s, d))


@lru_cache(maxsize=8)
def measurement(s, d):
    return evaluated(cx.market_measurement(frame(s, d), index_obs(s, d), *universe(s, d)))


MM = "session_no n advancing declining new_high new_low above_sma20_pct above_sma50_pct up_volume_pct coverage index_trend index_momentum index_volatility breadth_score regime_score regime_confidence final regime breadth_state risk_state data_status conflict".split()
query("market_measurement", f"SELECT {', '.join(MM)} FROM mmeas", f="above_sma20_pct above_sma50_pct up_volume_pct coverage breadth_score regime_score regime_confidence")(
    lambda s, d: measurement(s, d).select(*MM))

fragment("sm1_", f"""
 SELECT g.*, expected, index_return_1d, index_return_5d, index_return_20d,
   CASE WHEN n1>={MEM} AND n1/expected>=0.6 THEN m1 END AS sector_return_1d, CASE WHEN n5>={MEM} AND n5/expected>=0.6 THEN m5 END AS sector_return_5d,
   CASE WHEN n20r>={MEM} AND n20r/expected>=0.6 THEN m20 END AS sector_return_20d
 FROM (SELECT session_no, sector, count(*) AS n, avg(return_1d) AS m1, avg(return_5d) AS m5, avg(return_20d) AS m20, count(return_1d) AS n1, count(return_5d) AS n5, count(return_20d) AS n20r,
   count(sma20) AS n20, count(sma50) AS n50, count(*) FILTER (WHERE return_1d>0.01) AS advancing, count(*) FILTER (WHERE return_1d<-0.01) AS declining,
   sum(CASE WHEN sma20 IS NULL OR sma50 IS NULL THEN NULL WHEN close>sma20 AND sma20>sma50 THEN 1 WHEN close<sma20 AND sma20<sma50 THEN -1 ELSE 0 END) AS tv,
   count(CASE WHEN sma20 IS NOT NULL AND sma50 IS NOT NULL THEN 1 END) AS tn, avg(sma20_slope/close*100) AS slope,
   sum(volume) FILTER (WHERE return_1d IS NOT NULL) AS vol, count(volume) FILTER (WHERE return_1d IS NOT NULL) AS nv,
   coalesce(sum(volume) FILTER (WHERE return_1d>0.01),0) AS uv, coalesce(sum(volume) FILTER (WHERE return_1d<-0.01),0) AS dv
   FROM ind WHERE prev_close IS NOT NULL GROUP BY session_no, sector) g JOIN memb m ON g.sector=m.sector LEFT JOIN xobs x ON g.session_no=x.session_no""")
fragment("sm2_", """
 SELECT *, sector_return_1d-index_return_1d AS relative_1d, sector_return_5d-index_return_5d AS relative_5d, sector_return_20d-index_return_20d AS relative_20d FROM sm1_""")
fragment("sm3_", f"""
 SELECT *, CASE WHEN relative_5d IS NOT NULL AND relative_20d IS NOT NULL THEN greatest(0,least(100,50+CASE WHEN relative_1d IS NULL THEN 0 ELSE 0.2*greatest(-1,least(1,relative_1d/2))*50 END+0.35*greatest(-1,least(1,relative_5d/5))*50+0.45*greatest(-1,least(1,relative_20d/10))*50)) END AS rs_score,
   CASE WHEN tn>=2 THEN (tv+coalesce(sign(relative_20d),0))/(tn+CASE WHEN relative_20d IS NULL THEN 0 ELSE 1 END) END AS tmean,
   100*(advancing+0.5*(n1-advancing-declining))/nullif(n1,0) AS breadth, relative_5d/5-relative_20d/20 AS velocity,
   CASE WHEN vol>0 AND nv>={MEM} AND nv/expected>=0.6 THEN 50+50*(uv-dv)/vol END AS volume_score FROM sm2_""")
fragment("sm4_", """
 SELECT *, CASE WHEN tmean>=0.35 THEN 'POSITIVE' WHEN tmean<=-0.35 THEN 'NEGATIVE' WHEN tmean IS NOT NULL THEN 'NEUTRAL' END AS trend_state,
   CASE WHEN velocity IS NOT NULL AND (1+(slope IS NOT NULL)::INT+(breadth IS NOT NULL)::INT)>=2 THEN
    (greatest(-1,least(1,velocity))+CASE WHEN slope IS NULL THEN 0 ELSE greatest(-1,least(1,slope)) END+coalesce((breadth-50)/50,0))/(1+(slope IS NOT NULL)::INT+(breadth IS NOT NULL)::INT) END AS relative_momentum FROM sm3_""")
fragment("sm5_", """
 SELECT *, CASE trend_state WHEN 'POSITIVE' THEN 100.0 WHEN 'NEGATIVE' THEN 0 WHEN 'NEUTRAL' THEN 50 END AS p2, 50+50*relative_momentum AS p3,
   least(n1,n5,n20r)/expected AS hcov, coalesce((rs_score>=60 AND trend_state='NEGATIVE') OR (rs_score<40 AND trend_state='POSITIVE'),false) AS conflict,
   ((index_return_1d IS NOT NULL)::INT+(index_return_5d IS NOT NULL)::INT+(index_return_20d IS NOT NULL)::INT)/3.0 AS bench FROM sm4_""")
fragment("sm6_", f"""
 SELECT *, (coalesce(rs_score*.45,0)+coalesce(p2*.2,0)+coalesce(p3*.15,0)+coalesce(breadth*.15,0)+coalesce(volume_score*.05,0))/nullif(CASE WHEN rs_score IS NULL THEN 0 ELSE .45 END+CASE WHEN p2 IS NULL THEN 0 ELSE .2 END+CASE WHEN p3 IS NULL THEN 0 ELSE .15 END+CASE WHEN breadth IS NULL THEN 0 ELSE .15 END+CASE WHEN volume_score IS NULL THEN 0 ELSE .05 END,0) AS state_score,
   n>={MEM} AND n/expected>=0.6 AND hcov>=0.6 AND rs_score IS NOT NULL AND ((rs_score IS NOT NULL)::INT+(p2 IS NOT NULL)::INT+(p3 IS NOT NULL)::INT+(breadth IS NOT NULL)::INT+(volume_score IS NOT NULL)::INT)>=3 AS enough,
   100*(0.4*n/expected+0.2*least(n20,n50)/expected+0.15*nv/expected+0.15*hcov+0.1*bench)*CASE WHEN conflict THEN 0.8 ELSE 1 END AS conf0 FROM sm5_""")
fragment("smeas", """
 SELECT *, CASE WHEN enough AND sector_confidence>=50 THEN CASE WHEN state_score>=80 THEN 'LEADING' WHEN state_score>=60 THEN 'STRONG' WHEN state_score>=40 THEN 'NEUTRAL' WHEN state_score>=20 THEN 'WEAK' ELSE 'LAGGING' END END AS sector_state,
   CASE WHEN NOT enough OR rs_score IS NULL OR relative_momentum IS NULL THEN NULL WHEN rs_score>=50 AND relative_momentum>=0 THEN 'LEADING' WHEN rs_score>=50 THEN 'WEAKENING' WHEN relative_momentum>=0 THEN 'IMPROVING' ELSE 'LAGGING' END AS quadrant,
   CASE WHEN relative_momentum>0.1 AND rs_score>=60 THEN 'STRONG' WHEN relative_momentum>0.1 THEN 'IMPROVING' WHEN relative_momentum<-0.1 AND rs_score<40 THEN 'WEAK' WHEN relative_momentum<-0.1 THEN 'WEAKENING' WHEN relative_momentum IS NOT NULL THEN 'NEUTRAL' END AS momentum_state
 FROM (SELECT *, least(100, CASE WHEN enough THEN conf0 ELSE least(conf0,40) END) AS sector_confidence FROM sm6_) AS q""")


@lru_cache(maxsize=8)
def sectors(s, d):
    return evaluated(cx.sector_measurement(frame(s, d), index_obs(s, d), members(s, d), MEM))


SM = "session_no sector n sector_return_1d sector_return_5d sector_return_20d relative_5d relative_20d rs_score trend_state breadth relative_momentum volume_score state_score sector_confidence sector_state quadrant momentum_state enough".split()
query("sector_measurement", f"SELECT {', '.join(SM)} FROM smeas",
      f="sector_return_1d sector_return_5d sector_return_20d relative_5d relative_20d rs_score breadth relative_momentum volume_score state_score sector_confidence")(
    lambda s, d: sectors(s, d).select(*SM))

fragment("svs", """
 SELECT *, CASE WHEN w5 IS NOT NULL AND w20 IS NOT NULL THEN greatest(0,least(100,50+CASE WHEN w1 IS NULL THEN 0 ELSE 0.2*greatest(-1,least(1,w1/2))*50 END+0.35*greatest(-1,least(1,w5/5))*50+0.45*greatest(-1,least(1,w20/10))*50)) END AS stock_score
 FROM (SELECT i.symbol, i.session, i.session_no, i.sector, s.sector_state, i.return_1d-sector_return_1d AS w1, i.return_5d-sector_return_5d AS w5, i.return_20d-sector_return_20d AS w20
 FROM ind i JOIN smeas s ON i.session_no=s.session_no AND i.sector=s.sector) AS q""")


@lru_cache(maxsize=8)
def vs_sector(s, d):
    return cx.stock_vs_sector(frame(s, d), sectors(s, d))


query("stock_vs_sector", """
 SELECT v.symbol, v.session_no, w1 AS vs_sector_1d, w5 AS vs_sector_5d, w20 AS vs_sector_20d, stock_score,
  CASE WHEN stock_score IS NULL OR sector_state IS NULL OR m.regime IS NULL THEN NULL
   WHEN stock_score>=80 AND sector_state='LEADING' AND m.regime='STRONG_BULL' THEN 'STRONG_ALIGNMENT'
   WHEN stock_score>=60 AND sector_state IN ('LEADING','STRONG') AND m.regime IN ('BULL','STRONG_BULL') THEN 'POSITIVE_ALIGNMENT'
   WHEN stock_score<40 AND sector_state IN ('WEAK','LAGGING') AND m.regime IN ('BEAR','STRONG_BEAR') THEN 'NEGATIVE_ALIGNMENT' ELSE 'MIXED' END AS alignment
 FROM svs v LEFT JOIN mmeas m ON v.session_no=m.session_no""", f="vs_sector_1d vs_sector_5d vs_sector_20d stock_score")(
    lambda s, d: vs_sector(s, d).join(measurement(s, d).select("session_no", "regime"), "session_no", "left").select(
        "symbol", "session_no", "vs_sector_1d", "vs_sector_5d", "vs_sector_20d", "stock_score",
        cx.alignment(F.col("stock_score"), F.col("sector_state"), F.col("regime")).alias("alignment")))

query("relative_score", "SELECT session_no, sector, rs_score FROM smeas WHERE rs_score IS NOT NULL", f="rs_score")(
    lambda s, d: sectors(s, d).filter("rs_score IS NOT NULL").select("session_no", "sector", "rs_score"))

query("sector_ranking", """
 SELECT session_no, sector, rs_score, sector_state, row_number() OVER (PARTITION BY session_no ORDER BY rs_score IS NULL, round(rs_score,9) DESC,
   CASE sector_state WHEN 'LEADING' THEN 0 WHEN 'STRONG' THEN 1 WHEN 'NEUTRAL' THEN 2 WHEN 'WEAK' THEN 3 WHEN 'LAGGING' THEN 4 ELSE 5 END, round(sector_confidence,9) DESC, sector) AS rank FROM smeas""", f="rs_score")(
    lambda s, d: sectors(s, d).withColumn("rank", F.row_number().over(W.partitionBy("session_no").orderBy(
        F.round("rs_score", 9).desc_nulls_last(), F.coalesce(F.array_position(F.array(*[F.lit(x) for x in cx.SECTOR_STATES]), F.col("sector_state")) - 1, F.lit(5)),
        F.round("sector_confidence", 9).desc(), "sector"))).select("session_no", "sector", "rs_score", "sector_state", "rank"))

query("sector_leaders_laggards", """
 SELECT session_no, sector, symbol, stock_score, unnest(list_filter([CASE WHEN a<=5 THEN 'LEADER' END, CASE WHEN z<=5 THEN 'LAGGARD' END], lambda x: x IS NOT NULL)) AS side FROM (SELECT *,
   row_number() OVER (PARTITION BY session_no, sector ORDER BY round(stock_score,9) DESC, symbol) AS a, row_number() OVER (PARTITION BY session_no, sector ORDER BY round(stock_score,9), symbol) AS z
   FROM svs WHERE stock_score IS NOT NULL) AS q WHERE a<=5 OR z<=5""", f="stock_score")(
    lambda s, d: vs_sector(s, d).filter("stock_score IS NOT NULL").withColumns({
        "a": F.row_number().over(W.partitionBy("session_no", "sector").orderBy(F.round("stock_score", 9).desc(), "symbol")),
        "z": F.row_number().over(W.partitionBy("session_no", "sector").orderBy(F.round("stock_score", 9), "symbol"))})
    .select("session_no", "sector", "symbol", "stock_score", F.explode(F.array_compact(F.array(F.when(F.col("a") <= 5, "LEADER"), F.when(F.col("z") <= 5, "LAGGARD")))).alias("side")))

query("join_sector", "SELECT b.symbol, CAST(b.session AS VARCHAR) AS session, coalesce(d.sector,'UNKNOWN') AS sector, close FROM bars b LEFT JOIN (SELECT * FROM symdim WHERE symbol<>'N07') d ON b.symbol=d.symbol", f="close")(
    lambda s, d: fx.weekly_bars(s, d).drop("sector").join(fx.symbol_dim(s, d).filter("symbol <> 'N07'"), "symbol", "left").select(
        "symbol", "session", F.coalesce("sector", F.lit("UNKNOWN")).alias("sector"), "close"))

query("closed_observation", "SELECT symbol, session_no FROM ind WHERE prev_close>0 AND open>0 AND low>0 AND close>0 AND low<=least(open,close) AND greatest(open,close)<=high AND session_no=(SELECT last_no FROM lastno)")(
    lambda s, d: frame(s, d).join(fx.weekly_bars(s, d).agg(F.max("session_no").alias("last_no")), F.col("session_no") == F.col("last_no"))
    .filter(cx.closed_observation(None)).select("symbol", "session_no"))

query("exact_membership_match", """
 WITH a AS (SELECT sector, list_sort(list(DISTINCT symbol)) AS m FROM bars GROUP BY sector), b AS (SELECT sector, list_sort(list(symbol)) AS m FROM symdim GROUP BY sector)
 SELECT a.sector, a.m=b.m AS matched, len(a.m) AS members FROM a JOIN b ON a.sector=b.sector""")(
    lambda s, d: fx.weekly_bars(s, d).select("sector", "symbol").distinct().groupBy("sector").agg(F.array_sort(F.collect_set("symbol")).alias("a"))
    .join(fx.symbol_dim(s, d).groupBy("sector").agg(F.array_sort(F.collect_set("symbol")).alias("b")), "sector")
    .select("sector", (F.col("a") == F.col("b")).alias("matched"), F.size("a").alias("members")))

# A context is published at noon of the Tuesday after its session. A signal may use the context of
# the newest session that is due by then, and none if that one is missing: an equi-join on the session.
EXPECTED = "CAST(floor((epoch(signal_at)-epoch(TIMESTAMP '1990-01-01')-36*3600)/604800) AS BIGINT)"


def with_expected(p):
    due = F.unix_timestamp("signal_at") - F.unix_timestamp(F.lit("1990-01-01").cast("timestamp")) - 36 * 3600
    return p.withColumn("ctx_no", F.floor(due / 604800).cast("int"))


query("asof_market_context", f"""
 SELECT signal_id, m.session_no AS ctx_no, regime AS market_regime, regime_score FROM (SELECT signal_id, {EXPECTED} AS due FROM preds) AS p LEFT JOIN (SELECT * FROM mmeas WHERE final) AS m ON m.session_no=p.due""", f="regime_score")(
    lambda s, d: with_expected(predictions(s, d).select("signal_id", "signal_at")).withColumnRenamed("ctx_no", "due")
    .join(measurement(s, d).filter("final").select(F.col("session_no").alias("ctx_no"), F.col("regime").alias("market_regime"), "regime_score"), F.col("due") == F.col("ctx_no"), "left")
    .select("signal_id", "ctx_no", "market_regime", "regime_score"))

query("asof_sector_context", f"""
 SELECT signal_id, c.session_no AS ctx_no, c.sector_state, c.rs_score FROM (SELECT signal_id, sector, {EXPECTED} AS due FROM preds) AS p LEFT JOIN (SELECT * FROM smeas WHERE enough) AS c ON c.sector=p.sector AND c.session_no=p.due""", f="rs_score")(
    lambda s, d: with_expected(predictions(s, d).select("signal_id", "signal_at", "sector")).withColumnRenamed("ctx_no", "due")
    .join(sectors(s, d).filter("enough").select("sector", F.col("session_no").alias("due"), F.col("session_no").alias("ctx_no"), "sector_state", "rs_score"), ["sector", "due"], "left")
    .select("signal_id", "ctx_no", "sector_state", "rs_score"))

query("context_effects", """
 WITH b AS (SELECT p.signal_id, p.score AS raw, p.rsi, i.change_pct, m.regime_score-50 AS s1, m.regime_confidence AS c1, m.breadth_score-50 AS s2, m.regime_confidence AS c2, s.rs_score-50 AS s3, s.sector_confidence AS c3
  FROM preds p JOIN ind i ON p.symbol=i.symbol AND p.session_no=i.session_no LEFT JOIN mmeas m ON p.session_no=m.session_no LEFT JOIN smeas s ON p.session_no=s.session_no AND p.sector=s.sector),
 e AS (SELECT *, coalesce(raw<70 OR rsi>=70 OR change_pct>4,false) AS unsafe, CASE WHEN c1>=50 AND s1 IS NOT NULL AND raw>=55 THEN s1/100*2*c1/100 ELSE 0 END AS a1,
   CASE WHEN c2>=50 AND s2 IS NOT NULL AND raw>=55 THEN s2/100*1*c2/100 ELSE 0 END AS a2, CASE WHEN c3>=50 AND s3 IS NOT NULL AND raw>=55 THEN s3/100*2*c3/100 ELSE 0 END AS a3 FROM b),
 f AS (SELECT signal_id, CASE WHEN unsafe THEN least(0,a1) ELSE a1 END AS e1, CASE WHEN unsafe THEN least(0,a2) ELSE a2 END AS e2, CASE WHEN unsafe THEN least(0,a3) ELSE a3 END AS e3 FROM e)
 SELECT signal_id, e1*k AS market_effect, e2*k AS breadth_effect, e3*k AS sector_effect, (e1+e2+e3)*k AS context_effect FROM (SELECT *, CASE WHEN abs(e1+e2+e3)>3 THEN 3/abs(e1+e2+e3) ELSE 1.0 END AS k FROM f) AS g""",
      f="market_effect breadth_effect sector_effect context_effect")(lambda s, d: _effects(s, d))


def _effects(s, d):
    p = predictions(s, d).select("signal_id", "symbol", "sector", "session_no", F.col("score").alias("raw_score"), "rsi")
    m = measurement(s, d).select("session_no", (F.col("regime_score") - 50).alias("market_score"), F.col("regime_confidence").alias("market_confidence"),
                                 (F.col("breadth_score") - 50).alias("breadth_score"), F.col("regime_confidence").alias("breadth_confidence"))
    x = sectors(s, d).select("session_no", "sector", (F.col("rs_score") - 50).alias("sector_score"), "sector_confidence")
    j = (p.join(frame(s, d).select("symbol", "session_no", "change_pct"), ["symbol", "session_no"]).join(m, "session_no", "left")
         .join(x, ["session_no", "sector"], "left").withColumn("stale", F.lit(False)))
    return cx.context_effects(j, {"market": 2.0, "breadth": 1.0, "sector": 2.0}, 55).select(
        "signal_id", "market_effect", "breadth_effect", "sector_effect", "context_effect")
