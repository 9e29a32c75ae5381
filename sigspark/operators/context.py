"""Market and sector context: breadth, regime, relative strength, as-of joins.

Groups here are (session), (session, sector) or the index itself: at most one row per
symbol and session goes into a group, and every aggregate but the median is algebraic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sigspark.functions.scalars import clamp, first_match, pct_change, ratio, weighted_available

# Component weights and cut points of the market measurement.
BREADTH_WEIGHTS = {"advances": 0.30, "sma20": 0.20, "sma50": 0.20, "high_low": 0.15, "volume": 0.15}
REGIME_WEIGHTS = {"breadth": 0.50, "index_trend": 0.25, "index_momentum": 0.15, "volatility": 0.10}
LIVE_WEIGHTS = {"index": 0.25, "breadth": 0.25, "short_trend": 0.12, "long_trend": 0.12, "momentum": 0.10,
                "volume": 0.08, "sector_spread": 0.08}
STATE_CUTS = (80, 60, 40, 20)
VOLATILITY_CUTS = (0.75, 1.5, 2.5)
RS_WEIGHTS = {1: 0.20, 5: 0.35, 20: 0.45}
RS_SCALES = {1: 2.0, 5: 5.0, 20: 10.0}
SECTOR_WEIGHTS = {"rs": 0.45, "trend": 0.20, "momentum": 0.15, "breadth": 0.15, "volume": 0.05}
REGIMES = ("STRONG_BULL", "BULL", "NEUTRAL", "BEAR", "STRONG_BEAR")
BREADTHS = ("VERY_STRONG", "STRONG", "NEUTRAL", "WEAK", "VERY_WEAK")
SECTOR_STATES = ("LEADING", "STRONG", "NEUTRAL", "WEAK", "LAGGING")


def count_if(test: Column) -> Column:
    return F.count_if(F.coalesce(test, F.lit(False)))


def index_bars(bars: DataFrame) -> DataFrame:
    return bars.groupBy("session", "session_no").agg(
        *[F.avg(c).alias(c) for c in ("open", "high", "low", "close")], F.sum("volume").alias("volume")
    ).select(F.lit("INDEX").alias("symbol"), F.lit("INDEX").alias("sector"), "session", "open", "high", "low", "close",
             "volume", "session_no")


def state_label(score: Column, labels) -> Column:
    rules = [(score >= cut, label) for cut, label in zip(STATE_CUTS, labels)]
    return F.when(score.isNotNull(), first_match(*rules, default=labels[-1]))


def breadth_label(score: Column) -> Column:
    return first_match((score >= 55, "VERY_POSITIVE"), (score >= 20, "POSITIVE"), (score <= -55, "VERY_NEGATIVE"),
                       (score <= -20, "NEGATIVE"), default="NEUTRAL")


def sector_label(score: Column) -> Column:
    return first_match((score >= 50, "VERY_STRONG"), (score >= 15, "STRONG"), (score <= -50, "VERY_WEAK"),
                       (score <= -15, "WEAK"), default="NEUTRAL")


def rrg_quadrant(strength: Column, momentum: Column) -> Column:
    return F.when(
        strength.isNotNull() & momentum.isNotNull(),
        first_match(((strength >= 50) & (momentum >= 0), "LEADING"), (strength >= 50, "WEAKENING"),
                    (momentum >= 0, "IMPROVING"), default="LAGGING"),
    )


def risk_class(volatility: Column, breadth: Column, declining_pct: Column, momentum: Column) -> Column:
    known = volatility.isNotNull() | breadth.isNotNull() | declining_pct.isNotNull() | momentum.isNotNull()
    return first_match(
        ((volatility == "EXTREME") | ((breadth < 20) & (declining_pct >= 80)), "EXTREME"),
        ((volatility == "HIGH") | (breadth < 40) | ((momentum == "NEGATIVE") & (declining_pct >= 60)), "HIGH"),
        ((volatility == "LOW") & (breadth >= 60) & (momentum == "POSITIVE"), "LOW"),
        (known, "NORMAL"),
        default=None,
    )


def alignment(score: Column, sector: Column, market: Column) -> Column:
    strong = sector.isin("LEADING", "STRONG") & market.isin("BULL", "STRONG_BULL")
    return F.when(
        score.isNotNull() & sector.isNotNull() & market.isNotNull(),
        first_match(
            ((score >= 80) & (sector == "LEADING") & (market == "STRONG_BULL"), "STRONG_ALIGNMENT"),
            ((score >= 60) & strong, "POSITIVE_ALIGNMENT"),
            ((score < 40) & sector.isin("WEAK", "LAGGING") & market.isin("BEAR", "STRONG_BEAR"), "NEGATIVE_ALIGNMENT"),
            default="MIXED",
        ),
    )


def relative_score(by_horizon: dict[int, Column]) -> Column:
    """Weighted, clamped relative strength; NULL without the 5- and 20-session legs."""
    total = F.lit(50.0)
    for h, v in by_horizon.items():
        part = clamp(v / RS_SCALES[h], -1, 1) * 50 * RS_WEIGHTS[h]
        total = total + F.coalesce(part, F.lit(0.0))
    return F.when(by_horizon[5].isNotNull() & by_horizon[20].isNotNull(), clamp(total, 0, 100))


def index_observation(index: DataFrame) -> DataFrame:
    """Trend, momentum votes and volatility class of the index per session."""
    c, s, l = F.col("close"), F.col("sma20"), F.col("sma50")
    vote = lambda x: F.signum(x)
    rsi_vote = first_match((F.col("rsi") > 55, 1.0), (F.col("rsi") < 45, -1.0), default=0.0)
    votes = F.array_compact(
        F.array(vote(F.col("momentum3")), vote(F.col("sma20_slope")), F.when(F.col("rsi").isNotNull(), rsi_vote))
    )
    mean = F.aggregate(votes, F.lit(0.0), lambda a, x: a + x) / F.size(votes)
    r = ratio(F.col("atr_pct"), F.col("atr_baseline"))
    low, mid, high = VOLATILITY_CUTS
    return index.select(
        "session", "session_no",
        F.when(s.isNotNull() & l.isNotNull(),
               first_match(((c > s) & (s > l), "POSITIVE"), ((c < s) & (s < l), "NEGATIVE"), default="NEUTRAL")).alias("index_trend"),
        F.when(F.size(votes) >= 2, first_match((mean >= 0.5, "POSITIVE"), (mean <= -0.5, "NEGATIVE"), default="NEUTRAL")).alias("index_momentum"),
        F.when(r.isNotNull(), first_match((r < low, "LOW"), (r <= mid, "NORMAL"), (r <= high, "HIGH"), default="EXTREME")).alias("index_volatility"),
        *[F.col(f"return_{h}d").alias(f"index_return_{h}d") for h in (1, 5, 20)],
        F.col("change_pct").alias("index_change"),
    )


def market_breadth(frame: DataFrame, universe: int, min_stocks: int = 30, coverage: float = 0.6) -> DataFrame:
    """Per session: risers and fallers, strong moves, volume support, coverage, confidence."""
    r, v = F.col("change_pct"), F.col("volume_ratio")
    d = frame.filter(r.isNotNull()).groupBy("session_no").agg(
        F.count(F.lit(1)).alias("valid"),
        count_if(r > 0.01).alias("rising"), count_if(r < -0.01).alias("falling"),
        count_if(r >= 3).alias("strong_rising"), count_if(r <= -3).alias("strong_falling"),
        count_if((r > 0.01) & (v >= 120)).alias("supported_up"),
        count_if((r < -0.01) & (v >= 120)).alias("supported_down"),
    )
    cov = F.col("valid") / universe
    enough = (F.col("valid") >= min_stocks) & (cov >= coverage)
    raw = 100.0 * (F.col("rising") - F.col("falling")) / F.col("valid")
    return d.withColumns({
        "unchanged": F.col("valid") - F.col("rising") - F.col("falling"),
        "coverage": cov,
        "enough": enough,
        "score": F.when(enough, raw),
        "label": F.when(enough, breadth_label(raw)).otherwise("UNCERTAIN"),
        "confidence": F.when(enough, 100 * cov).otherwise(F.least(F.lit(40.0), 100 * cov)),
    })


def sector_live(frame: DataFrame, index: DataFrame, members: DataFrame, min_members: int = 5, coverage: float = 0.6) -> DataFrame:
    """Sector median against the index, score, volume support and trend."""
    trend = F.when(F.col("sma20").isNotNull(), F.signum(F.col("close") - F.col("sma20")))
    d = frame.filter(F.col("change_pct").isNotNull()).groupBy("session_no", "sector").agg(
        F.count(F.lit(1)).alias("n"), F.median("change_pct").alias("median_return"), F.avg("change_pct").alias("mean_return"),
        F.avg(F.when(F.col("change_pct") > 0, 1.0).otherwise(0.0)).alias("positive_share"),
        F.avg(F.when(F.col("volume_ratio") >= 120, 1.0).when(F.col("volume_ratio").isNotNull(), 0.0)).alias("volume_support"),
        (100 * F.avg(trend)).alias("trend_score"),
    )
    d = d.join(index.select("session_no", F.col("change_pct").alias("_idx")), "session_no").join(members, "sector")
    ok = (F.col("n") >= min_members) & (F.col("n") / F.col("expected") >= coverage)
    rel = F.when(ok, F.col("median_return") - F.col("_idx"))
    score = clamp(rel * 25, -100, 100)
    return d.withColumns({
        "relative_return": rel, "rs_score": score, "label": F.when(ok, sector_label(score)).otherwise("NEUTRAL"),
        "confidence": F.when(ok, 100.0 * F.col("n") / F.col("expected")).otherwise(0.0), "enough": ok,
    }).drop("_idx")


def market_regime_live(frame: DataFrame, index: DataFrame, breadth: DataFrame, sectors: DataFrame, universe: int,
                       min_stocks: int = 30, coverage: float = 0.6) -> DataFrame:
    """Seven weighted components, renormalised over the ones that are known."""
    t20 = F.when(F.col("sma20").isNotNull(), F.signum(F.col("close") - F.col("sma20")))
    t50 = F.when(F.col("sma50").isNotNull(), F.signum(F.col("close") - F.col("sma50")))
    need = max(min_stocks, int(-(-universe * coverage // 1)))

    def gated(value, sample):
        return F.when(F.count(sample) >= need, value)

    m = frame.filter(F.col("change_pct").isNotNull()).groupBy("session_no").agg(
        gated(100 * F.avg(t20), t20).alias("short_trend"), gated(100 * F.avg(t50), t50).alias("long_trend"),
        gated(clamp(F.median("momentum3") * 50, -100, 100), F.col("momentum3")).alias("momentum"),
        F.count("volume_ratio").alias("_nv"),
    )
    s = sectors.filter("enough").groupBy("session_no").agg(
        F.when(F.count(F.lit(1)) >= 3, 100 * F.avg(F.signum("median_return"))).alias("sector_spread"))
    d = (breadth.join(m, "session_no").join(s, "session_no", "left")
         .join(index.select("session_no", clamp(F.col("change_pct") / 3 * 100, -100, 100).alias("index")), "session_no", "left"))
    parts = {"index": F.col("index"), "breadth": F.col("score"), "short_trend": F.col("short_trend"),
             "long_trend": F.col("long_trend"), "momentum": F.col("momentum"),
             "volume": F.when(F.col("_nv") >= need, 100.0 * (F.col("supported_up") - F.col("supported_down")) / F.col("_nv")),
             "sector_spread": F.col("sector_spread")}
    known = sum([F.when(c.isNotNull(), 1).otherwise(0) for c in parts.values()], F.lit(0))
    ok = F.col("enough") & (known >= 3) & (parts["index"].isNotNull() | parts["short_trend"].isNotNull() | parts["long_trend"].isNotNull())
    d = d.withColumns({"components": known, "_ok": ok,
                       "regime_score": F.when(ok, weighted_available({k: (c, LIVE_WEIGHTS[k]) for k, c in parts.items()}))})
    conf = F.when(F.col("_ok"), F.col("confidence") * (0.7 + 0.3 * F.col("components") / 7)).otherwise(F.least(F.col("confidence"), F.lit(25.0)))
    x = F.col("regime_score")
    return d.withColumn("regime_confidence", conf).withColumn("regime", first_match(
        (x.isNull() | (F.col("regime_confidence") < 50), "UNCERTAIN"), (x >= 55, "STRONG_RISE"), (x >= 20, "RISE"),
        (x <= -55, "STRONG_FALL"), (x <= -20, "FALL"), default="FLAT")).drop("_ok", "_nv")


def market_measurement(frame: DataFrame, index_obs: DataFrame, universe: int, min_stocks: int = 30) -> DataFrame:
    """Closed-session breadth, regime and risk per session."""
    c, p, v = F.col("close"), F.col("prev_close"), F.col("volume")
    d = frame.filter(p.isNotNull()).groupBy("session_no").agg(
        F.count(F.lit(1)).alias("n"), count_if(c > p).alias("advancing"), count_if(c < p).alias("declining"),
        F.count("sma20").alias("n20"), F.count("sma50").alias("n50"),
        count_if(c > F.col("sma20")).alias("_a20"), count_if(c > F.col("sma50")).alias("_a50"),
        F.count(F.when(F.col("low20_prev") > 0, F.col("high20_prev"))).alias("n_hl"),
        count_if(F.col("high") > F.col("high20_prev")).alias("new_high"),
        count_if(F.col("low") < F.col("low20_prev")).alias("new_low"),
        F.sum(v).alias("_vol"), F.sum(F.when(c > p, v).otherwise(0.0)).alias("_upv"),
        F.sum(F.when(c < p, v).otherwise(0.0)).alias("_dnv"), F.count(v).alias("nv"),
    ).join(index_obs, "session_no", "left")
    n = F.col("n")
    d = d.withColumns({
        "above_sma20_pct": ratio(100 * F.col("_a20"), F.col("n20")),
        "above_sma50_pct": ratio(100 * F.col("_a50"), F.col("n50")),
        "up_volume_pct": ratio(100 * F.col("_upv"), F.col("_vol")),
        "coverage": n / universe,
        "_adv": 100 * (F.col("advancing") + 0.5 * (n - F.col("advancing") - F.col("declining"))) / n,
        "_hl": 50 + 50 * ratio(F.col("new_high") - F.col("new_low"), F.col("n_hl")),
        "_vs": F.when(F.col("nv") / n >= 0.6, 50 + 50 * ratio(F.col("_upv") - F.col("_dnv"), F.col("_vol"))),
    })
    values = {"advances": F.col("_adv"), "sma20": F.col("above_sma20_pct"), "sma50": F.col("above_sma50_pct"),
              "high_low": F.col("_hl"), "volume": F.col("_vs")}
    samples = {"advances": n, "sma20": F.col("n20"), "sma50": F.col("n50"), "high_low": F.col("n_hl"), "volume": F.col("nv")}
    d = d.withColumns({
        "breadth_score": weighted_available({k: (x, BREADTH_WEIGHTS[k]) for k, x in values.items()}),
        "_cc": sum([F.when(values[k].isNotNull(), w * samples[k] / n).otherwise(0.0) for k, w in BREADTH_WEIGHTS.items()], F.lit(0.0)),
        "_nvals": sum([F.when(x.isNotNull(), 1).otherwise(0) for x in values.values()], F.lit(0)),
    })
    level = lambda x: first_match((x == "POSITIVE", 100.0), (x == "NEUTRAL", 50.0), (x == "NEGATIVE", 0.0), default=None)
    vol = F.col("index_volatility")
    regime = {"breadth": F.col("breadth_score"), "index_trend": level(F.col("index_trend")),
              "index_momentum": level(F.col("index_momentum")),
              "volatility": first_match((vol == "LOW", 100.0), (vol == "NORMAL", 75.0), (vol == "HIGH", 25.0), (vol == "EXTREME", 0.0), default=None)}
    enough = (n >= min_stocks) & (F.col("coverage") >= 0.6)
    b = F.col("breadth_score")
    conflict = ((F.col("index_trend") == "POSITIVE") & (b < 40)) | ((F.col("index_trend") == "NEGATIVE") & (b >= 60))
    ic = sum([F.when(regime[k].isNotNull(), w).otherwise(0.0) for k, w in REGIME_WEIGHTS.items() if k != "breadth"], F.lit(0.0)) / 0.5
    d = d.withColumns({
        "regime_score": weighted_available({k: (x, REGIME_WEIGHTS[k]) for k, x in regime.items()}),
        "enough": enough, "conflict": F.coalesce(conflict, F.lit(False)),
        "_nreg": sum([F.when(x.isNotNull(), 1).otherwise(0) for x in regime.values()], F.lit(0)),
        "_ic": ic,
    })
    conf = 100 * F.col("coverage") * F.col("_cc") * (0.5 + 0.5 * F.col("_ic")) * F.when(F.col("conflict"), 0.75).otherwise(1.0)
    d = d.withColumn("regime_confidence", F.when(F.col("enough"), conf).otherwise(F.least(conf, F.lit(35.0))))
    final = F.col("enough") & (F.col("_nvals") >= 2) & (F.col("_nreg") >= 2) & (F.col("regime_confidence") >= 50)
    return d.withColumns({
        "final": final,
        "regime": F.when(final, state_label(F.col("regime_score"), REGIMES)),
        "breadth_state": F.when(F.col("enough") & (F.col("_nvals") >= 2), state_label(b, BREADTHS)),
        "risk_state": F.when(F.col("enough"), risk_class(vol, b, 100 * F.col("declining") / n, F.col("index_momentum"))),
        "data_status": first_match((F.col("enough") & F.col("index_trend").isNotNull() & (F.col("_nvals") == 5) & (F.col("_cc") >= 0.8), "GOOD"),
                                   (n > 0, "LIMITED"), default="INSUFFICIENT"),
    })


def sector_measurement(frame: DataFrame, index_obs: DataFrame, members: DataFrame, min_members: int = 5) -> DataFrame:
    """Relative strength, trend votes, velocity, breadth, volume and state per sector and session."""
    c, v, r1 = F.col("close"), F.col("volume"), F.col("return_1d")
    trend = F.when(F.col("sma20").isNotNull() & F.col("sma50").isNotNull(),
                   first_match(((c > F.col("sma20")) & (F.col("sma20") > F.col("sma50")), 1.0),
                               ((c < F.col("sma20")) & (F.col("sma20") < F.col("sma50")), -1.0), default=0.0))
    has = r1.isNotNull()
    d = frame.filter(F.col("prev_close").isNotNull()).groupBy("session_no", "sector").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(f"return_{h}d").alias(f"_m{h}") for h in (1, 5, 20)], *[F.count(f"return_{h}d").alias(f"_n{h}") for h in (1, 5, 20)],
        F.count("sma20").alias("n20"), F.count("sma50").alias("n50"),
        (100 * F.avg(F.when(F.col("sma20").isNotNull(), F.when(c > F.col("sma20"), 1.0).otherwise(0.0)))).alias("above_sma20_pct"),
        count_if(r1 > 0.01).alias("advancing"), count_if(r1 < -0.01).alias("declining"),
        F.sum(trend).alias("_tv"), F.count(trend).alias("_tn"),
        F.avg(F.col("sma20_slope") / c * 100).alias("_slope"),
        F.sum(F.when(has, v)).alias("_vol"), F.count(F.when(has, v)).alias("_nv"),
        F.sum(F.when(r1 > 0.01, v).otherwise(0.0)).alias("_uv"), F.sum(F.when(r1 < -0.01, v).otherwise(0.0)).alias("_dv"),
    ).join(members, "sector").join(index_obs, "session_no", "left")
    e = F.col("expected")
    ret = {h: F.when((F.col(f"_n{h}") >= min_members) & (F.col(f"_n{h}") / e >= 0.6), F.col(f"_m{h}")) for h in (1, 5, 20)}
    d = d.withColumns({f"sector_return_{h}d": x for h, x in ret.items()})
    d = d.withColumns({f"relative_{h}d": F.col(f"sector_return_{h}d") - F.col(f"index_return_{h}d") for h in (1, 5, 20)})
    rel = {h: F.col(f"relative_{h}d") for h in (1, 5, 20)}
    tv = F.col("_tv") + F.when(rel[20].isNotNull(), F.signum(rel[20])).otherwise(0.0)
    tn = F.col("_tn") + F.when(rel[20].isNotNull(), 1).otherwise(0)
    tmean = F.when(F.col("_tn") >= 2, tv / tn)
    velocity = rel[5] / 5 - rel[20] / 20
    d = d.withColumns({
        "rs_score": relative_score(rel),
        "trend_state": F.when(tmean.isNotNull(), first_match((tmean >= 0.35, "POSITIVE"), (tmean <= -0.35, "NEGATIVE"), default="NEUTRAL")),
        "breadth": ratio(100 * (F.col("advancing") + 0.5 * (F.col("_n1") - F.col("advancing") - F.col("declining"))), F.col("_n1")),
        "velocity": velocity,
        "volume_score": F.when((F.col("_vol") > 0) & (F.col("_nv") >= min_members) & (F.col("_nv") / e >= 0.6),
                               50 + 50 * (F.col("_uv") - F.col("_dv")) / F.col("_vol")),
    })
    mv = F.array_compact(F.array(clamp(F.col("velocity"), -1, 1), clamp(F.col("_slope"), -1, 1), (F.col("breadth") - 50) / 50))
    mom = F.when(F.col("velocity").isNotNull() & (F.size(mv) >= 2), F.aggregate(mv, F.lit(0.0), lambda a, x: a + x) / F.size(mv))
    d = d.withColumn("relative_momentum", mom)
    t = F.col("trend_state")
    parts = {"rs": F.col("rs_score"), "trend": first_match((t == "POSITIVE", 100.0), (t == "NEGATIVE", 0.0), (t.isNotNull(), 50.0), default=None),
             "momentum": 50 + 50 * F.col("relative_momentum"), "breadth": F.col("breadth"), "volume": F.col("volume_score")}
    known = sum([F.when(x.isNotNull(), 1).otherwise(0) for x in parts.values()], F.lit(0))
    hcov = F.least(F.col("_n1"), F.col("_n5"), F.col("_n20")) / e
    cov = F.col("n") / e
    bench = sum([F.when(F.col(f"index_return_{h}d").isNotNull(), 1).otherwise(0) for h in (1, 5, 20)], F.lit(0)) / 3
    base_conf = 100 * (0.40 * cov + 0.20 * F.least(F.col("n20"), F.col("n50")) / e + 0.15 * F.col("_nv") / e + 0.15 * hcov + 0.10 * bench)
    conflict = F.coalesce(((F.col("rs_score") >= 60) & (t == "NEGATIVE")) | ((F.col("rs_score") < 40) & (t == "POSITIVE")), F.lit(False))
    ok = (F.col("n") >= min_members) & (cov >= 0.6) & (hcov >= 0.6) & F.col("rs_score").isNotNull() & (known >= 3)
    conf = base_conf * F.when(conflict, 0.8).otherwise(1.0)
    d = d.withColumns({"state_score": weighted_available({k: (x, SECTOR_WEIGHTS[k]) for k, x in parts.items()}), "enough": ok,
                       "sector_confidence": F.least(F.lit(100.0), F.when(ok, conf).otherwise(F.least(conf, F.lit(40.0))))})
    m = F.col("relative_momentum")
    return d.withColumns({
        "sector_state": F.when(F.col("enough") & (F.col("sector_confidence") >= 50), state_label(F.col("state_score"), SECTOR_STATES)),
        "quadrant": F.when(F.col("enough"), rrg_quadrant(F.col("rs_score"), m)),
        "momentum_state": F.when(m.isNotNull(), first_match(
            ((m > 0.1) & (F.col("rs_score") >= 60), "STRONG"), (m > 0.1, "IMPROVING"),
            ((m < -0.1) & (F.col("rs_score") < 40), "WEAK"), (m < -0.1, "WEAKENING"), default="NEUTRAL")),
    })


def stock_vs_sector(frame: DataFrame, sectors: DataFrame) -> DataFrame:
    """Stock return minus sector return on three horizons, scored like a sector."""
    s = sectors.select("session_no", "sector", "sector_state", *[f"sector_return_{h}d" for h in (1, 5, 20)])
    d = frame.join(s, ["session_no", "sector"])
    d = d.withColumns({f"vs_sector_{h}d": F.col(f"return_{h}d") - F.col(f"sector_return_{h}d") for h in (1, 5, 20)})
    return d.withColumn("stock_score", relative_score({h: F.col(f"vs_sector_{h}d") for h in (1, 5, 20)}))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def asof_rows(left: DataFrame, right: DataFrame, key: list[str], at: str, known_at: str, value: list[str],
              bucket_seconds: int, tolerance_seconds: int | None = None) -> DataFrame:
    """Newest right row known at or before each left instant, without a range join.

    Both sides are cut into time buckets. Inside a bucket a union and a running
    last-value window find the match; what a bucket inherits is the last right row of
    the earlier buckets, found on one pre-aggregated row per bucket. A hot key is spread
    over its buckets, and no pair of rows is ever formed.
    """
    sec = lambda c: F.unix_micros(F.col(c)) / 1e6
    bucket = lambda c: F.floor(sec(c) / bucket_seconds)
    payload = F.struct(F.col(known_at).alias("known_at"), *[F.col(v) for v in value])
    r = right.filter(F.col(known_at).isNotNull()).select(*key, bucket(known_at).alias("_bkt"), payload.alias("_r"))
    lefts = left.withColumn("_bkt", bucket(at))
    heads = r.groupBy(*key, "_bkt").agg(F.max("_r").alias("_head"))
    marks = lefts.select(*key, "_bkt").distinct().unionByName(heads.select(*key, "_bkt")).distinct()
    w = W.partitionBy(*key).orderBy("_bkt").rowsBetween(W.unboundedPreceding, -1)
    carried = marks.join(heads, [*key, "_bkt"], "left").select(
        *key, "_bkt", F.last("_head", ignorenulls=True).over(w).alias("_carry"))
    row = F.struct(*[F.col(c) for c in left.columns])
    both = lefts.select(*key, "_bkt", F.col(at).alias("_at"), F.lit(1).alias("_side"), row.alias("_l"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r")).unionByName(
        r.select(*key, "_bkt", F.col("_r.known_at").alias("_at"), F.lit(0).alias("_side"),
                 F.lit(None).cast(lefts.select(row.alias("x")).schema["x"].dataType).alias("_l"), "_r"))
    wb = W.partitionBy(*key, "_bkt").orderBy("_at", "_side", "_r").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("_hit", F.last("_r", ignorenulls=True).over(wb)).filter("_side = 1").join(carried, [*key, "_bkt"], "left")
    hit = F.coalesce(F.col("_hit"), F.col("_carry"))
    if tolerance_seconds is not None:
        hit = F.when(sec("_at") - F.unix_micros(hit["known_at"]) / 1e6 <= tolerance_seconds, hit)
    return found.withColumn("_hit", hit).select("_l.*", F.col("_hit.known_at").alias("known_at"), *[F.col(f"_hit.{v}") for v in value])


def context_effects(df: DataFrame, limits: dict[str, float], threshold: float) -> DataFrame:
    """Bounded market, breadth and sector adjustment with a proportional total cap of 3."""
    raw = F.col("raw_score")
    unsafe = F.coalesce((raw < 70) | (F.col("rsi") >= 70) | (F.col("change_pct") > 4), F.lit(False))
    cols = {}
    for name, limit in limits.items():
        score, conf = F.col(f"{name}_score"), F.col(f"{name}_confidence")
        amount = F.when((conf >= 50) & score.isNotNull() & (raw >= threshold) & ~F.col("stale"), score / 100 * limit * conf / 100).otherwise(0.0)
        cols[f"{name}_effect"] = F.when(unsafe, F.least(F.lit(0.0), amount)).otherwise(amount)
    d = df.withColumns(cols)
    total = sum([F.col(f"{n}_effect") for n in limits], F.lit(0.0))
    scale = F.when(F.abs(total) > 3, 3 / F.abs(total)).otherwise(1.0)
    return d.withColumn("_scale", scale).withColumns({f"{n}_effect": F.col(f"{n}_effect") * F.col("_scale") for n in limits}).withColumn(
        "context_effect", sum([F.col(f"{n}_effect") for n in limits], F.lit(0.0))).drop("_scale")


def closed_observation(df: DataFrame) -> Column:
    """Daily row usable for breadth: positive, ordered OHLC with a previous close."""
    o, h, l, c, p = (F.col(x) for x in ("open", "high", "low", "close", "prev_close"))
    return (F.coalesce((o > 0) & (l > 0) & (c > 0) & (p > 0) & (l <= F.least(o, c)) & (F.greatest(o, c) <= h), F.lit(False)))


def change_vs(df: DataFrame, price: str, base: str) -> Column:
    return pct_change(F.col(price), F.col(base))
