"""Cohort reports over labelled examples."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sigspark.functions import stats as st
from sigspark.functions.scalars import clamp, first_match, ratio, score_band


def signal_name() -> Column:
    return F.when(F.col("model") == "TOMORROW_TOP10", "TOMORROW_TOP10").otherwise(F.col("decision"))


def buckets() -> dict[str, Column]:
    """Coarse condition buckets of a frozen record; NULL inputs give no bucket."""
    r, v, m = F.col("rsi"), F.col("volume_ratio"), F.col("momentum3")
    a, b = F.col("sma20"), F.col("sma50")
    return {
        "RSI": F.when(r.between(0, 100), first_match((r < 30, "<30"), (r < 50, "30-49"), (r < 70, "50-69"), default="70+")),
        "VOLUME": F.when(v >= 0, first_match((v < 100, "<100"), (v < 150, "100-149"), default="150+")),
        "SMA_TREND": F.when(a.isNotNull() & b.isNotNull(), F.when(a > b, "ABOVE").otherwise("BELOW_OR_EQUAL")),
        "OBV": F.col("obv_trend"),
        "MOMENTUM": F.when(m.isNotNull(), F.when(m > 0, "POSITIVE").otherwise("NEGATIVE_OR_ZERO")),
        "CONFIDENCE": score_band(F.col("confidence")),
    }


def signal_conditions() -> dict[str, Column]:
    """Condition families and combinations; unknown inputs leave a family out."""
    r, v, p = F.col("rsi"), F.col("volume_ratio"), F.col("price")

    def side(a, b):
        return F.when(a.isNotNull() & b.isNotNull(), first_match((a > b, "ABOVE"), (a < b, "BELOW"), default="EQUAL"))

    atr = 100 * F.col("atr14") / p
    rsi_ok = F.when(r.between(0, 100), (r >= 30) & (r < 70))
    vol_ok = F.when(v >= 0, v >= 150)
    trend = side(F.col("sma20"), F.col("sma50"))
    vwap = side(p, F.col("vwap20"))
    obv = first_match((F.col("obv_trend") == "RISING", "POSITIVE"), (F.col("obv_trend") == "FALLING", "NEGATIVE"),
                      (F.col("obv_trend") == "FLAT", "NEUTRAL"), default=None)

    def combo(*tests):
        known = [t.isNotNull() for t in tests]
        both = tests[0]
        k = known[0]
        for t, n in zip(tests[1:], known[1:]):
            both, k = both & t, k & n
        return F.when(k, F.when(both, "CONFIRMED").otherwise("NOT_CONFIRMED"))

    m = F.col("momentum3")
    return {
        "RSI": F.when(r.between(0, 100), first_match((r < 30, "0-29"), (r < 40, "30-39"), (r < 50, "40-49"), (r < 60, "50-59"), (r < 70, "60-69"), default="70-100")),
        "VOLUME": F.when(v >= 0, first_match((v < 80, "<80"), (v < 120, "80-119"), (v < 150, "120-149"), (v < 200, "150-199"), default="200+")),
        "PRICE_SMA20": side(p, F.col("sma20")), "PRICE_SMA50": side(p, F.col("sma50")), "SMA_TREND": trend, "VWAP": vwap, "OBV": obv,
        "BOLLINGER": F.col("bb_zone"),
        "BOLL_SQUEEZE": F.when(F.col("bb_squeeze").isNotNull(), F.when(F.col("bb_squeeze"), "YES").otherwise("NO")),
        "BOLL_BREAKOUT": F.when(F.col("bb_upper_break").isNotNull(), F.when(F.col("bb_upper_break"), "YES").otherwise("NO")),
        "ATR": F.when(atr > 0, first_match((atr < 2, "<2%"), (atr < 4, "2-4%"), default="4%+")),
        "MOMENTUM": F.when(m.isNotNull(), first_match((m > 0, "POSITIVE"), (m < 0, "NEGATIVE"), default="ZERO")),
        "COMBO_RSI_VOLUME": combo(rsi_ok, vol_ok),
        "COMBO_VWAP_OBV": combo(vwap == "ABOVE", obv == "POSITIVE"),
        "COMBO_TREND_VOLUME": combo(trend == "ABOVE", vol_ok),
    }


def long_labels(df: DataFrame, labels: dict[str, Column], keep: list[str], key: str = "indicator", value: str = "condition") -> DataFrame:
    items = F.array_compact(F.array(*[
        F.when(c.isNotNull(), F.struct(F.lit(k).alias(key), c.cast("string").alias(value))) for k, c in labels.items()]))
    return df.select(*keep, F.explode(items).alias("_i")).select(*keep, f"_i.{key}", f"_i.{value}")


def signal_keys() -> Column:
    band = score_band(F.col("score"))
    items = [F.struct(F.lit("overall").alias("kind"), F.lit("ALL").alias("name")),
             F.struct(F.lit("signals").alias("kind"), signal_name().alias("name")),
             F.when(band.isNotNull(), F.struct(F.lit("scores").alias("kind"), band.alias("name")))]
    items += [F.when(c.isNotNull(), F.struct(F.lit("criteria").alias("kind"), F.concat(F.lit(k + ":"), c).alias("name")))
              for k, c in buckets().items()]
    return F.array_compact(F.array(*items))


KEEP = ["horizon", "reason", "directional_return", "return_pct", "mfe", "mae"]


AGES = (7, 30, 90)


def age_class(asof: Column, at: Column) -> Column:
    """The narrowest look-back cohort a record is in; cohorts overlap, classes don't."""
    age = asof - at
    return first_match(*[((age >= 0) & (age <= n), n) for n in AGES], default=0)


def cohorts(age: str) -> Column:
    """All look-back cohorts that hold the records of an age class."""
    return F.array_compact(F.array(*[F.when((F.col(age) > 0) & (F.col(age) <= n), F.lit(str(n))) for n in AGES], F.lit("ALL")))


def signal_performance(examples: DataFrame, asof: DataFrame) -> DataFrame:
    d = examples.crossJoin(asof).withColumn("age", age_class(F.col("last_no"), F.col("session_no")))
    d = d.select("age", F.explode(signal_keys()).alias("_k"), *KEEP).select("age", "_k.kind", "_k.name", *KEEP)
    return st.outcome_stats(d, ["period", "kind", "name", "horizon"], roll=("age", "period", cohorts("age")))


def indicator_condition_performance(examples: DataFrame) -> DataFrame:
    d = long_labels(examples.withColumn("signal", signal_name()), signal_conditions(), ["signal", *KEEP])
    return st.outcome_stats(d, ["indicator", "condition", "signal_type", "horizon"], roll=("signal", "signal_type", F.array(F.lit("ALL"), F.col("signal"))))


def criterion_report(rows: DataFrame, flags, keys: list[str], minimum: int = 40, days: int = 5) -> DataFrame:
    """With and without each criterion: rates, interval of the difference and direction."""
    d = st.long_flags(rows, flags, [*keys, "session_no", "status", "completed", "return_pct", "target_hit", "stop_hit", "model", "decision"])
    known = d.filter(F.col("flag").isNotNull())
    k = [*keys, "criterion", "flag"]
    s = st.summarize(known, k).join(
        known.select(*k, "session_no").distinct().groupBy(*k).agg(F.count(F.lit(1)).alias("days")), k)
    cols = ["evaluated", "days", "success_rate", "success_low", "success_high", "median"]
    p = st.with_without(s, [*keys, "criterion"], cols)
    total = d.groupBy(*keys, "criterion").agg(st.count_if(F.col("flag").isNull()).alias("unknown"))
    p = p.join(total, [*keys, "criterion"])
    low = F.col("yes_success_low") - F.col("no_success_high")
    high = F.col("yes_success_high") - F.col("no_success_low")
    enough = F.coalesce((F.col("yes_evaluated") >= minimum) & (F.col("no_evaluated") >= minimum) & (F.col("yes_days") >= days)
                        & (F.col("no_days") >= days), F.lit(False))
    p = p.withColumns({"difference": F.col("yes_success_rate") - F.col("no_success_rate"), "low": low, "high": high, "enough": enough})
    return p.withColumn("direction", st.direction(F.col("low"), F.col("high"), F.col("yes_median"), F.col("no_median"), F.col("enough")))


def evidence_report(rows: DataFrame, flags, keys: list[str], minimum: int = 40, days: int = 5) -> DataFrame:
    d = st.long_flags(rows, flags, [*keys, "session_no", "status", "directional_return", "target_hit", "stop_hit", "decision", "max_rise", "max_drop"])
    s = st.evidence_stats(d.filter(F.col("flag").isNotNull()), [*keys, "criterion", "flag"], minimum, days)
    p = st.with_without(s, [*keys, "criterion"], ["sample", "days", "success_rate", "success_low", "success_high", "median", "sufficient"])
    low = F.col("yes_success_low") - F.col("no_success_high")
    high = F.col("yes_success_high") - F.col("no_success_low")
    p = p.withColumns({"difference": F.col("yes_success_rate") - F.col("no_success_rate"), "low": low, "high": high,
                       "enough": F.coalesce(F.col("yes_sufficient") & F.col("no_sufficient"), F.lit(False))})
    return p.withColumn("direction", st.direction(F.col("low"), F.col("high"), F.col("yes_median"), F.col("no_median"), F.col("enough")))


def combos(families: dict[str, str], sizes=(2, 3)) -> list[tuple[str, ...]]:
    """Vocabulary of criteria tuples from different families (fixed by the criteria list)."""
    out = []
    for size in sizes:
        for keys in combinations(families, size):
            if len({families[k] for k in keys}) == size:
                out.append(keys)
    return out


def combination_catalog(rows: DataFrame, families: dict[str, str], cap: int = 64) -> DataFrame:
    """Outcome-blind tuples ranked by known coverage; a quarter of the cap is kept for triples.

    Rows are first counted per pattern of known flags, so tuples meet patterns, not rows.
    """
    bit = {k: 1 << i for i, k in enumerate(families)}
    mask = sum([F.when(F.col(k).isNotNull(), b).otherwise(0) for k, b in bit.items()], F.lit(0)).cast("long")
    pat = rows.groupBy(mask.alias("m")).agg(F.count(F.lit(1)).alias("c"))
    items = F.array(*[F.struct(F.lit("+".join(k)).alias("combo"), F.lit(len(k)).alias("size"),
                               F.lit(sum(bit[x] for x in k)).cast("long").alias("need")) for k in combos(families)])
    cov = (pat.select("m", "c", F.explode(items).alias("i")).filter(F.col("m").bitwiseAND(F.col("i.need")) == F.col("i.need"))
           .groupBy("i.combo", "i.size").agg(F.sum("c").alias("coverage")))
    r = cov.withColumn("rank", F.row_number().over(W.partitionBy("size").orderBy(F.desc("coverage"), "combo")))
    triples = r.filter(F.col("size") == 3).agg(F.least(F.count(F.lit(1)), F.lit(cap // 4)).alias("nt"))
    return r.crossJoin(triples).filter(
        ((F.col("size") == 3) & (F.col("rank") <= cap // 4)) | ((F.col("size") == 2) & (F.col("rank") <= cap - F.col("nt")))).drop("nt")


def combination_report(rows: DataFrame, families: dict[str, str], keys: list[str], minimum: int = 50, days: int = 7) -> DataFrame:
    need = ["session_no", "status", "directional_return", "target_hit", "stop_hit", "decision", "max_rise", "max_drop"]
    items = []
    for k in combos(families):
        known, hit = F.col(k[0]).isNotNull(), F.col(k[0])
        for x in k[1:]:
            known, hit = known & F.col(x).isNotNull(), hit & F.col(x)
        items.append(F.struct(F.lit("+".join(k)).alias("criterion"), F.when(known, hit).alias("flag")))
    d = rows.select(*keys, *need, F.explode(F.array(*items)).alias("_f")).select(*keys, *need, "_f.*").filter(F.col("flag").isNotNull())
    s = st.evidence_stats(d, [*keys, "criterion", "flag"], minimum, days)
    p = st.with_without(s, [*keys, "criterion"], ["sample", "success_low", "success_high", "median", "sufficient"])
    low = F.col("yes_success_low") - F.col("no_success_high")
    high = F.col("yes_success_high") - F.col("no_success_low")
    enough = F.coalesce(F.col("yes_sufficient") & F.col("no_sufficient"), F.lit(False))
    dirn = st.direction(low, high, F.col("yes_median"), F.col("no_median"), enough)
    return p.withColumns({"enough": enough, "contribution": first_match((dirn == "UP", 0.25), (dirn == "DOWN", -0.25), default=0.0)})


def error_types() -> Column:
    """Failure types of a failed or stale labelled record, in fixed order; the last one is primary.

    Inputs beside the outcome: the evidence flags of the record, stale, entry_age (minutes) and
    entry_confirmed; an unknown flag accuses nobody.
    """
    failed = F.col("status").isin("STOP", "FAIL")
    short, stale = F.col("short"), F.coalesce("stale", F.lit(False))
    base, atr = F.col("price"), F.col("atr14")
    true = lambda k: F.coalesce(k, F.lit(False))
    false = lambda k: F.coalesce(~F.col(k), F.lit(False))
    name = first_match((short, "FALSE_SELL"), (F.col("decision") == "BUY", "FALSE_BUY"), default="UNKNOWN")
    kinds = (
        (stale, "STALE_DATA_ERROR"),
        (failed, name),
        (~short & true("MARKET_NEGATIVE"), "MARKET_CONTEXT_MISSED"),
        (~short & true("SECTOR_WEAK"), "SECTOR_CONTEXT_MISSED"),
        (true("NEWS_POSITIVE") & false("NEWS_PRICE_CONFIRMED"), "NEWS_FALSE_POSITIVE"),
        ((true("BOLLINGER_BREAK") | true("VOLUME_BREAKOUT")) & false("VOLUME"), "VOLUME_FALSE_BREAKOUT"),
        (F.abs(base - F.col("stop")) < atr * 0.75, "STOP_TOO_TIGHT"),
        ((F.abs(F.col("target") - base) > atr * 4) & ~F.col("target_hit"), "TARGET_TOO_AGGRESSIVE"),
        (F.col("entry_age") > 20, "LATE_ENTRY"),
        (false("entry_confirmed"), "EARLY_ENTRY"),
    )
    return F.when(failed | stale, F.array_compact(F.array(*[F.when(when, F.lit(k) if isinstance(k, str) else k) for when, k in kinds])))


def confidence_band() -> Column:
    v = F.col("confidence")
    return F.when(v.isNotNull(), first_match((v < 50, "0-49"), (v < 60, "50-60"), (v < 70, "60-70"), (v < 80, "70-80"), default="80+"))


def error_rates(rows: DataFrame, keys: list[str], minimum: int = 40, days: int = 5) -> DataFrame:
    """False-buy and false-sell rates, each hidden below the sample and day minimum."""
    side = F.when((F.col("decision") == "BUY"), "BUY").when((F.col("decision") == "SELL") & ~F.col("model").startswith("TOMORROW"), "SELL")
    d = rows.withColumn("_side", side)
    per = d.groupBy(*keys, "_side", "session_no").agg(
        F.count(F.lit(1)).alias("n"), st.count_if(F.col("status").isin("STOP", "FAIL")).alias("f"))
    agg = per.groupBy(*keys).agg(
        F.sum("n").alias("sample"), F.sum("f").alias("failures"), F.count_distinct("session_no").alias("days"),
        *[F.sum(F.when(F.col("_side") == s, F.col(c))).alias(f"{c}_{s}") for s in ("BUY", "SELL") for c in ("n", "f")],
        *[F.count_distinct(F.when(F.col("_side") == s, F.col("session_no"))).alias(f"d_{s}") for s in ("BUY", "SELL")])

    def rate(f, n, dd):
        return F.when((F.col(n) >= minimum) & (F.col(dd) >= days), F.col(f) / F.col(n))

    return agg.select(*keys, "sample", "failures", "days", rate("failures", "sample", "days").alias("error_rate"),
                      rate("f_BUY", "n_BUY", "d_BUY").alias("false_buy_rate"), rate("f_SELL", "n_SELL", "d_SELL").alias("false_sell_rate"))


def adjacent_warnings(bands: DataFrame, order: dict[str, int], keys: list[str]) -> DataFrame:
    """Sufficient neighbour bands whose higher one does not do better."""
    pos = F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.lit(v))])
    w = W.partitionBy(*keys).orderBy("_o")
    d = bands.filter("sufficient").withColumn("_o", pos[F.col("band")])
    d = d.withColumns({"lower_band": F.lag("band").over(w), "_lr": F.lag("success_rate").over(w), "_ll": F.lag("success_low").over(w)})
    return d.filter(F.col("success_rate") <= F.col("_lr")).select(
        *keys, "lower_band", F.col("band").alias("higher_band"), (F.col("success_high") < F.col("_ll")).alias("clear"))


def candidate_effect(a: str, b: str) -> Column:
    """Hit-rate and return-quality association of an active against an inactive cohort."""
    clip = lambda x: clamp(F.col(x), -10, 10)
    return (0.6 * (F.col(f"{a}success_rate") - F.col(f"{b}success_rate"))
            + 0.25 * (F.col(f"{a}clipped") - F.col(f"{b}clipped")) / 20
            + 0.15 * (clip(f"{a}median") - clip(f"{b}median")) / 20)


def indicator_stats(rows: DataFrame, keys: list[str], asof_no: int | None = None) -> DataFrame:
    """Hit rate, clipped mean, median, maturity- and size-weighted confidence."""
    ok = F.col("reason").isNull()
    v = F.when(ok, F.col("directional_return"))
    g = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample"), st.count_if(ok).alias("eligible"), st.count_if(v > 0).alias("wins"),
        F.avg(v).alias("avg_return"), F.avg(clamp(v, -10, 10)).alias("clipped"),
        F.avg(F.when(ok, F.when(F.col("mfe").isNotNull() & F.col("mae").isNotNull(), 1.0).otherwise(0.0))).alias("_full"))
    r = st.robust(rows.filter(ok), keys, "directional_return").select(*keys, "median")
    g = g.join(r, keys, "left") if keys else g.crossJoin(r)
    n = F.col("eligible")
    conf = F.least(F.lit(100.0), 100.0 * n / (n + 100)) * n / F.col("sample") * (0.75 + 0.25 * F.coalesce(F.col("_full"), F.lit(0.0)))
    return g.withColumns({
        "success_rate": ratio(F.col("wins"), n), "confidence": conf,
        "data_status": first_match((n >= 300, "STRONG_SAMPLE"), (n >= 100, "USABLE"), (n >= 30, "EARLY"), default="INSUFFICIENT"),
    }).drop("_full")
