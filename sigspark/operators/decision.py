"""Final decision from sided confirmations, and rule-table scoring of macro news."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.functions.scalars import clamp, first_match
from sigspark.operators.outcomes import evaluated

TECH = ("trend", "momentum", "volume", "position", "obv", "bollinger")


def side(x: Column, tolerance: float = 0.0) -> Column:
    return F.when(x.isNotNull(), first_match((x > tolerance, 1), (x < -tolerance, -1), default=0))


def confirmations(df: DataFrame) -> DataFrame:
    """Six technical sides and the risk side of a wide daily row; unknown stays NULL."""
    macd = side(F.col("macd") - F.col("macd_signal"))
    mom = side(F.col("momentum3"), 0.05)
    mom = F.when(F.coalesce(macd * mom < 0, F.lit(False)), 0).otherwise(mom)
    obv = first_match((F.col("obv_divergence") == "NEGATIVE", -1), (F.col("obv_trend") == "RISING", 1), (F.col("obv_trend") == "FALLING", -1),
                      (F.col("obv_trend") == "FLAT", 0), default=None)
    d = evaluated(df.withColumns({
        "c_macd": macd, "c_trend": side(F.col("sma20") - F.col("sma50")), "c_momentum": mom, "c_position": side(F.col("close") - F.col("sma20")), "c_obv": obv,
        "c_bollinger": first_match((F.col("squeeze_break"), 1), (F.col("bb_lower_break"), -1), (F.col("bb_mid").isNotNull(), 0), default=None),
        "c_risk": F.when(F.col("rr").isNotNull(), F.when(F.col("rr") >= 1.5, 1).otherwise(-1))}))
    v = F.col("volume_ratio_incl")
    d = d.withColumn("c_volume", F.when(v.isNotNull(), F.when((v >= 100) & F.col("c_momentum").isin(1, -1), F.col("c_momentum")).otherwise(0)))

    def count(x):
        return sum([F.when(F.col(f"c_{k}") == x, 1).otherwise(0) for k in TECH], F.lit(0))

    return evaluated(d.withColumns({"ups": count(1), "downs": count(-1)}))


def final_decision(df: DataFrame, thresholds=(82, 70, 35, 20)) -> DataFrame:
    """Five decisions with the list of blocks that forbid a buy."""
    strong_buy, buy, sell, strong_sell = thresholds
    t, m, score, conf = F.col("c_trend"), F.col("c_momentum"), F.col("score"), F.col("confidence")
    yes = lambda c: F.coalesce(c, F.lit(False))
    d = confirmations(df)
    mixed = ((F.col("ups") >= 2) & (F.col("downs") >= 2)) | yes((F.col("c_macd") == -1) & (F.col("c_position") == 1) & (F.col("c_obv") == -1))
    d = evaluated(d.withColumn("mixed", mixed).withColumn("confidence", F.when(F.col("mixed"), F.least(conf, F.lit(49.0))).otherwise(conf)))
    blocks = F.array_compact(F.array(
        F.when(F.col("change_pct") <= -7, F.lit("HARD_FALL")), F.when(F.col("change_pct") > 4, F.lit("EXTENDED_RISE")),
        F.when(~yes(F.col("c_risk") == 1), F.lit("RISK_REWARD")), F.when(F.col("rsi") >= 75, F.lit("OVERBOUGHT")),
        F.when(F.col("mixed"), F.lit("MIXED")), F.when(F.col("confidence") < 50, F.lit("LOW_CONFIDENCE"))))
    d = evaluated(d.withColumn("blocks", blocks))
    up = yes((t == 1) | (m == 1))
    down = yes((t == -1) | (m == -1))
    ok_buy = (F.size("blocks") == 0) & (F.col("ups") >= 3) & up & (score >= 65) & (score >= buy)
    all_up = yes((t == 1) & (m == 1) & (F.col("c_volume") == 1))
    ok_sell = (F.col("confidence") >= 50) & ~F.col("mixed") & (F.col("downs") >= 2) & down & (score <= sell)
    return d.withColumn("final", first_match(
        (ok_buy & (score >= strong_buy) & (F.col("ups") >= 5) & all_up, "STRONG_BUY"), (ok_buy, "BUY"),
        (ok_sell & (score <= strong_sell) & (F.col("downs") >= 4), "STRONG_SELL"), (ok_sell, "SELL"), default="WAIT"))


# Macro rule groups. A group applies when one of its words occurs; its
# cases then add to the general score and set sector scores (a later setting wins).
# A case marked ELSE only applies when the case before it did not.
MACRO = (
    ("RATES", ("tcmb", "politika faizi", "faiz kararı", "faiz indir", "faiz artır", "faiz artir"), (
        ("ALSO", ("faiz indir", "indirim", "beklentinin altında faiz"), 2.0, {"REAL_ESTATE": 5.0, "CONSTRUCTION": 4.0, "FINANCE": 3.0, "TRADE": 2.0}),
        ("ALSO", ("faiz artır", "faiz artir", "faiz artışı", "faiz artisi"), -2.0, {"REAL_ESTATE": -5.0, "CONSTRUCTION": -4.0, "TRADE": -2.0}))),
    ("INFLATION", ("enflasyon", "tüfe", "tuik", "tüik"), (
        ("ALSO", ("beklentinin üzerinde", "beklentiden yüksek", "yükseldi", "arttı"), -2.0, {"REAL_ESTATE": -2.5, "CONSTRUCTION": -2.0, "TRADE": -1.5}),
        ("ELSE", ("beklentinin altında", "beklentiden düşük", "geriledi", "düştü"), 2.0, {"REAL_ESTATE": 2.5, "CONSTRUCTION": 2.0, "FINANCE": 1.5}))),
    ("OIL", ("brent", "ham petrol", "petrol fiyat", "petrol yükseldi", "petrol düştü"), (
        ("ALSO", ("yükseldi", "arttı", "artış", "sıçradı"), 0.0, {"TRANSPORT": -5.0, "INDUSTRY": -1.0}),
        ("ELSE", ("düştü", "geriledi", "düşüş"), 0.0, {"TRANSPORT": 5.0, "INDUSTRY": 1.0}))),
    ("CURRENCY", ("dolar/tl", "usdtry", "döviz", "kur yükseldi", "tl değer kaybetti", "tl deger kaybetti"), (
        ("ALSO", ("yükseldi", "değer kaybetti", "deger kaybetti"), -1.0, {"TRANSPORT": -2.0, "TRADE": -1.0}),)),
    ("GOLD", ("altın", "altin", "ons altın", "ons altin"), (("ALSO", ("yükseldi", "arttı", "rekor"), 0.0, {"MINING": 3.0}),)),
    ("FED", ("fed", "fomc", "powell", "abd faiz"), (
        ("ALSO", ("faiz indir", "güvercin", "guvercin"), 2.0, {}), ("ALSO", ("faiz artır", "faiz artir", "şahin", "sahin"), -2.0, {}))),
)


def macro_score(text: Column, groups=MACRO) -> tuple[Column, Column, dict[str, Column]]:
    """Category (last group that applies), general score (sum), sector scores (last setting)."""
    any_of = lambda ws: F.exists(F.array(*[text.contains(w) for w in ws]), lambda b: b)
    category, general, sectors = F.lit("GENERAL"), F.lit(0.0), {}
    for name, words, cases in groups:
        on = any_of(words)
        category = F.when(on, name).otherwise(category)
        before = F.lit(False)
        for kind, ws, add, effects in cases:
            hit = on & any_of(ws) & (~before if kind == "ELSE" else F.lit(True))
            before = hit
            general = general + F.when(hit, add).otherwise(0.0)
            for sector, score in effects.items():
                sectors[sector] = F.when(hit, score).otherwise(sectors.get(sector, F.lit(None).cast("double")))
    return category, clamp(general, -10, 10), sectors
