"""News text: folding, amounts, lexicon score, candidate links, latest-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sigspark.functions.scalars import first_match
from sigspark.operators.context import asof_rows

# Letters folded to ASCII, keyword weights, routine and high-importance words.
FOLD = ("çğıöşü", "cgiosu")
POSITIVE = {
    "sozlesme": 2.5, "ihale": 1.5, "siparis": 2.0, "yatirim": 1.2, "tesvik": 1.8, "onay": 1.2, "ruhsat": 1.2, "temettu": 1.4,
    "kar payi": 1.4, "geri alim": 1.8, "bedelsiz": 1.0, "ihracat": 1.5, "yeni pazar": 1.5, "kapasite artisi": 1.6,
    "uretim artisi": 1.4, "borc odeme": 1.2, "kredi notu artisi": 2.0, "kar artisi": 2.2, "net kar": 1.0,
}
NEGATIVE = {
    "zarar": -2.0, "dava": -1.5, "ceza": -2.0, "sorusturma": -1.8, "faaliyet durdurma": -3.0, "uretim durdu": -3.0,
    "uretime ara": -2.5, "iflas": -5.0, "konkordato": -5.0, "temerrut": -4.0, "borc yapilandirma": -2.0,
    "kredi notu dususu": -2.2, "sermaye kaybi": -3.0, "bedelli": -0.8, "pay satisi": -1.0, "ortak satisi": -1.3, "kar dususu": -2.0,
}
ROUTINE = ("genel kurul", "yonetim kurulu", "komite", "bagimsiz denetim", "faaliyet raporu", "surdurulebilirlik", "esas sozlesme")
IMPORTANT = ("sozlesme", "ihale", "siparis", "iflas", "konkordato", "temerrut", "faaliyet durdurma", "uretim durdu", "ceza",
             "sorusturma", "birlesme", "devralma", "satinalma", "temettu", "geri alim")


def fold_text(x) -> Column:
    """Lower case, ASCII letters, every other run of characters one blank."""
    t = F.translate(F.lower(F.col(x) if isinstance(x, str) else x), *FOLD)
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def lexicon_score(folded: Column, positive=None, negative=None, routine=ROUTINE, important=IMPORTANT) -> dict[str, Column]:
    """Keyword weights, routine dampening, importance and confidence over the whole text."""
    words = {**(POSITIVE if positive is None else positive), **(NEGATIVE if negative is None else negative)}
    hit = {w: folded.contains(w) for w in words}
    raw = sum([F.when(h, F.lit(words[w])).otherwise(0.0) for w, h in hit.items()], F.lit(0.0))
    found = sum([F.when(h, 1).otherwise(0) for h in hit.values()], F.lit(0))
    any_of = lambda ws: F.exists(F.array(*[folded.contains(w) for w in ws]), lambda b: b)
    calm = any_of(routine) & ~any_of(important)
    score = F.greatest(F.lit(-10.0), F.least(F.lit(10.0), raw * F.when(calm, 0.45).otherwise(1.0)))
    return {
        "score": score, "found": found,
        "importance": first_match((any_of(important), 80), (calm, 30), default=55),
        "confidence": F.least(F.lit(95), 45 + F.least(F.lit(40), found * 8)),
    }


def impact_class(score: Column) -> Column:
    return first_match((score >= 6, "STRONG_POSITIVE"), (score >= 2, "POSITIVE"), (score <= -6, "STRONG_NEGATIVE"),
                       (score <= -2, "NEGATIVE"), default="NEUTRAL")


def candidate_links(news: DataFrame, key: str, seconds: int = 21600) -> DataFrame:
    """Duplicate candidates of one symbol within the time window, as links, not as pairs.

    Items meet only under an equal block key (folded title or body hash). In a time
    bucket every item is linked to the bucket's first item; neighbouring buckets are
    linked once. A group of n copies gives n - 1 links, so a hot group stays linear.
    """
    t = F.unix_timestamp("published_at")
    d = news.select("symbol", F.col(key).alias("_k"), "news_id", t.alias("_t"), F.floor(t / seconds).alias("_b"))
    item = F.struct("_t", "news_id")
    g = d.groupBy("symbol", "_k", "_b").agg(F.min(item).alias("_first"), F.max(item).alias("_last"), F.count(F.lit(1)).alias("_n"))
    inner = d.join(g.filter("_n > 1"), ["symbol", "_k", "_b"]).filter(F.col("news_id") != F.col("_first.news_id")).select(
        "symbol", F.col("_first.news_id").alias("anchor_id"), "news_id")
    prev = F.lag("_last").over(W.partitionBy("symbol", "_k").orderBy("_b"))  # one row per bucket
    step = g.withColumn("_p", prev).filter(F.col("_first._t") - F.col("_p._t") <= seconds).select(
        "symbol", F.col("_p.news_id").alias("anchor_id"), F.col("_first.news_id").alias("news_id"))
    return inner.unionByName(step)


def latest_k(news: DataFrame, k: int = 5, bucket_seconds: int = 86400) -> DataFrame:
    """k newest items per symbol: first per (symbol, day), then over the survivors."""
    order = [F.desc("published_at"), F.desc("news_id")]
    d = news.withColumn("_b", F.floor(F.unix_timestamp("published_at") / bucket_seconds))
    d = d.withColumn("_r", F.row_number().over(W.partitionBy("symbol", "_b").orderBy(*order))).filter(F.col("_r") <= k)
    day = d.groupBy("symbol", "_b").agg(F.count(F.lit(1)).alias("_n"))
    run = W.partitionBy("symbol").orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)
    keep = day.withColumn("_newer", F.coalesce(F.sum("_n").over(run), F.lit(0))).filter(F.col("_newer") < k).select("symbol", "_b")
    d = d.join(keep, ["symbol", "_b"], "left_semi")
    return d.withColumn("rank", F.row_number().over(W.partitionBy("symbol").orderBy(*order))).filter(F.col("rank") <= k).drop("_b", "_r")


#: Query parameters that only track where a reader came from.
TRACKING = "(?i)^(utm_.*|fbclid|gclid)(=.*)?$"


def canonical_url(u: Column) -> Column:
    """Lower-case host without www, path without trailing slash, sorted query without tracking
    parameters and empty values, no fragment."""
    plain = F.regexp_replace(u, "#.*$", "")
    bare = F.regexp_replace(F.regexp_replace(plain, "[?].*$", ""), "/+$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[a-zA-Z]+://([^/]+)", 1)), "^www\\.", "")
    given = F.split(F.regexp_extract(plain, "[?](.*)$", 1), "&")
    kept = F.array_sort(F.filter(given, lambda p: p.rlike("=.") & ~p.rlike(TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.concat(host, F.regexp_extract(bare, "^[a-zA-Z]+://[^/]+(.*)$", 1), query)


def reference_prices(news: DataFrame, quotes: DataFrame, asks: DataFrame, hours: int = 6, bucket_seconds: int = 3600) -> DataFrame:
    """symbol, news_id, asked_at, reference_price: for each question about a symbol, its live news and
    the first price seen at or after the publication, if that was strictly before the question.

    The forward as-of is the backward one on mirrored time. News are live for ``hours``; they meet
    questions by equal symbol and hour, so no range join is formed.
    """
    mirrored = lambda c: F.timestamp_micros(F.lit(0).cast("long") - F.unix_micros(c))
    seen = quotes.select("symbol", mirrored(F.col("event_time")).alias("known"), "price", F.col("event_time").alias("seen_at"))
    left = news.select("news_id", "symbol", "published_at", mirrored(F.col("published_at")).alias("at"))
    priced = asof_rows(left, seen, ["symbol"], "at", "known", ["price", "seen_at"], bucket_seconds)
    hour = lambda c: F.floor(F.unix_timestamp(c) / 3600)
    live = priced.withColumn("h", F.explode(F.sequence(hour(F.col("published_at")), hour(F.col("published_at")) + hours)))
    met = live.join(asks.withColumn("h", hour(F.col("asked_at"))), ["symbol", "h"])
    age = F.unix_micros("asked_at") - F.unix_micros("published_at")
    return met.filter((age >= 0) & (age < hours * 3_600_000_000)).select(
        "symbol", "news_id", "asked_at", F.when(F.col("seen_at") < F.col("asked_at"), F.col("price")).alias("reference_price"))
