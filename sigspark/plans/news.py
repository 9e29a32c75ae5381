"""News and text queries."""

from pyspark.sql import functions as F

from sigspark.operators import news as nw
from sigspark.plans.registry import fragment, query
from sigspark.sources import fixtures as fx

FOLD = "trim(regexp_replace(translate(lower({0}),'çğıöşü','cgiosu'),'[^a-z0-9]+',' ','g'))"
fragment("folded", f"SELECT news_id, symbol, published_at, {FOLD.format('title')} AS ft, {FOLD.format('body')} AS fb FROM newsf")


def folded(s, d):
    return fx.news(s, d).select("news_id", "symbol", "published_at", nw.fold_text("title").alias("ft"), nw.fold_text("body").alias("fb"))


query("fold_text", "SELECT news_id, ft, sha256(fb) AS body_hash FROM folded")(lambda s, d: folded(s, d).select("news_id", "ft", F.sha2("fb", 256).alias("body_hash")))
query("content_hash", "SELECT news_id, sha256(fb) AS body_hash FROM folded")(lambda s, d: folded(s, d).select("news_id", F.sha2("fb", 256).alias("body_hash")))

# The invented prose holds none of the domain words, so the fixture adds some that it does hold.
POS = {**nw.POSITIVE, "thou": 2.0, "ation": 1.2, "erin": 0.8}
NEG = {**nw.NEGATIVE, "onthe": -1.5, "hand": -2.0, "tere": -1.1}
ROUT, IMP = (*nw.ROUTINE, "there"), (*nw.IMPORTANT, "heth")
_w = {**POS, **NEG}
_has = lambda ws: "(" + " OR ".join(f"contains(fb,'{w}')" for w in ws) + ")"
_raw = "+".join(f"CASE WHEN contains(fb,'{w}') THEN {v} ELSE 0 END" for w, v in _w.items())
_cnt = "+".join(f"CASE WHEN contains(fb,'{w}') THEN 1 ELSE 0 END" for w in _w)
fragment("nlex", f"""
 SELECT news_id, symbol, published_at, greatest(-10,least(10,({_raw})*CASE WHEN {_has(ROUT)} AND NOT {_has(IMP)} THEN 0.45 ELSE 1 END)) AS score, {_cnt} AS found,
  CASE WHEN {_has(IMP)} THEN 80 WHEN {_has(ROUT)} THEN 30 ELSE 55 END AS importance, least(95,45+least(40,({_cnt})*8)) AS confidence FROM folded""")
CLS = "CASE WHEN score>=6 THEN 'STRONG_POSITIVE' WHEN score>=2 THEN 'POSITIVE' WHEN score<=-6 THEN 'STRONG_NEGATIVE' WHEN score<=-2 THEN 'NEGATIVE' ELSE 'NEUTRAL' END"


def lexed(s, d):
    return folded(s, d).withColumns(nw.lexicon_score(F.col("fb"), POS, NEG, ROUT, IMP))


query("news_lexicon_score", f"SELECT news_id, score, found, importance, confidence, {CLS} AS impact FROM nlex", f="score")(
    lambda s, d: lexed(s, d).select("news_id", "score", "found", "importance", "confidence", nw.impact_class(F.col("score")).alias("impact")))
query("class_labels", f"SELECT news_id, {CLS} AS impact FROM nlex")(lambda s, d: lexed(s, d).select("news_id", nw.impact_class(F.col("score")).alias("impact")))

ALARM = "CASE WHEN abs(score)>=6 AND confidence>=60 THEN 'CRITICAL' WHEN abs(score)>=2 AND importance>=55 THEN 'IMPORTANT' ELSE 'NORMAL' END"
query("latest_news_k", "SELECT symbol, news_id, rank FROM (SELECT symbol, news_id, row_number() OVER (PARTITION BY symbol ORDER BY published_at DESC, news_id DESC) AS rank FROM newsf) AS q WHERE rank<=5")(
    lambda s, d: nw.latest_k(fx.news(s, d)).select("symbol", "news_id", "rank"))
query("news_score_recent5", """
 SELECT symbol, sum(score/rank)/sum(1.0/rank) AS score, max(confidence) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY published_at DESC, news_id DESC) AS rank FROM nlex) AS q WHERE rank<=5 GROUP BY symbol""", f="score")(
    lambda s, d: nw.latest_k(lexed(s, d)).groupBy("symbol").agg((F.sum(F.col("score") / F.col("rank")) / F.sum(1.0 / F.col("rank"))).alias("score"), F.max("confidence").alias("confidence")))
query("news_candidate_pairs", """
 WITH d AS (SELECT symbol, fb AS k, news_id, CAST(epoch(published_at) AS BIGINT) AS t, CAST(epoch(published_at) AS BIGINT)//21600 AS b FROM folded),
 g AS (SELECT symbol, k, b, min(t) AS ft_, arg_min(news_id,t) AS fid, max(t) AS lt_, arg_max(news_id,t) AS lid, count(*) AS n FROM d GROUP BY symbol, k, b),
 p AS (SELECT *, lag(lid) OVER w AS pid, lag(lt_) OVER w AS pt FROM g WINDOW w AS (PARTITION BY symbol, k ORDER BY b))
 SELECT d.symbol, g.fid AS anchor_id, d.news_id FROM d JOIN g USING (symbol,k,b) WHERE n>1 AND d.news_id<>fid UNION ALL SELECT symbol, pid, fid FROM p WHERE ft_-pt<=21600""")(
    lambda s, d: nw.candidate_links(folded(s, d).withColumn("key", F.sha2("fb", 256)), "key"))
query("canonical_url", r"""
 WITH a AS (SELECT page_id, regexp_replace(url,'#.*$','') AS p FROM pages), b AS (SELECT page_id, regexp_replace(regexp_replace(p,'[?].*$',''),'/+$','') AS u, list_sort(list_filter(string_split(regexp_extract(p,'[?](.*)$',1),'&'), lambda x: regexp_matches(x,'=.') AND NOT regexp_full_match(lower(x),'(utm_.*|fbclid|gclid)(=.*)?'))) AS q FROM a)
 SELECT page_id, regexp_replace(lower(regexp_extract(u,'^[a-zA-Z]+://([^/]+)',1)),'^www\.','')||regexp_extract(u,'^[a-zA-Z]+://[^/]+(.*)$',1)||CASE WHEN len(q)>0 THEN '?'||array_to_string(q,'&') ELSE '' END AS url FROM b""")(
    lambda s, d: fx.table(s, d, "pages").select("page_id", nw.canonical_url(F.col("url")).alias("url")))
query("extract_articles")(lambda s, d: fx.table(s, d, "pages").select(
    "page_id", nw.canonical_url(F.col("url")).alias("url"), F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"),
    F.sha2(nw.fold_text(F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"<[^>]+>", " ")), 256).alias("content_id")))
