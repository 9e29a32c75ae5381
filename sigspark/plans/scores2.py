"""Second group of score, record and text queries."""

from __future__ import annotations

import os
from hashlib import sha256

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sigspark.functions import stats as st
from sigspark.functions.scalars import first_match, stable_id
from sigspark.operators import context as cx
from sigspark.operators import indicators as ind
from sigspark.operators import learning as ln
from sigspark.operators import scoring as sc
from sigspark.operators.outcomes import evaluated
from sigspark.plans.context import measurement, vs_sector
from sigspark.plans.records_fixture import FLAGS, examples, labelled, predictions
from sigspark.plans.registry import ORACLES, fragment, query
from sigspark.plans.reports import ok
from sigspark.plans.scoring import rows, sql_sum
from sigspark.session import complete, shared_dir
from sigspark.sources import fixtures as fx

query("daily_technical_score", f"SELECT symbol, session_no, greatest(0,least(100,50+{sql_sum(sc.TECHNICAL_RULES)}))::DOUBLE AS score FROM wrow", f="score")(
    lambda s, d: rows(s, d).select("symbol", "session_no", sc.technical_score().cast("double").alias("score")))
CLS = ORACLES["signal_class"]
query("aggressive_quality", f"SELECT w.symbol, w.session_no, signal_class, CASE signal_class WHEN 'AGGRESSIVE_BUY' THEN greatest(0,least(100,{sql_sum(sc.QUALITY_BUY)})) ELSE greatest(0,least(100,{sql_sum(sc.QUALITY_SELL)})) END::DOUBLE AS quality FROM wrow w JOIN ({CLS}) c ON w.symbol=c.symbol AND w.session_no=c.session_no WHERE signal_class IN ('AGGRESSIVE_BUY','AGGRESSIVE_SELL')", f="quality")(
    lambda s, d: evaluated(rows(s, d).withColumn("signal_class", sc.signal_class(None))).filter("signal_class LIKE 'AGGRESSIVE%'").select("symbol", "session_no", "signal_class", sc.aggressive_quality(F.col("signal_class")).cast("double").alias("quality")))
RSQ = """least(25,greatest(0,(rsi-prev_rsi)*4))+least(20,greatest(0,(macd_hist-prev_hist)*20))+least(20,greatest(0,volume_ratio_incl/10))+least(20,greatest(0,close_position/5))+CASE WHEN change_pct BETWEEN 0 AND 2 THEN 15 WHEN change_pct>2 AND change_pct<=3 THEN 10 WHEN change_pct>3 AND change_pct<=4 THEN 0 WHEN change_pct>4 THEN -10 ELSE 3 END+CASE WHEN rr>=2 THEN least(5,rr) ELSE 0 END"""
REQ = "rsi-prev_rsi>=0.5 AND macd_hist>prev_hist AND volume_ratio_incl>=90 AND close_position>=50"
query("reaction_score", f"SELECT symbol, session_no, {RSQ} AS score FROM wrow WHERE {REQ}", f="score")(
    lambda s, d: rows(s, d).filter(sc.strong_reaction()).select("symbol", "session_no", sc.reaction_score().alias("score")))
query("reaction_top10", f"SELECT session_no, symbol, rank FROM (SELECT session_no, symbol, row_number() OVER (PARTITION BY session_no ORDER BY round({RSQ},6) DESC, round(volume_ratio_incl,6) DESC, round(close_position,6) DESC, symbol) AS rank FROM wrow WHERE {REQ}) AS q WHERE rank<=10")(
    lambda s, d: sc.top_k(rows(s, d).filter(sc.strong_reaction()).withColumn("score", sc.reaction_score()), 10, F.round("score", 6).desc(), F.round("volume_ratio_incl", 6).desc(), F.round("close_position", 6).desc(), F.col("symbol"), group=("session_no",)).select("session_no", "symbol", "rank"))

_br = "coalesce(h.prev_close<=h.high20_prev AND h.close>h.high20_prev,false)"
_ISCORE = f"""
 SELECT symbol, bar_no, CASE WHEN from_open<=-7 THEN 'HARD_FALL' WHEN from_open>=9.5 THEN 'HARD_RISE' END AS excluded, CASE WHEN from_open>-7 AND from_open<9.5 THEN greatest(0,least(100,{sql_sum(sc.INTRADAY_RULES)}+CASE WHEN br AND volume_ratio>=130 THEN 15 WHEN br THEN 6 ELSE 0 END)) END::DOUBLE AS score
 FROM (SELECT h.*, h.session_no AS bar_no, e.macd_hist, e.prev_macd-e.prev_signal AS prev_hist, from_open, from_low, to_high, {_br} AS br FROM hind h JOIN hemas e ON h.symbol=e.symbol AND h.session=e.session JOIN hshape s ON s.symbol=h.symbol AND s.bar_start=h.session) AS q"""
query("intraday_score", _ISCORE, f="score")(lambda s, d: _iscore(s, d))


fragment("isc_", _ISCORE)
query("intraday_top10", """
 SELECT bar_no, symbol, rank FROM (SELECT c.bar_no, c.symbol, row_number() OVER (PARTITION BY c.bar_no ORDER BY score DESC, round(h.volume3_ratio,6) DESC NULLS LAST, round(h.momentum3,6) DESC NULLS LAST, c.symbol) AS rank
 FROM isc_ c JOIN hind h ON h.symbol=c.symbol AND h.session_no=c.bar_no WHERE score>=45) AS q WHERE rank<=10""")(lambda s, d: _itop(s, d))


def _itop(s, d):
    """Ten best intraday scores of a bar; ties by three-bar volume, then momentum."""
    x = _iscore(s, d, "volume3_ratio", "momentum3").filter("score >= 45")
    return sc.top_k(x, 10, F.desc("score"), F.round("volume3_ratio", 6).desc_nulls_last(), F.round("momentum3", 6).desc_nulls_last(), F.col("symbol"), group=("bar_no",)).select("bar_no", "symbol", "rank")


def _iscore(s, d, *more):
    h = fx.hourly_bars(s, d)
    shape = ind.intraday_shape(h).select("symbol", F.col("bar_no").alias("session_no"), "from_open", "from_low", "to_high")
    b = h.select("symbol", F.col("symbol").alias("sector"), F.col("bar_start").alias("session"), "open", "high", "low", "close", "volume", F.col("bar_no").alias("session_no"))
    f = ind.indicator_frame(b, ind.BarWindow("symbol", order="session_no")).withColumn("prev_hist", F.col("prev_macd") - F.col("prev_signal"))
    x = f.join(shape, ["symbol", "session_no"])
    brk = F.coalesce((F.col("prev_close") <= F.col("high20_prev")) & (F.col("close") > F.col("high20_prev")), F.lit(False))
    return x.select("symbol", F.col("session_no").alias("bar_no"), sc.intraday_exclusion().alias("excluded"), sc.intraday_score(brk, brk & F.coalesce(F.col("volume_ratio") >= 130, F.lit(False))).cast("double").alias("score"), *more)


query("fast_prescan", "SELECT symbol, session_no, points FROM (SELECT symbol, session_no, CASE WHEN volume_ratio_incl>=150 THEN 3 WHEN volume_ratio_incl>=110 THEN 2 ELSE 0 END+CASE WHEN abs(change_pct)>=2 THEN 2 ELSE 0 END+CASE WHEN close>sma5 THEN 1 ELSE 0 END+CASE WHEN sma5>sma10 THEN 1 ELSE 0 END AS points FROM ind) AS q WHERE points>=4")(
    lambda s, d: _frame(s, d).select("symbol", "session_no", F.expr("CASE WHEN volume_ratio_incl>=150 THEN 3 WHEN volume_ratio_incl>=110 THEN 2 ELSE 0 END + CASE WHEN abs(change_pct)>=2 THEN 2 ELSE 0 END + CASE WHEN close>sma5 THEN 1 ELSE 0 END + CASE WHEN sma5>sma10 THEN 1 ELSE 0 END").alias("points")).filter("points >= 4"))


def _frame(s, d):
    from sigspark.plans.records_fixture import frame

    return frame(s, d)


query("alignment", "SELECT v.symbol, v.session_no, CASE WHEN stock_score>=80 AND sector_state='LEADING' AND m.regime='STRONG_BULL' THEN 'STRONG_ALIGNMENT' WHEN stock_score>=60 AND sector_state IN ('LEADING','STRONG') AND m.regime IN ('BULL','STRONG_BULL') THEN 'POSITIVE_ALIGNMENT' WHEN stock_score<40 AND sector_state IN ('WEAK','LAGGING') AND m.regime IN ('BEAR','STRONG_BEAR') THEN 'NEGATIVE_ALIGNMENT' ELSE 'MIXED' END AS alignment FROM svs v JOIN mmeas m ON v.session_no=m.session_no WHERE stock_score IS NOT NULL AND sector_state IS NOT NULL AND m.regime IS NOT NULL")(
    lambda s, d: vs_sector(s, d).join(measurement(s, d).select("session_no", "regime"), "session_no").select("symbol", "session_no", cx.alignment(F.col("stock_score"), F.col("sector_state"), F.col("regime")).alias("alignment")).filter("alignment IS NOT NULL"))
query("due_at", "SELECT event_id, strftime(least(make_timestamp(CAST(ceil(epoch_us(ts)/300e6)*300e6 AS BIGINT))+INTERVAL 60 MINUTE, date_trunc('day',ts)+INTERVAL 1090 MINUTE),'%Y-%m-%d %H:%M:%S') AS due FROM events")(
    lambda s, d: fx.table(s, d, "events").select("event_id", F.least(F.timestamp_seconds((F.ceil(F.unix_micros(F.col("ts").cast("timestamp")) / 3e8) * 300).cast("long")) + F.expr("INTERVAL 60 MINUTES"), F.date_trunc("day", "ts").cast("timestamp") + F.expr("INTERVAL 1090 MINUTES")).alias("due")))
query("assemble_record", "SELECT p.signal_id, count(o.horizon) FILTER (WHERE o.completed) AS done, max(CASE WHEN o.horizon=1 THEN o.return_pct END) AS return_1, max(CASE WHEN o.horizon=5 THEN o.return_pct END) AS return_5 FROM preds p LEFT JOIN outc o ON p.signal_id=o.signal_id GROUP BY p.signal_id", f="return_1 return_5")(
    lambda s, d: predictions(s, d).select("signal_id").join(labelled(s, d).groupBy("signal_id").agg(st.count_if(F.col("completed")).alias("done"), *[F.max(F.when(F.col("horizon") == h, F.col("return_pct"))).alias(f"return_{h}") for h in (1, 5)]), "signal_id", "left")
    .select("signal_id", F.coalesce("done", F.lit(0)).alias("done"), "return_1", "return_5"))
query("append_predictions", "SELECT sha256(CAST(session_no AS VARCHAR)||chr(31)||symbol||chr(31)||decision||chr(31)||source) AS id, rank<=10 AS in_list, CASE WHEN rank<=10 THEN rank END AS list_rank FROM preds WHERE session_no%4<>1")(
    lambda s, d: predictions(s, d).withColumn("id", stable_id("", "session_no", "symbol", "decision", "source")).join(predictions(s, d).filter("session_no % 4 = 1").select(stable_id("", "session_no", "symbol", "decision", "source").alias("id")), "id", "left_anti")
    .select("id", (F.col("rank") <= 10).alias("in_list"), F.when(F.col("rank") <= 10, F.col("rank")).alias("list_rank")))
query("paired_list_verified", "SELECT signal_id, horizon, CASE WHEN source<>'DAILY_SCAN' THEN 'UNVERIFIED_SNAPSHOT' WHEN model LIKE '%SHADOW%' THEN 'NON_LIVE' WHEN reason IN ('UNVERIFIED','FUTURE_FEATURES') THEN reason WHEN NOT completed THEN 'PENDING' END AS issue FROM ex WHERE rank<=10")(
    lambda s, d: examples(s, d).filter("rank <= 10").select("signal_id", "horizon", first_match((F.col("source") != "DAILY_SCAN", "UNVERIFIED_SNAPSHOT"), (F.col("model").contains("SHADOW"), "NON_LIVE"), (F.col("reason").isin("UNVERIFIED", "FUTURE_FEATURES"), F.col("reason")), (~F.col("completed"), "PENDING"), default=None).alias("issue")))
query("map_condition_flags", "SELECT signal_id, len(list_filter([f_rsi,f_trend,f_volume,f_momentum,f_obv,f_bollinger], lambda x: x IS NOT NULL)) AS available, len(list_filter([f_rsi,f_trend,f_volume,f_momentum,f_obv,f_bollinger], lambda x: x)) AS active FROM preds")(
    lambda s, d: predictions(s, d).withColumn("m", F.create_map(*[x for f in FLAGS for x in (F.lit(f), F.struct(F.col(f).isNotNull().alias("available"), F.col(f).alias("active")))]))
    .select("signal_id", F.size(F.map_filter("m", lambda _, v: v["available"])).alias("available"), F.size(F.map_filter("m", lambda _, v: F.coalesce(v["active"], F.lit(False)))).alias("active")))

# Amounts with unit; the invented prose holds none of the units, so the fixture adds a symbol and words it does hold.
UNITS = {"tl": "tl", "try": "tl", "usd": "usd", "dolar": "usd", "eur": "eur", "euro": "eur", "%": "%", "adet": "adet", "###": "###", "&&&": "&&&", "the": "the", "de": "de"}
SCALES = {"milyon": 1_000_000, "million": 1_000_000, "milyar": 1_000_000_000, "billion": 1_000_000_000}
AMT = rf"([0-9]+(?:[.,][0-9]+)*)\s*({'|'.join(SCALES)})?\s*(tl|try|usd|dolar|eur|euro|adet|the|de|%|###|&&&)(?![0-9a-z])"
_plain = "CASE WHEN contains(n,',') THEN replace(replace(n,'.',''),',','.') WHEN length(n)-length(replace(n,'.',''))>1 OR regexp_matches(n,'[.][0-9]{3}$') THEN replace(n,'.','') ELSE n END"
_unit = "CASE u WHEN 'try' THEN 'tl' WHEN 'dolar' THEN 'usd' WHEN 'euro' THEN 'eur' ELSE u END"
query("money_amounts", rf"""
 WITH a AS (SELECT doc_id, unnest(regexp_extract_all(translate(lower(text),'çğıöşü','cgiosu'), '([0-9]+(?:[.,][0-9]+)*)\s*(milyon|milyar|million|billion)?\s*(tl|try|usd|dolar|eur|euro|adet|the|de|%|###|&&&)([^0-9a-z]|$)', ['n','s','u','z'])) AS m FROM documents),
 b AS (SELECT doc_id, m.n AS n, m.s AS s, m.u AS u FROM a)
 SELECT DISTINCT doc_id, {_unit} AS unit, TRY_CAST({_plain} AS DOUBLE)*CASE s WHEN 'milyon' THEN 1e6 WHEN 'million' THEN 1e6 WHEN 'milyar' THEN 1e9 WHEN 'billion' THEN 1e9 ELSE 1 END AS amount FROM b WHERE TRY_CAST({_plain} AS DOUBLE) IS NOT NULL""", f="amount")(lambda s, d: money(fx.table(s, d, "documents")))


def money(docs):
    """Amounts of a text: separators told apart, scale words applied, unit names joined, letters folded."""
    folded = F.translate(F.lower("text"), "çğıöşü", "cgiosu")
    found = docs.select("doc_id", F.explode(F.regexp_extract_all(folded, F.lit(AMT), F.lit(0))).alias("m"))
    part = lambda k: F.regexp_extract("m", AMT, k)
    n = part(1)
    points = F.length(n) - F.length(F.replace(n, F.lit("."), F.lit("")))
    bare = F.replace(n, F.lit("."), F.lit(""))
    value = F.when(F.contains(n, F.lit(",")), F.replace(bare, F.lit(","), F.lit("."))).when((points > 1) | n.rlike("[.][0-9]{3}$"), bare).otherwise(n)
    scale = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SCALES.items() for x in kv]), part(2)), F.lit(1))
    unit = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])[part(3)]
    out = found.select("doc_id", unit.alias("unit"), (value.try_cast("double") * scale).alias("amount"))
    return out.filter("amount IS NOT NULL").distinct()


# --- landed records: written once, read back with a fixed schema ---------------------------------
def landed(df, name, key, fmt="json"):
    """Freeze a frame in the shared folder under its key; a complete version is never written again."""
    path = os.path.join(shared_dir(df.sparkSession), name, sha256(key.encode()).hexdigest()[:24])
    if not complete(df.sparkSession, path):
        df.write.mode("overwrite").format(fmt).save(path)
    return path


query("read_record_json", "SELECT signal_id, symbol, decision, price FROM preds", f="price")(lambda s, d: _read_json(s, d))


def _read_json(s, d):
    p = predictions(s, d).select("symbol", F.struct("signal_id", "symbol", "decision", "price").alias("r"), F.floor(F.col("session_no") / 4).alias("b"))
    doc = p.groupBy("symbol", "b").agg(F.collect_list("r").alias("records")).select("records")  # four sessions of one symbol: at most four records
    return s.read.schema("records ARRAY<STRUCT<signal_id:STRING,symbol:STRING,decision:STRING,price:DOUBLE>>").json(landed(doc, "records", d)).select(F.inline("records"))


query("write_once_snapshot", "SELECT session_no, symbol, rank FROM preds WHERE rank<=10")(
    lambda s, d: s.read.schema("session_no INT, symbol STRING, rank INT").parquet(landed(predictions(s, d).filter("rank <= 10").select("session_no", "symbol", "rank"), "snapshots", d, "parquet")))
query("read_snapshots", "SELECT session_no, list, symbol, rank FROM (SELECT session_no, unnest(['TOP10','TOP3']) AS list, unnest([10,3]) AS k, symbol, rank FROM preds) AS q WHERE rank<=k")(lambda s, d: _snapshots(s, d))


def _snapshots(s, d):
    """Archive documents with two ranked lists each, exploded back to one row per list and rank."""
    item = F.struct("rank", "symbol")
    doc = predictions(s, d).filter("rank <= 10").groupBy("session_no").agg(F.array_sort(F.collect_list(item)).alias("top10"), F.array_sort(F.collect_list(F.when(F.col("rank") <= 3, item))).alias("top3"))
    a = s.read.schema("session_no INT, top10 ARRAY<STRUCT<rank:INT,symbol:STRING>>, top3 ARRAY<STRUCT<rank:INT,symbol:STRING>>").json(landed(doc, "archives", d))
    lists = F.create_map(F.lit("TOP10"), F.col("top10"), F.lit("TOP3"), F.col("top3"))
    return a.select("session_no", F.explode(lists).alias("list", "rows")).select("session_no", "list", F.posexplode("rows").alias("pos", "r")).select("session_no", "list", "r.symbol", (F.col("pos") + 1).alias("rank"))
