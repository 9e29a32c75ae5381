"""Sources, gates, records and joins over the fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sigspark.functions import stats as st
from sigspark.functions.scalars import canonical_symbol, finite, first_match, minutes_between, next_bar_start, num_or_null
from sigspark.operators import bars as br
from sigspark.operators import records as rc
from sigspark.plans.records_fixture import examples, labelled, last_session, predictions
from sigspark.plans.registry import fragment, query
from sigspark.sources import fixtures as fx

T = "strftime({}, '%Y-%m-%d %H:%M:%S')"
query("scan_daily_bars", "SELECT symbol, sector, CAST(session AS VARCHAR) AS session, open, high, low, close, volume, session_no FROM bars", f="open high low close volume")(
    lambda s, d: fx.weekly_bars(s, d).select("symbol", "sector", "session", "open", "high", "low", "close", "volume", "session_no"))
query("scan_intraday_bars", f"SELECT symbol, {T.format('bar_start')} AS bar_start, open, high, low, close, volume, slot FROM hours", f="open high low close volume")(
    lambda s, d: fx.hourly_bars(s, d).select("symbol", "bar_start", "open", "high", "low", "close", "volume", "slot"))
query("scan_quotes", f"SELECT event_type AS symbol, event_id AS quote_id, value AS price, {T.format('ts')} AS event_time FROM events WHERE value>0 AND ts<=TIMESTAMP '2024-01-20 00:00:00'", f="price")(
    lambda s, d: fx.quotes(s, d).filter("price > 0 AND event_time <= TIMESTAMP'2024-01-20 00:00:00'").select("symbol", "quote_id", "price", "event_time"))


def calendar(bounds, holidays=("01-01", "05-01", "12-25")):
    """Weekday sessions from ``lo`` to ``hi`` of a one-row frame, without fixed holidays, numbered from 1.

    One row per calendar day: the window over it is bounded by the date range.
    """
    days = bounds.select(F.explode(F.sequence("lo", "hi")).alias("session"))
    days = days.filter((F.weekday("session") < 5) & ~F.date_format("session", "MM-dd").isin(*holidays))
    at = F.col("session").cast("timestamp")
    return days.select("session", F.row_number().over(W.orderBy("session")).alias("session_no"),
                       (at + F.expr("INTERVAL '18:10' HOUR TO MINUTE")).alias("data_ready_at"), (at + F.expr("INTERVAL '18:15' HOUR TO MINUTE")).alias("close_at"))


CAL = "SELECT d AS session, row_number() OVER (ORDER BY d) AS session_no FROM (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS d FROM (SELECT min(o_orderdate)::DATE AS lo, max(o_orderdate)::DATE AS hi FROM orders) AS b) AS q WHERE isodow(d)<6 AND strftime(d,'%m-%d') NOT IN ('01-01','05-01','12-25')"
fragment("cal", CAL)
query("dim_calendar", f"SELECT CAST(c.session AS VARCHAR) AS session, c.session_no, {T.format('c.session + INTERVAL 1090 MINUTE')} AS data_ready_at, {T.format('c.session + INTERVAL 1095 MINUTE')} AS close_at, count(o.o_orderkey) AS orders FROM cal c LEFT JOIN orders o ON CAST(o.o_orderdate AS DATE)=c.session GROUP BY c.session, c.session_no")(
    lambda s, d: calendar(fx.table(s, d, "orders").agg(F.min("o_orderdate").cast("date").alias("lo"), F.max("o_orderdate").cast("date").alias("hi"))).join(fx.table(s, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("session")).agg(F.count(F.lit(1)).alias("n")), "session", "left")
    .select("session", "session_no", "data_ready_at", "close_at", F.coalesce("n", F.lit(0)).alias("orders")))
query("dim_universe", "SELECT c_custkey, CASE WHEN regexp_full_match(u,'[A-Z0-9]{2,12}') THEN u END AS symbol FROM (SELECT c_custkey, regexp_replace(upper(trim(' '||substr(c_mktsegment,1,1+c_custkey%12)||CASE WHEN c_custkey%3=0 THEN '.is' ELSE '' END)),'\\.IS$','') AS u FROM customer) AS q")(
    lambda s, d: fx.table(s, d, "customer").select("c_custkey", canonical_symbol(F.concat(F.lit(" "), F.expr("substr(c_mktsegment, 1, cast(1 + c_custkey % 12 as int))"), F.when(F.col("c_custkey") % 3 == 0, ".is").otherwise(""))).alias("symbol")))
query("dim_sector_map", "SELECT symbol, sector FROM symdim")(lambda s, d: fx.symbol_dim(s, d))
query("closed_bars", f"SELECT symbol, {T.format('bar_start')} AS bar_start, close FROM hours WHERE bar_start+INTERVAL 1 HOUR<=TIMESTAMP '2024-01-15 12:30:00'", f="close")(
    lambda s, d: br.closed_bars(fx.hourly_bars(s, d), F.lit("2024-01-15 12:30:00").cast("timestamp"), "bar_start", "1 HOUR").select("symbol", "bar_start", "close"))

# Copies and contradictions are planted in both normalisers: every 7th session repeats, every 11th differs.
fragment("dupbars", "SELECT symbol, session_no, open, high, low, close FROM bars UNION ALL SELECT symbol, session_no, open, high, low, close FROM bars WHERE session_no%7=0 UNION ALL SELECT symbol, session_no, open, high*2, low, close FROM bars WHERE session_no%11=0")


def _dup(b, no):
    c = ["symbol", no, "open", "high", "low", "close"]
    return b.select(*c).unionByName(b.filter(F.col(no) % 7 == 0).select(*c)).unionByName(b.filter(F.col(no) % 11 == 0).withColumn("high", F.col("high") * 2).select(*c))


query("normalize_daily_bars", "SELECT symbol, session_no, min(open) AS open, min(high) AS high, min(low) AS low, min(close) AS close FROM dupbars GROUP BY symbol, session_no HAVING count(DISTINCT (open,high,low,close))=1 AND bool_and(low>0 AND low<=least(open,close) AND greatest(open,close)<=high)", f="open high low close")(
    lambda s, d: br.normalize_bars(_dup(fx.weekly_bars(s, d), "session_no"), ["symbol", "session_no"]))
query("normalize_intraday_bars", "SELECT symbol, bar_no, open, high, low, close FROM hours WHERE slot BETWEEN 10 AND 17 AND bar_no%11<>0 AND low>0 AND low<=least(open,close) AND greatest(open,close)<=high", f="open high low close")(
    lambda s, d: br.normalize_bars(_dup(fx.hourly_bars(s, d).filter("slot BETWEEN 10 AND 17"), "bar_no"), ["symbol", "bar_no"]))
query("validate_intraday_frame", "SELECT symbol, CAST(day AS VARCHAR) AS day, count(*) AS n, bool_and(low>0 AND volume>0) AS positive, max(slot)-min(slot)+1=count(*) AS spaced, count(*)>=20 AND bool_and(low>0 AND volume>0) AND max(slot)-min(slot)+1=count(*) AS valid FROM hours GROUP BY symbol, day")(
    lambda s, d: fx.hourly_bars(s, d).groupBy("symbol", "day").agg(F.count(F.lit(1)).alias("n"), F.bool_and((F.col("low") > 0) & (F.col("volume") > 0)).alias("positive"), (F.max("slot") - F.min("slot") + 1 == F.count(F.lit(1))).alias("spaced"))
    .withColumn("valid", (F.col("n") >= 20) & F.col("positive") & F.col("spaced")))
query("session_contiguity", "SELECT symbol, session_no, session_no-lag(session_no,5) OVER (PARTITION BY symbol ORDER BY session_no)=5 AS contiguous FROM bars")(
    lambda s, d: fx.weekly_bars(s, d).select("symbol", "session_no", (F.col("session_no") - F.lag("session_no", 5).over(W.partitionBy("symbol").orderBy("session_no")) == 5).alias("contiguous")))
query("staleness", f"SELECT symbol, {T.format('max(ts)')} AS data_time, max(ts)<TIMESTAMP '2024-01-30 23:59:59'-INTERVAL 1200 SECOND AS stale FROM (SELECT event_type AS symbol, ts FROM events) AS q GROUP BY symbol")(
    lambda s, d: fx.quotes(s, d).groupBy("symbol").agg(F.max("event_time").alias("data_time")).withColumn("stale", F.col("data_time") < F.lit("2024-01-30 23:59:59").cast("timestamp") - F.expr("INTERVAL 1200 SECONDS")))
query("quote_validity", "SELECT symbol, count(*) FILTER (WHERE st='MISSING') AS missing, count(*) FILTER (WHERE st='FUTURE') AS future, count(*) FILTER (WHERE st='STALE') AS stale, count(*) FILTER (WHERE st='OK') AS ok, arg_max(price, event_time) FILTER (WHERE st='OK') AS newest FROM (SELECT event_type AS symbol, ts AS event_time, value AS price, CASE WHEN value IS NULL OR value<=0 THEN 'MISSING' WHEN ts>TIMESTAMP '2024-01-20 12:00:00' THEN 'FUTURE' WHEN ts<TIMESTAMP '2024-01-20 09:00:00' THEN 'STALE' ELSE 'OK' END AS st FROM events) AS q GROUP BY symbol", f="newest")(
    lambda s, d: fx.quotes(s, d).withColumn("st", first_match((F.col("price").isNull() | (F.col("price") <= 0), "MISSING"), (F.col("event_time") > F.lit("2024-01-20 12:00:00").cast("timestamp"), "FUTURE"), (F.col("event_time") < F.lit("2024-01-20 09:00:00").cast("timestamp"), "STALE"), default="OK"))
    .groupBy("symbol").agg(*[st.count_if(F.col("st") == v).alias(n) for n, v in (("missing", "MISSING"), ("future", "FUTURE"), ("stale", "STALE"), ("ok", "OK"))], F.max_by("price", F.when(F.col("st") == "OK", F.col("event_time"))).alias("newest")))
query("tag_performance_source", "SELECT signal_id, CASE WHEN model LIKE '%SHADOW%' THEN 'SHADOW' WHEN model LIKE '%BACKTEST%' THEN 'BACKTEST' WHEN model IN ('TOMORROW_TOP10','COMMON','NEWS','MACRO') THEN 'LIVE' ELSE 'UNKNOWN' END AS source FROM preds")(
    lambda s, d: predictions(s, d).select("signal_id", first_match((F.col("model").contains("SHADOW"), "SHADOW"), (F.col("model").contains("BACKTEST"), "BACKTEST"), (F.col("model").isin("TOMORROW_TOP10", "COMMON", "NEWS", "MACRO"), "LIVE"), default="UNKNOWN").alias("source")))
query("feature_provenance_reason", "SELECT signal_id, CASE WHEN feature_at>signal_at THEN 'FUTURE_FEATURES' END AS reason FROM preds")(
    lambda s, d: predictions(s, d).select("signal_id", F.when(F.col("feature_at") > F.col("signal_at"), "FUTURE_FEATURES").alias("reason")))
query("outcome_consistency_reason", "SELECT signal_id, horizon, CASE WHEN abs(return_pct-(exit_price/price-1)*100)>1e-4 THEN 'RETURN_MISMATCH' WHEN mfe<0 OR mae>0 THEN 'EXCURSION_MISMATCH' END AS reason FROM ex WHERE completed")(
    lambda s, d: examples(s, d).filter("completed").select("signal_id", "horizon", first_match((F.abs(F.col("return_pct") - (F.col("exit_price") / F.col("price") - 1) * 100) > 1e-4, "RETURN_MISMATCH"), ((F.col("mfe") < 0) | (F.col("mae") > 0), "EXCURSION_MISMATCH"), default=None).alias("reason")))
query("merge_bar_cache", "SELECT symbol, bar_no, arg_max(close, v) AS close FROM (SELECT symbol, bar_no, close, 0 AS v FROM hours UNION ALL SELECT symbol, bar_no, close*1.01, 1 FROM hours WHERE bar_no%5=0) AS q WHERE bar_no>(SELECT max(bar_no) FROM hours)-168 GROUP BY symbol, bar_no", f="close")(lambda s, d: _cache(s, d))


def _cache(s, d):
    h = fx.hourly_bars(s, d).select("symbol", "bar_no", "close")
    both = h.withColumn("v", F.lit(0)).unionByName(h.filter("bar_no % 5 = 0").withColumn("close", F.col("close") * 1.01).withColumn("v", F.lit(1)))
    newest = h.agg(F.max("bar_no").alias("_m"))
    return br.latest_per_key(both.crossJoin(newest).filter("bar_no > _m - 168"), ["symbol", "bar_no"], ["v"], ["close"])


query("merge_latest_rows", "SELECT symbol, arg_max(close, session_no) AS close, max(session_no) AS session_no FROM bars GROUP BY symbol", f="close")(
    lambda s, d: br.latest_per_key(fx.weekly_bars(s, d), ["symbol"], ["session_no"], ["close", "session_no"]))
query("universe_status", "SELECT d.symbol, CASE WHEN b.symbol IS NULL THEN 'NO_DATA' ELSE 'ANALYSED' END AS status, close FROM symdim d LEFT JOIN (SELECT symbol, close FROM bars WHERE session_no=(SELECT last_no FROM lastno) AND volume>100) b ON d.symbol=b.symbol", f="close")(
    lambda s, d: fx.symbol_dim(s, d).select("symbol").join(fx.weekly_bars(s, d).filter("volume > 100").join(last_session(fx.weekly_bars(s, d)), F.col("session_no") == F.col("last_no")).select("symbol", "close"), "symbol", "left")
    .select("symbol", F.when(F.col("close").isNull(), "NO_DATA").otherwise("ANALYSED").alias("status"), "close"))
query("exact_duplicate_audit", "SELECT count(*) AS dup_groups, sum(c-1)::BIGINT AS extra_copies, sum((c-1)*n)::BIGINT AS extra_chars FROM (SELECT sha256(text) AS h, length(text) AS n, count(*) AS c FROM documents GROUP BY sha256(text), length(text) HAVING count(*)>1) AS q")(
    lambda s, d: fx.table(s, d, "documents").groupBy(F.sha2("text", 256).alias("h"), F.length("text").alias("n")).agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    .agg(F.count(F.lit(1)).alias("dup_groups"), F.sum(F.col("c") - 1).alias("extra_copies"), F.sum((F.col("c") - 1) * F.col("n")).alias("extra_chars")))
# Duplicates: ids ending in 7 come twice, half of them with another price.
fragment("dupr", "SELECT symbol, session_no, model, signal_id, price FROM preds UNION ALL SELECT symbol, session_no, model, signal_id||'X', CASE WHEN session_no%2=0 THEN price*1.5 ELSE price END FROM preds WHERE signal_id LIKE '%7' UNION ALL SELECT symbol, session_no+100000, model, signal_id, price FROM preds WHERE signal_id LIKE '%13'")
query("dedupe_records", "WITH b AS (SELECT signal_id FROM dupr GROUP BY signal_id HAVING count(DISTINCT session_no)>1) SELECT symbol, session_no, model, count(*) AS copies, min(signal_id) AS kept_id, count(DISTINCT price)>1 OR bool_or(signal_id IN (SELECT signal_id FROM b)) AS conflict FROM dupr GROUP BY symbol, session_no, model")(lambda s, d: _dedupe(s, d))


def _dedupe(s, d):
    c = ["symbol", "session_no", "model", "signal_id", "price"]
    p = predictions(s, d).select(*c)
    two = p.filter("signal_id LIKE '%7'").withColumns({"signal_id": F.concat("signal_id", F.lit("X")), "price": F.when(F.col("session_no") % 2 == 0, F.col("price") * 1.5).otherwise(F.col("price"))})
    three = p.filter("signal_id LIKE '%13'").withColumn("session_no", F.col("session_no") + 100000)
    return rc.dedupe_records(p.unionByName(two).unionByName(three), ["symbol", "session_no", "model"], ["price"], "signal_id")


query("merge_immutable_records", """
 WITH st AS (SELECT signal_id, price, CASE WHEN session_no%3=0 THEN score END AS res FROM preds WHERE session_no%4<>0), inc AS (SELECT signal_id, CASE WHEN session_no%10=0 THEN price+1 ELSE price END AS price, CASE WHEN session_no%9=0 THEN score+1 ELSE score END AS res FROM preds)
 SELECT i.signal_id, CASE WHEN s.signal_id IS NULL THEN 'INSERT' WHEN s.price<>i.price OR (s.res IS NOT NULL AND s.res IS DISTINCT FROM i.res) THEN 'CONFLICT' WHEN s.res IS NULL AND i.res IS NOT NULL THEN 'UPDATE' ELSE 'DUPLICATE' END AS action FROM inc i LEFT JOIN st s ON i.signal_id=s.signal_id""")(lambda s, d: _merge(s, d))


def _merge(s, d):
    p = predictions(s, d)
    n = F.col("session_no")
    stored = p.filter(n % 4 != 0).select("signal_id", "price", F.when(n % 3 == 0, F.col("score")).alias("res"))
    inc = p.select("signal_id", F.when(n % 10 == 0, F.col("price") + 1).otherwise(F.col("price")).alias("price"), F.when(n % 9 == 0, F.col("score") + 1).otherwise(F.col("score")).alias("res"))
    return rc.merge_immutable(stored, inc, ["signal_id"], ["price"], ["res"])


query("conflict_report", "SELECT action, count(*) AS n FROM (SELECT CASE WHEN session_no%4=0 THEN 'INSERT' WHEN session_no%10=0 OR (session_no%3=0 AND session_no%9=0 AND score IS NOT NULL) THEN 'CONFLICT' WHEN session_no%3<>0 AND score IS NOT NULL THEN 'UPDATE' ELSE 'DUPLICATE' END AS action FROM preds) AS q GROUP BY action")(
    lambda s, d: _merge(s, d).groupBy("action").agg(F.count(F.lit(1)).alias("n")))
query("anti_join_seen", "SELECT p.signal_id FROM preds p WHERE NOT EXISTS (SELECT 1 FROM preds q WHERE q.signal_id=p.signal_id AND q.session_no%4<>0)")(
    lambda s, d: predictions(s, d).select("signal_id").join(predictions(s, d).filter("session_no % 4 <> 0").select("signal_id"), "signal_id", "left_anti"))
query("except_known", "SELECT symbol FROM (SELECT DISTINCT symbol FROM bars EXCEPT SELECT symbol FROM symdim WHERE sector='ASIA') AS q")(
    lambda s, d: fx.weekly_bars(s, d).select("symbol").distinct().exceptAll(fx.symbol_dim(s, d).filter("sector = 'ASIA'").select("symbol")))
query("horizon_slots", "SELECT p.signal_id, h.horizon, p.session_no+h.horizon AS target_no, CASE WHEN coalesce(o.completed,false) THEN 'COMPLETED' ELSE 'PENDING' END AS state FROM preds p CROSS JOIN hz h LEFT JOIN outc o ON p.signal_id=o.signal_id AND h.horizon=o.horizon")(
    lambda s, d: predictions(s, d).select("signal_id", "session_no", F.explode(F.array(*[F.lit(h) for h in (1, 3, 5, 10, 20, 60)])).alias("horizon"))
    .join(labelled(s, d).select("signal_id", "horizon", "completed"), ["signal_id", "horizon"], "left")
    .select("signal_id", "horizon", (F.col("session_no") + F.col("horizon")).alias("target_no"), F.when(F.col("completed"), "COMPLETED").otherwise("PENDING").alias("state")))
query("pending_outcomes", "SELECT p.signal_id, h.horizon FROM preds p CROSS JOIN hz h CROSS JOIN lastno WHERE p.session_no+h.horizon<=last_no AND NOT EXISTS (SELECT 1 FROM outc o WHERE o.signal_id=p.signal_id AND o.horizon=h.horizon AND o.completed)")(
    lambda s, d: predictions(s, d).crossJoin(last_session(fx.weekly_bars(s, d))).select("signal_id", "session_no", "last_no", F.explode(F.array(*[F.lit(h) for h in (1, 3, 5, 10, 20, 60)])).alias("horizon")).filter("session_no + horizon <= last_no").select("signal_id", "horizon")
    .join(labelled(s, d).filter("completed").select("signal_id", "horizon"), ["signal_id", "horizon"], "left_anti"))
query("intersect_cohorts", "SELECT signal_id FROM ex WHERE reason IS NULL GROUP BY signal_id HAVING count(*)=6")(
    lambda s, d: examples(s, d).filter("reason IS NULL").groupBy("signal_id").agg(F.count(F.lit(1)).alias("n")).filter("n = 6").select("signal_id"))
query("same_cohort_horizons", "WITH c AS (SELECT signal_id, sector, session_no, count(*) FILTER (WHERE reason IS NULL)=6 AS whole FROM ex GROUP BY signal_id, sector, session_no) SELECT signal_id FROM c WHERE whole AND (sector, session_no) IN (SELECT sector, session_no FROM c GROUP BY sector, session_no HAVING bool_and(whole))")(lambda s, d: _cohort(s, d))


def _cohort(s, d):
    c = examples(s, d).groupBy("signal_id", "sector", "session_no").agg((st.count_if(F.col("reason").isNull()) == 6).alias("whole"))
    days = c.groupBy("sector", "session_no").agg(F.bool_and("whole").alias("w")).filter("w").select("sector", "session_no")
    return c.filter("whole").join(days, ["sector", "session_no"], "left_semi").select("signal_id")


query("union_histories", "SELECT signal_id, model, NULL::VARCHAR AS legacy FROM preds UNION ALL SELECT 'L'||signal_id, model, 'Y' FROM preds WHERE session_no%6=0")(
    lambda s, d: predictions(s, d).select("signal_id", "model").unionByName(predictions(s, d).filter("session_no % 6 = 0").select(F.concat(F.lit("L"), "signal_id").alias("signal_id"), "model", F.lit("Y").alias("legacy")), allowMissingColumns=True))
query("paired_list_compare", """
 WITH l AS (SELECT *, row_number() OVER (PARTITION BY session_no ORDER BY score+CASE WHEN coalesce(f_trend,false) THEN 3 ELSE 0 END DESC, symbol) AS lrank FROM preds),
 j AS (SELECT l.session_no, o.horizon, l.rank, l.lrank, o.return_pct, o.completed FROM l JOIN outc o ON l.signal_id=o.signal_id),
 a AS (SELECT session_no, horizon, count(*) FILTER (WHERE rank<=10 AND completed) AS nb, count(*) FILTER (WHERE lrank<=10 AND completed) AS nl, avg(return_pct) FILTER (WHERE rank<=10) AS base_mean, avg(return_pct) FILTER (WHERE lrank<=10) AS learned_mean FROM j GROUP BY session_no, horizon)
 SELECT session_no, horizon, CASE WHEN nb=10 AND nl=10 THEN base_mean END AS base_mean, CASE WHEN nb=10 AND nl=10 THEN learned_mean END AS learned_mean,
  CASE WHEN nb<10 OR nl<10 THEN 'INSUFFICIENT' WHEN abs(learned_mean-base_mean)<=1e-9 THEN 'TIE' WHEN learned_mean>base_mean THEN 'LEARNED_BETTER' ELSE 'BASE_BETTER' END AS status FROM a""", f="base_mean learned_mean")(lambda s, d: _paired(s, d))


def _lists(df):
    w = W.partitionBy("session_no").orderBy((F.col("score") + F.when(F.col("f_trend"), 3).otherwise(0)).desc(), "symbol")  # one row per symbol and session
    return df.withColumn("lrank", F.row_number().over(w))


def _paired(s, d):
    l = _lists(predictions(s, d)).select("signal_id", "lrank")
    j = labelled(s, d).join(l, "signal_id")
    b, g = F.col("rank") <= 10, F.col("lrank") <= 10
    a = j.groupBy("session_no", "horizon").agg(st.count_if(b & F.col("completed")).alias("nb"), st.count_if(g & F.col("completed")).alias("nl"),
        F.avg(F.when(b, F.col("return_pct"))).alias("bm"), F.avg(F.when(g, F.col("return_pct"))).alias("lm"))
    ok = (F.col("nb") == 10) & (F.col("nl") == 10)
    return a.select("session_no", "horizon", F.when(ok, F.col("bm")).alias("base_mean"), F.when(ok, F.col("lm")).alias("learned_mean"),
                    first_match((~ok, "INSUFFICIENT"), (F.abs(F.col("lm") - F.col("bm")) <= 1e-9, "TIE"), (F.col("lm") > F.col("bm"), "LEARNED_BETTER"), default="BASE_BETTER").alias("status"))


query("paired_summary", """
 WITH l AS (SELECT *, row_number() OVER (PARTITION BY session_no ORDER BY score+CASE WHEN coalesce(f_trend,false) THEN 3 ELSE 0 END DESC, symbol) AS lrank FROM preds),
 j AS (SELECT l.session_no, o.horizon, l.rank, l.lrank, o.return_pct, o.completed FROM l JOIN outc o ON l.signal_id=o.signal_id),
 a AS (SELECT session_no, horizon, count(*) FILTER (WHERE rank<=10 AND completed) AS nb, count(*) FILTER (WHERE lrank<=10 AND completed) AS nl, avg(return_pct) FILTER (WHERE lrank<=10)-avg(return_pct) FILTER (WHERE rank<=10) AS edge FROM j GROUP BY session_no, horizon)
 SELECT horizon, count(*) FILTER (WHERE nb=10 AND nl=10) AS completed_days, count(*) FILTER (WHERE nb<10 OR nl<10) AS insufficient_days, count(*) FILTER (WHERE nb=10 AND nl=10 AND edge>1e-9) AS learned_wins, count(*) FILTER (WHERE nb=10 AND nl=10 AND edge<-1e-9) AS base_wins,
  avg(edge) FILTER (WHERE nb=10 AND nl=10) AS mean_edge FROM a GROUP BY horizon""", f="mean_edge")(lambda s, d: _paired(s, d).groupBy("horizon").agg(
    st.count_if(F.col("status") != "INSUFFICIENT").alias("completed_days"), st.count_if(F.col("status") == "INSUFFICIENT").alias("insufficient_days"), st.count_if(F.col("status") == "LEARNED_BETTER").alias("learned_wins"),
    st.count_if(F.col("status") == "BASE_BETTER").alias("base_wins"), F.avg(F.when(F.col("status") != "INSUFFICIENT", F.col("learned_mean") - F.col("base_mean"))).alias("mean_edge")))
query("rank_changes", """
 WITH l AS (SELECT *, row_number() OVER (PARTITION BY session_no ORDER BY score+CASE WHEN coalesce(f_trend,false) THEN 3 ELSE 0 END DESC, symbol) AS lrank FROM preds)
 SELECT session_no, symbol, rank AS base_rank, lrank AS learned_rank, rank-lrank AS rank_change, lrank<=10 AND rank>10 AS entered, rank<=10 AND lrank>10 AS exited FROM l WHERE (rank<=10 OR lrank<=10) AND rank<>lrank""")(
    lambda s, d: _lists(predictions(s, d)).filter("(rank <= 10 OR lrank <= 10) AND rank <> lrank").select("session_no", "symbol", F.col("rank").alias("base_rank"), F.col("lrank").alias("learned_rank"), (F.col("rank") - F.col("lrank")).alias("rank_change"),
        ((F.col("lrank") <= 10) & (F.col("rank") > 10)).alias("entered"), ((F.col("rank") <= 10) & (F.col("lrank") > 10)).alias("exited")))
query("capture_metrics", """
 WITH e AS (SELECT * FROM ex WHERE reason IS NULL AND horizon=1), w AS (SELECT count(*) AS n, count(*) FILTER (WHERE return_pct>=2) AS winners FROM e)
 SELECT k.size, count(*) FILTER (WHERE rank<=k.size) AS selected, count(*) FILTER (WHERE rank<=k.size AND return_pct>=2) AS hits, count(*) FILTER (WHERE rank<=k.size AND return_pct>=2)::DOUBLE/winners AS recall, count(*) FILTER (WHERE rank<=k.size AND return_pct>=2)::DOUBLE/count(*) FILTER (WHERE rank<=k.size) AS precision,
  (count(*) FILTER (WHERE rank<=k.size)-count(*) FILTER (WHERE rank<=k.size AND return_pct>=2))::DOUBLE/(n-winners) AS fp_rate FROM e CROSS JOIN w CROSS JOIN (SELECT unnest([10,30,50]) AS size) k GROUP BY k.size, winners, n""", f="recall precision fp_rate")(lambda s, d: _capture(s, d))


def _capture(s, d):
    e = examples(s, d).filter("reason IS NULL AND horizon = 1")
    win = F.col("return_pct") >= 2
    per = e.groupBy("rank").agg(F.count(F.lit(1)).alias("n"), st.count_if(win).alias("w"))
    tot = per.agg(F.sum("n").alias("_n"), F.sum("w").alias("_w"))
    x = per.crossJoin(tot).withColumn("size", F.explode(F.array(F.lit(10), F.lit(30), F.lit(50)))).filter("rank <= size").groupBy("size", "_n", "_w").agg(F.sum("n").alias("selected"), F.sum("w").alias("hits"))
    return x.select("size", "selected", "hits", (F.col("hits") / F.col("_w")).alias("recall"), (F.col("hits") / F.col("selected")).alias("precision"), ((F.col("selected") - F.col("hits")) / (F.col("_n") - F.col("_w"))).alias("fp_rate"))


query("continuation_label", "SELECT signal_id, CASE WHEN return_pct>0.1 THEN 'CONTINUED' WHEN return_pct<-0.1 THEN 'FAILED_CONTINUATION' ELSE 'NEUTRAL' END AS label FROM ex WHERE horizon=1 AND completed")(
    lambda s, d: examples(s, d).filter("horizon = 1 AND completed").select("signal_id", first_match((F.col("return_pct") > 0.1, "CONTINUED"), (F.col("return_pct") < -0.1, "FAILED_CONTINUATION"), default="NEUTRAL").alias("label")))
query("forward_prices_by_row", "SELECT symbol, session_no, lead(close,1) OVER w AS p1, lead(close,3) OVER w AS p3, lead(close,5) OVER w AS p5, lead(close,10) OVER w AS p10, lead(close,20) OVER w AS p20, lead(close,60) OVER w AS p60 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY session_no)", f="p1 p3 p5 p10 p20 p60")(
    lambda s, d: fx.weekly_bars(s, d).select("symbol", "session_no", *[F.lead("close", h).over(W.partitionBy("symbol").orderBy("session_no")).alias(f"p{h}") for h in (1, 3, 5, 10, 20, 60)]))
query("num_or_null", "SELECT event_id, TRY_CAST(CASE event_id%4 WHEN 0 THEN CAST(value AS VARCHAR) WHEN 1 THEN 'abc' WHEN 2 THEN '12.5' ELSE NULL END AS DOUBLE) AS num FROM events", f="num")(
    lambda s, d: fx.table(s, d, "events").select("event_id", num_or_null(F.expr("CASE CAST(event_id % 4 AS INT) WHEN 0 THEN CAST(value AS STRING) WHEN 1 THEN 'abc' WHEN 2 THEN '12.5' END")).alias("num")))
query("minutes_between", "SELECT event_id, CASE WHEN ts<=TIMESTAMP '2024-01-15' THEN epoch_us(TIMESTAMP '2024-01-15')/60e6-epoch_us(ts)/60e6 END AS age FROM events", f="age", digits=4)(
    lambda s, d: fx.table(s, d, "events").select("event_id", minutes_between("ts", F.lit("2024-01-15").cast("timestamp")).alias("age")))
query("next_bar_start", "SELECT event_id, strftime(make_timestamp(CAST(ceil(epoch_us(ts)/300e6)*300e6 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS bar_start FROM events")(
    lambda s, d: fx.table(s, d, "events").select("event_id", next_bar_start("ts").alias("bar_start")))
query("json_access", "SELECT event_id, CAST(json_extract(props,'$.k') AS BIGINT) AS k FROM events")(
    lambda s, d: fx.table(s, d, "events").select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k")))
query("alarm_match", """
 WITH a AS (SELECT event_type AS symbol, median(value) FILTER (WHERE ts<=c) AS target, min(c) AS created_at FROM (SELECT *, min(ts) OVER (PARTITION BY event_type)+INTERVAL 1 DAY AS c FROM events) AS e GROUP BY event_type)
 SELECT e.event_type AS symbol, op AS operator, min(e.event_id) AS quote_id FROM events e JOIN a ON e.event_type=a.symbol CROSS JOIN (SELECT unnest(['GE','LE']) AS op) o WHERE e.ts>a.created_at AND CASE op WHEN 'GE' THEN value>=target ELSE value<=target END GROUP BY e.event_type, op""")(lambda s, d: _alarms(s, d))


def alarms(s, d):
    """One alarm per symbol and operator at the exact median of the prices seen before it was made."""
    from sigspark.functions.quantiles import robust

    q = fx.quotes(s, d)
    at = q.groupBy("symbol").agg((F.min("event_time") + F.expr("INTERVAL 1 DAY")).alias("created_at"))
    seen = q.join(at, "symbol").filter("event_time <= created_at")
    med = robust(seen, ["symbol"], "price").select("symbol", F.col("median").alias("target"))
    return at.join(med, "symbol").withColumn("operator", F.explode(F.array(F.lit("GE"), F.lit("LE"))))


def hit():
    return (F.col("event_time") > F.col("created_at")) & F.when(F.col("operator") == "GE", F.col("price") >= F.col("target")).otherwise(F.col("price") <= F.col("target"))


def _alarms(s, d):
    return fx.quotes(s, d).join(alarms(s, d), "symbol").filter(hit()).groupBy("symbol", "operator").agg(F.min_by("quote_id", F.struct("event_time", "quote_id")).alias("quote_id"))


query("cross_source_conflicts", "SELECT symbol, session_no, horizon, count(DISTINCT v) AS distinct_values FROM (SELECT symbol, session_no, horizon, return_pct AS v FROM ex WHERE completed UNION ALL SELECT symbol, session_no, horizon, return_pct+1 FROM ex WHERE completed AND session_no%8=0) AS q GROUP BY symbol, session_no, horizon HAVING count(DISTINCT v)>1")(lambda s, d: _cross(s, d))


def _cross(s, d):
    e = examples(s, d).filter("completed").select("symbol", "session_no", "horizon", F.col("return_pct").alias("v"))
    return (e.unionByName(e.filter("session_no % 8 = 0").withColumn("v", F.col("v") + 1)).groupBy("symbol", "session_no", "horizon").agg(F.count_distinct("v").alias("distinct_values")).filter("distinct_values > 1"))
