"""Streaming queries run to the end of the available input, with batch SQL twins."""

from pyspark.sql import functions as F

from sigspark.functions.scalars import first_match, pct_change
from sigspark.operators import indicators as ind
from sigspark.plans.bars import alarms, hit
from sigspark.plans.registry import fragment, query
from sigspark.sources import fixtures as fx
from sigspark.streaming import stateful as sf
from sigspark.streaming import streams as sm

query("stream_bars_5m", "SELECT event_type AS symbol, strftime(b,'%Y-%m-%d %H:%M:%S') AS bar_start, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS ticks FROM (SELECT *, time_bucket(INTERVAL 5 MINUTE, ts) AS b FROM events) AS q WHERE b+INTERVAL 5 MINUTE<=(SELECT max(ts) FROM events)-INTERVAL 10 MINUTE GROUP BY event_type, b", f="open high low close")(
    lambda s, d: sm.drain(sm.bars(sm.quote_stream(s, d)), f"bars {d}"))
query("stream_session_vwap", "SELECT event_type AS symbol, strftime(date_trunc('day',ts),'%Y-%m-%d %H:%M:%S') AS session, sum(value*v)/sum(v) AS vwap, count(*) AS ticks FROM (SELECT *, CAST(json_extract(props,'$.k') AS BIGINT)+1.0::DOUBLE AS v FROM events) AS e WHERE date_trunc('day',ts)+INTERVAL 1 DAY<=(SELECT max(ts) FROM events)-INTERVAL 10 MINUTE GROUP BY event_type, date_trunc('day',ts)", f="vwap")(
    lambda s, d: sm.drain(sm.session_vwap(sm.quote_stream(s, d)), f"vwap {d}"))
query("stream_alarms", "WITH a AS (SELECT event_type AS symbol, median(value) FILTER (WHERE ts<=c) AS target, min(c) AS created_at FROM (SELECT *, min(ts) OVER (PARTITION BY event_type)+INTERVAL 1 DAY AS c FROM events) AS e GROUP BY event_type) SELECT DISTINCT a.symbol, op AS operator FROM events e JOIN a ON e.event_type=a.symbol CROSS JOIN (SELECT unnest(['GE','LE']) AS op) o WHERE e.ts>a.created_at AND CASE op WHEN 'GE' THEN value>=target ELSE value<=target END")(
    lambda s, d: sm.drain(sm.fired_alarms(sm.quote_stream(s, d), alarms(s, d), hit()), f"alarms {d}"))
# Arrival: up to nine minutes after the trade or one before it; times in steps of ten minutes, so that quotes meet.
fragment("arrivals", "SELECT event_type AS symbol, event_id AS quote_id, epoch_us(ts)//600000000*600000000 AS qt, value AS price, epoch_us(ts)+((event_id*7919)%600-60)*1000000 AS arrived FROM events")
fragment("guarded", """
 SELECT *, CASE WHEN bad IS NOT NULL THEN bad WHEN qt<top THEN 'LATE' WHEN qt=top AND price<>first_price THEN 'CONFLICT' END AS reason FROM (
  SELECT *, max(CASE WHEN bad IS NULL THEN qt END) OVER (PARTITION BY symbol ORDER BY arrived, quote_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top, first_value(CASE WHEN bad IS NULL THEN price END IGNORE NULLS) OVER (PARTITION BY symbol, qt ORDER BY arrived, quote_id) AS first_price FROM (
   SELECT *, CASE WHEN price IS NULL OR price<=0 THEN 'INVALID_PRICE' WHEN qt>arrived THEN 'FUTURE' WHEN qt//86400000000<>arrived//86400000000 THEN 'OTHER_DAY' END AS bad FROM arrivals) AS a) AS b""")
ARRIVED = "symbol string, quote_id long, at long, price double, arrived long"


def _guard(s, d):
    us = F.unix_micros(F.col("event_time").cast("timestamp"))
    q = fx.quotes(s, d).select("symbol", "quote_id", F.floor(us / 600_000_000).cast("long").alias("slot"), "price", (us + ((F.col("quote_id") * 7919) % 600 - 60) * 1_000_000).alias("arrived"))
    q = q.select("symbol", "quote_id", (F.col("slot") * 600_000_000).alias("at"), "price", "arrived")
    job = sf.Job(s, ARRIVED, lambda x: sf.keyed(x, "symbol", sf.LatestQuote()), {"good": "reason IS NULL", "quarantine": "reason IS NOT NULL"})
    return sf.in_two_parts(job, q, f"arrived < {middle(q, 'arrived')}")


def middle(rows, at):
    low, high = rows.agg(F.min(at), F.max(at)).first()
    return ((low or 0) + (high or 0)) // 2


query("stream_latest_quote", "SELECT symbol, arg_max(price, (qt, -arrived)) AS price, strftime(make_timestamp(max(qt)),'%Y-%m-%d %H:%M:%S') AS event_time FROM guarded WHERE reason IS NULL GROUP BY symbol", f="price")(
    lambda s, d: _guard(s, d).read("good").groupBy("symbol").agg(F.max_by("price", F.struct("at", -F.col("arrived"))).alias("price"), F.timestamp_micros(F.max("at")).alias("event_time")))
query("late_and_future_guard", "SELECT symbol, quote_id, price, reason FROM guarded WHERE reason IS NOT NULL", f="price")(lambda s, d: _guard(s, d).read("quarantine").select("symbol", "quote_id", "price", "reason"))
query("seen_ids", "SELECT event_type AS feed, user_id AS id, strftime(min(ts),'%Y-%m-%d %H:%M:%S') AS first_seen FROM events GROUP BY event_type, user_id HAVING epoch_us(min(ts))>=(SELECT epoch_us(min(ts)) FROM events)+86400000000")(lambda s, d: _seen(s, d))


def _seen(s, d):
    """The first day is the first sync: its ids are seen, later ones are new."""
    e = fx.table(s, d, "events").select(F.col("event_type").alias("feed"), F.col("user_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    job = sf.Job(s, "feed string, id long, at long", lambda x: sf.keyed(x, "feed", sf.Seen(one_sync=True)), {"new": "true"})
    return sf.in_two_parts(job, e, f"at < {(e.agg(F.min('at')).first()[0] or 0) + sf.DAY}").read("new").select("feed", "id", F.timestamp_micros("at").alias("first_seen"))


SIG = "CASE WHEN close>vwap AND close>open THEN 'BUY' WHEN close<vwap AND close<open THEN 'SELL' ELSE 'WATCH' END"
fragment("hsig", f"SELECT symbol, day, slot, bar_start, {SIG} AS signal, least(100.0, abs((close/vwap-1)*100)) AS score, least(100.0, abs((close/open-1)*100)) AS confidence FROM hvwap")
fragment("hlife", """
 SELECT *, lag(state) OVER w AS previous_state, lag(score) OVER w AS previous_score, lag(confidence) OVER w AS previous_confidence, min(bar_start) OVER (PARTITION BY symbol, day, run) AS started_at FROM (SELECT *, sum(CASE WHEN side=old THEN 0 ELSE 1 END) OVER (PARTITION BY symbol, day ORDER BY slot) AS run FROM (SELECT *, CASE WHEN signal='WATCH' THEN old ELSE signal END AS side, CASE WHEN signal='BUY' THEN CASE old WHEN 'BUY' THEN 'BUY_ON' WHEN 'SELL' THEN 'RECOVERING' ELSE 'NEW_BUY' END
  WHEN signal='SELL' THEN CASE old WHEN 'BUY' THEN 'TURNED_SELL' WHEN 'SELL' THEN 'SELL_ON' ELSE 'NEW_SELL' END ELSE CASE old WHEN 'BUY' THEN 'WEAKENING' WHEN 'SELL' THEN 'RECOVERING' ELSE 'WATCH' END END AS state
 FROM (SELECT *, coalesce(last_value(CASE WHEN signal<>'WATCH' THEN signal END IGNORE NULLS) OVER (PARTITION BY symbol, day ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),'WATCH') AS old FROM hsig) AS q) AS p) AS r WINDOW w AS (PARTITION BY symbol, day ORDER BY slot)""")


def signals(s, d):
    v = ind.session_vwap(fx.hourly_bars(s, d))
    c, o, w = F.col("close"), F.col("open"), F.col("vwap")
    return v.select("symbol", "day", "slot", "bar_start", first_match(((c > w) & (c > o), "BUY"), ((c < w) & (c < o), "SELL"), default="WATCH").alias("signal"),
                    F.least(F.lit(100.0), F.abs(pct_change(c, w))).alias("score"), F.least(F.lit(100.0), F.abs(pct_change(c, o))).alias("confidence"))


def _life(s, d, sinks):
    rows = signals(s, d).select("symbol", F.unix_micros(F.col("bar_start").cast("timestamp")).alias("at"), "signal", "score", "confidence")
    job = sf.Job(s, "symbol string, at long, signal string, score double, confidence double", lambda x: sf.keyed(x, "symbol", sf.Life()), sinks)
    return sf.in_two_parts(job, rows, f"at < {middle(rows, 'at')}")


_T = "strftime({0},'%Y-%m-%d %H:%M:%S') AS {0}"
query("signal_lifecycle", f"SELECT symbol, {_T.format('bar_start')}, signal, old AS previous_side, state, {_T.format('started_at')}, (epoch_us(bar_start)-epoch_us(started_at))/60e6::DOUBLE AS age_minutes FROM hlife", f="age_minutes")(
    lambda s, d: _life(s, d, {"all": "true"}).read("all").select("symbol", F.timestamp_micros("at").alias("bar_start"), "signal", "previous_side", "state", F.timestamp_micros("started_at").alias("started_at"), "age_minutes"))
query("emit_significant_events", f"SELECT symbol, {_T.format('bar_start')}, state, score FROM hlife WHERE state<>'WATCH' AND (previous_state IS NULL OR (state<>previous_state AND state NOT IN ('BUY_ON','SELL_ON')) OR abs(score-previous_score)>=10 OR abs(confidence-previous_confidence)>=10)", f="score")(
    lambda s, d: _life(s, d, {"events": "important"}).read("events").select("symbol", F.timestamp_micros("at").alias("bar_start"), "state", "score"))
