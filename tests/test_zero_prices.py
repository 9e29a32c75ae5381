"""Prices of zero: ratios follow floating point, as in the SQL of the queries."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from sigspark import plans
from sigspark.functions.scalars import float_change, float_ratio
from sigspark.operators import indicators as ind

INF = math.inf


def hours(spark, rows):
    return spark.createDataFrame(rows, "symbol string, slot int, open double, high double, low double, close double").withColumn("day", F.lit("2024-01-01").cast("date"))


def test_ratio_over_zero(spark):
    d = spark.createDataFrame([(2.0, 0.0), (-2.0, 0.0), (0.0, 0.0), (3.0, 2.0), (None, 0.0), (1.0, None)], "a double, b double")
    got = [(r.q, r.p) for r in d.select(float_ratio("a", "b").alias("q"), float_change("a", "b").alias("p")).collect()]
    assert got[:2] == [(INF, INF), (-INF, -INF)] and all(math.isnan(x) for x in got[2])
    assert got[3] == (1.5, 50.0) and got[4:] == [(None, None)] * 2


def test_shape_of_a_session_that_fell_to_zero(spark):
    d = hours(spark, [("A", 0, 10.0, 12.0, 5.0, 8.0), ("A", 1, 8.0, 9.0, 0.0, 4.0), ("A", 2, 4.0, 4.0, 0.0, 0.0)])
    got = {r.slot: r for r in ind.intraday_shape(d).collect()}
    assert got[0].from_low == pytest.approx(60.0) and got[1].from_low == INF
    assert math.isnan(got[2].from_low) and got[2].to_high == INF and got[2].from_open == -100.0


def events(spark, path, zero):
    """Two days of one type, two rows an hour; the hours in zero hold a price of zero."""
    rows = [(h * 2 + k, 1704067200 + h * 3600 + k * 60, 1, "A", 0.0 if h in zero and k == zero[h] else 50.0 + (h * 7 + k) % 11, "{}") for h in range(48) for k in range(3)]
    d = spark.createDataFrame(rows, "event_id long, t long, user_id long, event_type string, value double, props string")
    d.select("event_id", F.timestamp_seconds("t").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props").write.parquet(f"{path}/events.parquet")


def test_momentum_from_zero(spark):
    d = spark.createDataFrame([("A", i, 9.0, 9.0, 0.0, c, 100.0) for i, c in enumerate([0.0, 5.0, 6.0, 7.0, 8.0])], "symbol string, n int, open double, high double, low double, close double, volume double")
    got = {r.n: r for r in ind.indicator_frame(d.withColumns({"session": F.col("n"), "sector": F.lit("s")}), ind.BarWindow("symbol", order="n")).collect()}
    assert got[2].momentum3 is None and got[3].momentum3 == INF and got[4].momentum3 == pytest.approx(60.0) and got[1].change_pct == INF


def both(spark, path, name):
    """The query's rows and its SQL's, NaN as NULL."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet/*.parquet'")
    cur = con.execute(plans.all_oracles()[name])
    names = sorted(c[0] for c in cur.description)
    at = [[c[0] for c in cur.description].index(n) for n in names]
    got = plans.all_queries()[name](spark, str(path)).select(*names).collect()
    plain = lambda rows: sorted((tuple(None if isinstance(x, float) and math.isnan(x) else x for x in r) for r in rows), key=repr)
    return plain(got), plain(tuple(r[i] for i in at) for r in cur.fetchall())


@pytest.mark.parametrize("name", ["intraday_shape", "intraday_score"])
def test_queries_with_zero_prices(spark, tmp_path, name):
    events(spark, tmp_path, {1: 1, 30: 2, 24: 0})  # within an hour, as a close, as a day's open
    got, want = both(spark, tmp_path, name)
    assert len(got) == 48 and got == want


def many_events(spark, path):
    """Twenty days of five types at random times; about one value in twelve is zero."""
    rng = random.Random(5)
    at = [(1704067200 * 10**6 + rng.randrange(20 * 86_400 * 10**6), rng.choice("ABCDE")) for _ in range(40_000)]
    rows = [(i, t, 1, s, 0.0 if rng.random() < 0.08 else round(rng.expovariate(0.02), 2), "{}") for i, (t, s) in enumerate(dict.fromkeys(at))]
    d = spark.createDataFrame(rows, "event_id long, t long, user_id long, event_type string, value double, props string")
    d.select("event_id", F.timestamp_micros("t").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props").coalesce(1).write.parquet(f"{path}/events.parquet")


def test_top10_with_many_zero_prices(spark, tmp_path):
    many_events(spark, tmp_path)
    got, want = both(spark, tmp_path, "intraday_top10")
    assert got and got == want


@pytest.mark.parametrize("name", ["label_signal_outcomes", "intraday_signal_performance"])
def test_outcomes_with_zero_prices(spark, tmp_path, name):
    many_events(spark, tmp_path)  # lows, opens and closes of zero, also of the signal's bar
    got, want = both(spark, tmp_path, name)
    assert got and got == want and (name != "label_signal_outcomes" or any(INF in r for r in got))


def test_top10_order_with_zero_prices(spark, tmp_path):
    """Sixty types with two events an hour, three values in a hundred zero: equal scores and volumes leave the rank to a momentum over zero."""
    rng = random.Random(11)
    rows = [(i, 1704067200 * 10**6 + t, 1, f"T{rng.randrange(60)}", 0.0 if rng.random() < 0.03 else round(rng.expovariate(0.02), 2), "{}") for i, t in enumerate(sorted(rng.sample(range(15 * 86_400 * 10**6), 40_000)))]
    d = spark.createDataFrame(rows, "event_id long, t long, user_id long, event_type string, value double, props string")
    d.select("event_id", F.timestamp_micros("t").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got, want = both(spark, tmp_path, "intraday_top10")
    assert len(want) > 50 and got == want
