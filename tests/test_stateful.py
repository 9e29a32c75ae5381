import random

import pytest

from sigspark.streaming import stateful as sf

LIFE = "symbol string, at long, signal string, score double, confidence double"
QUOTE = "symbol string, quote_id long, at long, price double, arrived long"
MINUTE = 60_000_000


def run(spark, rows, schema, job, key, cuts, order="at", sinks=None):
    """The rows in as many batches as there are cuts and one more, each a restart of the query."""
    df = spark.createDataFrame(rows, schema)
    j = sf.Job(spark, schema, lambda x: sf.keyed(x, key, job()), sinks or {"out": "true"})
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = df if low is None else df.filter(f"{order} >= {low}")
        j.land(part if high is None else part.filter(f"{order} < {high}"))
        j.run()
    return j


def lives(rows):
    """The state machine by hand, one symbol's day after the other."""
    out, last = {}, {}
    for symbol, at, signal, score, confidence in sorted(rows, key=lambda r: (r[0], r[1])):
        key, day = symbol, at // sf.DAY
        old = last.get(key)
        if old and old["day"] != day:
            old = None
        before = old["side"] if old else "WATCH"
        if signal == "BUY":
            state = {"BUY": "BUY_ON", "SELL": "RECOVERING"}.get(before, "NEW_BUY")
        elif signal == "SELL":
            state = {"BUY": "TURNED_SELL", "SELL": "SELL_ON"}.get(before, "NEW_SELL")
        else:
            state = {"BUY": "WEAKENING", "SELL": "RECOVERING"}.get(before, "WATCH")
        side = before if signal == "WATCH" else signal
        since = old["since"] if old and side == before else at
        fresh = not old or (state != old["state"] and state not in ("BUY_ON", "SELL_ON"))
        jump = bool(old) and (abs(score - old["score"]) >= 10 or abs(confidence - old["confidence"]) >= 10)
        out[symbol, at] = (before, state, since, state != "WATCH" and (fresh or jump))
        last[key] = dict(day=day, side=side, state=state, since=since, score=score, confidence=confidence)
    return out


@pytest.mark.parametrize("cuts", [[], [sf.DAY + 700 * MINUTE, 2 * sf.DAY + 30 * MINUTE]])
def test_life_cycle_over_restarts_equals_one_run_and_the_hand_machine(spark, cuts):
    rng = random.Random(1)
    rows = [(s, d * sf.DAY + m * 5 * MINUTE, rng.choice(["BUY", "SELL", "WATCH"]), rng.uniform(0, 40), rng.uniform(0, 25)) for s in "AB" for d in (1, 2) for m in sorted(rng.sample(range(288), 40))]
    got = {(r["symbol"], r["at"]): (r["previous_side"], r["state"], r["started_at"], r["important"]) for r in run(spark, rows, LIFE, sf.Life, "symbol", cuts).read("out").collect()}
    assert got == lives(rows)


def test_state_of_a_day_that_is_over_expires(spark):
    rows = [("A", sf.DAY + MINUTE, "BUY", 1.0, 1.0), ("B", sf.DAY + MINUTE, "BUY", 1.0, 1.0), ("B", 3 * sf.DAY + 60 * MINUTE, "BUY", 1.0, 1.0)]
    job = run(spark, rows, LIFE, sf.Life, "symbol", [3 * sf.DAY])
    assert [r["state"] for r in job.read("out").orderBy("at", "symbol").collect()] == ["NEW_BUY", "NEW_BUY", "NEW_BUY"]
    held = spark.read.format("statestore").option("stateVarName", "last").load(f"{job.base}/cp").collect()
    assert [r["key"]["symbol"] for r in held] == ["B"]
    before = job.read("out").count()
    job.run()  # nothing new has landed
    assert job.read("out").count() == before


def test_same_data_keeps_the_state_and_older_data_is_ignored(spark):
    at = sf.DAY + 500 * MINUTE
    rows = [("A", at, "BUY", 1.0, 1.0), ("A", at, "BUY", 1.0, 1.0), ("A", at - 5 * MINUTE, "SELL", 1.0, 1.0)]
    job = sf.Job(spark, LIFE, lambda x: sf.keyed(x, "symbol", sf.Life()), {"out": "true"})
    for i in range(3):
        job.land(spark.createDataFrame([rows[i]], LIFE))
        job.run()
    assert [r["state"] for r in job.read("out").orderBy("at").collect()] == ["NEW_BUY", "NEW_BUY"]


@pytest.mark.parametrize("cuts", [[], [sf.DAY + 620 * MINUTE]])
def test_quotes_are_split_to_good_and_quarantine(spark, cuts):
    at = sf.DAY + 600 * MINUTE
    rows = [("A", 1, at, 10.0, at + MINUTE), ("A", 2, at, 10.5, at + 2 * MINUTE), ("A", 3, at, 10.0, at + 3 * MINUTE), ("A", 4, at - MINUTE, 9.0, at + 4 * MINUTE),
            ("A", 5, at + 50 * MINUTE, 9.0, at + 25 * MINUTE), ("A", 6, at - sf.DAY, 9.0, at + 26 * MINUTE), ("A", 7, at + 20 * MINUTE, 11.0, at + 27 * MINUTE),
            ("A", 8, at + 21 * MINUTE, None, at + 28 * MINUTE), ("B", 9, at, 5.0, at), ("A", 10, at + 10 * MINUTE, 12.0, at + 29 * MINUTE)]
    job = run(spark, rows, QUOTE, sf.LatestQuote, "symbol", cuts, "arrived", {"good": "reason IS NULL", "quarantine": "reason IS NOT NULL"})
    assert {r["quote_id"] for r in job.read("good").collect()} == {1, 3, 7, 9}
    assert {r["quote_id"]: r["reason"] for r in job.read("quarantine").collect() if r["quote_id"] != 6} == {2: "CONFLICT", 4: "LATE", 5: "FUTURE", 8: "INVALID_PRICE", 10: "LATE"}
    six = [r["reason"] for r in job.read("quarantine").collect() if r["quote_id"] == 6]
    assert six == ["OTHER_DAY"]


def test_a_batch_written_again_replaces_itself(spark):
    job = sf.Job(spark, QUOTE, lambda x: x, {"good": "price > 0", "bad": "price <= 0"})
    df = spark.createDataFrame([("A", 1, 0, 1.0, 0), ("A", 2, 0, -1.0, 0)], QUOTE)
    for _ in range(2):
        job.split(df, 0)
    assert (job.read("good").count(), job.read("bad").count()) == (1, 1)


def test_resignals_and_seen_ids_by_hand(spark):
    t = sf.DAY + 600 * MINUTE
    schema = "symbol string, at long, price double, decision string, score double, target double, stop double"
    rows = [("A", t, 100.0, "BUY", 50.0, 110.0, 90.0), ("A", t + MINUTE, 100.5, "BUY", 52.0, 110.2, 90.1), ("A", t + 2 * MINUTE, 101.1, "BUY", 52.0, 110.2, 90.1),
            ("A", t + 3 * MINUTE, 101.2, "SELL", 52.0, 95.0, 105.0), ("A", t + 4 * MINUTE, 101.2, "SELL", 52.0, 96.1, 105.0), ("A", t + 5 * MINUTE, 101.3, "SELL", 56.0, 96.1, 105.0),
            ("A", t + 6 * MINUTE, 101.3, "SELL", 60.9, 96.1, 105.0), ("A", t + sf.DAY, 101.3, "SELL", 60.9, 96.1, 105.0)]
    got = run(spark, rows, schema, sf.Resignal, "symbol", [t + 3 * MINUTE]).read("out")
    assert sorted((r["at"] - t) // MINUTE for r in got.collect()) == [0, 2, 3, 4, 6, 1440]
    ids = [("f", i, t + i) for i in (1, 2, 3)] + [("f", i, t + MINUTE + i) for i in (2, 4, 4, 5)] + [("g", 1, t + MINUTE)]
    new = run(spark, ids, "feed string, id long, at long", sf.Seen, "feed", [t + MINUTE]).read("out").collect()
    assert sorted((r["feed"], r["id"]) for r in new) == [("f", 4), ("f", 5)]


def test_stream_equals_the_batch_form(spark):
    from pyspark.sql import functions as F

    from sigspark.streaming import streams as sm

    rng = random.Random(3)
    rows = [(s, d * sf.DAY + m * 60 * MINUTE, rng.choice(["BUY", "SELL", "WATCH"]), rng.uniform(0, 40), 0.0) for s in "ABC" for d in (1, 2, 3) for m in range(24)]
    job = run(spark, rows, LIFE, sf.Life, "symbol", [2 * sf.DAY + 700 * MINUTE])
    batch = spark.createDataFrame(rows, LIFE).withColumns({"bar_start": F.timestamp_micros("at"), "day": F.floor(F.col("at") / sf.DAY), "slot": F.col("at")})
    life = sm.lifecycle(batch)
    key = ("symbol", "at", "previous_side", "state", "previous_state")
    assert sorted(map(repr, life.select(*key).collect())) == sorted(map(repr, job.read("out").select(*key).collect()))
    assert sorted(map(tuple, sm.significant(life).select("symbol", "at").collect())) == sorted(map(tuple, job.read("out").filter("important").select("symbol", "at").collect()))


def test_seen_ids_are_all_kept(spark):
    """More ids than the 3000 once remembered come back, and a feed can be new after the one first sync."""
    t = sf.DAY
    ids = [("f", i, t + i) for i in range(4000)] + [("f", i, t + MINUTE + 7 * i + k) for i in (5, 3999, 5000, 5001) for k in (3, 1)] + [("g", 1, t + MINUTE)]
    new = run(spark, ids, "feed string, id long, at long", sf.Seen, "feed", [t + 5000, t + 4 * MINUTE]).read("out").collect()
    assert sorted(map(tuple, new)) == [("f", 5000, t + MINUTE + 35001), ("f", 5001, t + MINUTE + 35008)]
    every = run(spark, ids, "feed string, id long, at long", lambda: sf.Seen(one_sync=True), "feed", [t + 5000]).read("out").collect()
    assert sorted(map(tuple, every)) == [("f", 5000, t + MINUTE + 35001), ("f", 5001, t + MINUTE + 35008), ("g", 1, t + MINUTE)]
