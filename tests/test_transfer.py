"""Transfer of weight within families, against the rule worked out one by one."""

import random

import pytest

from sigspark.operators import flags as fl
from sigspark.operators import transfer as tr


def records(spark, n=400):
    """SMA_TREND wins, its copy EMA_TREND too, MACD loses; RSI wins alone; VOLUME loses and OBV_TREND wins."""
    rng, out = random.Random(3), []
    for i in range(n):
        good = rng.random() < 0.5
        flags = dict.fromkeys(fl.CRITERIA)
        flags["SMA_TREND"] = good if rng.random() < 0.9 else not good
        flags["EMA_TREND"] = None if i % 10 == 0 else flags["SMA_TREND"]
        flags["MACD"] = rng.random() < 0.5 if i % 4 == 0 else not good
        flags["RSI"] = good
        flags["VOLUME"], flags["OBV_TREND"] = (not good if i % 3 else good), (good if (i // 3) % 3 else not good)
        flags["BUY"], flags["SELL"] = good, not good
        out.append((1, i, i % 20, "SUCCESS" if good else "FAIL", 2.0 if good else -2.0, good, not good, "BUY", 2.0, -2.0, *flags.values()))
    cols = "horizon int, signal_id int, session_no int, status string, directional_return double, target_hit boolean, stop_hit boolean, decision string, max_rise double, max_drop double, "
    return spark.createDataFrame(out, cols + ", ".join(f"{c} boolean" for c in fl.CRITERIA))


def weights(spark, **changed):
    rows = [(c, w, *changed.get(c, (w, w))) for c, w in fl.BASE_WEIGHT.items()]
    return spark.createDataFrame(rows, "criterion string, base double, baseline double, current double")


def test_transfer_keeps_budgets_and_gives_way_to_representatives(spark):
    got = {r.criterion: r for r in tr.family_transfer(records(spark), weights(spark), ["horizon"]).collect()}
    assert set(got) == set(fl.CRITERIA)
    assert [got[c].direction for c in ("SMA_TREND", "EMA_TREND", "MACD", "RSI", "VOLUME", "OBV_TREND", "BUY")] == ["UP", "UP", "DOWN", "UP", "DOWN", "UP", "UP"]
    assert got["SMA_TREND"].representative == "SMA_TREND" and got["EMA_TREND"].representative == "SMA_TREND" and got["EMA_TREND"].agreement == 1.0
    # RSI agrees with SMA_TREND in about nine of ten rows, so it gives way as well, from another family.
    assert got["RSI"].representative == "SMA_TREND" and 0.85 <= got["RSI"].agreement < 1
    moved = {c: r.proposed - r.current for c, r in got.items() if r.proposed != r.current}
    assert moved == pytest.approx({"SMA_TREND": 0.0025, "MACD": -0.0025, "OBV_TREND": 0.0025, "VOLUME": -0.0025})
    for family, members in fl.FAMILIES.items():
        assert sum(got[c].proposed for c in members) == pytest.approx(fl.BUDGETS[family])
    assert got["BUY"].representative is None and got["BUY"].proposed == 0.0 and got["DISCLOSURE"].direction == "SAME"


def test_transfer_stops_at_bounds(spark):
    base = fl.BASE_WEIGHT["SMA_TREND"]
    near = tr.family_transfer(records(spark), weights(spark, SMA_TREND=(base, base + 0.004), MACD=(base, base - 0.004)), ["horizon"])
    got = {r.criterion: r.proposed for r in near.collect()}
    assert got["SMA_TREND"] == pytest.approx(base + 0.005) and got["MACD"] == pytest.approx(base - 0.005)
    full = tr.family_transfer(records(spark), weights(spark, SMA_TREND=(base, base + 0.006)), ["horizon"])
    got = {r.criterion: r.proposed for r in full.collect()}
    assert got["SMA_TREND"] == pytest.approx(base + 0.006) and got["MACD"] == pytest.approx(base)  # past its bound: nothing moves
    few = tr.family_transfer(records(spark, 60), weights(spark), ["horizon"]).collect()
    assert len(few) == len(fl.CRITERIA) and all(r.proposed == r.current for r in few)
    assert tr.family_transfer(records(spark).limit(0), weights(spark), ["horizon"]).count() == 0


def test_choice_in_order_equals_a_loop(spark):
    rng = random.Random(5)
    scopes, pairs, want = [], [], {}
    for s in range(20):
        places = sorted(rng.sample(range(36), rng.randrange(1, 12)))
        scopes.append((s, places))
        alike = {(a, b): rng.choice((0, 90, 100)) for a in places for b in places if b < a}
        pairs += [(s, a, b, 100, v) for (a, b), v in alike.items()]
        kept = []
        for a in places:
            first = next((b for b in kept if alike[a, b] >= 85), None)
            want[s, a] = (a, None) if first is None else (first, alike[a, first] / 100)
            if first is None:
                kept.append(a)
    moved = spark.createDataFrame(scopes, "scope int, places array<int>")
    told = spark.createDataFrame(pairs, "scope int, a int, b int, matches long, agreed long")
    got = {(r.scope, r.place): (r.representative, r.agreement) for r in tr.representatives(moved, told, ["scope"], 40).collect()}
    assert got == want
