from datetime import date

import pytest

from sigspark.operators import intraday as iy

BAR = "symbol string, day date, slot int, open double, high double, low double, close double"
SIG = "signal_id string, symbol string, day date, slot int, price double, decision string, target double, stop double, zone_low double, zone_high double"
D = [date(2026, 10, 5 + i) for i in range(5)]


def bars(drop=()):
    """Four slots a day; closes rise by one each bar from 100."""
    out, close = [], 100.0
    for d in D:
        for slot in range(4):
            if (d, slot) not in drop:
                out.append(("A", d, slot, close, close + 2, close - 2, close))
            close += 1
    return out


def labels(spark, signals, rows=None):
    d = iy.label_path(spark.createDataFrame(signals, SIG), spark.createDataFrame(rows or bars(), BAR), {"1H": (1, 0), "SESSION": (None, 0), "D1": (None, 1), "D3": (None, 3)}, last_slot=3)
    return {(r["signal_id"], r["horizon"]): r for r in d.collect()}


def test_path_runs_through_the_session_and_then_days(spark):
    got = labels(spark, [("l", "A", D[0], 1, 101.0, "BUY", 110.0, 90.0, 98.0, 101.5), ("s", "A", D[0], 1, 101.0, "SELL", 90.0, 108.5, None, None)])
    assert [got["l", h]["return_pct"] for h in ("1H", "SESSION", "D1", "D3")] == pytest.approx([(c / 101 - 1) * 100 for c in (102, 103, 107, 115)])
    # Day one peaks at 109: the target of 110 is met on day two, a short's stop of 108.5 on day one.
    assert [got["l", h]["touch"] for h in ("SESSION", "D1", "D3")] == ["NEITHER", "NEITHER", "TARGET"]
    assert [got["s", h]["touch"] for h in ("SESSION", "D1", "D3")] == ["NEITHER", "STOP", "STOP"]
    assert got["s", "D1"]["side_return"] == pytest.approx((101 / 107 - 1) * 100) and got["s", "D1"]["side_mae"] == pytest.approx((101 / 109 - 1) * 100)
    assert got["l", "D3"]["target_hit"] is True and got["l", "D3"]["stop_hit"] is False
    # Entry on the first bar after the signal (low 100); moves count from the bar after it.
    assert got["l", "SESSION"]["zone_entry_no"] == 2 and got["l", "SESSION"]["post_entry_mfe"] == pytest.approx((105 / 101 - 1) * 100) and got["l", "SESSION"]["post_entry_mae"] == 0
    assert got["l", "1H"]["zone_entered"] is True and got["l", "1H"]["post_entry_mfe"] is None
    assert got["s", "D1"]["zone_entered"] is None


def test_short_signals_have_no_zone_and_bad_levels_no_touch(spark):
    got = labels(spark, [("s", "A", D[0], 1, 101.0, "SELL", 90.0, 120.0, 100.0, 102.0), ("w", "A", D[0], 1, 101.0, "BUY", 90.0, 120.0, None, None)])
    assert got["s", "D1"]["zone_entered"] is False
    assert (got["w", "D1"]["target_hit"], got["w", "D1"]["stop_hit"], got["w", "D1"]["touch"]) == (None, None, "NEITHER")


def test_reasons_of_what_cannot_be_measured(spark):
    sig = [("end", "A", D[0], 3, 103.0, "BUY", 110.0, 90.0, None, None), ("late", "A", D[4], 1, 117.0, "BUY", 130.0, 90.0, None, None), ("gap", "A", D[1], 1, 105.0, "BUY", 130.0, 90.0, None, None),
           ("none", "B", D[0], 1, 100.0, "BUY", 110.0, 90.0, None, None), ("zero", "A", D[0], 1, 0.0, "BUY", 110.0, 90.0, None, None)]
    got = labels(spark, sig, bars(drop={(D[1], 3), *((D[3], s) for s in range(4))}))
    assert [got["end", h]["reason"] for h in ("1H", "SESSION", "D1")] == ["HORIZON_EXCEEDS_SESSION", "NO_POST_SIGNAL_BAR", "NO_POST_SIGNAL_BAR"]
    assert [got["late", h]["reason"] for h in ("SESSION", "D1", "D3")] == [None, "MISSING_DAILY_BAR", "MISSING_DAILY_BAR"]
    assert [got["gap", h]["reason"] for h in ("1H", "SESSION")] == [None, "MISSING_BAR"]
    assert got["none", "D1"]["reason"] == "MISSING_BAR" and got["zero", "1H"]["reason"] == "INVALID_SOURCE"
    assert all(r["return_pct"] is None and r["touch"] is None for r in got.values() if r["reason"])
    assert labels(spark, [("x", "A", D[1], 1, 105.0, "BUY", 130.0, 90.0, None, None)], bars(drop={(D[3], s) for s in range(4)}))["x", "D3"]["reason"] == "MISSING_DAILY_BAR"
