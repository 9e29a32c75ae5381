"""The plan for the next session, on hand-made bars."""

import pytest

from sigspark.operators import plan as pl


def series(n, step=0.4, gap=None):
    """A rising series of bars, each a point high on both sides, with twice the volume on the last one."""
    out = []
    for k in range(n):
        close = 100 + step * k - (1.5 if k % 5 == 4 else 0)
        no = k + (3 if gap is not None and k >= gap else 0)
        out.append((no, close - 0.3, close + 1.0, close - 1.0, close, 300.0 if k == n - 1 else 100.0))
    return out


def plans(spark, **symbols):
    rows = [(s, *r) for s, bars in symbols.items() for r in bars]
    bars = spark.createDataFrame(rows, "symbol string, session_no long, open double, high double, low double, close double, volume double")
    return {(r.symbol, r.asked_no): r for r in pl.tomorrow_plan(bars).collect()}


def test_levels_by_hand(spark):
    """Price 100, ATR 10, support 90, resistance 104, averages 97 and 98."""
    cols = "close double, atr double, support double, resistance double, sma20 double, ema21 double"
    rows = [(100.0, 10.0, 90.0, 104.0, 97.0, 98.0), (100.0, 10.0, 100.0, 104.0, 97.0, 98.0), (100.0, 0.0, 90.0, 104.0, 97.0, 98.0), (100.0, 10.0, 90.0, None, 97.0, 98.0), (100.0, 10.0, 90.0, 98.0, 97.0, 98.0)]
    got = pl.plan_levels(spark.createDataFrame(rows, cols), "close", "atr", "support", "resistance").select(*pl.LEVELS).collect()
    low, high, stop, gain = 97 - 2.3, 97 + 0.3, 87.5, 104.0
    high = min(high, 104 - 1.0)
    entry = (low + high) / 2
    assert list(got[0]) == pytest.approx([low, high, gain, 106.5, stop, (gain - entry) / (entry - stop), entry])
    assert all(v is None for r in got[1:4] for v in r)
    assert got[4].buy_zone_high == pytest.approx(97.0) and got[4].take_profit_low == 98.0  # a close resistance limits both


def test_needs_51_sessions_without_a_gap(spark):
    got = plans(spark, A=series(60), G=series(60, gap=20), B=[(*r[:3], 0.0 if r[0] == 30 else r[3], *r[4:]) for r in series(60)])
    assert got["A", 49].plan_status == "INSUFFICIENT" and got["A", 49].warnings == ["DAILY_DATA"] and got["A", 49].reference_price is None
    assert got["A", 50].plan_status != "INSUFFICIENT" and got["A", 50].plan_no == 51
    assert all(r.plan_status == "INSUFFICIENT" for (s, _), r in got.items() if s in "GB")


def test_deductions_status_and_look_ahead(spark):
    full = series(60)
    got = plans(spark, A=full, S=full[:57], C=[*full[:-1], (59, 110.0, 111.0, 100.0, 101.0, 100.0)])
    last = got["A", 59]
    assert last.confirmation_count == len(last.reasons) and "ABOVE_SMA20" in last.reasons and "POSITIVE_BODY" in last.reasons
    assert last.confidence == pytest.approx(max(0, last.confirmation_count / 8 * 100 - sum(pl.DEDUCTIONS.get(w, 0) for w in last.warnings)))
    # A plan of an earlier session is the same with and without later bars.
    assert got["A", 56].asDict() == got["S", 56].asDict() | {"symbol": "A"}
    stale = got["S", 59]
    assert stale.session_no == 56 and "STALE" in stale.warnings and stale.plan_status == "WAIT" and stale.buy_zone_low is None and stale.confidence <= 35
    crash = got["C", 59]
    assert "CRASH" in crash.warnings and crash.plan_status == "WAIT" and crash.stop_loss is None


def test_empty_bars(spark):
    bars = spark.createDataFrame([], "symbol string, session_no long, open double, high double, low double, close double, volume double")
    assert pl.tomorrow_plan(bars).count() == 0
