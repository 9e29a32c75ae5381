"""Buying and selling points, levels and decision of a bar, by hand."""

import pytest

from sigspark.operators import intraday as iy

NAMES = "id close day_open day_high day_low vwap macd_hist prev_hist ema9 ema21 obv_trend rsi volume3_ratio momentum3 momentum6 resistance20".split()
SCHEMA = ", ".join(f"{n} {'string' if n in ('id', 'obv_trend') else 'double'}" for n in NAMES)
STRONG = (0.5, 0.4, 99.5, 99.0, "RISING", 60.0, 160.0, 0.5, 1.0, 99.9)
ROWS = [
    ("dear", 100.0, 98.0, 101.0, 97.0, 99.0, *STRONG),  # points enough, too little reward
    ("buy", 100.0, 99.0, 103.0, 99.5, 99.0, *STRONG),
    ("sell", 95.0, 100.0, 100.0, 95.0, 97.0, -0.5, -0.4, 96.0, 97.0, "FALLING", 30.0, 50.0, -1.0, -2.0, 101.0),
    ("unknown", 100.0, None, 100.0, 100.0, *[None] * 10, None),
    ("mixed", 100.0, 94.0, 100.0, 94.0, 100.0, 0.0, 0.1, 101.0, 100.5, "FLAT", 76.0, 125.0, 1.0, -1.0, 99.0),
]


def test_points_levels_and_decision(spark):
    got = {r.id: r for r in iy.buy_sell(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert {k: (r.buy_points, r.sell_points, r.decision, r.decision_confidence) for k, r in got.items()} == {
        "dear": (100, 0, "WATCH", 100), "buy": (100, 0, "BUY", 100), "sell": (0, 100, "SELL", 100), "unknown": (0, 0, "WATCH", 0),
        # 5 (averages), 9 (volume), 7 (breakout without volume) against 15 (histogram), 12 (hot), 10 (risen too fast)
        "mixed": (21, 37, "WATCH", 37)}
    levels = lambda r: (r.entry_low, r.entry_high, r.take_profit, r.stop_loss, r.reward_risk)
    assert levels(got["dear"]) == pytest.approx((99.28, 100, 101.4, 98.4, 0.875))
    assert levels(got["buy"]) == pytest.approx((99.5, 100, 103, 98.73, 3 / 1.27))
    assert levels(got["sell"]) == pytest.approx((95, 95, 100, 93.9, 5 / 1.1))
    assert levels(got["unknown"]) == pytest.approx((100, 100, 100.175, 99.89, 0.175 / 0.11))


def test_empty_and_repeated_rows(spark):
    assert iy.buy_sell(spark.createDataFrame([], SCHEMA)).count() == 0
    assert iy.buy_sell(spark.createDataFrame(ROWS[:1] * 2, SCHEMA)).count() == 2
