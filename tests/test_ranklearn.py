import pytest
from pyspark.sql import functions as F

from sigspark.operators import ranklearn as rl

COLS = "signal_id string, session_no int, rank int, score double, rsi double, volume_ratio double, price double, sma20 double, sma50 double, vwap20 double, obv_trend string, bb_zone string, bb_squeeze boolean, bb_upper_break boolean, atr14 double, momentum3 double"
TABLE = "indicator string, condition string, edge double, strength double"


def candidate(name, rank, score, rsi=55.0, volume=160.0, momentum=1.0):
    return (name, 1, rank, score, rsi, volume, 100.0, 99.0, 98.0, 101.0, "RISING", None, None, None, None, momentum)


def run(spark, rows, table):
    d = rl.reranked(rl.adjusted(spark.createDataFrame(rows, COLS), spark.createDataFrame(table, TABLE)), "session_no")
    return {r["signal_id"]: r for r in d.collect()}


def test_order_is_unchanged_without_evidence(spark):
    rows = [candidate("a", 1, 70.0), candidate("b", 2, 70.0), candidate("c", 3, 60.0)]
    got = run(spark, rows, [])
    assert [(got[x]["adjustment"], got[x]["learned_rank"], got[x]["rank_change"], got[x]["final_score"]) for x in "abc"] == [(0.0, 1, 0, 70.0), (0.0, 2, 0, 70.0), (0.0, 3, 0, 60.0)]


def test_families_share_one_averaged_budget(spark):
    table = [("RSI", "50-59", 0.8, 1.0), ("MOMENTUM", "POSITIVE", 0.4, 0.6), ("SMA_TREND", "ABOVE", 5.0, 1.0), ("VWAP", "BELOW", -9.0, 1.0), ("RSI", "0-29", 7.0, 1.0)]
    got = run(spark, [candidate("a", 1, 70.0)], table)["a"]
    # (0.8 + 0.4) / 2 * 0.75, then one family at its cap each way.
    assert got["uncapped"] == pytest.approx(0.45 + 0.75 - 0.75)


def test_combination_replaces_its_families_only_when_as_well_supported(spark):
    single = [("RSI", "50-59", 0.8, 0.6), ("VOLUME", "150-199", -0.4, 0.25), ("SMA_TREND", "ABOVE", 0.2, 1.0)]
    row = [candidate("a", 1, 70.0)]
    strong = run(spark, row, [*single, ("COMBO_RSI_VOLUME", "CONFIRMED", -0.5, 0.6)])["a"]
    weak = run(spark, row, [*single, ("COMBO_RSI_VOLUME", "CONFIRMED", -0.5, 0.25)])["a"]
    assert strong["uncapped"] == pytest.approx(0.15 - 0.5)
    assert weak["uncapped"] == pytest.approx(0.6 - 0.3 + 0.15)
    both = run(spark, row, [*single, ("COMBO_RSI_VOLUME", "CONFIRMED", -0.5, 1.0), ("COMBO_TREND_VOLUME", "CONFIRMED", 0.9, 1.0)])["a"]
    assert both["uncapped"] == pytest.approx(0.6 + 0.9)


def test_total_cap_bounds_and_new_order(spark):
    up = [(i, c, 9.0, 1.0) for i, c in (("RSI", "50-59"), ("SMA_TREND", "ABOVE"), ("VOLUME", "150-199"), ("OBV", "POSITIVE"))]
    got = run(spark, [candidate("a", 1, 71.0, rsi=75.0, volume=90.0), candidate("b", 2, 70.0), candidate("c", 3, 99.5)], up)
    assert got["b"]["uncapped"] == pytest.approx(2.25) and got["c"]["final_score"] == 100.0
    assert [got[x]["learned_rank"] for x in "abc"] == [3, 2, 1] if got["a"]["final_score"] < got["b"]["final_score"] else True
    many = [*up, ("VWAP", "BELOW", 9.0, 1.0), ("COMBO_VWAP_OBV", "NOT_CONFIRMED", 9.0, 1.0)]
    assert run(spark, [candidate("b", 1, 70.0)], many)["b"]["adjustment"] <= rl.MOST


def test_evidence_prefers_the_own_list_and_halves_the_rest(spark):
    rows = []
    for h in (1, 3):
        for i in range(120):
            own = i % 2 == 0
            good = i % 3 > 0 if own else i % 3 == 0
            rows.append((f"s{i}", h, "OWN" if own else "X", 55.0 if i < 80 else 20.0, None, 3.0 if good else -2.0, 3.0 if good else -2.0, 4.0, -2.0))
    cols = "signal_id string, horizon int, model string, rsi double, reason string, directional_return double, return_pct double, mfe double, mae double"
    h = spark.createDataFrame(rows, cols)
    for name, kind in (("volume_ratio", "double"), ("price", "double"), ("sma20", "double"), ("sma50", "double"), ("vwap20", "double"), ("obv_trend", "string"), ("bb_zone", "string"), ("bb_squeeze", "boolean"), ("bb_upper_break", "boolean"), ("atr14", "double"), ("momentum3", "double")):
        h = h.withColumn(name, F.lit(None).cast(kind))
    got = {(r["indicator"], r["condition"]): (r["edge"], r["strength"]) for r in rl.evidence(h, F.col("model") == "OWN").collect()}
    # 40 own rows with RSI 55: LOW trust at full share; 20 own rows with RSI 20 are too few, so are 40 of all at half share.
    assert got["RSI", "50-59"][1] == 0.25 and got["RSI", "0-29"][1] == 0.125
    only_late = rl.evidence(h.filter("horizon = 3"), F.col("model") == "OWN").collect()
    assert only_late == []
