from pyspark.sql import functions as F

from sigspark.operators import flags as fl

COLUMNS = ("rsi DOUBLE, macd DOUBLE, macd_signal DOUBLE, sma20 DOUBLE, sma50 DOUBLE, ema9 DOUBLE, ema21 DOUBLE, close DOUBLE, prev_close DOUBLE, vwap20 DOUBLE, prev_vwap20 DOUBLE, "
           "obv_trend STRING, obv_break STRING, obv_divergence STRING, bb_mid DOUBLE, bb_squeeze BOOLEAN, bb_upper_break BOOLEAN, momentum3 DOUBLE, volume_ratio_incl DOUBLE, rr DOUBLE, support20 DOUBLE, "
           "resistance20 DOUBLE, atr14 DOUBLE, breakout_level DOUBLE, market_score DOUBLE, breadth_score DOUBLE, market_confidence DOUBLE, sector_score DOUBLE, sector_confidence DOUBLE, "
           "news_source STRING, news_confirmed BOOLEAN, news_points DOUBLE, macro_points DOUBLE, final STRING, known BOOLEAN")
FULL = dict(rsi=65.0, macd=2.0, macd_signal=1.0, sma20=9.0, sma50=10.0, ema9=5.0, ema21=4.0, close=100.0, prev_close=98.0, vwap20=99.0, prev_vwap20=98.0, obv_trend="RISING", obv_break="DOWN",
            obv_divergence=None, bb_mid=97.0, bb_squeeze=False, bb_upper_break=True, momentum3=-1.0, volume_ratio_incl=150.0, rr=1.5, support20=90.0, resistance20=100.0, atr14=5.0, breakout_level=100.0,
            market_score=10.0, breadth_score=-3.0, market_confidence=50.0, sector_score=5.0, sector_confidence=49.0, news_source="SITE", news_confirmed=False, news_points=0.0, macro_points=-2.0, final="WAIT", known=True)
WANT = dict(SMA_TREND=False, EMA_TREND=True, MACD=True, RSI=True, MOMENTUM=False, VOLUME=True, OBV_TREND=True, OBV_BREAK=False, OBV_POS_DIVERGENCE=False, OBV_NEG_DIVERGENCE=False, VOLUME_BREAKOUT=True,
            VWAP=True, VWAP_RECLAIM=True, BOLLINGER_SQUEEZE=False, BOLLINGER_BREAK=True, SUPPORT_RESISTANCE=False, ATR_NORMAL=True, RISK_REWARD=True, MARKET_POSITIVE=True, MARKET_NEGATIVE=False,
            BREADTH_POSITIVE=False, BREADTH_NEGATIVE=True, SECTOR_STRONG=None, SECTOR_WEAK=None, DISCLOSURE=False, COMPANY_SITE=True, NEWS_POSITIVE=False, NEWS_NEGATIVE=False, NEWS_PRICE_CONFIRMED=False,
            MACRO_POSITIVE=False, MACRO_NEGATIVE=True, STRONG_BUY=False, BUY=False, WAIT=True, SELL=False, STRONG_SELL=False)


def test_criteria_by_hand(spark):
    assert len(fl.CRITERIA) == 36 == len(WANT)
    empty = {k: None for k in FULL} | {"known": True}
    rows = [FULL, FULL | {"known": False}, empty]
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in COLUMNS.split(", ")) for r in rows], COLUMNS)
    got = [r.asDict() for r in df.select(*[v.alias(k) for k, v in fl.evidence_flags(F.col("known")).items()]).collect()]
    assert got[0] == WANT
    assert set(got[1].values()) == {None} == set(got[2].values())


def test_controlled_score_by_hand(spark):
    names = [*fl.CRITERIA, "raw", "valid", "unsafe"]
    schema = ", ".join(f"{c} BOOLEAN" for c in fl.CRITERIA) + ", raw DOUBLE, valid BOOLEAN, unsafe BOOLEAN"
    row = lambda **k: tuple({"raw": 50.0, "valid": True, "unsafe": False, **k}.get(n) for n in names)
    rows = [row(MACD=True, RSI=True, VWAP=False), row(MACD=True, RSI=True, unsafe=True), row(RSI=True, unsafe=True), row(MACD=True, valid=False), row(), row(MACD=True, BUY=True, raw=99.5)]
    weights = spark.createDataFrame([("MACD", fl.BASE_WEIGHT["MACD"] + 0.015), ("RSI", fl.BASE_WEIGHT["RSI"] - 0.004), ("BUY", 0.9)], "criterion string, weight double")
    df = spark.createDataFrame(rows, schema).coalesce(1)
    got = fl.controlled_score(df, weights, "raw", F.col("valid"), F.col("unsafe")).select("part_trend", "part_momentum", "correction", "shadow").collect()
    assert [tuple(round(x, 9) for x in r) for r in got] == [(1.5, -0.4, 1.1, 51.1), (1.5, -0.4, 0.0, 50.0), (0.0, -0.4, -0.4, 49.6), (0.0, 0.0, 0.0, 50.0), (0.0, 0.0, 0.0, 50.0), (1.5, 0.0, 2.0, 100.0)]
