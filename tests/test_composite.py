from sigspark.operators import composite as cp

SCHEMA = ("technical DOUBLE, technical_age DOUBLE, news_effect DOUBLE, news_confirmation DOUBLE, news_id LONG, macro_points DOUBLE, sector_points DOUBLE, macro_id LONG, sector_id LONG, macro_age DOUBLE, "
          "history_n LONG, history_k LONG, regime_points DOUBLE, rsi DOUBLE, macd DOUBLE, volume_ratio_incl DOUBLE, support20 DOUBLE, resistance20 DOUBLE")
BASE = dict(technical=90.0, technical_age=5.0, news_effect=4.0, news_confirmation=2.0, news_id=1, macro_points=3.0, sector_points=2.0, macro_id=7, sector_id=8, macro_age=1440.0, history_n=40, history_k=30,
            regime_points=2.0, rsi=50.0, macd=1.0, volume_ratio_incl=100.0, support20=1.0, resistance20=2.0)


def score(spark, **change):
    row = BASE | change
    return cp.composite_score(spark.createDataFrame([tuple(row[c.split()[0]] for c in SCHEMA.split(", "))], SCHEMA)).first()


def test_seven_groups_by_hand(spark):
    r = score(spark)
    parts = [28.0, 2.4, 0.45, 0.2, 0.75, 0.75, 0.4]
    assert [round(r[f"c_{g}"], 9) for g in cp.WEIGHTS] == parts
    assert round(r.score, 9) == round(50 + sum(parts), 9) and r.score_confidence == 100 and r.composite == "STRONG_BUY"


def test_one_event_counts_once(spark):
    assert score(spark, sector_id=7).c_sector == 0
    assert score(spark, sector_id=None, sector_points=3.0).c_sector == 0
    r = score(spark, news_id=7)
    assert r.c_macro == 0 and r.c_sector > 0


def test_age_and_gaps_lower_confidence_and_hold_a_buy(spark):
    assert score(spark, technical_age=11.0).score_confidence == 70
    r = score(spark, technical_age=21.0)
    assert r.score_confidence == 35 and r.composite == "WATCH"
    assert score(spark, technical=None).score_confidence == 20
    assert score(spark, history_n=29).c_history == 0
    assert score(spark, technical=0.0, news_effect=-6.0).composite == "STRONG_SELL"
