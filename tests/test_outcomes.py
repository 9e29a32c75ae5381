import datetime as dt
import random

from sigspark.operators import outcomes as out

BARS = "symbol string, session_no int, open double, high double, low double, close double"
REC = "id string, symbol string, session_no int, price double, target double, stop double, decision string, model string"


def label(spark, bars, recs, last, horizons=(1, 3, 5)):
    b = spark.createDataFrame(bars, BARS)
    r = spark.createDataFrame(recs, REC)
    return {(x.id, x.horizon): x for x in out.label_daily_outcomes(r, b, spark.createDataFrame([(last,)], "last_no int"), horizons).collect()}


def test_touch_rules(spark):
    bars = [("A", 1, 100, 100, 100, 100), ("A", 2, 100, 121, 79, 100), ("B", 1, 100, 100, 100, 100), ("B", 2, 125, 130, 70, 90), ("C", 1, 1, 1, 1, 1), ("C", 2, 100, 121, 95, 110)]
    bars = [tuple(float(v) if i > 1 else v for i, v in enumerate(b)) for b in bars]
    recs = [(s, s, 1, 100.0, 120.0, 80.0, "BUY", "COMMON") for s in "ABC"]
    r = label(spark, bars, recs, 2, (1,))
    assert (r["A", 1].first_touch, r["A", 1].status) == ("AMBIGUOUS", "INSUFFICIENT")
    assert (r["B", 1].first_touch, r["B", 1].status) == ("TARGET", "SUCCESS")
    assert r["C", 1].status == "SUCCESS" and r["C", 1].mfe == 21.0 and r["C", 1].mae == -5.0


def brute(bars, rec, h, last):
    _, sym, s, base, t, sp, dec, model = rec
    if s + h > last:
        return None
    w = [bars.get((sym, k)) for k in range(s + 1, s + h + 1)]
    if any(x is None for x in w):
        return ("INSUFFICIENT", None)
    short = dec == "SELL"
    first = None
    for o, hi, lo, c in w:
        th, sh = (lo <= t, hi >= sp) if short else (hi >= t, lo <= sp)
        if th or sh:
            ot, os_ = (o <= t, o >= sp) if short else (o >= t, o <= sp)
            first = "TARGET" if ot else "STOP" if os_ else "AMBIGUOUS" if th and sh else "TARGET" if th else "STOP"
            break
    return (first, round((w[-1][3] / base - 1) * 100, 9))


def test_against_brute_force_over_page_borders(spark):
    rnd = random.Random(5)
    bars, table = [], {}
    for sym in "AB":
        for n in range(40, 150):
            if rnd.random() < 0.03:
                continue
            c = rnd.uniform(80, 120)
            o = rnd.uniform(80, 120)
            hi, lo = max(o, c) + rnd.random() * 8, min(o, c) - rnd.random() * 8
            bars.append((sym, n, o, hi, lo, c))
            table[sym, n] = (o, hi, lo, c)
    recs = []
    for (sym, n), (o, hi, lo, c) in table.items():
        buy = rnd.random() < 0.5
        recs.append((f"{sym}{n}", sym, n, c, c * (1.12 if buy else 0.88), c * (0.9 if buy else 1.1), "BUY" if buy else "SELL", "COMMON"))
    got = label(spark, bars, recs, 149, (1, 5, 20))
    for rec in recs:
        for h in (1, 5, 20):
            want = brute(table, rec, h, 149)
            x = got.get((rec[0], h))
            if want is None:
                assert x is None
            elif want[0] == "INSUFFICIENT":
                assert not x.completed and x.status == "INSUFFICIENT"
            else:
                assert (x.first_touch, round(x.return_pct, 9)) == want


def test_future_bars_do_not_change_a_label(spark):
    bars = [("A", n, 100.0, 104.0, 97.0, 101.0) for n in range(1, 10)]
    rec = [("A1", "A", 1, 100.0, 120.0, 80.0, "BUY", "COMMON")]
    a = label(spark, bars[:4], rec, 4)
    b = label(spark, bars + [("A", 10, 1.0, 500.0, 1.0, 1.0)], rec, 10)
    assert tuple(a["A1", 3]) == tuple(b["A1", 3])
    assert ("A1", 5) not in a
