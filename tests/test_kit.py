import datetime as dt
import random
from statistics import mean, median

import pytest
from pyspark.sql import functions as F

from sigspark.functions import stats as st
from sigspark.functions.quantiles import robust
from sigspark.operators import bars as br
from sigspark.operators import context as cx
from sigspark.operators import news as nw
from sigspark.operators import records as rc
from sigspark.streaming import streams as sm


def test_robust_is_exact_with_a_hot_group_and_ties(spark):
    rnd = random.Random(1)
    data = {"hot": [rnd.gauss(0, 3) for _ in range(3000)] + [1.25] * 900, "few": [4.0, -2.0, 7.5], "one": [3.0], "far": [1e9, -1e9, 5.0, 6.0] * 6}
    d = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs] + [("few", None)], "k string, v double")
    got = {r.k: r for r in robust(d, ["k"], "v").collect()}
    for k, vs in data.items():
        s, cut = sorted(vs), int(len(vs) * 0.1)
        assert got[k].n == len(vs)
        assert got[k].median == pytest.approx(median(s))
        assert got[k].mean == pytest.approx(mean(s), abs=1e-6)
        assert got[k].trimmed_mean == pytest.approx(mean(s[cut:-cut] if cut else s), abs=1e-6)


def test_wilson_bounds(spark):
    lo, hi = st.wilson(F.lit(0), F.lit(0))
    r = spark.range(1).select(lo.alias("a"), hi.alias("b"), st.wilson(F.lit(30), F.lit(40))[0].alias("c"), st.wilson(F.lit(40), F.lit(40))[1].alias("d")).first()
    assert r.a is None and r.b is None and r.c == pytest.approx(0.59807, abs=1e-4) and r.d == 1.0


def test_relative_score_parts(spark):
    def score(a, b, c):
        v = {1: F.lit(a).cast("double"), 5: F.lit(b).cast("double"), 20: F.lit(c).cast("double")}
        return cx.relative_score(v)

    r = spark.range(1).select(score(2, 5, 10).alias("a"), score(10000, 0, 0).alias("b"), score(1, None, 2).alias("c")).first()
    assert (r.a, r.b, r.c) == (100.0, 60.0, None)


def test_asof_against_brute_force(spark):
    rnd = random.Random(2)
    t0 = dt.datetime(2024, 1, 1)
    at = lambda: t0 + dt.timedelta(minutes=rnd.randrange(0, 60000))
    left = [(i, rnd.choice("AB"), at()) for i in range(300)]
    right = [(rnd.choice("AB"), at(), j) for j in range(120)]
    got = cx.asof_rows(spark.createDataFrame(left, "id int, k string, t timestamp"), spark.createDataFrame(right, "k string, known timestamp, v int"), ["k"], "t", "known", ["v"], 86400, 5 * 86400)
    got = {r.id: r.v for r in got.collect()}
    assert len(got) == 300
    for i, k, t in left:
        c = max(((x, v) for kk, x, v in right if kk == k and x <= t), default=None)
        want = c[1] if c and (t - c[0]).total_seconds() <= 5 * 86400 else None
        assert got[i] == want


def test_conflicting_bar_day_is_dropped(spark):
    rows = [("A", 1, 1.0, 2.0, 0.5, 1.5)] * 2 + [("A", 2, 1.0, 2.0, 0.5, 1.5), ("A", 2, 1.0, 3.0, 0.5, 1.5), ("A", 3, 1.0, 0.9, 0.5, 0.8)]
    d = spark.createDataFrame(rows, "symbol string, n int, open double, high double, low double, close double")
    assert [r.n for r in br.normalize_bars(d, ["symbol", "n"]).collect()] == [1]


def test_immutable_merge_actions(spark):
    s = spark.createDataFrame([("a", 1.0, None), ("b", 1.0, 5.0), ("c", 1.0, 5.0)], "id string, price double, res double")
    i = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 6.0), ("c", 1.0, 5.0), ("d", 1.0, None), ], "id string, price double, res double")
    got = {r.id: r.action for r in rc.merge_immutable(s, i, ["id"], ["price"], ["res"]).collect()}
    assert got == {"a": "UPDATE", "b": "CONFLICT", "c": "DUPLICATE", "d": "INSERT"}


def test_links_stay_linear_and_connect_copies(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("S", i, "same", t0 + dt.timedelta(minutes=7 * i)) for i in range(200)] + [("S", 999, "same", t0 + dt.timedelta(days=9))]
    d = spark.createDataFrame(rows, "symbol string, news_id int, key string, published_at timestamp")
    links = [(r.anchor_id, r.news_id) for r in nw.candidate_links(d, "key").collect()]
    assert len(links) == 199 and 999 not in {x for p in links for x in p}
    seen = {0}
    for _ in range(10):
        seen |= {b for a, b in links if a in seen}
    assert seen == set(range(200))


def test_lifecycle_states_and_day_reset(spark):
    sig = ["BUY", "BUY", "WATCH", "SELL", "SELL", "BUY"]
    day = dt.date(2024, 1, 1)
    rows = [("A", day, i, dt.datetime(2024, 1, 1, i), s, 50.0) for i, s in enumerate(sig)] + [("A", dt.date(2024, 1, 2), 0, dt.datetime(2024, 1, 2), "BUY", 50.0)]
    d = spark.createDataFrame(rows, "symbol string, day date, slot int, bar_start timestamp, signal string, score double")
    got = [r.state for r in sm.lifecycle(d).orderBy("day", "slot").collect()]
    assert got == ["NEW_BUY", "BUY_ON", "WEAKENING", "TURNED_SELL", "SELL_ON", "RECOVERING", "NEW_BUY"]
