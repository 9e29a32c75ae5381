"""Point-in-time outcome labels for frozen records.

Bars are folded into pages: one row per (symbol, page of 64 sessions) holding the
bars of its own sessions and of the reach after them, at most 124 structs. A record
meets exactly one page with a plain equi-join, so all horizons cost one shuffle of the
records, a hot symbol is spread over its pages (and split further by the adaptive skew
join), and no row explosion or regrouping by record follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.functions.scalars import first_match, pct_change, ratio

DAILY_HORIZONS = (1, 3, 5, 10, 20, 60)
PAGE = 64


def evaluated(df: DataFrame) -> DataFrame:
    """Fix the row's columns as computed values.

    Array expressions are not shared between the expressions that use them, and filters
    are pushed down by copying them. A generator ends both: what is below is computed
    once per row, what is above reads plain columns. No shuffle, no row is added.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))


def bar_pages(bars: DataFrame, key=("symbol",), order: str = "session_no", reach: int = 60, page: int = PAGE) -> DataFrame:
    """Pages of bars; order numbers are unique per key, which bounds every page."""
    no = F.col(order)
    own = F.floor(no / page)
    pages = F.when(no % page < reach, F.array(own, own - 1)).otherwise(F.array(own))
    bar = F.struct(no.alias("no"), "open", "high", "low", "close")
    return (
        bars.select(*key, F.explode(pages).alias("_page"), bar.alias("_b"))
        .groupBy(*key, "_page")
        .agg(F.array_sort(F.collect_list("_b")).alias("_bars"))
    )


def attach_pages(records: DataFrame, bars: DataFrame, key=("symbol",), order: str = "session_no", reach: int = 60) -> DataFrame:
    pages = bar_pages(bars, key, order, reach)
    return records.withColumn("_page", F.floor(F.col(order) / PAGE)).join(pages, [*key, "_page"], "left").drop("_page")


def _get(arr: Column, i: int) -> Column:
    return F.get(arr, F.lit(i))


def touch_columns(window: Column, base: Column, target: Column, stop: Column, short: Column) -> dict[str, Column]:
    """First order numbers at which target and stop were touched."""
    def hit_target(b):
        return F.when(short, b["low"] <= target).otherwise(b["high"] >= target)

    def hit_stop(b):
        return F.when(short, b["high"] >= stop).otherwise(b["low"] <= stop)

    return {
        "_tk": _get(F.filter(window, hit_target), 0)["no"],
        "_sk": _get(F.filter(window, hit_stop), 0)["no"],
    }


def best_move(high: Column, low: Column, base: Column, short: Column) -> Column:
    best = F.when(short, ratio(base - low, base) * 100).otherwise(ratio(high - base, base) * 100)
    return F.greatest(F.lit(0.0), F.coalesce(best, F.lit(0.0)))


def worst_move(high: Column, low: Column, base: Column, short: Column) -> Column:
    worst = F.when(short, ratio(base - high, base) * 100).otherwise(ratio(low - base, base) * 100)
    return F.least(F.lit(0.0), F.coalesce(worst, F.lit(0.0)))


def _high(bars: Column) -> Column:
    return F.array_max(F.transform(bars, lambda b: b["high"]))


def _low(bars: Column) -> Column:
    return F.array_min(F.transform(bars, lambda b: b["low"]))


def touches(df: DataFrame, path: str = "_path") -> DataFrame:
    """What one scan of the whole path tells every horizon: the touch times, the opening
    price of the first touch bar and the moves before a touch (touch bar left out)."""
    w, base, short = F.col(path), F.col("price"), F.col("short")
    df = evaluated(df.withColumns(touch_columns(w, base, F.col("target"), F.col("stop"), short)))
    at = F.least(F.col("_tk"), F.col("_sk"))
    before_stop = F.filter(w, lambda b: b["no"] < F.col("_sk"))
    before_target = F.filter(w, lambda b: b["no"] < F.col("_tk"))
    return df.withColumns(
        {
            "_open": _get(F.filter(w, lambda b: b["no"] == at), 0)["open"],
            "_mfs": best_move(_high(before_stop), _low(before_stop), base, short),
            "_mat": worst_move(_high(before_target), _low(before_target), base, short),
        }
    )


def first_touch(use_open_rule: bool = True) -> Column:
    """TARGET, STOP, AMBIGUOUS or NULL; the opening price decides a double touch when asked."""
    short, t, s, o = F.col("short"), F.col("target"), F.col("stop"), F.col("_open")
    at = F.least(F.col("_tk"), F.col("_sk"))
    rules = [(at.isNull(), None)]
    if use_open_rule:
        rules += [(F.when(short, o <= t).otherwise(o >= t), "TARGET"), (F.when(short, o >= s).otherwise(o <= s), "STOP")]
    rules += [(F.col("_tk") == F.col("_sk"), "AMBIGUOUS"), (F.col("_tk") == at, "TARGET")]
    return F.when(F.col("levels_ok"), first_match(*rules, default="STOP"))


def path_of(order: str, reach: int) -> Column:
    empty = F.expr("CAST(array() AS ARRAY<STRUCT<no:INT,open:DOUBLE,high:DOUBLE,low:DOUBLE,close:DOUBLE>>)")
    return F.filter(F.coalesce(F.col("_bars"), empty), lambda b: (b["no"] > F.col(order)) & (b["no"] <= F.col(order) + reach))


def outcome_status(risk: Column, directional: Column, against: Column) -> Column:
    touch = F.col("first_touch")
    return first_match(
        (touch == "STOP", "STOP"),
        ((touch == "AMBIGUOUS") | ~F.col("levels_ok"), "INSUFFICIENT"),
        (touch == "TARGET", "SUCCESS"),
        ((directional >= risk) & (against < risk), "SUCCESS"),
        ((directional > 0) & (directional >= risk * 0.5), "PARTIAL"),
        default="FAIL",
    )


def label_daily_outcomes(
    records: DataFrame, bars: DataFrame, last_session: DataFrame, horizons=DAILY_HORIZONS, order: str = "session_no"
) -> DataFrame:
    """One row per record and due horizon. Missing sessions never slide a horizon.

    ``last_session`` is a single row (last closed session number); bars after it are
    never read for a label.
    """
    reach = max(horizons)
    base, t, s = F.col("price"), F.col("target"), F.col("stop")
    d = attach_pages(records, bars, order=order, reach=reach)
    short = (F.col("decision") == "SELL") & ~F.col("model").startswith("TOMORROW")
    d = evaluated(d.withColumns({"_path": path_of(order, reach), "short": short}).drop("_bars"))
    ordered = F.when(F.col("short"), (t < base) & (base < s)).otherwise((s < base) & (base < t))
    d = touches(d).withColumn("levels_ok", F.coalesce(ordered, F.lit(False)))
    d = d.crossJoin(last_session.select(F.col("last_no").alias("_last")))
    d = d.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    due = F.col(order) + F.col("horizon")
    d = d.filter(due <= F.col("_last"))
    # A touch after the horizon has not happened yet.
    d = d.withColumns({"_w": F.filter("_path", lambda b: b["no"] <= due), "_tk": F.when(F.col("_tk") <= due, F.col("_tk")),
                       "_sk": F.when(F.col("_sk") <= due, F.col("_sk"))})
    d = evaluated(d.drop("_path"))
    d = evaluated(d.withColumns({"_n": F.size("_w"), "_hi": _high(F.col("_w")), "_lo": _low(F.col("_w")),
                                 "_exit": F.get("_w", F.size("_w") - 1)["close"]}).drop("_w"))
    reward = F.when(F.when(F.col("short"), t < base).otherwise(t > base), F.abs(t - base) / base * 100)
    d = d.withColumns(
        {
            "completed": (F.col("_n") == F.col("horizon")) & (base > 0),
            "mfe": best_move(F.col("_hi"), F.col("_lo"), base, F.col("short")),
            "mae": worst_move(F.col("_hi"), F.col("_lo"), base, F.col("short")),
            "mfe_before_stop": F.when(F.col("_sk").isNotNull(), F.col("_mfs")),
            "mae_before_target": F.when(F.col("_tk").isNotNull(), F.col("_mat")),
            # The opening price belongs to the earliest touch, which is inside the horizon or there is none.
            "first_touch": first_touch(),
        }
    )
    d = d.withColumn("approach_ratio", ratio(F.col("mfe"), reward))
    done = F.col("completed")
    exit_, hi, lo = F.col("_exit"), F.col("_hi"), F.col("_lo")
    change = pct_change(exit_, base)
    d = d.withColumns(
        {
            "exit_price": F.when(done, exit_),
            "return_pct": F.when(done, change),
            "directional_return": F.when(done, F.when(F.col("short"), -change).otherwise(change)),
            "max_rise": F.when(done, pct_change(hi, base)),
            "max_drop": F.when(done, pct_change(lo, base)),
            "risk_pct": F.when(F.col("levels_ok"), F.abs(base - s) / base * 100),
            "reward_pct": F.when(F.col("levels_ok"), F.abs(t - base) / base * 100),
        }
    )
    against = F.when(F.col("short"), F.greatest(F.lit(0.0), F.col("max_rise"))).otherwise(
        F.abs(F.least(F.lit(0.0), F.col("max_drop")))
    )
    keep = [c for c in ("mfe", "mae", "mfe_before_stop", "mae_before_target", "approach_ratio", "first_touch")]
    d = d.withColumns(
        {
            "status": F.when(~done, "INSUFFICIENT").otherwise(
                outcome_status(F.col("risk_pct"), F.col("directional_return"), against)
            ),
            "missing_reason": first_match((~(base > 0), "MISSING_REFERENCE"), (~done, "MISSING_SESSION"), default=None),
            "target_hit": F.when(done & F.col("levels_ok"), F.col("_tk").isNotNull()),
            "stop_hit": F.when(done & F.col("levels_ok"), F.col("_sk").isNotNull()),
            "rr": ratio(F.col("reward_pct"), F.col("risk_pct")),
            "due_no": due,
        }
    )
    d = d.withColumns({c: F.when(done, F.col(c)) for c in keep})
    return evaluated(d.drop("_tk", "_sk", "_last", "_n", "_hi", "_lo", "_exit", "_open", "_mfs", "_mat"))


def quality_reason(order: str = "session_no") -> Column:
    """First failed check of a labelled record, NULL when the example is clean."""
    base, target = F.col("price"), F.col("target")
    sign = first_match((F.col("decision") == "BUY", 1), (F.col("decision") == "SELL", -1), default=None)
    change = pct_change(F.col("exit_price"), base)
    return first_match(
        (F.col("symbol").isNull() | (F.trim("symbol") == "") | F.col("signal_at").isNull(), "MALFORMED"),
        (F.col("training_state") == "REFERENCE", "UNVERIFIED"),
        (F.col("model").rlike("SHADOW|BACKTEST|BASELINE"), "NON_LIVE"),
        (F.col("feature_at") > F.col("signal_at"), "FUTURE_FEATURES"),
        (base.isNull() | (base <= 0), "MISSING_BASE_PRICE"),
        (target.isNull() | (target <= 0), "MISSING_TARGET_PRICE"),
        (sign.isNull(), "UNKNOWN_DIRECTION"),
        ((target - base) * sign <= 0, "INVALID_TARGET_DIRECTION"),
        (F.col("status").isNull() | ~F.col("completed"), "PENDING"),
        (F.col("exit_price").isNull() | (F.col("exit_price") <= 0) | F.col("return_pct").isNull(), "INVALID_RESULT_PRICE"),
        (F.abs(F.col("return_pct") - change) > 0.001, "BASE_OR_RETURN_MISMATCH"),
        default=None,
    )
