"""Aggregate builders for outcome reports: each report stays one groupBy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.functions.quantiles import robust
from sigspark.functions.scalars import first_match, ratio

Z = 1.96
LABELS = ("SUCCESS", "PARTIAL", "FAIL", "STOP")
RELIABILITY = ((300, "HIGH"), (100, "MEDIUM"), (30, "LOW"))


def count_if(test: Column) -> Column:
    return F.count_if(F.coalesce(test, F.lit(False)))


def wilson(successes: Column, n: Column) -> tuple[Column, Column]:
    s, n = successes.cast("double"), n.cast("double")
    p = s / n
    den = 1 + Z * Z / n
    centre = (p + Z * Z / (2 * n)) / den
    radius = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / den
    known = n > 0
    return (F.when(known, F.greatest(F.lit(0.0), centre - radius)), F.when(known, F.least(F.lit(1.0), centre + radius)))


def corr_guarded(x: str, y: str, minimum: int = 3) -> Column:
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    spread = (F.max(a) > F.min(a)) & (F.max(b) > F.min(b))
    cov, va, vb = F.covar_pop(a, b), F.var_pop(a), F.var_pop(b)
    return F.when((F.count_if(both) >= minimum) & spread, F.try_divide(cov, F.sqrt(va * vb)))


def reliability(n: Column) -> Column:
    return first_match(*[(n >= cut, name) for cut, name in RELIABILITY], default="INSUFFICIENT")


def is_buy() -> Column:
    return (F.col("model") == "TOMORROW_TOP10") | (F.col("decision") == "BUY")


def summary_aggs() -> list[Column]:
    """Counts of a summary over completed rows; success only counts labelled rows."""
    r, st = F.col("return_pct"), F.col("status")
    labelled = st.isin(*LABELS)
    return [
        F.count(F.lit(1)).alias("evaluated"),
        count_if(labelled).alias("labelled"),
        count_if(st == "SUCCESS").alias("successes"),
        count_if(r > 0).alias("positive"), count_if(r < 0).alias("negative"), count_if(r == 0).alias("neutral"),
        count_if(F.col("target_hit")).alias("target_hits"), count_if(F.col("stop_hit")).alias("stop_hits"),
        count_if(is_buy() & (r > 0)).alias("tp"), count_if(is_buy() & (r <= 0)).alias("fp"),
        count_if(~is_buy() & (r <= 0)).alias("tn"), count_if(~is_buy() & (r > 0)).alias("fn"),
    ]


def summarize(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Summary of completed outcomes per group, with robust centre and success interval."""
    base = rows.filter("completed AND return_pct IS NOT NULL")
    g = base.groupBy(*keys).agg(*summary_aggs())
    g = g.join(robust(base, keys, "return_pct"), keys)
    lo, hi = wilson(F.col("successes"), F.col("labelled"))
    return g.withColumns({
        "success_rate": ratio(F.col("successes"), F.col("labelled")), "success_low": lo, "success_high": hi,
        "fp_rate": ratio(F.col("fp"), F.col("fp") + F.col("tn")), "fn_rate": ratio(F.col("fn"), F.col("fn") + F.col("tp")),
    })


def outcome_stats(rows: DataFrame, keys: list[str], value: str = "directional_return", roll=None) -> DataFrame:
    """Full statistics of clean examples per group; pending and excluded rows only counted.

    roll: as in ``robust``; rows then carry the fine key instead of the coarse one.
    """
    ok = F.col("reason").isNull()
    v = F.when(ok, F.col(value))
    every = rows.withColumn(roll[1], F.explode(roll[2])) if roll else rows
    counts = every.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), count_if(F.col("reason") == "PENDING").alias("pending"),
        count_if(F.col("reason").isNotNull() & (F.col("reason") != "PENDING")).alias("excluded"),
        count_if(ok).alias("completed_n"), count_if(v > 0).alias("positive"), count_if(v < 0).alias("negative"),
        count_if(v == 0).alias("neutral"), F.max(v).alias("best"), F.min(v).alias("worst"),
        F.stddev_pop(v).alias("_sd"), F.avg(F.when(v > 0, v)).alias("mean_win"), F.avg(F.when(v < 0, v)).alias("mean_loss"),
        F.sum(F.when(v > 0, v)).alias("_wins"), F.sum(F.when(v < 0, v)).alias("_losses"),
        F.avg(F.when(ok, F.col("return_pct"))).alias("mean_raw_return"),
        F.avg(F.when(ok, F.col("mfe"))).alias("mean_mfe"), F.avg(F.when(ok, F.col("mae"))).alias("mean_mae"),
    )
    r = robust(rows.filter(ok), keys, value, roll=roll)
    d = counts.join(r, keys, "left") if keys else counts.crossJoin(r)
    n = F.col("completed_n")
    return d.withColumns({
        "success_rate": ratio(F.col("positive"), n), "reliability": reliability(n), "sufficient": n >= 30,
        "stddev": F.when(n > 1, F.col("_sd")), "payoff_ratio": ratio(F.col("mean_win"), F.abs(F.col("mean_loss"))),
        "profit_factor": F.when(F.col("negative") > 0, ratio(F.coalesce("_wins", F.lit(0.0)), F.abs(F.col("_losses")))),
    }).drop("_sd", "_wins", "_losses", "n")


def evidence_stats(rows: DataFrame, keys: list[str], minimum: int = 40, days: int = 5) -> DataFrame:
    """Cohort statistics with an explicit sufficiency flag (samples and distinct days)."""
    st, v = F.col("status"), F.col("directional_return")
    day = rows.select(*keys, "session_no").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("days")) if keys else None
    g = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample"), count_if(st == "SUCCESS").alias("wins"), count_if(st.isin("STOP", "FAIL")).alias("failures"),
        F.min(v).alias("worst_return"), F.max(v).alias("best_return"),
        F.avg(F.col("target_hit").cast("double")).alias("target_hit_rate"), F.avg(F.col("stop_hit").cast("double")).alias("stop_hit_rate"),
        F.min(F.when(F.col("decision") == "SELL", -F.col("max_rise")).otherwise(F.col("max_drop"))).alias("adverse"))
    r = robust(rows, keys, "directional_return")
    if keys:
        g = g.join(day, keys).join(r, keys)
    else:
        g = g.crossJoin(rows.select("session_no").distinct().agg(F.count(F.lit(1)).alias("days"))).crossJoin(r)
    lo, hi = wilson(F.col("wins"), F.col("sample"))
    return g.withColumns({
        "partials": F.col("sample") - F.col("wins") - F.col("failures"),
        "success_rate": ratio(F.col("wins"), F.col("sample")), "success_low": lo, "success_high": hi,
        "sufficient": (F.col("sample") >= minimum) & (F.col("days") >= days),
    }).drop("n")


SUPPRESSED = ("success_rate", "median", "trimmed_mean", "mean", "target_hit_rate", "stop_hit_rate", "worst_return",
              "best_return", "adverse")


def suppress(stats: DataFrame, columns=SUPPRESSED) -> DataFrame:
    """Small cohorts keep their counts but lose every rate and return."""
    return stats.withColumns({c: F.when(F.col("sufficient"), F.col(c)) for c in columns if c in stats.columns})


def long_flags(rows: DataFrame, flags: dict[str, Column] | list[str], keep: list[str]) -> DataFrame:
    """Wide nullable flags to (criterion, flag) rows: one narrow explode, no join."""
    pairs = flags.items() if isinstance(flags, dict) else [(f, F.col(f)) for f in flags]
    items = F.array(*[F.struct(F.lit(k).alias("criterion"), c.alias("flag")) for k, c in pairs])
    return rows.select(*keep, F.explode(items).alias("_f")).select(*keep, "_f.criterion", "_f.flag")


def with_without(stats: DataFrame, keys: list[str], value_cols: list[str]) -> DataFrame:
    """Pivot the two sides of a flag into yes_ and no_ columns by conditional aggregation."""
    return stats.groupBy(*keys).agg(
        *[F.max(F.when(F.col("flag"), F.col(c))).alias(f"yes_{c}") for c in value_cols],
        *[F.max(F.when(~F.col("flag"), F.col(c))).alias(f"no_{c}") for c in value_cols],
    )


def direction(low: Column, high: Column, yes: Column, no: Column, enough: Column, edge: float = 0.25) -> Column:
    return first_match(
        (enough & (low > 0) & (yes > no + edge), "UP"), (enough & (high < 0) & (yes < no - edge), "DOWN"), default="SAME")
