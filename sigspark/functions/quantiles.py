"""Exact mean, median and trimmed mean per group without collecting a group.

A plain median keeps every value of its group in one task. Here each group's approximate
1st and 99th percentile (a mergeable sketch) set its bucket width, so narrow ratios and wide
returns alike fall into many buckets. Values are then counted in those buckets (partial
aggregation), a running count over the few buckets
of a group finds the buckets that hold the middle ranks and the trim points, and only
the rows of those buckets are looked at again, with equal values counted together.
The result is exact; the work per task is one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def robust(df: DataFrame, keys: list[str], value: str, trim: float = 0.1, buckets: int = 512,
           prefix: str = "", roll: tuple[str, str, Column] | None = None) -> DataFrame:
    """keys + n, mean, median, trimmed_mean of the non-null values (columns take the prefix).

    roll: (fine key, coarse key, array of the coarse keys that a fine one belongs to). Rows carry
    the fine key, which splits them; counts are taken there and only then rolled up to the
    overlapping coarse keys, so a row isn't copied for each of them.
    """
    if roll:
        fine, coarse, belongs = roll
        keys = [k for k in keys if k != coarse]
        extra = [fine]
    else:
        extra = []
    base = df.filter(F.col(value).isNotNull()).select(*extra, *keys, F.col(value).cast("double").alias("_v"))
    ends = base.groupBy(*keys).agg(F.percentile_approx("_v", F.array(F.lit(0.01), F.lit(0.99)), F.lit(200)).alias("_e"))
    base = base.join(ends, keys) if keys else base.crossJoin(ends)  # one row a group
    place = F.floor((F.col("_v") - F.col("_e")[0]) / F.nullif(F.col("_e")[1] - F.col("_e")[0], F.lit(0.0)) * (buckets - 2))
    b = F.greatest(F.lit(-1), F.least(F.lit(buckets), F.coalesce(place, F.signum(F.col("_v") - F.col("_e")[0])))).cast("int")
    base = base.select(*extra, *keys, "_v", b.alias("_b"))
    same = base.groupBy(*extra, *keys, "_b", "_v").agg(F.count(F.lit(1)).alias("_c"))
    hist = same.groupBy(*extra, *keys, "_b").agg(F.sum("_c").alias("_n"), F.sum(F.col("_v") * F.col("_c")).alias("_s"))
    if roll:
        inner, keys = keys, [coarse, *keys]
        hist = hist.withColumn(coarse, F.explode(belongs)).groupBy(*keys, "_b").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
    run = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
    hist = hist.withColumn("_hi", F.sum("_n").over(run)).withColumn("_t", F.sum("_n").over(W.partitionBy(*keys)))
    hist = hist.withColumn("_lo", F.col("_hi") - F.col("_n")).withColumn("_k", F.floor(F.col("_t") * trim))
    r1, r2 = F.floor((F.col("_t") + 1) / 2), F.floor(F.col("_t") / 2) + 1
    low, high = F.col("_k"), F.col("_t") - F.col("_k")

    def holds(rank):
        return (F.col("_lo") < rank) & (rank <= F.col("_hi"))

    cut = ((F.col("_lo") < low) & (low < F.col("_hi"))) | ((F.col("_lo") < high) & (high < F.col("_hi")))
    inside = (F.col("_lo") >= low) & (F.col("_hi") <= high)
    hist = hist.withColumns({"_cut": cut, "_need": holds(r1) | holds(r2) | cut})
    whole = hist.groupBy(*keys).agg(
        F.max("_t").alias("_t"), F.max("_k").alias("_k"), F.sum("_s").alias("_s"),
        F.sum(F.when(inside, F.col("_s")).otherwise(0.0)).alias("_in"))
    marks = hist.filter("_need").select(*keys, "_b", "_lo", "_t", "_k", "_cut")
    if roll:
        same = same.join(marks.select(*inner, "_b").distinct(), [*inner, "_b"], "left_semi").withColumn(coarse, F.explode(belongs)).drop(fine)
    rows = same.join(marks, [*keys, "_b"])
    wb = W.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_vh", F.col("_lo") + F.sum("_c").over(wb)).withColumn("_vl", F.col("_vh") - F.col("_c"))

    def at(rank):
        return F.max(F.when((F.col("_vl") < rank) & (rank <= F.col("_vh")), F.col("_v")))

    kept = F.greatest(F.lit(0), F.least(F.col("_vh"), high) - F.greatest(F.col("_vl"), low))
    parts = rows.groupBy(*keys).agg(
        ((at(r1) + at(r2)) / 2).alias("_med"),
        F.sum(F.when(F.col("_cut"), F.col("_v") * kept).otherwise(0.0)).alias("_part"))
    out = whole.join(parts, keys) if keys else whole.crossJoin(parts)
    return out.select(
        *keys,
        F.col("_t").alias(prefix + "n"),
        (F.col("_s") / F.col("_t")).alias(prefix + "mean"),
        F.col("_med").alias(prefix + "median"),
        ((F.col("_in") + F.col("_part")) / (F.col("_t") - 2 * F.col("_k"))).alias(prefix + "trimmed_mean"),
    )
