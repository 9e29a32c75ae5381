"""Running sums over a whole table in a given order, without one task that sees all rows.

Rows are range-partitioned by the order and written; a partition's place in the order is its
number. What a row's own partition holds before it comes from a window inside the partition, what
earlier partitions hold from one row for each of them. Equal rows are counted inside their scan
task first, so a group of repeats is as many entries as tasks that read it, and is only spread
out again at the end, over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigspark.llm.common import written

#: The scan task of an entry: equal rows of different tasks stay different entries.
TASK = "_task"


def counted(rows: DataFrame) -> DataFrame:
    """The rows' columns, _task and copies; equal rows of one scan task become one entry."""
    return rows.withColumn(TASK, F.spark_partition_id()).groupBy(*[F.col(f"`{c}`") for c in rows.columns], TASK).agg(F.count("*").alias("copies"))


def running(rows: DataFrame, order: list[Column], value: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds before: the sum of ``value`` over the rows of the same ``by`` that come first.

    rows: a written table (range bounds are sampled from it). The order must tell rows apart,
    or those it can't tell apart must be equal.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(b).asc_nulls_last() for b in by]
    dealt = written(rows.withColumn("_value", value).repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()))
    # One row for each partition (and each ``by`` in it).
    heads = dealt.groupBy(*by, "_part").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(*[F.col(b).alias(f"_by_{b}") for b in by], F.col("_part").alias("_of"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_head"))
    inside = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("_own", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    same = F.col("_part") == F.col("_of")
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    return own.join(heads, same).select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_own") + F.col("_head")).alias("before"))


def expanded(entries: DataFrame) -> DataFrame:
    """One row for each copy again, with its number in copy (from 0)."""
    once = entries.filter("copies = 1").withColumn("copy", F.lit(0).cast("long"))
    more = entries.filter("copies > 1").repartition(F.hash(*[F.col(f"`{c}`") for c in entries.columns]))
    more = more.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return once.unionByName(more)
