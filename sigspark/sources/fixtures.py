"""Driver tables seen through the engine's own schemas (bars, events, news)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WEEK_ZERO = "1990-01-01"  # a Monday; session numbers count weeks from here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def week_no(session) -> F.Column:
    return (F.datediff(session, F.lit(WEEK_ZERO).cast("date")) / 7).cast("int")


def symbol_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, sector: one row per nation."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("symbol"),
        F.col("r_name").alias("sector"),
    )


def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars per supplier nation.

    Open and close are the first and last trade of the week; min_by and max_by are
    partially aggregated before the shuffle, so a hot symbol costs no hot task, and
    the result holds at most one row per symbol and calendar session.
    """
    li = table(spark, sf_dir, "lineitem")
    su = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    price = F.col("l_extendedprice") / 1000.0
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    bars = (
        li.join(su, li.l_suppkey == su.s_suppkey)
        .groupBy(
            F.concat(F.lit("N"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0")).alias("symbol"),
            F.date_trunc("week", "l_shipdate").cast("date").alias("session"),
        )
        .agg(
            F.min_by(price, order).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, order).alias("close"),
            F.sum("l_quantity").alias("volume"),
        )
    )
    return bars.join(symbol_dim(spark, sf_dir), "symbol").withColumn("session_no", week_no(F.col("session")))


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-hour bars per event type; they stand in for five-minute bars."""
    ev = table(spark, sf_dir, "events")
    order = F.struct("ts", "event_id")
    return (
        ev.groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("bar_start"))
        .agg(
            F.min_by("value", order).alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", order).alias("close"),
            (F.count("*") * 100.0).alias("volume"),
        )
        .withColumn("day", F.col("bar_start").cast("date"))
        .withColumn("slot", F.hour("bar_start"))
        .withColumn("bar_no", (F.unix_timestamp("bar_start") / 3600).cast("int"))
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("news_id"),
        F.col("source").alias("symbol"),
        F.col("lang"),
        F.substring("text", 1, 80).alias("title"),
        F.col("text").alias("body"),
        (F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60)).alias("published_at"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quote stream shape over events: symbol, price, event time, source row."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.col("value").alias("price"), F.col("ts").alias("event_time"),
        F.col("event_id").alias("quote_id"),
    )
