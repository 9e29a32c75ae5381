"""Structured Streaming jobs and the batch forms they must agree with."""

from __future__ import annotations

import os
import re
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sigspark.functions.scalars import first_match
from sigspark.session import shared_dir

EVENT_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def quote_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File stream of quotes; on a cluster the same columns come from a message source."""
    raw = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.select(F.col("event_type").alias("symbol"), F.col("value").alias("price"),
                      F.col("ts").cast("timestamp").alias("event_time"), F.col("event_id").alias("quote_id"),
                      (F.from_json("props", "k BIGINT")["k"] + 1.0).alias("volume"))


def drain(stream: DataFrame, job: str, mode: str = "append") -> DataFrame:
    """Run all available input to a table in the shared folder and read it back.

    Progress lives in a checkpoint there as well, under the job's name and the plan of the
    query, so a lost executor or a restarted driver resumes instead of starting over, a second
    run adds only what is new, and a changed query starts anew instead of meeting old state.
    """
    spark = stream.sparkSession
    plan = re.sub(r"#\d+L?", "", stream._jdf.queryExecution().logical().toString())
    base = os.path.join(shared_dir(spark), f"stream-{sha256(f'{job} {mode} {plan}'.encode()).hexdigest()[:24]}")
    q = (stream.writeStream.outputMode(mode).format("parquet").option("path", base + "/out")
         .option("checkpointLocation", base + "/cp").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(base + "/out")


def bars(quotes: DataFrame, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Tumbling bars, published once the watermark has passed their end."""
    order = F.struct("event_time", "quote_id")
    g = quotes.withWatermark("event_time", late).groupBy("symbol", F.window("event_time", length)).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.count(F.lit(1)).alias("ticks"))
    return g.select("symbol", F.col("window.start").alias("bar_start"), "open", "high", "low", "close", "ticks")


def session_vwap(quotes: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Session price weighted by volume, final once the session is over."""
    g = quotes.withWatermark("event_time", late).groupBy("symbol", F.window("event_time", "1 day")).agg(
        (F.sum(F.col("price") * F.col("volume")) / F.sum("volume")).alias("vwap"), F.count(F.lit(1)).alias("ticks"))
    return g.select("symbol", F.col("window.start").alias("session"), "vwap", "ticks")


def fired_alarms(quotes: DataFrame, alarms: DataFrame, test: Column, late: str = "60 days") -> DataFrame:
    """Stream-static join; each alarm fires once (state is bounded by the alarm table)."""
    hits = quotes.withWatermark("event_time", late).join(alarms, "symbol").filter(test)
    return hits.dropDuplicates(["symbol", "operator"]).select("symbol", "operator")


def lifecycle(signals: DataFrame, order: str = "slot") -> DataFrame:
    """Batch form: signal state per symbol and day from the side that was active before.

    The side of a symbol is its last non-neutral signal of the day, so the state machine
    is a last-value window; a group is one symbol's slots of one day.
    """
    w = W.partitionBy("symbol", "day").orderBy(order)
    side = F.when(F.col("signal") != "WATCH", F.col("signal"))
    old = F.coalesce(F.last(side, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit("WATCH"))
    d = signals.withColumn("previous_side", old)
    s, o = F.col("signal"), F.col("previous_side")
    d = d.withColumn("state", first_match(
        ((s == "BUY") & (o == "BUY"), "BUY_ON"), ((s == "BUY") & (o == "SELL"), "RECOVERING"), (s == "BUY", "NEW_BUY"),
        ((s == "SELL") & (o == "BUY"), "TURNED_SELL"), ((s == "SELL") & (o == "SELL"), "SELL_ON"), (s == "SELL", "NEW_SELL"),
        (o == "BUY", "WEAKENING"), (o == "SELL", "RECOVERING"), default="WATCH"))
    return d.withColumns({"previous_state": F.lag("state").over(w), "previous_score": F.lag("score").over(w)})


def significant(d: DataFrame, change: float = 10.0) -> DataFrame:
    """Only transitions (a mere continuation is none) or a score move of at least the limit."""
    moved = F.abs(F.col("score") - F.col("previous_score")) >= change
    turned = F.col("previous_state").isNull() | ((F.col("state") != F.col("previous_state")) & ~F.col("state").isin("BUY_ON", "SELL_ON"))
    return d.filter((F.col("state") != "WATCH") & (turned | F.coalesce(moved, F.lit(False)))).withColumn(
        "event_id", F.sha2(F.concat_ws("|", "symbol", F.col("bar_start").cast("string"), "state"), 256))
