"""Technical snapshot rows, tri-state flags and reason lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.functions.scalars import first_match, reason_list


def latest_per_symbol(df: DataFrame, order: str = "session_no") -> DataFrame:
    """Newest row per symbol by max_by over the whole row: partial aggregation, no sort."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy("symbol").agg(F.max_by(row, F.col(order)).alias("_r")).select("_r.*")


def technical_snapshot(frame: DataFrame, order: str = "session_no") -> DataFrame:
    """One nested row per symbol: groups with status, values, confidence and staleness."""
    last = latest_per_symbol(frame, order)
    newest = frame.agg(F.max(order).alias("_newest"))
    d = last.crossJoin(newest)  # a single-row aggregate

    stale = F.col(order) < F.col("_newest")

    def group(ok, **values):
        return F.struct(
            F.when(ok, "OK").otherwise("UNKNOWN").alias("status"),
            F.when(ok, F.when(stale, 35).otherwise(100)).otherwise(0).alias("confidence"),
            stale.alias("stale"),
            *[F.col(v).alias(k) for k, v in values.items()],
        )

    n = F.col("bar_count")
    closing = ["open", "high", "low", "close", "prev_close", "volume", "sma20", "sma50", "sma20_slope", "high20_prev",
               "low20_prev", "atr14", "atr_pct", "atr_baseline", "rsi", "return_1d", "return_5d", "return_20d"]
    return d.select(
        "symbol", "session", "bar_count", "volume_ratio", stale.alias("stale"),
        first_match((n < 4, 0), (stale, 35), default=100).alias("confidence"),
        group(n >= 4, value="obv", trend="obv_trend", slope="obv_slope", breakout="obv_break",
              divergence="obv_divergence").alias("obv"),
        group(n >= 20, upper="bb_upper", middle="bb_mid", lower="bb_lower", width="bb_width", squeeze="bb_squeeze",
              expansion="bb_expansion", upper_break="bb_upper_break", lower_break="bb_lower_break",
              return_inside="bb_return_inside", squeeze_break="squeeze_break").alias("bollinger"),
        group(n >= 5, short_pct="momentum3", acceleration="acceleration", direction="momentum_direction",
              state="momentum_state", positive_turn="positive_turn", negative_turn="negative_turn").alias("momentum"),
        F.struct(*closing).alias("closing"),
    )


def technical_flags(frame: DataFrame) -> DataFrame:
    """Tri-state flags; a comparison with a NULL input stays NULL."""
    return frame.withColumns(
        {
            "obv_rising": F.col("obv_trend") == "RISING",
            "obv_falling": F.col("obv_trend") == "FALLING",
            "obv_breakout": F.col("obv_break") == "UP",
            "obv_positive_divergence": F.col("obv_divergence") == "POSITIVE",
            "obv_negative_divergence": F.col("obv_divergence") == "NEGATIVE",
            "band_return": F.col("bb_return_inside"),
            "momentum_strengthening": F.col("momentum_state") == "STRENGTHENING",
            "momentum_weakening": F.col("momentum_state") == "WEAKENING",
        }
    )


def technical_reasons(flags: DataFrame) -> DataFrame:
    return flags.withColumns(
        {
            "positive": reason_list(
                (F.col("obv_rising"), "OBV rising"),
                (F.col("obv_positive_divergence"), "Positive OBV divergence"),
                (F.col("squeeze_break"), "Break out of a Bollinger squeeze on volume"),
                (F.col("momentum_strengthening"), "Short momentum strengthening"),
            ),
            "negative": reason_list(
                (F.col("obv_falling"), "OBV weakening"),
                (F.col("obv_negative_divergence"), "Negative OBV divergence"),
                (F.col("momentum_weakening"), "Momentum turning down"),
            ),
        }
    )
