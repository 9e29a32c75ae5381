"""Bar gates: visibility, sanity, duplicates, contiguity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closed_bars(bars: DataFrame, asof, start: str, length: str, known: str | None = None) -> DataFrame:
    """Bars whose interval ended (and which were known) by the as-of instant; one per slot.

    The filter sits below every window, so no later bar can leak into an indicator.
    """
    ready = F.col(start) + F.expr(f"INTERVAL {length}")
    seen = F.greatest(ready, F.col(known)) if known else ready
    return bars.withColumn("available_at", seen).filter(F.col("available_at") <= asof)


def sane_ohlc():
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return F.coalesce((o > 0) & (h > 0) & (l > 0) & (c > 0) & (l <= F.least(o, c)) & (F.greatest(o, c) <= h), F.lit(False))


def normalize_bars(bars: DataFrame, key: list[str]) -> DataFrame:
    """A slot with an invalid row or with rows that differ is dropped whole.

    Two min/max pairs decide equality with partial aggregation; no group is collected.
    """
    row = F.struct("open", "high", "low", "close")
    return (
        bars.groupBy(*key)
        .agg(F.min(row).alias("_a"), F.max(row).alias("_b"), F.bool_and(sane_ohlc()).alias("_ok"))
        .filter((F.col("_a") == F.col("_b")) & F.col("_ok"))
        .select(*key, "_a.*")
    )


def first_per_slot(rows: DataFrame, key: list[str], order: list[str], values: list[str]) -> DataFrame:
    best = F.min_by(F.struct(*values), F.struct(*order))
    return rows.groupBy(*key).agg(best.alias("_r")).select(*key, "_r.*")


def latest_per_key(rows: DataFrame, key: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Newest row per key by a partially aggregated max_by: a hot key is no hot task."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_r")).select(*key, "_r.*")
