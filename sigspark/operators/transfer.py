"""Transfer of weight between the criteria of a family, from the losing to the winning one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.operators import reports as rp
from sigspark.operators.flags import CRITERIA, FAMILIES
from sigspark.operators.learning import masks
from sigspark.session import frozen

# The agreement that makes two criteria one, the largest move, the distance from the baseline.
ALIKE, STEP, REACH = 0.85, 0.0025, 0.005
PLACE = {c: i for i, c in enumerate(CRITERIA)}
FAMILY_OF = {c: family for family, members in FAMILIES.items() for c in members}
#: The family whose weights never move.
FIXED_FAMILY = "decision"


def catalogue(spark) -> DataFrame:
    """place, criterion, family: one row for each criterion, in order."""
    return spark.createDataFrame([(i, c, FAMILY_OF[c]) for c, i in PLACE.items()], "place int, criterion string, family string")


def agreement(rows: DataFrame, moved: DataFrame, scope: list[str]) -> DataFrame:
    """scope, a, b (places, b before a), matches, agreed: rows in which both are known, and alike.

    Rows fold into flag patterns (known mask, value mask) before they meet pairs, and only pairs of
    criteria that ``moved`` (scope, places) names are counted.
    """
    known, value = masks(list(CRITERIA))
    patterns = rows.select(*scope, known.alias("hk"), value.alias("hv")).groupBy(*scope, "hk", "hv").agg(F.count(F.lit(1)).alias("n"))
    pairs = moved.select(*scope, "places", F.explode("places").alias("a")).select(*scope, "a", F.explode(F.filter("places", lambda x: x < F.col("a"))).alias("b"))
    bit = lambda mask, at: F.expr(f"shiftright({mask}, {at}) & 1")
    both, alike = bit("hk", "a") * bit("hk", "b"), bit("hv", "a") == bit("hv", "b")
    return patterns.join(pairs, scope).groupBy(*scope, "a", "b").agg(
        F.sum(F.col("n") * both).alias("matches"), F.sum(F.when(alike, F.col("n") * both).otherwise(0)).alias("agreed"))


def representatives(moved: DataFrame, pairs: DataFrame, scope: list[str], minimum: int) -> DataFrame:
    """scope, place, representative, agreement: of the moved criteria in order, one that agrees with an
    earlier representative gives way to it, any other represents itself.

    A scope holds at most one entry a criterion, so the choice in order is a fold over a small array.
    """
    same = pairs.filter((F.col("matches") >= minimum) & (F.col("agreed") >= ALIKE * F.col("matches")))
    near = same.groupBy(*scope).agg(F.map_from_entries(F.collect_list(F.struct(F.struct("a", "b"), F.col("agreed") / F.col("matches")))).alias("near"))
    none = F.lit(None).cast("map<struct<a:int,b:int>,double>")
    told = moved.join(near, scope, "left").withColumn("near", F.coalesce("near", none))
    empty = F.array().cast("array<struct<place:int,representative:int,agreement:double>>")

    def take(done, x):
        alike = lambda r: F.element_at("near", F.struct(x.alias("a"), r["place"].alias("b")))
        first = F.get(F.filter(done, lambda r: (r["place"] == r["representative"]) & alike(r).isNotNull()), F.lit(0))
        own = F.struct(x.alias("place"), F.coalesce(first["place"], x).alias("representative"), F.when(first.isNotNull(), alike(first)).alias("agreement"))
        return F.concat(done, F.array(own))

    return told.select(*scope, F.explode(F.aggregate("places", empty, take)).alias("_r")).select(*scope, "_r.*")


def family_transfer(rows: DataFrame, weights: DataFrame, scope: list[str], minimum: int = 40, days: int = 5) -> DataFrame:
    """Proposed weights of every criterion in every scope.

    rows: evaluated records with the criteria as nullable columns (operators.flags) and what
    ``evidence_report`` reads; weights: criterion, base, baseline, current (and the scope's columns,
    if each scope has its own). In each family the first winning and the first losing representative
    trade: at most ``STEP``, within half of the base weight and ``REACH`` of the baseline on either
    side. What one gains the other gives, so a family keeps its budget. Output: scope, criterion, family,
    direction, representative (of a criterion that moved; itself or the one it gives way to),
    agreement, current, proposed, yes_sample, no_sample, difference. Scopes without a row are absent.
    The records are written once, since the report and the agreements read them several times.
    """
    names, rows = catalogue(rows.sparkSession), frozen(rows)
    report = rp.evidence_report(rows, list(CRITERIA), scope, minimum, days).select(*scope, "criterion", "direction", "yes_sample", "no_sample", "difference")
    every = rows.select(*scope).distinct().crossJoin(names).join(report, [*scope, "criterion"], "left")
    every = frozen(every.withColumn("direction", F.coalesce("direction", F.lit("SAME"))))
    moving = (F.col("direction") != "SAME") & (F.col("family") != FIXED_FAMILY)
    moved = every.filter(moving).groupBy(*scope).agg(F.sort_array(F.collect_list("place")).alias("places"))  # at most one a criterion
    chosen = representatives(moved, agreement(rows, moved, scope), scope, minimum)
    own = [c for c in scope if c in weights.columns]
    d = every.join(chosen, [*scope, "place"], "left").join(weights, [*own, "criterion"])
    free = F.col("representative") == F.col("place")
    low, high = F.greatest(F.col("base") * 0.5, F.col("baseline") - REACH), F.least(F.col("base") * 1.5, F.col("baseline") + REACH)
    side = lambda way, room: F.min(F.when(free & (F.col("direction") == way), F.struct("place", room.alias("room"))))
    trades = d.groupBy(*scope, "family").agg(side("UP", high - F.col("current")).alias("up"), side("DOWN", F.col("current") - low).alias("down"))
    delta = F.least(F.lit(STEP), "up.room", "down.room")
    trades = trades.filter("up IS NOT NULL AND down IS NOT NULL").select(*scope, "family", F.greatest(F.lit(0.0), delta).alias("delta"), F.col("up.place").alias("winner"), F.col("down.place").alias("loser"))
    d = d.join(trades, [*scope, "family"], "left")
    step = F.when(F.col("place") == F.col("winner"), F.col("delta")).when(F.col("place") == F.col("loser"), -F.col("delta")).otherwise(0.0)
    for_ = names.select(F.col("place").alias("representative"), F.col("criterion").alias("represented_by"))
    d = d.withColumn("proposed", F.col("current") + step).join(for_, "representative", "left")
    return d.select(*scope, "criterion", "family", "direction", F.col("represented_by").alias("representative"), "agreement", "current", "proposed", "yes_sample", "no_sample", "difference")
