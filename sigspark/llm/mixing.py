"""Mixing sources to target weights, DataFrame functions only.

Every document gets a key drawn from a hash of its id and text; within its source, documents stand
in the order of the keys (range-partitioned and sorted), distributed prefix sums of word counts
give each its place, and the mix is cut at the source's exact budget. A budget larger than the
source repeats it: whole epochs first, then the same order again up to the cut. The document at
the cut is taken in part, its first words.

Targets: sources in order of their code points (null last) get the weights in turn and share
``share`` times all words. No target exceeds ``most`` times its source; what is over is shared
again by weight until none is above. That takes two sums over the sources a round.

Nothing depends on the number of tasks: the keys are hashes, rows of equal key, id and size are
equal. The order of sources comes from the same distributed sums, so their number isn't bounded by
a task either.

Defined cases: a null or empty text has size 0 and is taken 0 times; a source of size 0 has target
0; a null source is a source of its own; a null doc_id is passed on; equal rows are rows of their
own and share their stretch of the order; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import written
from sigspark.llm.ranks import TASK, counted, expanded, running

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
SEED = "mix"
#: White space of the word rule: blank and U+0009 to U+000D.
SPACE = r"\x20\x09-\x0D"


def n_words(text: Column) -> Column:
    """Number of runs that aren't white space."""
    return F.regexp_count(text, F.lit(rf"[^{SPACE}]+")).cast("long")


def mix_key(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """60 bits of an MD5 over seed, id and text."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text)
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, key, size of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", "source", mix_key(F.col("doc_id"), text, seed).alias("key"), n_words(text).alias("size"))


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, weight, target. totals: source, source_size (a written table, one row a source)."""
    placed = running(totals, [F.col("source").asc_nulls_last()], F.lit(1).cast("long"))
    turn = F.col("before") % len(weights)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (turn + 1).cast("int"))
    weighed = written(placed.select("source", "source_size", weight.alias("weight")))
    cap = F.lit(most).cast("long") * F.col("source_size")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:  # the level only rises, so a source once full stays full
        full = cap <= F.lit(level) * F.col("weight")
        sums = weighed.agg(F.sum(F.when(full, cap).otherwise(0)).alias("held"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("weight")).first()
        if not sums["weight"]:
            break
        higher = (share * total - sums["held"]) / sums["weight"]
        if higher <= level:
            break
        level = higher
    return weighed.withColumn("target", F.least(cap.cast("double"), F.lit(level) * F.col("weight")))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, source, key, size, source_size, target, epochs (whole ones), rest (words of the last, partial epoch), taken."""
    entries = written(counted(sized(docs, seed)))
    totals = written(entries.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("source_size")))
    plan = targets(totals, weights, share, most)
    budget = F.floor(F.col("target") + 0.5)
    plan = plan.select(
        F.col("source").alias("of"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).alias("epochs"),
        F.when(F.col("source_size") > 0, budget % F.col("source_size")).otherwise(0).alias("left"),
    )
    order = [F.col("key").asc(), F.col("doc_id").asc_nulls_last(), F.col("size").asc(), F.col(TASK).asc()]
    placed = running(entries, order, F.col("copies") * F.col("size"), by=("source",))
    rows = expanded(placed.join(plan, F.col("source").eqNullSafe(F.col("of"))))
    place = F.col("before") + F.col("copy") * F.col("size")
    rest = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("left") - place))
    return rows.select("doc_id", "source", "key", "size", "source_size", "target", "epochs", rest.alias("rest"), (F.col("epochs") * F.col("size") + rest).alias("taken"))


def mixture(docs: DataFrame, plan: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, epoch, text: the mixed texts, a partial one cut after its last taken word.

    plan: a written result of ``mixed``. Of equal rows each has its own row of the plan.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select("doc_id", "source", "text", mix_key(F.col("doc_id"), text, seed).alias("key")).dropDuplicates()
    p = plan.filter("taken > 0").select(F.col("doc_id").alias("p_id"), F.col("source").alias("p_source"), F.col("key").alias("p_key"), "epochs", "rest")
    same = (F.col("key") == F.col("p_key")) & F.col("doc_id").eqNullSafe(F.col("p_id")) & F.col("source").eqNullSafe(F.col("p_source"))
    met = own.join(p, same)
    pieces = F.regexp_extract_all(F.col("text"), F.lit(rf"[{SPACE}]*+[^{SPACE}]++"), F.lit(0))
    head = F.array_join(F.slice(pieces, F.lit(1), F.col("rest").cast("int")), "")
    turns = F.explode(F.sequence(F.lit(1).cast("long"), F.col("epochs") + F.when(F.col("rest") > 0, 1).otherwise(0)))
    return met.withColumn("epoch", turns).select("doc_id", "source", "epoch", F.when(F.col("epoch") <= F.col("epochs"), F.col("text")).otherwise(head).alias("text"))


#: The same mix in SQL; the level of the targets in closed form, from sources by size over weight.
ORACLE = rf"""
WITH sized AS (
 SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR),'') || ':' || coalesce(text,'')),1,15) AS BIGINT) AS key FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, 2*source_size AS cap, CASE (row_number() OVER (ORDER BY source NULLS LAST)-1)%3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM totals),
filled AS (SELECT *, CAST(cap AS DOUBLE)/w AS ratio, sum(cap) OVER r AS held, sum(w) OVER () - sum(w) OVER r AS rest_w, 1.5*(sum(source_size) OVER ()) AS words
 FROM weighed WINDOW r AS (ORDER BY CAST(cap AS DOUBLE)/w RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
lv AS (SELECT coalesce((SELECT (CAST(words AS DOUBLE)-held)/rest_w FROM filled WHERE held+ratio*rest_w <= words AND rest_w>0 ORDER BY ratio DESC LIMIT 1),
 (SELECT CAST(max(words) AS DOUBLE)/sum(w) FROM filled)) AS level),
plan AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), level*w) AS target, CAST(floor(least(CAST(cap AS DOUBLE), level*w)+0.5) AS BIGINT) AS budget FROM filled, lv),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS before FROM sized)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size>0 THEN (budget//source_size)*size + greatest(0, least(size, budget%source_size - before)) ELSE 0 END AS BIGINT) AS taken
FROM placed JOIN plan ON placed.source IS NOT DISTINCT FROM plan.source
"""
