"""One identity for the copies of a news event: pair verdicts, then canonical records.

Events with equal content are one class. Classes meet where a verdict other than DIFFERENT is
possible: under an equal title, body, address or amount set, or, for fuzzy titles, where the
rarest informative word of one is a word of the other. The rule asks that the informative words
of one title all stand in the other, so that blocking loses nothing; it meets classes of one
symbol in the same or the next time bucket only. Of a pair's verdict all but the sequence ratio
are column expressions; the ratio is worked out for the few pairs that still depend on it.

A record starts with the first event that no earlier record takes. An event joins the youngest
record of its symbol that began within the window and has a variant it is a copy of. That rule
is sequential, but only records begun within the last window of a block of time can reach into
the next block. So blocks are walked side by side, each event with the verdicts on the classes
near it, and a block is walked again only when other records reach into it than before.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from sigspark.functions.scalars import first_match
from sigspark.operators.news import fold_text
from sigspark.session import frozen

# Words without content in titles, words too general to tell events apart, money
# words, words that turn an event into another one, lengths read and limits of likeness.
STOP = ("a", "s", "as", "anonim", "sirketi", "sirket", "yeni", "tutarinda", "tutarli", "bir", "ile", "ve", "imzaladi", "imzalandi",
        "imzalanmasi", "yapildi", "hakkinda", "aciklama", "ozel", "durum")
GENERIC = ("sozlesme", "ihale", "yatirim", "finansal", "sonuc", "duyuru", "haber", "imza")
MONEY = ("milyon", "milyar", "tl", "usd", "eur")
ACTIONS = ("iptal", "fesih", "sonlandir", "yenile", "uzat")
TITLE_CHARS, BODY_CHARS, WINDOW = 500, 12_000, 21_600
BLOCK = 32 * WINDOW  # seconds that are walked in one go
BODY_SAME_TITLE, TITLE_SAME_URL, TITLE_LIKELY, BODY_LIKELY = 0.65, 0.8, 0.88, 0.75
AMOUNT = r"([0-9]+(?:[.,][0-9]+)*)\s*(milyon|milyar|million|billion)?\s*(tl|try|usd|dolar|eur|euro|%|adet)\b"
SCALES = {"milyon": 1e6, "million": 1e6, "milyar": 1e9, "billion": 1e9}
UNITS = {"try": "tl", "dolar": "usd", "euro": "eur"}
OFFICIAL = "KAP"


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def words_but(text: Column, symbol: Column) -> Column:
    """Folded words without the ticker."""
    return F.filter(F.split(fold_text(text), " "), lambda w: (w != "") & (w != F.lower(symbol)))


def amount_set(text: Column) -> Column:
    """Sorted texts unit|value of all amounts."""
    def one(m: Column) -> Column:
        n, scale, unit = (F.regexp_extract(m, AMOUNT, k) for k in (1, 2, 3))
        bare = F.replace(n, F.lit("."), F.lit(""))
        points = F.length(n) - F.length(bare)
        plain = F.when(F.contains(n, F.lit(",")), F.replace(bare, F.lit(","), F.lit("."))).when((points > 1) | n.rlike("[.][0-9]{3}$"), bare).otherwise(n)
        value = plain.try_cast("double") * F.coalesce(F.try_element_at(_map(SCALES), scale), F.lit(1.0))
        return F.concat_ws("|", F.coalesce(F.try_element_at(_map(UNITS), unit), unit), value.cast("string"))

    folded = F.translate(F.lower(text), "çğıöşü", "cgiosu")
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(folded, F.lit(AMOUNT), F.lit(0)), one)))


def _digest(x: Column) -> Column:
    """The first 128 bits of SHA-256 in 22 characters."""
    return F.substring(F.base64(F.unhex(F.substring(F.sha2(x, 256), 1, 32))), 1, 22)


def informative(title_n: Column) -> Column:
    """Sorted informative words of a folded title. Worked out where they are read: the title is shorter to send."""
    return F.array_sort(F.array_except(F.array_distinct(F.filter(F.split(title_n, " "), lambda w: w != "")), F.array(*map(F.lit, STOP))))


def _body(symbol: str = "symbol", body: str = "body") -> Column:
    """What verdicts read of a body."""
    return F.array_join(words_but(F.substring(F.coalesce(body, F.lit("")), 1, BODY_CHARS), F.col(symbol)), " ")


def prepared(news: DataFrame) -> DataFrame:
    """news_id, symbol, kind, url, title, t (seconds), b (time bucket), class_id and what the verdict reads, bodies as digest and length.

    news: news_id, symbol, title, body, kind, url, event_time. Rows without title, symbol or
    time are no events; kinds, addresses and bodies may be null.
    """
    title = F.substring(F.trim("title"), 1, TITLE_CHARS)
    body = F.substring(F.coalesce("body", F.lit("")), 1, BODY_CHARS)
    d = news.filter(F.col("title").isNotNull() & (F.trim("title") != "") & F.col("symbol").isNotNull() & F.col("event_time").isNotNull())
    d = d.select("news_id", "symbol", F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("url", F.lit("")).alias("url"),
                 F.unix_timestamp("event_time").alias("t"), title.alias("title"), body.alias("body"))
    d = d.withColumn("class_id", _digest(F.concat_ws("\x1f", "symbol", "kind", "url", "title", "body"))).withColumn("b", F.floor(F.col("t") / WINDOW))
    names = words_but(F.col("title"), F.col("symbol"))
    d = d.withColumns({"title_n": F.array_join(names, " "), "body_n": _body(), "amounts": amount_set(F.concat_ws(" ", "title", "body"))})
    return d.withColumns({"body_id": _digest(F.col("body_n")), "body_len": F.length("body_n")}).drop("body", "body_n")


def _classes(events: DataFrame) -> DataFrame:
    """One row a class: what verdicts read, the number of events, and the first event as its name."""
    keep = ("symbol", "kind", "url", "title_n", "amounts", "body_id", "body_len")
    return events.groupBy("class_id").agg(*[F.first(c).alias(c) for c in keep], F.count(F.lit(1)).alias("n"), F.min(F.struct("t", "news_id"))["news_id"].alias("named"))


def class_pairs(events: DataFrame, classes: DataFrame) -> DataFrame:
    """later, earlier: names of ordered pairs of different classes that can be copies and occur so within the window.

    Keys are hashes of symbol, kind of key, value and time bucket: an equal hash of others only adds a pair that the verdict drops.
    """
    general = F.array(*map(F.lit, (*GENERIC, *MONEY)))
    mark = lambda kind, x: F.xxhash64(F.lit(kind), F.col("symbol"), x)
    exact = [mark("T", F.col("title_n")), F.when(F.col("body_len") >= 60, mark("B", F.col("body_id"))), F.when(F.col("url") != "", mark("U", F.col("url"))),
             F.when(F.size("amounts") > 0, mark("A", F.array_join("amounts", ";")))]
    words = lambda c: F.transform(c, lambda w: mark("W", w))
    own = classes.withColumn("tokens", informative(F.col("title_n"))).select("class_id", "named", F.array_compact(F.array(*exact)).alias("exact"), words(F.col("tokens")).alias("every"), words(F.array_except("tokens", general)).alias("telling"))
    spread = own.select("named", F.explode("telling").alias("w"))
    often = spread.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    rarest = spread.join(often, "w").groupBy("named").agg(F.min(F.struct("n", "w"))["w"].alias("rarest"))
    asked = F.when(F.col("rarest").isNotNull(), F.array("rarest")).otherwise(F.col("every"))
    keyed = own.join(rarest, "named", "left").select("class_id", "named", F.concat("exact", "every").alias("held"), F.concat("exact", asked).alias("asked"))
    cells = events.groupBy("class_id", "b").agg(F.min(F.struct("t", "news_id")).alias("first"), F.max(F.struct("t", "news_id")).alias("last")).join(keyed, "class_id")
    at = {"c": "named", "t0": "first.t", "n0": "first.news_id", "t1": "last.t", "n1": "last.news_id"}
    cells = frozen(cells.select("b", *[F.col(v).alias(k) for k, v in at.items()], "held", "asked"))
    side = lambda name: [F.col(k).alias(f"{name}_{k}") for k in at]
    near = F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("at")
    held = cells.select("b", F.explode("held").alias("key"), *side("y")).select(F.xxhash64("key", "b").alias("spot"), *[f"y_{k}" for k in at])
    seek = cells.select("asked", near, *side("x")).select("at", F.explode("asked").alias("key"), *[f"x_{k}" for k in at]).select(F.xxhash64("key", "at").alias("spot"), *[f"x_{k}" for k in at])
    met = seek.join(held, "spot").filter("x_c <> y_c")

    def follows(x: str, y: str) -> Column:
        of = lambda n: (F.col(f"{x}_{n}"), F.col(f"{y}_{n}"))
        (x0, _), (_, y1) = of("t0"), of("t1")
        xb, yb = (F.floor(t / WINDOW) for t in of("t0"))
        same = (xb == yb) & (F.struct(F.col(f"{x}_t1"), F.col(f"{x}_n1")) > F.struct(F.col(f"{y}_t0").alias(f"{x}_t1"), F.col(f"{y}_n0").alias(f"{x}_n1")))
        pair = F.struct(F.col(f"{x}_c").alias("later"), F.col(f"{y}_c").alias("earlier"))
        return F.when(same | ((xb == yb + 1) & (x0 - y1 <= WINDOW)), pair)

    return met.select(F.inline(F.array_compact(F.array(follows("x", "y"), follows("y", "x"))))).distinct()


def ratio_at_least(a: str, b: str, least: float) -> bool:
    """Whether the sequence ratio reaches the limit; its cheap upper bounds are asked first."""
    m = SequenceMatcher(None, a, b)
    return m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least


@F.pandas_udf(DoubleType())
def _title_like(a: pd.Series, b: pd.Series) -> pd.Series:
    """The highest limit of likeness that two titles reach, else 0."""
    limits = (TITLE_LIKELY, TITLE_SAME_URL)
    return pd.Series([next((m for m in limits if ratio_at_least(x, y, m)), 0.0) for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(BooleanType())
def _body_like(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    return pd.Series([ratio_at_least(x, y, m) for x, y, m in zip(a, b, least, strict=True)], dtype=bool)


def same_class(c: str = "") -> Column:
    """Whether two events of one class are copies: a short title needs a long body or the same entry."""
    at = (lambda n: F.col(f"{c}.{n}")) if c else F.col
    return (F.size(informative(at("title_n"))) >= 3) | (at("body_len") >= 60) | ((at("url") != "") & (at("body_len") > 0))


def pair_verdicts(classes: DataFrame, pairs: DataFrame, news: DataFrame) -> DataFrame:
    """later, earlier (classes), verdict of the pairs that are copies. pairs: names; bodies come from news for the pairs that need their ratio."""
    light = [c for c in classes.columns if c not in ("n", "named")]
    side = lambda name, key: classes.select(F.col("named").alias(key), F.struct(*light).alias(name))
    d = pairs.join(side("x", "later"), "later").join(side("y", "earlier"), "earlier").filter("x.symbol = y.symbol")
    of = lambda n: (F.col(f"x.{n}"), F.col(f"y.{n}"))
    (aa, ab), (na, nb), (la, lb) = of("amounts"), of("title_n"), of("body_len")
    d = d.withColumns({"ta": informative(na), "tb": informative(nb)})
    ta, tb = F.col("ta"), F.col("tb")
    fa, fb = (F.filter(c, lambda w: w.rlike("[0-9]")) for c in (ta, tb))
    units = lambda a: F.array_distinct(F.transform(a, lambda x: F.split(x, "[|]")[0]))
    of_unit = lambda a, u: F.filter(a, lambda x: F.split(x, "[|]")[0] == u)
    turned = F.lit(False)
    for word in ACTIONS:
        turned |= F.contains(na, F.lit(word)) != F.contains(nb, F.lit(word))
    other_sum = F.exists(F.array_intersect(units(aa), units(ab)), lambda u: of_unit(aa, u) != of_unit(ab, u))
    other_fact = (F.size(fa) > 0) & (F.size(fb) > 0) & (fa != fb) & (aa != ab)
    d = d.filter(~turned & ~other_sum & ~other_fact)
    shared = F.array_intersect(ta, tb)
    generic, general = F.array(*map(F.lit, GENERIC)), F.array(*map(F.lit, (*GENERIC, *MONEY)))
    left_a, left_b = F.array_except(F.array_except(ta, tb), general), F.array_except(F.array_except(tb, ta), general)
    n, both_bodies = F.size(shared), (la > 0) & (lb > 0)
    overlap = n / F.greatest(F.lit(1), F.least(F.size(ta), F.size(tb)))
    same_body = both_bodies & (F.col("x.body_id") == F.col("y.body_id"))
    same_url = (F.col("x.url") != "") & (F.col("x.url") == F.col("y.url"))
    entry = (F.col("x.kind") == F.col("y.kind")) & same_url & same_body
    d = d.select("later", "earlier", F.col("x.class_id").alias("later_id"), F.col("y.class_id").alias("earlier_id"), la.alias("la"), lb.alias("lb"), (na == nb).alias("same_title"), same_body.alias("same_body"), both_bodies.alias("bodies"), n.alias("n"), overlap.alias("overlap"),
                 ((F.size(ta) < 3) & ~(same_body & (la >= 60)) & ~entry).alias("thin"), ((F.size(left_a) > 0) & (F.size(left_b) > 0)).alias("apart"), (la >= 60).alias("long"),
                 (same_url & (n >= 3) & (overlap >= 0.8)).alias("addressed"), ((F.size(aa) > 0) & (aa == ab) & (overlap >= 0.75) & (n >= 3)).alias("fact"),
                 ((overlap >= 0.8) & (F.size(F.array_except(shared, generic)) >= 2)).alias("fuzzy"), F.array_join(ta, " ").alias("title_a"), F.array_join(tb, " ").alias("title_b"))
    d = d.filter(F.when(F.col("same_title"), ~F.col("thin")).otherwise(~F.col("apart")))
    sure = first_match((F.col("same_title") & (F.col("same_body") | ~F.col("bodies")), "EXACT_DUPLICATE"),
                       (~F.col("same_title") & F.col("same_body") & F.col("long") & (F.col("n") >= 2), "EXACT_DUPLICATE"),
                       (~F.col("same_title") & ~F.col("addressed") & F.col("fact"), "LIKELY_DUPLICATE"), default=None)
    d = d.withColumn("verdict", sure).filter(F.col("verdict").isNotNull() | F.col("same_title") | F.col("addressed") | F.col("fact") | F.col("fuzzy"))
    d = frozen(d.select("later", "earlier", "later_id", "earlier_id", "la", "lb", "same_title", "same_body", "bodies", "addressed", "fact", "fuzzy", "title_a", "title_b", "verdict"))
    # Pairs still open, in the order of the rule: titles first, then the bodies of those whose lengths allow it.
    open_ = d.filter(F.col("verdict").isNull()).withColumn("like", F.when(~F.col("same_title") & (F.col("addressed") | F.col("fuzzy")), _title_like("title_a", "title_b")).otherwise(0.0))
    near = F.col("fuzzy") & (F.col("like") >= TITLE_LIKELY)
    told = first_match((F.col("same_title"), None), (F.col("addressed") & (F.col("like") >= TITLE_SAME_URL), "EXACT_DUPLICATE"), (F.col("fact"), "LIKELY_DUPLICATE"),
                       (near & (~F.col("bodies") | F.col("same_body")), "LIKELY_DUPLICATE"), default=None)
    least = F.when(F.col("same_title"), BODY_SAME_TITLE).when(near, BODY_LIKELY)
    open_ = open_.withColumns({"verdict": told, "least": least})
    in_reach = F.try_divide(2.0 * F.least("la", "lb"), F.col("la") + F.col("lb")) >= F.col("least")
    judged = frozen(open_.filter(F.col("verdict").isNotNull() | F.coalesce(in_reach, F.lit(False))).select("later", "earlier", "later_id", "earlier_id", "verdict", "least", "same_title"))
    ask = judged.filter(F.col("verdict").isNull())
    wanted = frozen(ask.select(F.explode(F.array("later", "earlier")).alias("news_id")).distinct())
    bodies = news.join(wanted, "news_id", "left_semi").select("news_id", _body().alias("body_n"))
    of_event = lambda key, name: bodies.select(F.col("news_id").alias(key), F.col("body_n").alias(name))
    asked = ask.join(of_event("later", "body_a"), "later").join(of_event("earlier", "body_b"), "earlier").filter(_body_like("body_a", "body_b", "least"))
    asked = asked.withColumn("verdict", F.when(F.col("same_title"), "EXACT_DUPLICATE").otherwise("LIKELY_DUPLICATE"))
    out = lambda x: x.select(F.col("later_id").alias("later"), F.col("earlier_id").alias("earlier"), "verdict")
    return out(d.filter("verdict IS NOT NULL")).unionByName(out(judged.filter("verdict IS NOT NULL"))).unionByName(out(asked))


def verdicts(news: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, classes, links between different classes), each written once."""
    events = frozen(prepared(news))
    classes = frozen(_classes(events))
    return events, classes, frozen(pair_verdicts(classes, class_pairs(events, classes), news))


def _walk(events: pa.Table, before: pa.Table) -> pa.Table:
    """Events of one symbol and block by the sequential rule, and one row with the records that events after the block can join. before: such a row of the block before."""
    rows = sorted(events.to_pylist(), key=lambda e: (e["a"]["t"], e["a"]["news_id"]))
    records, youngest, out = [], {}, []  # by start: (start, class of each content); the youngest record that holds a class

    def holds(at: int, class_id: str, content: str) -> None:
        if content not in records[at][1]:
            records[at][1][content] = class_id
            youngest[class_id] = max(at, youngest.get(class_id, at))

    for r in (r for row in before.to_pylist() for r in row["held"]):
        records.append(({"t": r["t"], "news_id": r["news_id"]}, {}))
        for v in r["variants"]:
            holds(len(records) - 1, v["class_id"], v["content"])
    for e in rows:
        told = dict(zip(e["earlier"] or (), e["verdicts"] or (), strict=True))
        at, verdict = max((youngest[c] for c in told if c in youngest), default=None), None
        if at is None or e["a"]["t"] - records[at][0]["t"] > WINDOW:  # where the youngest is too old, all are
            at = len(records)
            records.append((e["a"], {}))
        else:
            verdict = next(told[c] for c in records[at][1].values() if c in told)
        holds(at, e["class_id"], e["content"])
        out.append({"symbol": e["symbol"], "block": e["block"], "news_id": e["news_id"], "canonical_id": records[at][0]["news_id"], "verdict": verdict})
    if rows:
        late = (rows[0]["block"] + 1) * BLOCK - WINDOW
        held = [{**a, "variants": [{"class_id": c, "content": x} for x, c in held.items()]} for a, held in records if a["t"] >= late]
        out.append({"symbol": rows[0]["symbol"], "block": rows[0]["block"], "held": held})
    of = {f.name: f.type for f in events.schema}
    variant = pa.list_(pa.struct([("class_id", pa.string()), ("content", pa.string())]))
    return pa.Table.from_pylist(out, pa.schema([("symbol", of["symbol"]), ("block", pa.int64()), ("news_id", of["news_id"]), ("canonical_id", of["news_id"]), ("verdict", pa.string()),
                                                ("held", pa.list_(pa.struct([("t", pa.int64()), ("news_id", of["news_id"]), ("variants", variant)])))]))


def walked(base: DataFrame, links: DataFrame) -> DataFrame:
    """news_id, canonical_id, verdict of events by the sequential rule.

    Blocks of time are walked side by side. A block is walked again when the records left open by the block before
    are others than it was walked with, so that only blocks that can change move again.
    """
    spark, key = base.sparkSession, ["symbol", "block"]
    cells = base.select("class_id", "b").distinct()
    asked = links.join(cells, links.later == cells.class_id).select("later", "b", "earlier", "verdict", F.explode(F.array(F.col("b") - 1, F.col("b"))).alias("at"))
    near = asked.join(cells.select(F.col("class_id").alias("earlier"), F.col("b").alias("at")), ["earlier", "at"]).groupBy(F.col("later").alias("class_id"), "b").agg(F.collect_set(F.struct("earlier", "verdict")).alias("near"))
    rows = frozen(base.join(near, ["class_id", "b"], "left").select(
        "symbol", F.floor(F.col("t") / BLOCK).alias("block"), "news_id", "class_id", "content", F.col("at").alias("a"), F.col("near.earlier").alias("earlier"), F.col("near.verdict").alias("verdicts")))
    id_type = base.schema["news_id"].dataType.simpleString()
    held = f"array<struct<t: bigint, news_id: {id_type}, variants: array<struct<class_id: string, content: string>>>>"
    schema = f"symbol string, block bigint, news_id {id_type}, canonical_id {id_type}, verdict string, held {held}"
    steps = []
    todo = spark.createDataFrame([], f"symbol string, block bigint, held {held}")
    again = rows
    while True:
        done = again.groupBy(*key).cogroup(todo.groupBy(*key)).applyInArrow(_walk, schema)
        steps.append(frozen(done.withColumn("round", F.lit(len(steps)))))
        ends = reduce(DataFrame.unionByName, steps).filter("held IS NOT NULL")
        moved = ends.join(steps[-1].filter("held IS NOT NULL").select(*key), key, "left_semi").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("round", "held")), asc=False).alias("h"))
        left = F.coalesce(F.try_element_at("h", F.lit(2))["held"], F.array().cast(held))
        todo = moved.filter(F.col("h")[0]["held"] != left).select("symbol", (F.col("block") + 1).alias("block"), F.col("h")[0]["held"].alias("held"))
        todo = frozen(todo.join(rows.select(*key).distinct(), key, "left_semi"))
        if todo.limit(1).count() == 0:
            break
        again = rows.join(todo.select(*key), key, "left_semi")
    found = reduce(DataFrame.unionByName, steps).filter("news_id IS NOT NULL")
    return found.groupBy("news_id").agg(F.max_by(F.struct("canonical_id", "verdict"), "round").alias("r")).select("news_id", "r.canonical_id", "r.verdict")


def canonical(news: DataFrame) -> DataFrame:
    """news_id, symbol, t, kind, title, canonical_id, verdict (of the event against its record; null for a record's first)."""
    events, classes, links = verdicts(news)
    own = classes.filter(same_class() & (F.col("n") > 1)).select(F.col("class_id").alias("later"), F.col("class_id").alias("earlier"), F.lit("EXACT_DUPLICATE").alias("verdict"))
    links = frozen(links.unionByName(own))
    # Only events of linked classes can join a record or be joined; every other is a record of its own.
    linked = links.select(F.explode(F.array("later", "earlier")).alias("class_id")).distinct()
    base = frozen(events.join(linked, "class_id", "left_semi").select("news_id", "symbol", "t", "b", "class_id", F.struct("t", "news_id").alias("at"), _digest(F.concat_ws("\x1f", "title_n", "body_id")).alias("content")))
    joined = walked(base, links)
    return events.select("news_id", "symbol", "t", "kind", "url", "title").join(joined, "news_id", "left").withColumn("canonical_id", F.coalesce("canonical_id", "news_id"))


def records(members: DataFrame) -> DataFrame:
    """One row a record: size, sources (the official one first), main title (the latest official one, else the first), times."""
    at = F.struct("t", "news_id")
    official = F.col("kind") == OFFICIAL
    label = F.array_sort(F.collect_set(F.struct((~official).cast("int").alias("o"), "kind")))  # as many as there are kinds of source
    return members.groupBy("canonical_id").agg(
        F.first("symbol").alias("symbol"), F.count(F.lit(1)).alias("n"), F.array_join(F.transform(label, lambda x: x["kind"]), " + ").alias("sources"),
        F.coalesce(F.max_by(F.when(official, F.col("title")), F.when(official, at)), F.min_by("title", at)).alias("title"),
        F.min("t").alias("first_t"), F.max("t").alias("last_t"))
