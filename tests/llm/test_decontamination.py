import random

import numpy as np
from pyspark.sql import functions as F

from sigspark.llm import decontamination as dc


def brute(docs, items):
    """Longest verified overlap by every diagonal of every pair, from the words themselves."""
    import re

    split = lambda t: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    out = {}
    for d, text in docs:
        for i, item in items:
            a, b = split(text), split(item)
            if len(b) < dc.SPAN:
                continue
            for shift in range(-len(b), len(a)):
                lo, hi = max(0, shift), min(len(a), shift + len(b))
                if hi - lo < dc.SPAN:
                    continue
                start, end, n = dc.stretch(np.array([a[k] == b[k - shift] for k in range(lo, hi)]))
                if n >= min(dc.LEAST, len(b)) and n >= dc.IDENTITY * (end - start):
                    out[d, i] = max(out.get((d, i), 0), n)
    return out


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghé", k=rng.randint(2, 6)))
    prose = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(prose(rng.randint(9, 60)))) for i in range(12)] + [(50, "too short"), (51, None), (52, "")]
    docs = []
    for d in range(40):
        text = prose(60)
        if d % 2:
            plant = items[d % 12][1].split()
            for k in range(5, len(plant), 7 + d % 5):
                if d % 4 == 1:
                    plant[k] = word()
            text[20:20] = plant if d % 3 else plant[: len(plant) // 2]
        docs.append((d, (", " if d % 5 == 0 else " ").join(text).upper() if d % 7 == 0 and d % 5 else " ".join(text)))
    docs += [(90, None), (91, ""), (92, items[0][1]), (92, items[0][1]), (None, items[1][1])]
    df = spark.createDataFrame([(d, t, 3) for d, t in docs], "doc_id long, text string, item_id int").repartition(4)
    marks = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_match for r in dc.overlaps(df, marks).collect()}
    want = brute(docs, items)
    assert want and got == {k: v for k, v in want.items()}
    assert (92, 0) in got and (None, 1) in got
    assert dc.overlaps(df.limit(0), marks).count() == 0
    assert dc.overlaps(df, marks.limit(0)).count() == 0


def test_bitmap_holds_every_seed(spark):
    seeds = [0, -1, 1 << 62, -(1 << 63), 12345678901234567]
    raw = dc.bitmap(spark.createDataFrame([(s,) for s in seeds], "seed long"), 18)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")
    a, b = dc.slots(np.array(seeds, np.int64).view(np.uint64), 18)
    assert bits[a].all() and bits[b].all() and bits.sum() <= 2 * len(seeds)


def longest(match):
    """Matches of the longest passing stretch, from all stretches."""
    n = len(match)
    return max((sum(match[a:b]) for a in range(n) for b in range(a + 1, n + 1) if 5 * sum(match[a:b]) >= 4 * (b - a)), default=0)


def test_passage_equals_all_stretches():
    rng = random.Random(8)
    for k in range(300):
        match = [rng.random() < (0.3, 0.6, 0.75, 0.85)[k % 4] for _ in range(rng.randrange(45))]
        start, end, n = dc.passage(np.array(match, bool))
        assert n == sum(match[start:end]) == longest(match)
        assert 5 * n >= 4 * (end - start) and (not n or match[start] and match[end - 1])


def test_edited_passages_hold_what_their_parts_hold(spark):
    rng = random.Random(6)
    fresh = lambda n: ["".join(rng.choices("abcdefgh", k=9)) for _ in range(n)]
    item = fresh(38)
    edited = [w if k % 14 < 10 else "x" + w for k, w in enumerate(item)]  # three runs of 10, 4 changed words between
    docs = [(1, edited), (2, edited[:10]), (3, edited[:24]), (4, [w if k % 3 else "x" + w for k, w in enumerate(item)])]
    docs += [(5, [*item[:9], "x", item[10]]), (6, item[:9])]  # the best stretch of both is the run of 9
    df = spark.createDataFrame([(d, " ".join(fresh(30) + w + fresh(30))) for d, w in docs], "doc_id long, text string")
    got = {r.doc_id: (r.n_match, r.n_overlap) for r in dc.overlaps(df, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()}
    assert got == {1: (20, 24), 2: (10, 10), 3: (20, 24), 5: (10, 11)}


def test_dump_and_repeated_words_carry_one_item_a_diagonal(spark, monkeypatch):
    """A copy of the whole benchmark: what is compared grows with the copy, not with its square."""
    rng = random.Random(9)
    fresh = lambda n: ["".join(rng.choices("abcdefgh", k=9)) for _ in range(n)]
    items = [(i, " ".join(fresh(40))) for i in range(400)] + [(900, "a " * 30)]
    marks = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(t for _, t in items[:400])), (2, "a " * 20000)], "doc_id long, text string")
    compared = spark.sparkContext.accumulator(0)
    plain = dc.stretch
    monkeypatch.setattr(dc, "stretch", lambda match: (compared.add(len(match)), plain(match))[1])
    got = {(r.doc_id, r.item_id): (r.n_match, r.doc_word) for r in dc.overlaps(docs, marks).collect()}
    assert got == {(1, i): (40, 40 * i) for i in range(400)} | {(2, 900): (30, 0)}
    assert compared.value <= 16000 + 20030 * 30


def test_shared_phrase_meets_only_items_that_go_on_alike(spark, monkeypatch):
    rng = random.Random(10)
    fresh = lambda n: ["".join(rng.choices("abcdefgh", k=9)) for _ in range(n)]
    prompt = fresh(8)
    items = [(i, " ".join(prompt + fresh(20))) for i in range(300)] + [(900, " ".join(prompt))]
    docs = [(d, " ".join(fresh(10) + prompt + fresh(10))) for d in range(50)] + [(99, "x " + items[7][1])]
    tried = spark.sparkContext.accumulator(0)
    plain = dc.stretch
    monkeypatch.setattr(dc, "stretch", lambda match: (tried.add(1), plain(match))[1])
    found = dc.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.n_match for r in found.collect()}
    assert got == {(d, 900): 8 for d in [*range(50), 99]} | {(99, 7): 28}
    assert tried.value <= 60  # all pairs would be 15,351


def test_words_beside_a_seed_may_stand_behind_a_gap(spark):
    """Eight words, four others, eight words: the least identity that passes, from either side."""
    item = [f"w{k}" for k in range(20)]
    cut = [w if not 8 <= k < 12 else "x" for k, w in enumerate(item)]
    df = spark.createDataFrame([(1, " ".join(["y"] * 9 + cut + ["z"] * 9)), (2, " ".join(cut)), (3, " ".join(cut[:13]))], "doc_id long, text string")
    got = {r.doc_id: (r.n_match, r.n_overlap) for r in dc.overlaps(df, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()}
    assert got == {1: (16, 20), 2: (16, 20)}


def test_one_more_word_is_asked_for_where_many_items_hold_a_seed_and_nowhere_else(spark):
    rng = random.Random(41)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    shared, own = words(8), words(30)
    items = [(f"i{i}", f"{shared} {words(20)}") for i in range(dc.FEW + 1)] + [("alone", own), ("short", words(9))]
    known = dc.items(spark.createDataFrame(items, "item_id string, text string")).withColumn("number", F.monotonically_increasing_id())
    every = dc.item_seeds(known)
    hot = dc.hot_seeds(every)
    assert hot.count() == len(dc.MASKS)
    rows = [(r.seed, r.key, r.n) for r in dc.needed(every, hot).collect()]
    seeds = {r.seed for r in hot.collect()}
    assert all((s == k) == (s not in seeds) for s, k, _ in rows)
    # each shared window starts its item: five words stand behind it
    assert sum(s in seeds for s, _, _ in rows) == (dc.FEW + 1) * len(dc.MASKS) * 5
    docs = [(1, f"{words(50)} {shared} {words(50)}"), (2, f"{words(40)} {items[0][1]} {words(9)}"), (3, f"{words(70)} {own}")]
    got = dc.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.n_match) for r in got) == [(2, "i0", 28), (3, "alone", 30)]
