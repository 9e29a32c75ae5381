import random
import re
from collections import defaultdict

import pytest

from sigspark.llm import mixing
from sigspark.llm.common import written


def shares(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by sharing again and again, one source list in order (None last)."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full, left = dict.fromkeys(names, 0.0), set(), share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        if not open_:
            return target
        for s in open_:
            target[s] = left * weight[s] / sum(weight[x] for x in open_)
        over = [s for s in open_ if target[s] > most * sizes[s]]
        if not over:
            return target
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
            full.add(s)


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(300):
        source = rng.choice(["a", "a", "a", "b", "", "é", None, "z"])
        text = rng.choice([None, "", " \t ", "word " * rng.randint(1, 60), "x y\x1c z\n" * rng.randint(1, 9)])
        rows.append((i, text, source, "clash"))
    return rows + [(None, "the same words", "b", "clash")] * 50 + [(7, "twice here", "z", "one"), (7, "other text here", "z", "two")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_budgets_are_met_exactly(spark, seed):
    rows = corpus(seed)
    found = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string, size string").repartition(5)).collect()
    assert len(found) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, text, source, _ in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = shares(sizes)
    for r in found:
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["epochs"] * r["size"] + r["rest"]
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    # Whole documents but for one at each source's cut.
    cut = [r for r in found if r["taken"] not in (r["epochs"] * r["size"], (r["epochs"] + 1) * r["size"])]
    assert len({r["source"] for r in cut}) == len(cut)


def test_reruns_and_partitionings_agree(spark):
    df = spark.createDataFrame(corpus(4), "doc_id long, text string, source string, extra string")
    key = lambda d: sorted(map(repr, d.select("doc_id", "source", "size", "taken").collect()))
    first = key(mixing.mixed(df.repartition(3)))
    assert first == key(mixing.mixed(df.coalesce(1))) == key(mixing.mixed(df.repartition(7, "source")))


def test_texts_of_the_mix(spark):
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra string")
    plan = written(mixing.mixed(docs))
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    texts = mixing.mixture(docs, plan).collect()
    assert sum(words(r["text"]) for r in texts) == sum(r["taken"] for r in plan.collect())
    whole = {(r[0], r[2], r[1]) for r in rows}
    assert all(any(t.startswith(r["text"]) for i, s, t in whole if (i, s) == (r["doc_id"], r["source"]) and t) for r in texts)


def test_empty_table_one_source_and_long_text(spark):
    kinds = "doc_id long, text string, source string"
    assert mixing.mixed(spark.createDataFrame([], kinds)).count() == 0
    assert [r["taken"] for r in mixing.mixed(spark.createDataFrame([(1, None, None), (2, "", "a")], kinds)).collect()] == [0, 0]
    only = mixing.mixed(spark.createDataFrame([(1, "w " * 400_000, "a")], kinds)).collect()[0]
    assert (only["size"], only["target"], only["taken"]) == (400_000, 600_000.0, 600_000)
