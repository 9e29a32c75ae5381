import hashlib
import math
import random
import re
import zlib

import pytest

from sigspark.llm import importance
from sigspark.llm.common import written

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ROW = "doc_id long, text string, weight string"


def grams(text, least, most):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lower)
    return [" ".join(w[i : i + n]) for n in range(least, most + 1) for i in range(len(w) - n + 1)], len(w)


def brute(docs, target, least=1, most=1, buckets=10_000, least_words=20, percent=10):
    place = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for text in (x[1] for x in docs):
        for g in grams(text, least, most)[0]:
            s[place(g)] += 1
    for text in target:
        for g in grams(text, least, most)[0]:
            t[place(g)] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (S + buckets) / ((a + 1) * (T + buckets)))) for a, b in zip(s, t)]
    out = []
    for doc_id, text, *_ in docs:
        g, n = grams(text, least, most)
        h = int(hashlib.sha256(f"2024:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[place(x)] for x in g)
        out.append([doc_id, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in out if r[5] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = i + 1
    return sorted(repr(r[:5]) for r in out)


def corpus(seed, n=250):
    rng = random.Random(seed)
    vocab = ["Alpha", "beta", "gamma9", "Çok", "ÉTÉ", "naïve", "x", "日本", "q r", "und", "der"]
    text = lambda k: rng.choice(["", " ", "--"]).join([""]) + "".join(rng.choice(vocab) + rng.choice([" ", "  ", ", ", "\n", "-", "\x00"]) for _ in range(k))
    docs = [(i, rng.choice([None, "", text(5), text(40), text(90)]), "clash") for i in range(n)]
    docs += [(None, "the same few words " * 9, "clash")] * 12 + [(3, "one id on two texts " * 6, "clash")]
    return docs, [text(30) for _ in range(8)] + ["alpha beta " * 20]


@pytest.mark.parametrize("seed,least,most", [(1, 1, 1), (2, 1, 3), (3, 2, 2)])
def test_equals_the_plain_computation(spark, seed, least, most):
    docs, target = corpus(seed)
    df = spark.createDataFrame(docs, ROW).repartition(6)
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)] + [(99, None)], "item_id long, text string")
    found = importance.resampled(df, goal, least, most).collect()
    assert sorted(repr([r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")]) for r in found) == brute(docs, target, least, most)


def test_overlapped_scan():
    data = importance.collapsed("A-b  c\tA--b\x00É9")
    assert data == "a b c a b É9".encode()
    assert [m.span() for m in importance.spans(2).finditer(data, overlapped=True)] == [(0, 3), (2, 5), (4, 7), (6, 9), (8, 13)]
    assert not list(importance.spans(3).finditer(b"a b", overlapped=True)) and importance.collapsed(None) == b""


def test_draw_returns_documents(spark):
    docs, target = corpus(5)
    df = spark.createDataFrame(docs, ROW)
    plan = written(importance.resampled(df, spark.createDataFrame([(t,) for t in target], "text string"), percent=50))
    got = importance.drawn(df, plan).collect()
    assert sorted(r["draw_rank"] for r in got) == sorted(r["rank"] for r in plan.collect() if r["rank"]) == list(range(1, len(got) + 1))
    assert all(len(WORD.findall(r["text"])) >= 20 and r["weight"] == "clash" for r in got)


def test_empty_tables_and_long_texts(spark):
    goal = spark.createDataFrame([("alpha",)], "text string")
    assert importance.resampled(spark.createDataFrame([], ROW), goal).count() == 0
    long = [(1, "y" * 3_000_000, ""), (2, "alpha " * 500_000, "")]
    rows = {r["doc_id"]: r for r in importance.resampled(spark.createDataFrame(long, ROW), goal.limit(0), percent=100).collect()}
    assert (rows[1]["n_features"], rows[1]["rank"], rows[2]["n_features"], rows[2]["rank"]) == (1, None, 500_000, 1)
