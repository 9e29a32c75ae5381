import random
from collections import Counter

import pytest

from sigspark.llm import suffix_dedup


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), runs, bytes(b for b, g in zip(r, gone, strict=True) if not g)))
    return out


def test_intervals_stop_at_the_length():
    rng = random.Random(3)
    for _ in range(150):
        length = rng.choice([3, 5, 12, 20])
        base = [bytes(rng.choices(range(rng.choice([2, 4, 256])), k=40)) for _ in range(3)]
        parts = []
        for _ in range(rng.randint(1, 12)):
            b = bytearray(rng.choice(base))
            b[rng.randrange(40)] = rng.randrange(256)
            a = rng.randrange(10)
            parts.append(bytes(b[a : a + rng.randint(0, 40)]))
        weights = [rng.choice([1, 1, 2]) for _ in parts]
        seen = Counter()
        for p, w in zip(parts, weights, strict=True):
            for i in range(len(p) - length + 1):
                seen[p[i : i + length]] += w
        got = [list(map(bool, x)) for x in suffix_dedup.repeated_windows(parts, weights, length)]
        assert got == [[seen[p[i : i + length]] > 1 for i in range(len(p) - length + 1)] for p in parts]


@pytest.mark.parametrize("most", [4096, 2])
def test_whole_texts_against_brute_force(spark, most):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = prose(40)
    texts = [prose(30) + shared[a : a + 80] + prose(20) for a in range(0, 60, 4)] + [shared] * 3 + [None, "", "short", "a" * 90, "ab" * 70]
    near = prose(60)
    texts += [near, near[:100] + "X" + near[100:], near + near]
    df = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int").repartition(3)
    got = sorted(suffix_dedup.deduplicated(df, length=40, gram=8, most=most).collect(), key=lambda r: r.doc_id or 0)
    assert [(r.n_bytes, sum(r.span_ends) - sum(r.span_starts), len(r.span_starts), bytes(r.kept)) for r in got] == brute(texts, 40)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.deduplicated(df).count() == 0


def test_long_texts_are_cut_into_overlapping_segments(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 64)
    rng = random.Random(2)
    text = "".join(rng.choices("abcdefgh", k=900))
    texts = [text, text[300:700], "z" + text[500:560] + "y"]
    raw = [t.encode() for t in texts]
    runs = [suffix_dedup.anchor_runs([r[at : at + 64 + 39] for at in range(0, len(r) - 39, 64)], 40, 8) for r in raw]
    assert [int(r[2].sum()) for r in runs] == [max(0, len(r) - 39) for r in raw]
