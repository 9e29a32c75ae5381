import random
from itertools import combinations

from sigspark.llm import licenses
from sigspark.llm.license_texts import TEMPLATES


def test_longest_increasing_run():
    rng = random.Random(1)
    for _ in range(60):
        v = [rng.randrange(9) for _ in range(rng.randrange(9))]
        got = [v[i] for i in licenses.increasing(v)]
        assert all(a < b for a, b in zip(got, got[1:], strict=False))
        assert len(got) == max(k for k in range(len(v) + 1) for c in combinations(v, k) if all(a < b for a, b in zip(c, c[1:], strict=False)))


def test_alignment_anchors_on_unique_words():
    a, b = "x the cat the dog sat y".split(), "the cat the big dog sat".split()
    assert licenses.aligned(a, b) == [(1, 0), (2, 1), (3, 2), (4, 4), (5, 5)]
    assert licenses.aligned([], b) == [] and licenses.aligned(["q"], b) == []
    assert licenses.aligned(b, b) == [(i, i) for i in range(6)]


def test_planted_notices_are_found_and_prose_is_left_alone(spark):
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choice("the of and to is under a in for work version public any use this".split()) for _ in range(n))
    rows, want = [], set()
    for i, (name, text) in enumerate(TEMPLATES):
        words = text.split()
        if len(words) > 20:
            del words[9]
            words[15] = "changed"
        rows.append((i, f"{prose(80)}.\n{' '.join(words).upper()}. {prose(50)}", 1))
        want.add((i, name))
    rows += [(100 + i, prose(400), 1) for i in range(20)] + [(200, None, 1), (201, "", 1), (202, "license", 1), (None, TEMPLATES[0][1], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, license int").repartition(3)
    got = {(r.doc_id, r.license) for r in licenses.scan(df).collect()}
    assert got == want | {(None, "Apache-2.0")}
    assert licenses.scan(df.limit(0)).count() == 0


def found(text):
    known = licenses.Templates()
    words, _ = licenses.word_hashes([text])
    return [(known.names[t], n, a, b) for t, n, a, b in known.scan(words, *known.hits(words))]


def test_close_copies_are_found_one_by_one():
    line = "Licensed under the MIT License"
    assert found(f"alpha {line} beta {line} gamma") == [("MIT", 5, 1, 6), ("MIT", 5, 7, 12)]
    for name, text in TEMPLATES:
        size = len(licenses.word_hashes([text])[0])
        for copies in (1, 2, 3, 40):
            for between in ("", "beta", "copyright some company and others " * 6):
                step = size + len(between.split())
                got = found(f"alpha {f' {between} '.join([text] * copies)} gamma")
                assert got == [(name, size, 1 + k * step, 1 + k * step + size) for k in range(copies)], (name, copies, between)


def test_close_copies_with_edits_and_mixed_notices():
    rng = random.Random(3)
    # GPL-2.0 and GPL-3.0 differ in a word that an edit can hit.
    long = [(name, text.split()) for name, text in TEMPLATES if len(text.split()) > 20 and name != "GPL-2.0"]
    for _ in range(100):
        want, words = [], ["alpha"]
        for name, text in rng.choices(long, k=rng.randint(2, 6)):
            own = list(text)
            del own[rng.randrange(1, len(own) - 1)]
            own[rng.randrange(1, len(own) - 1)] = "changed"
            own.insert(rng.randrange(1, len(own) - 1), "inserted here")
            want.append(name)
            words += own + ["beta"] * rng.randrange(3)
        assert [d[0] for d in found(" ".join(words))] == want
