import numpy as np
import pytest
import xxhash

from sigspark.llm import simhash
from sigspark.llm.components import components


def slow_print(text):
    words = [w for w in simhash.WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    out = 0
    for bit in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(s.encode(), 42) >> bit & 1 for s in shingles) > len(shingles):
            out |= 1 << bit
    return out


def brute(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def test_fingerprint_is_the_stated_vote():
    for text in (None, "", " \n", "One", "One two", "The Cat SAT on É the mat the cat sat on", "a b c " * 50):
        assert simhash.fingerprint(text) == slow_print(text)


def test_anchors_cover_one_bit_of_a_half():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 63, 200, dtype=np.int64)
    for change in [(3,), (0, 35), (1, 2, 40), (32, 33, 5)]:
        y = x.copy()
        for bit in change:
            y ^= np.int64(1 << bit)
        one, two = ({(int(r), int(w)) for r, w in zip(*simhash.anchors_of(v), strict=True)} for v in (x, y))
        assert {r for r, _ in one & two} == set(range(200))
    rows, _ = simhash.anchors_of(x)
    assert np.bincount(rows).max() <= 34


@pytest.mark.parametrize("block", [4096, 3])
def test_links_connect_what_brute_force_connects(spark, block):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 62, 12)
    prints = sorted({int(s) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for s in seeds for _ in range(12)} | {0, 1, 7, 15})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame(list(enumerate(signed)), "node long, fp long").repartition(3)
    found = {r.node: r.component for r in components(simhash.link_edges(df, block=block)).collect()}
    assert [found.get(i, i) for i in range(len(prints))] == brute(prints)


def test_documents_with_nulls_ties_and_clashing_names(spark):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(5, long, 1), (3, long + " end", 2), (9, None, 3), (8, "  ", 4), (7, "alone here now", 5), (5, long, 1), (None, "nobody knows this", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int").repartition(2)
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert found == [(-1, None), (3, 3), (5, 3), (5, 3), (7, 7), (8, 8), (9, 8)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_rows_without_id_link_others_and_one_id_on_two_texts_links_nothing(spark, monkeypatch):
    from pyspark.sql import functions as F

    prints = [(9, 0b0), (None, 0b111), (7, 0b111111), (20, 0b111111111), (4, 1 << 40 | 0xFFFF0000), (4, 0xABCDEF << 20), (30, 0xABCDEF << 20 | 1), (31, 1 << 40 | 0xFFFF0001)]
    df = spark.createDataFrame(prints, "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs.select("doc_id", F.col("fp")))
    found = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert [found[p] for p in prints] == [7, 7, 7, 7, 4, 4, 4, 4] and len(set(found)) == 8
    far = spark.createDataFrame([(4, 0), (4, (1 << 30) - 1), (5, 1), (6, (1 << 30) - 2)], "doc_id long, fp long")
    edges = simhash.link_edges(far.select(F.col("fp").alias("node"), "fp")).collect()
    assert {frozenset((r["a"], r["b"])) for r in edges} == {frozenset((0, 1)), frozenset(((1 << 30) - 1, (1 << 30) - 2))}
