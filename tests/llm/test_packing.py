import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from sigspark.llm import packing

PATH = packing.default_tokenizer()


def brute_ids(text):
    t = Tokenizer.from_file(PATH)
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, docs, sequence):
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= sequence
    total = sum(len(brute_ids(t)) for _, t in docs)
    assert sum(r.length for r in rows) == total
    return len(by_seq), -(-total // sequence)


def test_pieces_places_and_round_trip(spark):
    docs = [(1, "a b c"), (2, None), (3, ""), (4, "Héllo  wörld\n\nit's fine <|endoftext|> ok "), (5, "word " * 300), (6, "x y z w " * 31), (None, "no id"), (4, "Héllo  wörld\n\nit's fine <|endoftext|> ok ")]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, length int").repartition(3)
    rows = packing.packed(df, sequence=64).collect()
    used, least = check(rows, docs, 64)
    assert used <= least + 1
    for r in rows:
        if r.doc_id is not None:
            ids = brute_ids(dict(docs)[r.doc_id])[r.start : r.start + r.length]
            assert len(ids) == r.length and zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32
            assert r.start == 64 * r.piece
    once = df.filter("doc_id < 4 or doc_id > 4")
    plan = packing.packed(once, sequence=64).cache()
    out = {r.sequence_id: r.ids for r in packing.sequences(once, plan, sequence=64).collect()}
    for r in plan.collect():
        assert out[r.sequence_id][r.offset : r.offset + r.length] == brute_ids(dict(docs)[r.doc_id])[r.start : r.start + r.length]
    assert packing.packed(df.limit(0)).count() == 0


def test_two_replace_the_smallest():
    # Greedy gives 6 + 3 (gap 1); two and two fill the gap of 4 left by the three.
    assert packing.patterns({6: 1, 3: 1, 2: 2}, 10)[0] == (1, (6, 2, 2))


@pytest.mark.parametrize("seed", range(4))
def test_patterns_use_every_piece_and_are_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    counts = {int(k): int(n) for k, n in zip(rng.integers(1, 200, 60), rng.integers(1, 20, 60), strict=True)}
    found = packing.patterns(counts, 200)
    used = {}
    for bins, lengths in found:
        assert sum(lengths) <= 200 and bins > 0
        for s in lengths:
            used[s] = used.get(s, 0) + bins
    assert used == counts
    assert len(found) <= 8 * len(counts)
    gaps = []  # first fit, largest first
    for size in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        at = next((i for i, g in enumerate(gaps) if g >= size), None)
        if at is None:
            gaps.append(200 - size)
        else:
            gaps[at] -= size
    assert sum(b for b, _ in found) <= 1.02 * len(gaps) + 1


def test_control_and_space_characters_keep_their_ids():
    words = packing.WordIds(PATH)
    odd = [chr(c) for c in range(0x3001) if not chr(c).isprintable() or chr(c).isspace()]
    texts = [f"{a}{c}{b}" for c in odd for a, b in (("a", "b"), ("Don't,", "é!"), ("", "x"), ("x ", " "))]
    texts += ["".join(f"w{c}" for c in odd), "".join(odd), "a\x1cb", " \x1f\x1e "]
    tokenizer = Tokenizer.from_file(PATH)
    want = [[*tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert [w.tolist() for w in words.encode(texts)] == want
    assert words.encode(["a\x1cb"])[0].tolist() == [320, 472, 321, 0]
