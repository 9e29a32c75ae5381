import random
import zlib

import pytest

from sigspark.llm import sharding


def fits(sizes, capacity, shards):
    used, now = 1, 0
    for s in sizes:
        if s > capacity:
            return False
        if now + s > capacity:
            used, now = used + 1, 0
        now += s
    return used <= shards


def brute(sizes, shards):
    return next(c for c in sorted({sum(sizes[i:j]) for i in range(len(sizes)) for j in range(i + 1, len(sizes) + 1)}) if fits(sizes, c, shards))


@pytest.mark.parametrize("seed,coarse,fine", [(1, 2, 1), (2, 4, 2), (3, 12, 6)])
def test_capacity_is_the_optimum(spark, seed, coarse, fine):
    rng = random.Random(seed)
    sizes = {rng.randrange(1 << 63): rng.choice([rng.randint(1, 50), rng.randint(1, 2000)]) for _ in range(120)}
    groups = spark.createDataFrame(list(sizes.items()), "key long, bytes long").cache()
    ordered = [n for _, n in sorted(sizes.items())]
    for shards in (3, 7):
        cuts, capacity = sharding.cut_keys(groups, shards, coarse, fine)
        assert capacity == brute(ordered, shards)
        edges = [0, *cuts, 1 << 63]
        assert len(cuts) == shards - 1 and cuts == sorted(cuts)
        assert max(sum(n for k, n in sizes.items() if a <= k < b) for a, b in zip(edges, edges[1:], strict=False)) == capacity


def test_rows_slots_and_edge_cases(spark):
    rows = [(i, f"text {i}" * (i % 7), 0) for i in range(60)] + [(100 + i, "the same text", 0) for i in range(40)] + [(207, None, 0), (207, None, 0), (None, "é", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(4)
    got = sharding.assigned(df, 5).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted((i or -1, 16 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t, _ in rows)
    text = {i: t for i, t, _ in rows}
    place = {}
    for r in got:
        assert place.setdefault(text[r.doc_id], r.shard) == r.shard
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert max(r.shard for r in got) < 5
    assert sharding.assigned(df.limit(0), 5).count() == 0
