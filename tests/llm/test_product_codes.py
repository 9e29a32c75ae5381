import hashlib
import math
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from sigspark.llm import product_codes as pc

ROW = "vec_id long, embedding array<double>, label int, code string"


def brute(rows, entries=16, rounds=6):
    """Every distance of every round, in Python integers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(Fraction(x) * 4096) for x in r[1]] for r in kept]
    w = len(whole[0]) // 8
    part = lambda v, p: v[p * w : (p + 1) * w]
    book = [[part(v, p) for v in whole[:entries]] for p in range(8)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda v, p: min(range(len(book[p])), key=lambda e: (dist(part(v, p), book[p][e]), e))
    for _ in range(rounds):
        new = []
        for p in range(8):
            groups = defaultdict(list)
            for v in whole:
                groups[best(v, p)].append(part(v, p))
            new.append([[sum(c) // len(g) for c in zip(*g)] if (g := groups.get(e)) else old for e, old in enumerate(book[p])])
        book = new
    out, sums = [], defaultdict(int)
    for r, v in zip(kept, whole):
        own = [best(v, p) for p in range(8)]
        error = min(sum(dist(part(v, p), book[p][e]) for p, e in enumerate(own)), pc.LONGEST)
        sums[r[2]] += error
        out.append((r[0], "".join(f"{e:02x}" for e in own), error, r[2]))
    digest = hashlib.sha256(",".join(str(x) for p in book for e in p for x in e).encode()).hexdigest()
    return sorted(repr((i, c, e, min(sums[k], pc.LONGEST))) for i, c, e, k in out), digest


def vectors(seed, n, width, scale=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, scale) for _ in range(width)] for _ in range(12)]
    rows = [(i * 3, [x + rng.gauss(0, 0.1 * scale) for x in rng.choice(centres)], rng.choice([0, 1, 2, None]), "clash") for i in range(n)]
    return rows


def check(spark, rows, chunk=64):
    found, book = pc.compressed(spark.createDataFrame(rows, ROW).repartition(4), chunk=chunk)
    got = sorted(repr(tuple(r[c] for c in ("vec_id", "code", "error", "label_error"))) for r in found.collect())
    want, digest = brute(rows)
    assert got == want and pc.digest(book) == digest


@pytest.mark.parametrize("seed,n,width,scale", [(1, 500, 16, 1.0), (2, 300, 64, 0.2), (3, 9, 8, 1.0), (4, 200, 24, 1e6), (5, 120, 16, 1e200)])
def test_equals_all_distances(spark, seed, n, width, scale):
    check(spark, vectors(seed, n, width, scale), chunk=300 if seed == 1 else 64)


def test_ties_repeats_nulls_and_invalid_rows(spark):
    rows = vectors(6, 60, 16) + [(5, [0.5] * 16, 1, "")] * 70 + [(None, [0.25] * 16, None, ""), (5, [-0.5] * 16, 1, "")]
    rows += [(i, [0.0, 1.0] * 8, 2, "") for i in range(3)] + [(i, [float(i % 2)] * 16, 2, "") for i in range(40, 60)]
    bad = [(900, None, 1, ""), (901, [math.nan] * 16, 1, ""), (902, [math.inf] + [0.0] * 15, 1, ""), (903, [None] + [0.0] * 15, 1, "")]
    check(spark, rows + bad)
    odd = [(904, [0.0] * 15, 1, ""), (905, [0.0] * 8, 1, ""), (906, [], 1, "")]
    found, _ = pc.compressed(spark.createDataFrame(rows + bad + odd, ROW))
    assert found.count() == len(rows)
    assert pc.compressed(spark.createDataFrame(bad, ROW))[0].count() == 0 == pc.compressed(spark.createDataFrame([], ROW))[0].count()


def test_shortlists_hold_every_nearest_entry_and_do_shorten():
    rng = np.random.default_rng(3)
    points = rng.integers(-4000, 4000, (40, 4))[rng.integers(0, 40, 4096)] + rng.integers(-90, 90, (4096, 4))
    points = points[np.argsort(pc.hilbert(points), kind="stable")]
    starts = np.arange(0, len(points), pc.BLOCK)
    part = pc.Part(points, np.arange(len(points)), *[f.reduceat(points, starts) for f in (np.minimum, np.maximum, np.add)])
    entries = points[rng.choice(len(points), 16, replace=False)].copy()
    entries[5] = entries[2]
    lists, own = part.shortlists(entries), pc.nearest(points, entries)[0]
    assert lists[np.arange(len(points)) // pc.BLOCK, own].all()
    assert lists.mean() < 0.7
    sums, counts = part.totals(entries)
    assert counts.tolist() == np.bincount(own, minlength=16).tolist() and counts[5] == 0
    assert all(np.array_equal(sums[e], points[own == e].sum(0)) for e in range(16))


def test_hilbert_neighbours_on_a_full_grid():
    """On a full grid each step along the curve goes to a neighbouring cell."""
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    # 12 bits a side: scaled points of the grid keep the order of the 8-cell curve.
    walk = grid[np.argsort(pc.hilbert(grid), kind="stable")]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_pieces_of_sums():
    for v in (0, 5, -5, 1 << 40, -(1 << 40), (1 << 90) - 7, -(1 << 90) + 7):
        assert sum(x << 40 * at for at, x in pc.limbs(v)) == v and all(abs(x) < 1 << 40 for _, x in pc.limbs(v))


def test_decoded_vectors(spark):
    rows = vectors(8, 200, 16)
    found, book = pc.compressed(spark.createDataFrame(rows, ROW))
    back = {r["vec_id"]: r["vector"] for r in pc.decoded(found, book).collect()}
    near = np.mean([np.sum((np.array(back[r[0]]) - np.array(r[1])) ** 2) for r in rows])
    assert near < 0.3 * np.mean([np.sum(np.array(r[1]) ** 2) for r in rows])
