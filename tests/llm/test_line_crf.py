from itertools import product

import duckdb
import numpy as np

from sigspark.llm import line_crf

SF = "/root/testdata/sf0.01"


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    count = np.array([3, 1, 5, 2])
    first = np.cumsum(count) - count
    score, trans = rng.normal(0, 2, count.sum()), rng.normal(0, 1, (2, 2))
    inside = np.array([f + t for f, n in zip(first, count, strict=True) for t in range(n - 1)])
    single, joint = line_crf.marginals(score, trans, first, count, inside)
    at = 0
    for f, n in zip(first, count, strict=True):
        weight = {y: np.exp(sum(score[f + t] * y[t] for t in range(n)) + sum(trans[y[t], y[t + 1]] for t in range(n - 1))) for y in product((0, 1), repeat=int(n))}
        total = sum(weight.values())
        for t in range(n):
            assert np.isclose(single[f + t], sum(w for y, w in weight.items() if y[t]) / total)
        for t in range(n - 1):
            want = [[sum(w for y, w in weight.items() if y[t] == a and y[t + 1] == b) / total for b in (0, 1)] for a in (0, 1)]
            assert np.allclose(joint[at], want)
            at += 1


def test_held_out_accuracy_and_edge_cases(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = line_crf.fit(docs, labels)
    got = {r.doc_id: r.score for r in line_crf.graded(docs, model).collect()}
    truth = duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet' WHERE doc_id IN (SELECT doc_id FROM '{SF}/documents.parquet')").fetchall()
    import zlib

    held = [(got[i], q) for i, q in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(s >= line_crf.THRESHOLD) == q for s, q in held]) > 0.93
    odd = spark.createDataFrame([(1, None, 2.0), (2, "", 1.0), (None, " \n\t\n", 1.0), (3, "x", 0.5), (4, "line of words here.\n" * 4000, 0.1)], "doc_id long, text string, score double")
    rows = {r.doc_id: r.score for r in line_crf.graded(odd, model).collect()}
    assert rows[1] == rows[2] == rows[None] == model.share and all(0 <= s <= 1 for s in rows.values())
    assert line_crf.graded(odd.limit(0), model).count() == 0
    bare = line_crf.fit(docs, labels.limit(0))
    assert {r.score for r in line_crf.graded(odd, bare).collect()} == {0.5}
