import zlib

import duckdb
import numpy as np

from sigspark.llm import language

SF = "/root/testdata/sf0.01"


def test_gradient_by_differences():
    rng = np.random.default_rng(2)
    model = language.ByteGru(["a", "b", "c"], hidden=3)
    x, y = rng.integers(97, 101, (4, 6)).astype(np.uint8), np.array([0, 1, 2, 1])
    _, grad = model.loss_and_gradient(x, y)
    for name, place in (("u", (0, 0, 1, 2)), ("u", (1, 1, 0, 0)), ("table", (0, 1, 98, 1)), ("table", (1, 0, 99, 2)), ("out", (1, 2, 0)), ("bias", (1,))):
        kept = model.p[name][place]
        sides = []
        for step in (1e-5, -1e-5):
            model.p[name][place] = kept + step
            sides.append(model.loss_and_gradient(x, y)[0])
        model.p[name][place] = kept
        assert np.isclose((sides[0] - sides[1]) / 2e-5, grad[name][place], rtol=1e-3, atol=1e-6)


def test_prediction_equals_training_pass():
    rng = np.random.default_rng(2)
    model = language.ByteGru(["a", "b"], hidden=4)
    x = rng.integers(97, 120, (5, 9)).astype(np.uint8)
    prob = language.position_probabilities(model.frozen(), x)
    loss, _ = model.loss_and_gradient(x, np.array([0, 1, 0, 1, 1]))
    own = prob[np.array([0, 1, 0, 1, 1])[None, :], np.arange(9)[:, None], np.arange(5)[None, :]]
    assert np.isclose(-np.log(own).mean(), loss, rtol=1e-4)


def test_held_out_accuracy_and_edge_cases(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs)
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    odd = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "12 \n!?", 1.0), (4, "the and of " * 20000, 1.0), (None, "the cat and the", 1.0)], "doc_id long, text string, score double")
    rows = {r.doc_id: r for r in language.identify(odd, model).collect()}
    assert [rows[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and [rows[i].score for i in (1, 2, 3)] == [0.0] * 3
    assert rows[4].lang_pred == "en" and rows[None].lang_pred in model.languages
    assert language.identify(odd.limit(0), model).count() == 0
    bare = language.fit(docs.limit(0))
    assert {r.lang_pred for r in language.identify(odd, bare).collect()} == {"und"}
    runs = language.label_runs(model, "the of and " * 30)
    assert runs[0][0] == 0 and runs[-1][1] == 330 and all(a[1] == b[0] for a, b in zip(runs, runs[1:], strict=False))
