import corpus_pipeline
from sigspark.llm import simhash

SF = "/root/testdata/sf0.01"


def planted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    base = [r for r in docs.collect() if len(r.text) > 900][:4]
    extra = [
        (10_001, base[0].text, base[0].lang),
        (10_002, base[1].text + " end", base[1].lang),
        (10_003, base[2].text[:400] + " " + item + " " + base[3].text[300:700], base[2].lang),
        (10_004, base[3].text[:500] + ' token = "0123456789abcdef0123456789abcdef" ' + base[2].text[200:600], base[3].lang),
        (10_005, None, None),
        (10_006, "", "en"),
        (10_007, "12 34 \n !", "en"),
        (None, "the was and for " + base[0].text[100:400], "en"),
        (None, "the was and for " + base[0].text[100:400], "en"),
    ]
    more = spark.createDataFrame([(i, t, lang, "src", len(t or ""), 1.0) for i, t, lang in extra], "doc_id long, text string, lang string, source string, n_chars long, score double")
    return docs.selectExpr("*", "2.0D AS score").unionByName(more).repartition(4), base, extra


def test_stages_take_effect_and_keep_columns(spark):
    docs, base, extra = planted(spark)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "decontaminate", "redact_secrets", "pack"]
    now = docs.cache()
    before = {r.doc_id: r for r in now.collect()}

    told = stages["language_id"](spark, now, SF).cache()
    assert told.columns == docs.columns
    gone = set(before) - {r.doc_id for r in told.collect()}
    assert {10_005, 10_006, 10_007} <= gone and len(gone) <= 5

    once = stages["near_dedup"](spark, told, SF).cache()
    rows = told.select("doc_id", "text").collect()
    prints = [simhash.fingerprint(r.text) for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(len(rows)):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    want = sorted(min((rows[i].doc_id is None, rows[i].doc_id or 0) for i in range(len(rows)) if root[i] == k) for k in set(root))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in once.collect()) == want
    assert once.columns == docs.columns

    clean = stages["decontaminate"](spark, once, SF).cache()
    ids = {r.doc_id for r in clean.collect()}
    assert 10_003 not in ids and base[2].doc_id in ids | ({r.doc_id for r in told.collect()} - {r.doc_id for r in once.collect()})

    safe = stages["redact_secrets"](spark, clean, SF).cache()
    assert safe.count() == clean.count() and safe.columns == docs.columns
    assert all("0123456789abcdef" not in r.text for r in safe.collect())

    packed = stages["pack"](spark, safe, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in safe.collect()}
    for stage in list(stages.values()):
        assert stage(spark, docs.limit(0), SF).count() == 0
    now.unpersist()


def test_run_packs_what_the_stages_keep(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.count() > 50
