import re
from collections import Counter

import duckdb

from sigspark.llm import quality_rules as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", "  \n\x0b ", "one two three four five", "a b c d e f a b c d e", "x " * 40, "é b # | \n\n \nline\nline\n line\nline", "\U0001f600 wide " * 9, "w1 w2 w3 w4 w5 w6 " * 3000, "\nlead"]


def test_measurements_against_brute_force(spark):
    rows = [(i if i else None, t, 5) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words long").repartition(3)
    got = sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in q.ledger(df).collect())
    assert got == sorted((i or 0, *brute(t)) for i, t, _ in rows)
    assert q.ledger(df.limit(0)).count() == 0


def test_policies_and_ablation(spark):
    book = spark.createDataFrame([(1, 0), (2, 1), (3, 3), (4, 8), (5, 9), (6, 64), (7, 64)], "doc_id long, failed long")
    got = {(r.version, r.rule): (r.n_failed, r.n_only, r.n_rejected) for r in q.ablation(book).collect()}
    assert got["v1", "few_words"] == (3, 2, 3) and got["v2", "few_words"] == (3, 1, 4)
    assert got["v2", "symbols"] == (2, 1, 4) and got["v3", "shouting"] == (2, 2, 6)
    assert q.ablation(book.limit(0)).count() == 0
    kept = {p.version: {r.doc_id for r in book.filter(q.verdict(p)).collect()} for p in q.POLICIES}
    assert kept == {"v1": {1, 4, 6, 7}, "v2": {1, 6, 7}, "v3": {1}}


def test_sql_says_the_same(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cur = con.execute(entry.oracle_sql()["op5_quality_rules"])
    names = [d[0] for d in cur.description]
    df = entry.queries()["op5_quality_rules"](spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == sorted(cur.fetchall())
