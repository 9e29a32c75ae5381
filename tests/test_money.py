from sigspark.plans.scores2 import money


def test_amounts_by_hand(spark):
    rows = [(1, "1.250.000 TL"), (2, "12,5 milyon dolar"), (3, "3 milyar TRY ve 7 adet"), (4, "2.500 Euro, 2.5 EUR"), (5, "%5 5% 1.234,50 tl"), (6, None), (7, "12 tlx")]
    got = {(r.doc_id, r.unit, r.amount) for r in money(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "tl", 1250000.0), (2, "usd", 12500000.0), (3, "tl", 3e9), (3, "adet", 7.0), (4, "eur", 2500.0), (4, "eur", 2.5), (5, "%", 5.0), (5, "tl", 1234.5)}
