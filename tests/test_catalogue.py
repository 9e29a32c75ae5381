import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "bollinger", "session_vwap", "market_breadth", "dedupe_records", "news_lexicon_score", "stream_bars_5m", "normalize_daily_bars",
    "scan_daily_bars", "dim_calendar", "dim_sector_map", "forward_prices_by_row", "mention_symbols", "money_amounts", "canonical_url",
    "volume_breakout_first", "closed_bars",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


def test_every_oracle_parses(con):
    for name, sql in entry.oracle_sql().items():
        con.execute(f"EXPLAIN {sql}")


def test_entry_runs(spark):
    assert set(entry.entry(spark).columns) == {"session_no", "symbol", "tscore", "rank"}


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted(map(str, (tuple(r[names.index(c)] for c in sorted(names)) for r in cur.fetchall())))
    got = sorted(map(str, (tuple(r[c] for c in sorted(names)) for r in df.collect())))
    assert got == want
