"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from sigspark import plans
from sigspark.session import local_session

HEADLINE = (
    "scan_daily_bars", "bollinger", "macd", "session_vwap", "label_daily_outcomes", "signal_performance", "criterion_report",
    "market_measurement", "sector_measurement", "asof_sector_context", "tomorrow_top10", "dedupe_records", "news_lexicon_score",
    "news_candidate_pairs", "stream_bars_5m",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    qs = plans.all_queries()
    times = {}
    for name in HEADLINE:
        t = time.perf_counter()
        qs[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
