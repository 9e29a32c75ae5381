"""Market-signal research on Spark: bars, indicators, signals, outcomes, reports."""
