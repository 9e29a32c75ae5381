"""Named queries over the driver tables. Importing the package fills the registry."""

import importlib

from sigspark.plans.registry import ORACLES, QUERIES, compose

MODULES = (
    "base_sql",

    "indicators",
    "records_fixture",
    "outcomes",
    "context",
    "reports",
    "scoring",
    "bars",
    "news",
    "identity",
    "streams",
    "learning",
    "more",
    "scores2",
    "evidence",
    "decision",
    "flags",
    "composite",
    "ranklearn",
    "plan",
    "transfer",
)

for _m in MODULES:
    importlib.import_module(f"sigspark.plans.{_m}")


def all_queries():
    return dict(QUERIES)


def all_oracles():
    return {k: compose(v) for k, v in ORACLES.items()}
