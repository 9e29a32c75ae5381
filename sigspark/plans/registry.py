"""Catalogue of named queries and their plain-SQL twins.

A query is a function (spark, sf_dir) -> DataFrame. Its SQL twin is written by hand
for an independent engine; named fragments (bars, hours, ...) used in it are pulled in
as CTEs. Both sides publish doubles rounded to the same digits and dates as text.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FRAGMENTS: dict[str, str] = {}


#: Fragments that a recursive one reads: worked out once, not in every step.
ONCE: set[str] = set()


def fragment(name: str, sql: str, once: bool = False) -> None:
    FRAGMENTS[name] = sql
    if once:
        ONCE.add(name)


def _needs(sql: str) -> list[str]:
    words = set(re.findall(r"\w+", sql))
    return [n for n in FRAGMENTS if n in words]


def compose(body: str) -> str:
    """Prefix the body with the fragments it names, dependencies first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in _needs(FRAGMENTS[name]):
            if dep != name:
                visit(dep)
        ordered.append(name)

    for n in _needs(body):
        visit(n)
    if not ordered:
        return body
    if body.lstrip().upper().startswith("WITH"):
        body = f"SELECT * FROM (\n{body}\n) AS body_"
    ctes = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in ONCE else ''}({FRAGMENTS[n]})" for n in ordered)
    return f"WITH RECURSIVE {ctes}\n{body}"


def published(df: DataFrame, digits: int) -> DataFrame:
    """Output form: doubles rounded, integers as long, dates and times as text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, "|")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, f: str = "", digits: int = 8):
    """Register a query. ``f`` lists the double columns of the SQL side."""

    def wrap(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return published(fn(spark, sf_dir), digits)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            cols = f.split()
            body = sql.strip()
            if cols:
                rounded = ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE) AS {c}" for c in cols)
                body = f"SELECT * REPLACE ({rounded}) FROM (\n{body}\n) AS result_"
            ORACLES[name] = body
        return fn

    return wrap
