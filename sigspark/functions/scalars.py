"""Small Column helpers shared by every operator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str | int | float


def col(x: ColumnLike) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def finite(x: ColumnLike) -> Column:
    """Double, with NaN and infinities turned into NULL."""
    d = col(x).cast("double")
    return F.when(F.isnan(d) | d.isin(float("inf"), float("-inf")), None).otherwise(d)


def num_or_null(x: ColumnLike) -> Column:
    """Numeric parse of free text: anything that is not a finite number is NULL."""
    return finite(col(x).cast("string").try_cast("double"))


def clamp(x: ColumnLike, low: float, high: float) -> Column:
    c = col(x)
    return F.when(c.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c)))


def ratio(a: ColumnLike, b: ColumnLike) -> Column:
    """a/b, NULL on a zero or missing denominator."""
    d = col(b).cast("double")
    return F.when(d != 0, col(a).cast("double") / d)


def pct_change(new: ColumnLike, old: ColumnLike) -> Column:
    return (ratio(new, old) - 1) * 100


def float_ratio(a: ColumnLike, b: ColumnLike) -> Column:
    """a/b by the rules of floating point: infinite over zero, NaN for zero over zero; NULL only for a missing side."""
    n, d = col(a).cast("double"), col(b).cast("double")
    return F.when(d == 0, n * float("inf")).otherwise(F.try_divide(n, d))


def float_change(new: ColumnLike, old: ColumnLike) -> Column:
    return (float_ratio(new, old) - 1) * 100


def flag(test: Column, *needed: Column) -> Column:
    """Tri-state: NULL as soon as one needed input is NULL."""
    known = reduce(lambda a, b: a & b, [c.isNotNull() for c in needed])
    return F.when(known, test)


def one(test: Column) -> Column:
    """1 when true, 0 when false or unknown."""
    return F.when(test, 1).otherwise(0)


def points(*rules: tuple[Column, float]) -> Column:
    """Additive score: each rule adds its points when its test is true."""
    return reduce(
        lambda a, b: a + b,
        [F.when(test, F.lit(float(p))).otherwise(F.lit(0.0)) for test, p in rules],
        F.lit(0.0),
    )


def first_match(*rules: tuple[Column, object], default=None) -> Column:
    """Ordered decision list; the first true test names the result."""
    out = None
    for test, value in rules:
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(test, v) if out is None else out.when(test, v)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def reason_list(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(test, F.lit(text)) for test, text in rules]))


def minutes_between(earlier: ColumnLike, later: ColumnLike) -> Column:
    """Age in minutes; NULL when the earlier instant lies in the future."""
    gap = (F.unix_micros(col(later).cast("timestamp")) - F.unix_micros(col(earlier).cast("timestamp"))) / 60e6
    return F.when(gap >= 0, gap)


def next_bar_start(at: ColumnLike, seconds: int = 300) -> Column:
    """First bar boundary at or after the instant."""
    return F.timestamp_seconds((F.ceil(F.unix_micros(col(at).cast("timestamp")) / (seconds * 1e6)) * seconds).cast("long"))


def side_return(base: ColumnLike, price: ColumnLike, short: Column) -> Column:
    """Short return measured on the exit price (base/price - 1)."""
    return F.when(short, pct_change(base, price)).otherwise(pct_change(price, base))


def float_side_return(base: ColumnLike, price: ColumnLike, short: Column) -> Column:
    """The side's return by the rules of floating point: a price of zero is a price."""
    return F.when(short, float_change(base, price)).otherwise(float_change(price, base))


def negated_return(base: ColumnLike, price: ColumnLike, short: Column) -> Column:
    """Short return as the negated long return."""
    r = pct_change(price, base)
    return F.when(short, -r).otherwise(r)


def weighted_available(parts: dict[str, tuple[Column, float]]) -> Column:
    """Weighted mean over the components that are present, weights renormalised."""
    num = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) * w for c, w in parts.values()])
    den = reduce(
        lambda a, b: a + b,
        [F.when(c.isNotNull(), F.lit(float(w))).otherwise(0.0) for c, w in parts.values()],
    )
    return F.when(den > 0, num / den)


def canonical_symbol(x: ColumnLike, prefix: str = "EX:", suffix: str = ".IS") -> Column:
    """Trimmed upper-case ticker without exchange marks; NULL unless 2-12 of A-Z0-9."""
    s = F.upper(F.trim(col(x)))
    s = F.when(s.startswith(prefix), F.substring(s, len(prefix) + 1, 64)).otherwise(s)
    s = F.regexp_replace(s, suffix.replace(".", r"\.") + "$", "")
    return F.when(s.rlike("^[A-Z0-9]{2,12}$"), s)


def stable_id(prefix: str, *parts: ColumnLike, bits: int = 256) -> Column:
    """Hash identity over the parts in the given order; NULL parts keep their place."""
    text = F.concat_ws("\x1f", *[F.coalesce(col(p).cast("string"), F.lit("\x00")) for p in parts])
    return F.concat(F.lit(prefix), F.sha2(text, bits))


def score_band(x: ColumnLike) -> Column:
    c = col(x)
    low = F.least(F.lit(90), (F.floor(c / 10) * 10).cast("int"))
    high = F.when(low == 90, 100).otherwise(low + 9)
    return (
        F.when(c.isNull() | (c < 0) | (c > 100), None)
        .when(c < 50, F.lit("0-49"))
        .otherwise(F.concat_ws("-", low.cast("string"), high.cast("string")))
    )
