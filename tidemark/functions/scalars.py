"""Scalar functions of columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str


def c(x: Col | float | int) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def half_up(x: Col, digits: int = 4) -> Column:
    """Rounding with halves towards +infinity: -2.5 gives -2."""
    return F.floor(c(x) * F.lit(10.0**digits) + 0.5) / F.lit(10.0**digits)


def settled(x: Col, digits: int = 6) -> Column:
    """Rounding for comparison across engines: a tie goes up even if a sum's last bit differs; what isn't finite stays."""
    scaled = c(x) * F.lit(10.0**digits) + 0.5001
    return F.when(F.abs(scaled) < 2.0**53, F.floor(scaled)).otherwise(scaled) / F.lit(10.0**digits)


def quotient(x: Col, y: Col) -> Column:
    """x / y in floating point, where a division by zero is infinite, or NaN for 0 / 0."""
    over_zero = F.when(c(x) > 0, float("inf")).when(c(x) < 0, float("-inf")).when(c(x).isNotNull(), float("nan"))
    return F.when(c(y) == 0, over_zero).otherwise(c(x) / F.nullif(c(y), F.lit(0.0)))


def settled_sql(x: str, digits: int = 6) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5001) / 1e{digits}"


def finite_or_null(x: Col) -> Column:
    """The number in a value or text; null for blanks, text without a number, NaN and infinities."""
    n = F.trim(c(x).cast("string")).try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) != F.lit(float("inf"))), n)


def clamp(x: Col, low: float, high: float) -> Column:
    return F.when(c(x).isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c(x))))


def pct_change(now: Col, before: Col) -> Column:
    """Percent from a positive base, else null."""
    return F.when(c(before) > 0, (c(now) / c(before) - 1) * 100)


def is_date(x: Col) -> Column:
    """Whether a text is a calendar date as YYYY-MM-DD."""
    return F.coalesce(c(x).rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(c(x), F.lit("yyyy-MM-dd")).isNotNull(), F.lit(False))


def number_of(*texts: Col) -> Column:
    """The first of the texts that holds a number, with thousands separators or without."""
    return F.coalesce(*[finite_or_null(F.regexp_replace(c(t).cast("string"), ",", "")) for t in texts])


def sigmoid(x: Col) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c(x)))


def logit(p: Col, edge: float = 1e-6) -> Column:
    q = clamp(p, edge, 1 - edge)
    return F.log(q / (1 - q))


def compact_number(x: Col) -> Column:
    """1234567 as 1.23M: K, M, B and T with two digits, small numbers with up to four."""
    n = c(x)
    steps = [(1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K")]
    out = F.format_string("%.2f", n)
    for size, unit in reversed(steps):
        out = F.when(F.abs(n) >= size, F.format_string(f"%.2f{unit}", n / size)).otherwise(out)
    return F.when(n.isNull(), F.lit("n/a")).otherwise(out)


def microprice(bid: Col, bid_volume: Col, ask: Col, ask_volume: Col) -> Column:
    """The midpoint pulled to the side with less volume."""
    total = c(bid_volume) + c(ask_volume)
    return F.when(total > 0, (c(ask) * c(bid_volume) + c(bid) * c(ask_volume)) / total)


def imbalance(bids: Col, asks: Col, levels: int) -> Column:
    """(bid - ask) / (bid + ask) over the first levels of two arrays of volumes."""
    add = lambda a: F.aggregate(F.slice(c(a), 1, levels), F.lit(0.0), lambda s, v: s + v.cast("double"))
    total = add(bids) + add(asks)
    return F.when(total > 0, (add(bids) - add(asks)) / total)


def age_ms(now: Col, then: Col) -> Column:
    """Milliseconds between two timestamps, not below 0."""
    micros = F.unix_micros(c(now).cast("timestamp")) - F.unix_micros(c(then).cast("timestamp"))
    return F.greatest(F.lit(0.0), micros / 1000.0)


def content_hash(*columns: Col) -> Column:
    """sha256 of the columns as JSON, by name order."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def joined_hash(separator: str, *columns: Col) -> Column:
    return F.sha2(F.concat_ws(separator, *[c(x).cast("string") for x in columns]), 256)


def reasons(*pairs: tuple[str, Column]) -> Column:
    """Names of the conditions that hold, in order."""
    return F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in pairs]), lambda x: x.isNotNull())


def first_reason(*pairs: tuple[str, Column]) -> Column:
    return F.coalesce(*[F.when(cond, F.lit(name)) for name, cond in pairs])


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)
