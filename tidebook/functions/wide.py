"""Exact arithmetic beyond 38 digits: Arrow-batched functions on Python integers.

Inputs are decimals or bigints, results are ``decimal(38, 0)``; a null input, or a result beyond 38 digits, gives null.
"""

from __future__ import annotations

from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MOST = 10**38


def _out(x: int | None) -> Decimal | None:
    return None if x is None or abs(x) >= _MOST else Decimal(x)


def _rows(*cols: pd.Series):
    for values in zip(*cols):
        yield None if any(v is None or v != v for v in values) else [int(v) for v in values]


@F.pandas_udf(T.DecimalType(38, 0))
def mul_div(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    """a x b / c rounded toward zero; null where c is 0."""

    def one(r):
        if r is None or r[2] == 0:
            return None
        n, d = r[0] * r[1], r[2]
        q = abs(n) // abs(d)
        return _out(q if (n < 0) == (d < 0) else -q)

    return pd.Series([one(r) for r in _rows(a, b, c)], dtype=object)


def mul_div_longs(a: Column, b: Column, c: Column) -> Column:
    """a x b / c of bigints (c: up to 28 digits), rounded toward zero, in built-in functions: the product of two fits 38 digits, and less its remainder it divides exactly. Null where c is 0 or the result has over 32 digits."""
    short = lambda x: x.cast("decimal(19,0)")
    product, d = (short(a) * short(b)).cast("decimal(38,0)"), F.nullif(c.cast("decimal(28,0)"), F.lit(0).cast("decimal(28,0)"))
    return F.try_divide((product - product % d).cast("decimal(38,0)"), d).cast("decimal(38,0)")


def quotient(df: DataFrame, a: Column, b: Column, c: Column) -> Column:
    """a x b / c over the rows of ``df``, rounded toward zero: in built-in functions if a and b are integers by their types, else in Arrow batches."""
    whole = all(isinstance(f.dataType, T.IntegralType) for f in df.select(a.alias("a"), b.alias("b")).schema.fields)
    return (mul_div_longs if whole else mul_div)(a, b, c)


@F.pandas_udf(T.BooleanType())
def product_at_most(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Whether a x b <= c x d."""
    return pd.Series([None if r is None else r[0] * r[1] <= r[2] * r[3] for r in _rows(a, b, c, d)], dtype=object)


@F.pandas_udf(T.DecimalType(38, 0))
def zero_price(mark: pd.Series, mm: pd.Series, tav: pd.Series, side: pd.Series, fraction: pd.Series) -> pd.Series:
    """The price at which closing keeps the ratio of account value to maintenance margin.

    (mark x MM x 1e4 - TAV x side x mark x fraction) / (MM x 1e4), rounded up for longs and down for shorts, from 1 to 2^32 - 1.
    """

    def one(r):
        if r is None or r[1] == 0:
            return None
        m, req, value, s, f = r
        n, d = m * req * 10_000 - value * s * m * f, req * 10_000
        q = -(-n // d) if s > 0 else n // d
        return _out(min(max(q, 1), 2**32 - 1))

    return pd.Series([one(r) for r in _rows(mark, mm, tav, side, fraction)], dtype=object)


@F.pandas_udf(T.DecimalType(38, 0))
def zero_quote(notional: pd.Series, mm: pd.Series, tav: pd.Series, side: pd.Series, fraction: pd.Series) -> pd.Series:
    """The quote at which a closed part of that notional keeps the ratio.

    (N x MM x 1e4 - N x fraction x TAV x side) / (MM x 1e4); the magnitude is rounded up where the
    dividend's sign is the position's side, else down.
    """

    def one(r):
        if r is None or r[1] == 0:
            return None
        n, req, value, s, f = r
        top, d = n * req * 10_000 - n * f * value * s, req * 10_000
        sign = (top > 0) - (top < 0)
        q = -(-abs(top) // d) if sign == s else abs(top) // d
        return _out(sign * q)

    return pd.Series([one(r) for r in _rows(notional, mm, tav, side, fraction)], dtype=object)


def isolated_change(p: int, new: int, allocated: int, value: int, new_value: int, requirement: int, increase: int, profit: int) -> int:
    """Margin that moves into an isolated position whose size goes from ``p`` to ``new`` (negative: out of it).

    ``value`` and ``new_value`` are allocated margin plus unrealised profit before and after; ``requirement`` is the new position's,
    ``increase`` that of the added part, ``profit`` the trade's profit less its fee. A closed position gives its margin back;
    a turned one is filled up to its requirement; a grown one gets what profit leaves of the increase; a reduced
    one gives what exceeds its share of the old value (rounded up) and its requirement, at most what it has.
    """
    if new == 0:
        return -max(allocated, 0)
    if (p > 0) != (new > 0) and p != 0:
        return requirement - new_value
    if abs(new) >= abs(p):
        return max(increase - profit, 0)
    share = -(-value * abs(new) // abs(p))
    return -min(max(new_value - max(share, requirement), 0), max(allocated, 0))


@F.pandas_udf(T.DecimalType(38, 0))
def isolated_margin_change(p: pd.Series, new: pd.Series, allocated: pd.Series, value: pd.Series, new_value: pd.Series, requirement: pd.Series, increase: pd.Series, profit: pd.Series) -> pd.Series:
    """``isolated_change`` of each row."""
    return pd.Series([None if r is None else _out(isolated_change(*r)) for r in _rows(p, new, allocated, value, new_value, requirement, increase, profit)], dtype=object)
