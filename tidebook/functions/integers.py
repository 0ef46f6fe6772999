"""Integer arithmetic on bigint columns with the rounding each formula asks for.

Spark's ``div`` truncates toward zero and must not be used on decimals, where its bigint result overflows silently.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("long")


def sgn(x: Column) -> Column:
    """-1, 0 or 1 as a bigint (``signum`` gives a double)."""
    return F.when(x > 0, F.lit(1)).when(x < 0, F.lit(-1)).otherwise(F.when(x.isNotNull(), F.lit(0))).cast("long")


def floor_div(a: Column, b: Column | int) -> Column:
    """Quotient rounded down, for a positive divisor."""
    b = _col(b)
    return F.call_function("div", a - F.pmod(a, b), b)


def trunc_div(a: Column, b: Column | int) -> Column:
    """Quotient of the magnitudes with the sign put back (rounded toward zero)."""
    return sgn(a) * F.call_function("div", F.abs(a), _col(b))


def ceil_div(a: Column, b: Column | int) -> Column:
    """Quotient rounded up, for a non-negative dividend and a positive divisor."""
    b = _col(b)
    return F.call_function("div", a + b - 1, b)


def euclid_div(a: Column, b: Column | int) -> Column:
    """Quotient that leaves a remainder of zero or more, for a positive divisor."""
    return floor_div(a, b)


def clamp(x: Column, low: Column | int, high: Column | int) -> Column:
    """``x`` within the bounds."""
    return F.greatest(F.least(x, _col(high)), _col(low))


def median3(a: Column, b: Column, c: Column) -> Column:
    """The middle one of three."""
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))


def in_bits(x: Column, bits: int) -> Column:
    """Whether ``x`` is an unsigned integer of so many bits."""
    return x.between(0, 2**bits - 1)
