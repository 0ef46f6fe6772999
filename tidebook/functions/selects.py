"""Choices between arrays and records, and signed arithmetic of 38 digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"


def select(flag: Column, a: Column, b: Column) -> Column:
    """``a`` where the flag holds, else ``b`` (also where it is null): scalars, arrays of one length, or records."""
    return F.when(F.coalesce(flag, F.lit(False)), a).otherwise(b)


def select_fields(flag: Column, a: dict[str, Column], b: dict[str, Column]) -> Column:
    """The record of ``a``'s fields where the flag holds, else of ``b``'s; both must have the same fields."""
    if set(a) != set(b):
        raise ValueError(f"fields differ: {sorted(set(a) ^ set(b))}")
    return select(flag, F.struct(*(a[k].alias(k) for k in a)), F.struct(*(b[k].alias(k) for k in a)))


def wide(x: Column) -> Column:
    """As a signed integer of 38 digits."""
    return x.cast(WIDE)


def abs_diff(a: Column, b: Column) -> Column:
    """|a - b|."""
    return wide(F.abs(wide(a) - wide(b)))


def abs_sum(a: Column, b: Column) -> Column:
    """|a| + |b|."""
    return wide(F.abs(wide(a)) + F.abs(wide(b)))


def negated(a: Column) -> Column:
    """-a."""
    return wide(-wide(a))


def compared(a: Column, b: Column) -> Column:
    """-1, 0 or 1."""
    return F.signum(wide(a) - wide(b)).cast("int")


def try_subtract(a: Column, b: Column) -> tuple[Column, Column]:
    """|a| - b of magnitudes, 0 where that is negative; and whether it is."""
    borrow = F.abs(wide(a)) < wide(b)
    return wide(F.when(~borrow, F.abs(wide(a)) - wide(b)).otherwise(0)), borrow


def mul_add(a: Column, x: Column, b: Column) -> Column:
    """a x + b."""
    return wide(wide(a) * x + wide(b))


def fits(a: Column, bits: int) -> Column:
    """Whether the magnitude has at most so many bits."""
    return F.abs(wide(a)) < F.lit(2**bits).cast(WIDE) if bits < 63 else F.abs(wide(a)) < F.lit(str(2**bits)).cast(WIDE)
