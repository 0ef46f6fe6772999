"""Wide unsigned integers as 32 bytes, the highest first.

Spark orders binary values by unsigned bytes, so ``=``, ``<``, ``min`` and ``max`` work on these as they are. Sums go by 32-bit limbs with a carry, in
built-in functions. A result that does not fit is null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BYTES, LIMBS = 32, 8


def from_hex(text: Column) -> Column:
    """From hexadecimal text of any case with or without ``0x``; null if it has other letters, none, or over 256 bits."""
    digits = F.regexp_replace(F.lower(text), "^0x", "")
    digits = F.when(digits.rlike("^[0-9a-f]+$"), F.regexp_replace(digits, "^0+(?=.)", ""))
    return F.when(F.length(digits) <= 2 * BYTES, F.unhex(F.lpad(digits, 2 * BYTES, "0")))


def from_long(x: Column) -> Column:
    """From a bigint of 0 or more; null below."""
    return F.when(x >= 0, F.unhex(F.lpad(F.hex(x), 2 * BYTES, "0")))


def to_hex(x: Column) -> Column:
    """As hexadecimal text without leading zeros."""
    return F.regexp_replace(F.lower(F.hex(x)), "^0+(?=.)", "")


def limbs(x: Column) -> Column:
    """The eight 32-bit limbs, the lowest first."""
    return F.array(*(F.conv(F.hex(F.substring(x, 4 * i + 1, 4)), 16, 10).cast("long") for i in range(LIMBS - 1, -1, -1)))


def _carried(parts: Column, total: Callable[[Column, Column], Column]) -> Column:
    """A struct of the limbs, lowest first, and the carry beyond them; ``total`` gives a limb from an element of ``parts`` and the carry from below."""
    start = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, part: Column) -> Column:
        t = total(part, acc["carry"])
        return F.struct(F.shiftright(t, 32).alias("carry"), F.concat(acc["out"], F.array(t.bitwiseAND(F.lit(2**32 - 1)))).alias("out"))

    return F.aggregate(parts, start, step, lambda acc: F.struct(acc["carry"].alias("carry"), F.unhex(F.array_join(F.reverse(F.transform(acc["out"], lambda v: F.lpad(F.hex(v), 8, "0"))), "")).alias("x")))


def _pairs(a: Column, b: Column) -> Column:
    return F.zip_with(limbs(a), limbs(b), lambda x, y: F.struct(x.alias("a"), y.alias("b")))


def add(a: Column, b: Column) -> Column:
    """a + b; null if it takes over 256 bits."""
    done = _carried(_pairs(a, b), lambda p, carry: p["a"] + p["b"] + carry)
    return F.when(done["carry"] == 0, done["x"])


def subtract(a: Column, b: Column) -> Column:
    """a - b; null if b is greater."""
    return F.when(b <= a, _carried(_pairs(a, b), lambda p, carry: p["a"] - p["b"] + carry)["x"])


def times(a: Column, x: int) -> Column:
    """a times a constant from 0 to 2^30; null if it takes over 256 bits."""
    done = _carried(limbs(a), lambda v, carry: v * x + carry)
    return F.when(done["carry"] == 0, done["x"])
