"""Packed keys, sentinels, bits and bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model.units import NONCE_BITS


def nil_to_null(x: Column, nil: int) -> Column:
    """``x`` with its sentinel as null."""
    return F.when(x != nil, x)


def order_index(market: Column, nonce: Column) -> Column:
    """Market and nonce in one integer, the market above."""
    return F.shiftleft(market.cast("long"), NONCE_BITS).bitwiseOR(nonce)


def order_market(index: Column) -> Column:
    """The market of an order index."""
    return F.shiftrightunsigned(index, NONCE_BITS)


def order_nonce(index: Column) -> Column:
    """The nonce of an order index."""
    return index.bitwiseAND(F.lit(2**NONCE_BITS - 1))


def path_bits(index: Column, levels: int) -> Column:
    """The bits of an index from the lowest up, one a tree level."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda i: F.call_function("mod", F.call_function("div", index, F.pow(F.lit(2.0), i).cast("long")), F.lit(2).cast("long")).cast("int"))


def split_base(x: Column, base: int, digits: int) -> Column:
    """The digits of a non-negative integer in a base, the lowest first."""
    return F.transform(F.sequence(F.lit(0), F.lit(digits - 1)), lambda i: F.call_function("mod", F.call_function("div", x, F.pow(F.lit(float(base)), i).cast("long")), F.lit(base).cast("long")))


def le_bytes(x: Column, n: int) -> Column:
    """The bytes of a non-negative integer, the lowest first."""
    return split_base(x, 256, n)


def join_bytes(parts: Column) -> Column:
    """The integer of little-endian bytes (at most 7)."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(1).cast("long").alias("unit"))
    return F.aggregate(parts, start, lambda acc, b: F.struct((acc["sum"] + acc["unit"] * b).alias("sum"), (acc["unit"] * 256).alias("unit")))["sum"]


def rotl32(x: Column, k: int) -> Column:
    """A 32-bit word turned left by ``k`` bits; to the right by 32 - ``k``."""
    return F.shiftleft(x.cast("long"), k).bitwiseAND(F.lit(2**32 - 1)).bitwiseOR(F.shiftrightunsigned(x.cast("long"), 32 - k))


def packed_fields(size: int, *fields: tuple[Column, int]) -> Column:
    """Integers as big-endian hexadecimal fields of so many bytes each, one after another, filled up with zero bytes to ``size``."""
    parts = [F.lpad(F.lower(F.hex(x.cast("long"))), 2 * n, "0") for x, n in fields]
    return F.rpad(F.concat(*parts), 2 * size, "0")
