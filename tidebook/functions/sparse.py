"""Sparse lists: JSON maps from index to value, and arrays of fixed length in which a neutral value fills the gaps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lists of state documents: their length and the value that stands for nothing (fixed values).
POSITIONS, ASSETS, SHARES, STRATEGIES = 255, 64, 16, 8


def parsed(text: Column, value: str) -> Column:
    """A map from JSON text, or null where the text is no JSON object of such values; empty and null text are empty maps."""
    kind = T.MapType(T.StringType(), T._parse_datatype_string(value))
    empty = F.create_map().cast(kind)
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", empty).otherwise(F.from_json(text, kind))


def fault(text: Column, value: str, size: int) -> Column:
    """Why a sparse list cannot be read: ``json``, ``key`` (no plain whole number from 0 to size - 1), ``twice`` (one index again) or ``value`` (null); null: it can."""
    m = parsed(text, value)
    keys = F.map_keys(m)
    index = F.transform(keys, lambda k: k.try_cast("int"))
    good = F.forall(index, lambda i: i.isNotNull() & (i >= 0) & (i < size))
    plain = F.forall(keys, lambda k: k.rlike("^(0|[1-9][0-9]*)$"))
    return F.when(m.isNull(), "json").when(~plain | ~good, "key").when(F.size(F.array_distinct(index)) < F.size(index), "twice").when(F.exists(F.map_values(m), lambda v: v.isNull()), "value")


def dense(m: Column, size: int, neutral: Column) -> Column:
    """The array of ``size`` values of a map with whole-number keys as text; ``neutral`` where it has none."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at(m, i.cast("string")), neutral))


def sparse(values: Column, neutral: Column) -> Column:
    """The map of an array's values that are not ``neutral``, by index as text, in order."""
    entries = F.filter(F.transform(values, lambda v, i: F.struct(i.cast("string").alias("key"), v.alias("value"))), lambda e: ~e["value"].eqNullSafe(neutral))
    return F.map_from_entries(entries)
