"""Ordered folds: state that depends on the order of a key's rows.

Rows are dealt out by key, sorted, and streamed through each task with the state of one key at a time, so a key with
very many rows needs time but no memory beyond that state. Arithmetic is in Python integers, exact at any width.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from .positions import parties

BATCH = 10_000


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable, step: Callable, finish: Callable, schema: str) -> DataFrame:
    """Fold the rows of each key in order.

    ``start(key)`` makes a state, ``step(state, row)`` returns ``(state, rows out)`` for each row as a named tuple, ``finish(key, state)`` the
    rows at the key's end; rows out are tuples of the schema.
    """
    spark = df.sparkSession
    fields = spark.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)
    names, places = df.columns, [df.columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out, make = None, None, [], namedtuple("Row", names)._make

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

        for b in batches:
            for row in map(make, zip(*(c.to_pylist() for c in b.columns))):
                k = tuple([row[i] for i in places])
                if k != key:
                    if key is not None:
                        out += finish(key, state)
                    key, state = k, start(k)
                state, more = step(state, row)
                out += more
                if len(out) >= BATCH:
                    yield batch()
                    out = []
        if key is not None:
            out += finish(key, state)
        if out:
            yield batch()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def sign(x: int) -> int:
    """-1, 0 or 1."""
    return (x > 0) - (x < 0)


def change_position(p: int, e: int, d: int, q: int) -> tuple[int, int, int]:
    """Position, entry quote and realised profit after a trade of ``d`` signed lots for the quote ``q``.

    A new or turned position enters at the trade's price per lot rounded down; a grown one adds the quote; a reduced one keeps its share of
    the entry quote, rounded down.
    """
    if d == 0:
        return p, e, 0
    new = p + d
    if sign(p) != sign(new):
        entry = (abs(q) // abs(d)) * abs(new) if q > 0 else 0
    elif sign(d) == sign(p):
        entry = e + max(q, 0)
    else:
        entry = e * abs(new) // abs(p)
    return new, entry, sign(new) * entry - (sign(p) * e + sign(d) * q)


def entry_quotes(fills: DataFrame) -> DataFrame:
    """Final position, entry quote and realised profit of each party (takers and makers) and market, folded in fill order, those of one time, order and line by lots and quote."""

    def step(state, row):
        p, e, r = state
        p, e, more = change_position(p, e, row.d, row.quote)
        return (p, e, r + more), []

    return ordered_fold(parties(fills), ["account", "market"], ["ts", "ok", "ln", "d", "quote"], lambda k: (0, 0, 0), step, lambda k, s: [(*k, s[0], Decimal(s[1]), Decimal(s[2]))], "account long, market long, position long, entry_quote decimal(38,0), realised decimal(38,0)")
