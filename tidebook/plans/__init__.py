"""The queries over the analytical tables, and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import books, codecs, handlers, ledgers, positions, scalars, settlement, streams


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query by name."""
    return positions.QUERIES | books.QUERIES | ledgers.QUERIES | handlers.QUERIES | scalars.QUERIES | settlement.QUERIES | codecs.QUERIES | streams.QUERIES


def oracle_sql() -> dict[str, str]:
    """SQL for those that it can express."""
    return positions.SQL | books.SQL | ledgers.SQL | handlers.SQL | scalars.SQL | settlement.SQL | codecs.SQL | streams.SQL
