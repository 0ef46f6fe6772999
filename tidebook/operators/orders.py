"""Order flags, counters, families and funding settlements."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import euclid_div, sgn
from ..model.units import COLLATERAL_SCALE
from .folds import ordered_fold


def reduces(position: Column, is_ask: Column) -> Column:
    """Whether an order of this side makes the position smaller: asks against longs, bids against shorts."""
    return F.when(is_ask == 1, position > 0).otherwise(position < 0)


def triggered(mark: Column, trigger: Column, is_ask: Column, is_stop: Column) -> Column:
    """Whether the mark has reached an order's trigger: stops of sellers and profits of buyers from above, the others from below; no trigger is always reached."""
    falling = (is_ask == 1) == is_stop
    return (trigger == 0) | F.when(falling, mark <= trigger).otherwise(mark >= trigger)


def switched_off(cancel_all_at: Column, now: Column) -> Column:
    """Whether an account's scheduled cancel-all is due (0: none)."""
    return (cancel_all_at != 0) & (cancel_all_at <= now)


def counters(events: DataFrame) -> DataFrame:
    """Open orders by account and market from opening (+1) and closing (-1) events ``(account, market, change, tied)``, and those tied to a position."""
    tied = F.when(F.col("tied"), F.col("change")).otherwise(F.lit(0).cast("long"))
    return events.groupBy("account", "market").agg(F.sum("change").alias("open_orders"), F.sum(tied).alias("tied_orders"))


def families(orders: DataFrame) -> DataFrame:
    """Each child order with its parent: ``(order_id, parent_id, base)`` joined with itself, roots left out; ``larger`` if the child exceeds its parent."""
    parents = orders.select(F.col("order_id").alias("parent_id"), F.col("base").alias("parent_base"))
    return orders.join(parents, "parent_id").select("order_id", "parent_id", "base", "parent_base", (F.col("base") > F.col("parent_base")).alias("larger"))


def last_match(items: Column, key: str, value: Column) -> Column:
    """The last struct of an array whose field equals the value, or null."""
    return F.try_element_at(F.filter(items, lambda x: x[key] == value), F.lit(-1))


def settlements(positions: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Funding that positions owe since they last settled, by account: p x (own prefix - market prefix), joined by market.

    ``positions`` has ``(account, market, position, last_prefix)``, ``prefixes`` the markets' ``(market, prefix)``.
    """
    owed = F.col("position") * (F.col("last_prefix") - F.col("prefix"))
    return positions.join(prefixes, "market").groupBy("account").agg(F.sum(owed).alias("funding"))


def position_usdc(allocated: Column, position: Column, entry_quote: Column) -> Column:
    """Quote units in a position: allocated margin in whole quote units (rounded down) less the signed entry quote."""
    return euclid_div(allocated, COLLATERAL_SCALE) - sgn(position) * entry_quote


def hash_chain(log: DataFrame, key: str = "market") -> DataFrame:
    """A SHA-256 chain over each key's rows ``(key, seq, value)`` in order: h' = sha256(h || '|' || seq || '|' || value), in hex, from the empty text.

    A stand-in to compare logs with; it is compatible with no other chain.
    """

    def step(state, row):
        return (hashlib.sha256(f"{state[0]}|{row.seq}|{row.value}".encode()).hexdigest(), state[1] + 1), []

    return ordered_fold(log.select(key, "seq", "value"), [key], ["seq"], lambda k: ("", 0), step, lambda k, s: [(k[0], s[0], s[1])], f"{key} long, digest string, n long")
