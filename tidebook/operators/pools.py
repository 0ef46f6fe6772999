"""Pools and staking: share values, redeemable shares, operator fees, cooldowns and minting limits.

Wide quotients are exact (Arrow batches of Python integers); all are rounded toward zero.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.wide import mul_div, quotient
from ..model.units import EMPTY_VALUE, SHARE_TICK, USDC_TICK
from .folds import ordered_fold

WIDE = "decimal(38,0)"
PRINCIPAL_UNIT = 100  # principals are in hundredths of the precision that staked values have (fixed value)
STAKE_FACTOR = 10  # a holder's principal in a pool is bound by this many times the staked value


def staking_value(shares: Column, balance: Column, total: Column, unit: int = 1) -> Column:
    """shares x balance div (total x unit); null in an empty pool."""
    return mul_div(shares, balance, (total.cast(WIDE) * unit).cast(WIDE))


def redeemable(available: Column, total: Column, value: Column) -> Column:
    """Shares that an amount buys back: available x total div |value|; null without value."""
    return mul_div(available, total, F.abs(value))


def operator_fee(shares_value: Column, principal: Column, rate: Column, total: Column, tav: Column) -> Column:
    """The operator's part of a holder's profit, in shares: profit x rate x total div (1e6 x value), 0 without profit.

    ``tav`` is the pool's account value in quote units, ``rate`` in 1e-6.
    """
    profit = F.greatest(shares_value - principal, F.lit(0)).cast(WIDE)
    return F.coalesce(mul_div((profit * rate).cast(WIDE), total, (F.abs(tav).cast(WIDE) * USDC_TICK).cast(WIDE)), F.lit(0).cast(WIDE))


def holds_least(operator: Column, total: Column, min_rate: Column) -> Column:
    """Whether the operator holds at least the pool's least share (in 1e-4)."""
    return operator * SHARE_TICK >= total * min_rate


def cooled_down(now: Column, entered: Column, cooldown: int, exempt: Column) -> Column:
    """Whether a holder may redeem: the operator at once, others after the cooldown."""
    return exempt | (now >= entered + cooldown)


def may_mint(principal: Column, added: Column, staked_value: Column) -> Column:
    """Whether the principal after a deposit, in units of ``PRINCIPAL_UNIT`` of the staked value's, stays within ``STAKE_FACTOR`` times that value."""
    return (principal + added) * PRINCIPAL_UNIT <= staked_value * STAKE_FACTOR


def redemptions(holdings: DataFrame, now: int, cooldown: int, main_pool: int) -> DataFrame:
    """Every holder's value, fee and right to redeem, for which only the main pool's holders wait; ``(pool, holder, shares, principal, entered, total, tav, rate, is_operator)``."""
    value = quotient(holdings, F.col("shares"), F.abs("tav"), F.col("total"))
    rows = holdings.withColumn("value", value)
    fee = operator_fee(F.col("value"), F.col("principal"), F.col("rate"), F.col("total"), F.col("tav"))
    free = cooled_down(F.lit(now).cast("long"), F.col("entered"), cooldown, F.col("is_operator") | (F.col("pool") != main_pool))
    return rows.select("pool", "holder", "value", F.when(F.col("is_operator"), F.lit(0).cast(WIDE)).otherwise(fee).alias("fee"), free.alias("free"))


def share_lookup(holders: DataFrame, shares: DataFrame) -> DataFrame:
    """Each of ``holders`` ``(account, pool)`` with its ``shares`` ``(account, pool, shares)`` in that pool, summed, 0 where it has none."""
    held = shares.groupBy("account", "pool").agg(F.sum("shares").alias("shares"))
    return holders.join(held, ["account", "pool"], "left").fillna(0, ["shares"])


def merged_shares(shares: DataFrame, changes: DataFrame) -> DataFrame:
    """Share lists after changes ``(account, pool, shares)``: upserted by account and pool, empty ones dropped."""
    both = shares.select("account", "pool", "shares").unionByName(changes.select("account", "pool", "shares"))
    return both.groupBy("account", "pool").agg(F.sum("shares").alias("shares")).where("shares <> 0")


def pool_ledger(log: DataFrame) -> DataFrame:
    """Mints and burns of shares in order, with the pool's totals after each; ``(pool, seq, holder, kind, amount)``, ``kind`` being ``mint`` (of a value) or ``burn`` (of shares).

    A mint gives amount x shares div value of the pool (``EMPTY_VALUE`` a share in an empty one), a burn pays shares x value div total; both round down, so holders
    who stay never lose. A row that would give or pay nothing, or burns more than there is, is refused and changes nothing. Each pool's rows stream through one task with
    two numbers of state.
    """

    def step(state, row):
        total, value = state
        amount, got = row.amount, 0
        if amount > 0 and row.kind == "mint":
            got = amount // EMPTY_VALUE if not total or not value else amount * total // value
            total, value = (total + got, value + amount) if got else state
        elif 0 < amount <= total and row.kind == "burn":
            got = amount * value // total
            total, value = (total - amount, value - got) if got else state
        return (total, value), [(row.pool, row.seq, row.holder, row.kind, got > 0, Decimal(got), Decimal(total), Decimal(value))]

    schema = f"pool long, seq long, holder long, kind string, taken boolean, got {WIDE}, total {WIDE}, value {WIDE}"
    return ordered_fold(log.select("pool", "seq", "holder", "kind", "amount"), ["pool"], ["seq"], lambda k: (0, 0), step, lambda k, s: [], schema)
