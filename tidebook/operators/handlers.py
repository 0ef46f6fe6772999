"""Transactions as changes of state: last values, signed movements and the rules of their kinds, as columns over the ordered log.

The log has ``(seq, ts, tx_type, account, ...)`` and the fields that the kinds carry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.wide import mul_div_longs
from ..model.units import COLLATERAL_SCALE, EMPTY_VALUE, MASTER, MAX_TRANSFER, SIMPLE, SUB, TX_TYPES, UNIFIED
from .debits import written
from .ledger import delta_encoded, last_fields, last_values

WIDE = "decimal(38,0)"


def of(log: DataFrame, *kinds: str) -> DataFrame:
    """The rows of some kinds."""
    return log.where(F.col("tx_type").isin(*(TX_TYPES[k] for k in kinds)))


def movements(rows: DataFrame, *moves: tuple[Column, Column, Column]) -> DataFrame:
    """Signed rows ``(account, place, amount)`` summed by account and place, without zeros."""
    out = F.array(*(F.struct(a.alias("account"), p.alias("place"), x.cast(WIDE).alias("amount")) for a, p, x in moves))
    return rows.select(F.inline(out)).groupBy("account", "place").agg(F.sum("amount").cast(WIDE).alias("amount")).where("amount <> 0")


def api_keys(log: DataFrame) -> DataFrame:
    """The key of each account and slot after all changes, from both layers."""
    return last_values(of(log, "l1_change_pubkey", "l2_change_pubkey"), ["account", "slot"], ["seq"], ["value", "tx_type"])


def market_settings(log: DataFrame) -> DataFrame:
    """Markets that were created, with the last value of what creations, updates and strategy settings gave."""
    rows = of(log, "l1_create_market", "l1_update_market", "l2_update_market_config")
    strategy = F.col("tx_type") == TX_TYPES["l2_update_market_config"]
    rows = rows.withColumns({"created": F.when(F.col("tx_type") == TX_TYPES["l1_create_market"], F.col("seq")), "strategy": F.when(strategy, F.col("strategy")), "fraction": F.when(~strategy, F.col("value"))})
    return last_fields(rows, ["market"], "seq", ["created", "strategy", "fraction"]).where("created IS NOT NULL")


def asset_settings(log: DataFrame) -> DataFrame:
    """Assets by the last registration or update; updates before an asset's registration change nothing."""
    rows = of(log, "l1_register_asset", "l1_update_asset")
    first = F.min(F.when(F.col("tx_type") == TX_TYPES["l1_register_asset"], F.col("seq"))).over(W.partitionBy("slot"))
    return last_values(rows.withColumn("first", first).where("seq >= first"), ["slot"], ["seq"], ["value", "seq"])


def system_settings(log: DataFrame) -> DataFrame:
    """The one row of system configuration, by the last value of each field ``(cooldown, pool)`` that a row sets (others: null)."""
    return last_fields(of(log, "l1_set_system_config"), [], "seq", ["cooldown", "pool"])


def sub_accounts(log: DataFrame) -> DataFrame:
    """New sub accounts of each master: their number, and the first and last of their indices."""
    return of(log, "l2_create_sub_account").groupBy("account").agg(F.count("*").alias("n"), F.min("index").alias("first_index"), F.max("index").alias("last_index"))


def pool_fees(log: DataFrame) -> DataFrame:
    """Changes of operator fees, and whether each is taken: a fee can only fall, so it must not exceed the least of all before it; the first row sets it."""
    w = W.partitionBy("slot").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    rows = of(log, "l2_create_public_pool", "l2_update_public_pool", "l2_create_staking_pool").withColumn("fee_before", F.min("value").over(w))
    return rows.select("slot", "seq", "value", F.coalesce(F.col("value") <= F.col("fee_before"), F.lit(True)).alias("taken"))


def leverages(log: DataFrame) -> DataFrame:
    """The last margin fraction of each account and market among those that keep the market's ``least``."""
    return last_values(of(log, "l2_update_leverage").where("value >= least"), ["account", "market"], ["seq"], ["value"])


def margin_moves(log: DataFrame) -> DataFrame:
    """Collateral moved between an account (place -1) and its isolated positions (their market), of rows with ``(direction, position, isolated, market_status, cross_available, isolated_available)``.

    ``direction`` 1 adds margin, 0 takes it back. A row moves its value in collateral units if the market is active, the position isolated and not empty, the value from 1 to 2^60 - 1, and
    what it takes from has as much available: the account for added margin, the position for margin taken back. Nulls in these refuse a row.
    """
    adds, amount = F.col("direction") == 1, F.col("value").cast(WIDE) * COLLATERAL_SCALE
    enough = amount <= F.when(adds, F.col("cross_available")).otherwise(F.col("isolated_available"))
    rows = of(log, "l2_update_margin").where(F.col("direction").isin(0, 1) & (F.col("market_status") == 1) & F.col("isolated") & (F.col("position") != 0) & F.col("value").between(1, MAX_TRANSFER) & enough)
    signed = F.when(adds, amount).otherwise(-amount)
    return movements(rows, (F.col("account"), F.lit(-1).cast("long"), -signed), (F.col("account"), F.col("market"), signed))


def _worth() -> Column:
    """What a row's shares are worth in its pool of ``pool_total`` shares and the value ``pool_value``, rounded down; an empty pool has a fixed price."""
    return F.when(F.col("pool_total") == 0, F.col("value").cast(WIDE) * EMPTY_VALUE).otherwise(mul_div_longs(F.col("value"), F.col("pool_value"), F.col("pool_total")))


def stakes(log: DataFrame) -> DataFrame:
    """Shares and their worth that accounts staked, less what they unstaked, at the state of the pool that each row carries; ``staking.staking`` moves that state itself."""
    sign = F.when(F.col("tx_type") == TX_TYPES["l2_stake_assets"], 1).otherwise(-1)
    rows = of(log, "l2_stake_assets", "l2_unstake_assets").where("value > 0")
    return rows.groupBy("account").agg(F.sum(sign * F.col("value")).cast(WIDE).alias("shares"), F.sum(sign * _worth()).cast(WIDE).alias("staked"))


def minted(log: DataFrame) -> DataFrame:
    """Shares minted less those burnt, by account and pool (place: the pool), and the money for them (place -1), at the state of the pool that each row carries."""
    rows = of(log, "l2_mint_shares", "l2_burn_shares", "l1_burn_shares", "l2_force_burn_shares").where("value > 0")
    sign = F.when(F.col("tx_type") == TX_TYPES["l2_mint_shares"], 1).otherwise(-1)
    return movements(rows, (F.col("account"), F.col("slot"), sign * F.col("value")), (F.col("account"), F.lit(-1).cast("long"), -sign * _worth()))


def account_modes(changes: DataFrame) -> DataFrame:
    """Requests for an asset mode, whether each is taken, the mode after it and what it moves into collateral; ``(account, seq, mode, account_type, balance, locked, tav, im, funded)``.

    Accounts start simple. Only masters and sub accounts may ask, and for the other mode only. To unified: the asset's balance moves into collateral. To simple: taken only
    if nothing is locked, the account value covers the initial requirement, and the funded collateral is not negative; nothing moves. A refused request leaves the mode, so the mode
    before a row is that of the last one that could not be refused for its state: no row waits for another's outcome.
    """
    may = F.col("account_type").isin(MASTER, SUB)
    ok = may & ((F.col("mode") == UNIFIED) | ((F.col("locked") == 0) & (F.col("tav") >= F.col("im")) & (F.col("funded") >= 0)))
    w = W.partitionBy("account").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    rows = changes.withColumn("sure", F.when(ok, F.col("mode"))).withColumn("before", F.coalesce(F.last("sure", True).over(w), F.lit(SIMPLE)))
    taken = F.col("sure").isNotNull() & (F.col("before") != F.col("mode"))
    after = F.when(taken, F.col("mode")).otherwise(F.col("before"))
    moved = F.when(taken & (F.col("mode") == UNIFIED), F.col("balance")).otherwise(F.lit(0).cast("long"))
    return rows.select("account", "seq", taken.alias("taken"), after.cast("long").alias("mode"), moved.alias("to_collateral"))


def strategy_moves(log: DataFrame) -> DataFrame:
    """Amounts moved between a fund's strategies ``from_strategy`` and ``to_strategy``, two different ones, up to the row's ``limit``."""
    rows = of(log, "l2_strategy_transfer").where("value BETWEEN 1 AND limit AND from_strategy <> to_strategy")
    return movements(rows, (F.col("account"), F.col("from_strategy"), -F.col("value")), (F.col("account"), F.col("to_strategy"), F.col("value")))


def stamps(blocks: DataFrame) -> DataFrame:
    """What each block of a market does, in order (funding, oracle, premium), and the times of the last of each after it.

    Funding falls into a market's first block of an hour and a premium into its first of a minute, so the stamps are the first times of the block's hour and minute.
    """
    hour, minute = F.call_function("div", F.col("ts"), F.lit(3_600_000).cast("long")), F.call_function("div", F.col("ts"), F.lit(60_000).cast("long"))
    first = lambda w: F.first(F.struct("ts", "seq")).over(w.orderBy("ts", "seq"))
    rows = blocks.withColumns({"h": hour, "m": minute})
    rows = rows.withColumns({"f": first(W.partitionBy("market", "h")), "p": first(W.partitionBy("market", "m"))})
    return rows.select("market", "seq", (F.col("f.seq") == F.col("seq")).alias("funding"), (F.col("p.seq") == F.col("seq")).alias("premium"), F.col("f.ts").alias("last_funding"), F.col("ts").alias("last_oracle"), F.col("p.ts").alias("last_premium"))


def due_timers(timers: DataFrame, now: int) -> DataFrame:
    """Timers ``(kind, account, at)`` that are due (0: none), by kind: number, earliest and accounts."""
    return timers.where((F.col("at") != 0) & (F.col("at") <= now)).groupBy("kind").agg(F.count("*").alias("n"), F.min("at").alias("earliest"), F.countDistinct("account").alias("accounts"))


def merged_batches(batches: DataFrame) -> DataFrame:
    """Neighbouring batches ``(batch, first_block, last_block, first_ts, last_ts, old_root, new_root)`` and what keeps each from being merged with the one after it."""
    after = batches.select((F.col("batch") - 1).alias("batch"), F.col("first_block").alias("next_block"), F.col("first_ts").alias("next_ts"), F.col("old_root").alias("next_root"))
    fault = F.when(F.col("next_block") != F.col("last_block") + 1, "height").when(F.col("next_ts") < F.col("last_ts"), "time").when(F.col("next_root") != F.col("new_root"), "root").otherwise("none")
    return batches.join(after, "batch").select("batch", "last_block", "next_block", fault.alias("fault"))


def delta_sequence(changes: DataFrame, group: int) -> DataFrame:
    """Published changes ``(account, market, delta)``: for each account its index as the difference from the account before, the number of its entries, then the entries by market.

    The entries are worked out once and written: the steps between accounts are found over the numbers alone, in several passes.
    """
    rows = changes.groupBy("account").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("market", "delta"))).alias("entries"))
    text = F.array_join(F.transform("entries", lambda e: F.concat_ws(":", e["market"], e["delta"])), " ")
    rows = written(rows.select("account", "n", text.alias("entries")), "entries")
    steps = delta_encoded(rows.select("account"), group)
    return rows.join(steps, "account").select("account", F.col("delta").alias("step"), "n", "entries")
