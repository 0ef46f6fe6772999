"""Positions, fees, profit and loss, and open interest from fills.

``fills`` has ``(taker, maker, market, side, base, quote, fee_rate, ts, ok, ln)``; the side is the taker's, the maker takes the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sgn

ORDER = ("ts", "ok", "ln")


def position_fold(fills: DataFrame) -> DataFrame:
    """Net lots and net cash of each taker and market: plain sums, combined before the shuffle."""
    return fills.groupBy(F.col("taker").alias("account"), "market").agg(F.sum(F.col("side") * F.col("base")).alias("position"), F.sum(-F.col("side") * F.col("quote")).alias("cash"))


def position_changes(fills: DataFrame, early: Column) -> DataFrame:
    """Net change ``delta`` of every account and market from the state of the ``early`` fills to that of all, without zeros: both states are summed in one pass."""
    d = F.col("side") * F.col("base")
    both = fills.groupBy(F.col("taker").alias("account"), "market").agg(F.sum(d).alias("after"), F.sum(F.when(early, d)).alias("before"))
    return both.select("account", "market", (F.col("after") - F.coalesce("before", F.lit(0).cast("long"))).alias("delta")).where("delta <> 0")


def running_position(fills: DataFrame) -> DataFrame:
    """Each fill with its account's position in the market after it."""
    w = W.partitionBy("taker", "market").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0)
    return fills.select(F.col("taker").alias("account"), "market", *ORDER, F.sum(F.col("side") * F.col("base")).over(w).alias("position"))


def fees_by_account(fills: DataFrame) -> DataFrame:
    """Taker fees in collateral units (quote x rate)."""
    return fills.groupBy(F.col("taker").alias("account")).agg(F.sum((F.col("quote").cast("decimal(38,0)") * F.col("fee_rate")).cast("decimal(38,0)")).cast("decimal(38,0)").alias("fee"))


def fee_flows(fills: DataFrame, fee_account: int = -1, maker_part: int = 4) -> DataFrame:
    """Signed fee rows summed by account: takers and makers pay, the fee account receives; the total is 0.

    The maker's rate is the taker's divided by ``maker_part``.
    """
    quote = F.col("quote").cast("decimal(38,0)")
    taker = (quote * F.col("fee_rate")).cast("decimal(38,0)")
    maker = (quote * F.call_function("div", F.col("fee_rate"), F.lit(maker_part).cast("long"))).cast("decimal(38,0)")
    rows = F.array(F.struct(F.col("taker").alias("account"), (-taker).cast("decimal(38,0)").alias("amount")), F.struct((-F.col("maker") - 2).alias("account"), (-maker).cast("decimal(38,0)").alias("amount")), F.struct(F.lit(fee_account).cast("long").alias("account"), (taker + maker).cast("decimal(38,0)").alias("amount")))
    return fills.select(F.inline(rows)).groupBy("account").agg(F.sum(F.col("amount").cast("decimal(38,0)")).cast("decimal(38,0)").alias("amount"))


def unrealised(position: Column, mark: Column, entry_quote: Column, multiplier: Column | int = 1) -> Column:
    """Unrealised profit: sign(p) x (|p| x mark x multiplier - entry quote); the negated branch holds for 0."""
    value = F.abs(position) * mark * multiplier - entry_quote
    return F.when(position > 0, value).otherwise(-value)


def open_interest(fills: DataFrame) -> DataFrame:
    """Open interest of each market: half the sum of all parties' absolute positions, and the longs' side of it."""
    both = fills.select(F.inline(F.array(F.struct("market", F.col("taker").alias("party"), (F.col("side") * F.col("base")).alias("d")), F.struct("market", (-F.col("maker") - 2).alias("party"), (-F.col("side") * F.col("base")).alias("d")))))
    net = both.groupBy("market", "party").agg(F.sum("d").alias("p"))
    return net.groupBy("market").agg(F.call_function("div", F.sum(F.abs("p")), F.lit(2).cast("long")).alias("open_interest"), F.sum(F.greatest("p", F.lit(0).cast("long"))).alias("longs"), F.count(F.when(F.col("p") != 0, 1)).alias("parties"))


def parties(fills: DataFrame) -> DataFrame:
    """Two rows a fill, ``(account, market, ts, ok, ln, d, quote)``: the taker's and the maker's (accounts from -2 down), with opposite signed lots."""
    d = F.col("side") * F.col("base")
    rows = F.array(F.struct(F.col("taker").alias("account"), d.alias("d")), F.struct((-F.col("maker") - 2).alias("account"), (-d).alias("d")))
    return fills.select("market", *ORDER, "quote", F.inline(rows)).select("account", "market", *ORDER, "d", "quote")


def open_interest_changes(fills: DataFrame) -> DataFrame:
    """The change of open interest that each fill makes: that of |position| of its taker and of its maker."""
    w = W.partitionBy("account", "market").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0)
    rows = parties(fills).withColumn("after", F.sum("d").over(w))
    return rows.groupBy("market", *ORDER).agg(F.sum(F.abs("after") - F.abs(F.col("after") - F.col("d"))).alias("change"))


def spot_rows(fills: DataFrame, *others: str, size_unit: int = 1_000_000, quote_unit: int = 1_000_000, maker_part: int = 4) -> DataFrame:
    """Six signed balance rows ``(account, asset, amount)`` a trade: buyer, seller and fee account, in base and quote; with some ``others`` of its columns.

    Amounts are in the assets' own units, ``size_unit`` a lot and ``quote_unit`` a quote unit. The buyer pays its fee in base, the seller in quote: amount x (unit div 1e6) x
    its rate, which is ``fee_rate`` for the taker and a part of it for the maker. Asset 0 is quote, others are markets + 1. The sums over accounts are 0 for every asset.
    """
    wide = lambda x: x.cast("decimal(38,0)")
    buys = F.col("side") > 0
    taker, maker = F.col("taker"), -F.col("maker") - 2
    taker_rate, maker_rate = F.col("fee_rate"), F.call_function("div", F.col("fee_rate"), F.lit(maker_part).cast("long"))
    buyer, seller = F.when(buys, taker).otherwise(maker), F.when(buys, maker).otherwise(taker)
    base_fee = wide(wide(F.col("base") * (size_unit // 1_000_000)) * F.when(buys, taker_rate).otherwise(maker_rate))
    quote_fee = wide(wide(F.col("quote") * (quote_unit // 1_000_000)) * F.when(buys, maker_rate).otherwise(taker_rate))
    base, quote = wide(wide(F.col("base")) * size_unit), wide(wide(F.col("quote")) * quote_unit)
    asset, cash, house = F.col("market") + 1, F.lit(0).cast("long"), F.lit(-1).cast("long")
    row = lambda account, what, amount: F.struct(account.alias("account"), what.alias("asset"), wide(amount).alias("amount"))
    rows = F.array(row(buyer, asset, base - base_fee), row(buyer, cash, -quote), row(seller, asset, -base), row(seller, cash, quote - quote_fee), row(house, asset, base_fee), row(house, cash, quote_fee))
    return fills.select(*others, F.inline(rows))


def spot_deltas(fills: DataFrame, size_unit: int = 1_000_000, quote_unit: int = 1_000_000, maker_part: int = 4) -> DataFrame:
    """The rows of ``spot_rows`` summed by account and asset, without zeros."""
    rows = spot_rows(fills, size_unit=size_unit, quote_unit=quote_unit, maker_part=maker_part)
    return rows.groupBy("account", "asset").agg(F.sum("amount").cast("decimal(38,0)").alias("amount")).where("amount <> 0")


def spot_changes(fills: DataFrame, early: Column) -> DataFrame:
    """Net change ``delta`` of every account and asset from the balances of the ``early`` fills to those of all, without zeros: one sum, to which an early row's amount adds and from which it is taken. Rows that add nothing to it are not moved."""
    amount, none = F.col("amount"), F.lit(0).cast("decimal(38,0)")
    rows = spot_rows(fills.withColumn("early", F.coalesce(early, F.lit(False))), "early").select("account", "asset", F.when(F.col("early"), none).otherwise(amount).alias("amount"))
    return rows.where("amount <> 0").groupBy("account", "asset").agg(F.sum("amount").cast("decimal(38,0)").alias("delta")).where("delta <> 0")


def trade_parties(fills: DataFrame, accounts: DataFrame, field: str, fee_account: int) -> DataFrame:
    """Fills with the ``field`` of their taker's, maker's and fee account, as ``taker_``, ``maker_`` and ``fee_`` field; fills of unknown accounts are left out."""
    out = fills.withColumn("fee_account", F.lit(fee_account).cast("long"))
    for name, key in (("taker", "taker"), ("maker", "maker"), ("fee", "fee_account")):
        out = out.join(accounts.select(F.col("account").alias(key), F.col(field).alias(f"{name}_{field}")), key)
    return out


def self_trades(fills: DataFrame) -> DataFrame:
    """Fills whose two parties are one account."""
    return fills.where("taker = maker").select("taker", "market", *ORDER, "base")


def signs(fills: DataFrame) -> DataFrame:
    """Longs, shorts and flats by market."""
    p = position_fold(fills).withColumn("s", sgn(F.col("position")))
    return p.groupBy("market").agg(*(F.sum((F.col("s") == v).cast("long")).alias(n) for n, v in (("longs", 1), ("shorts", -1), ("flats", 0))))
