"""Order books: priority, depth, impact prices, nonces and locked balances.

``orders`` has ``(market, is_ask, price, base, nonce, account, ts)``. Asks rank by price and nonce ascending, bids by price and nonce
descending (bid nonces count down, so an earlier bid has the larger nonce).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ceil_div, order_index, order_market, order_nonce
from ..model.units import FIRST_BID_NONCE, IMPACT_NOTIONAL, MARGIN_TICK, MAX_BASE


LOCK_BITS = 96  # of a locked balance

def running(rows: DataFrame, keys: list[str], level: str, order: list[str | Column], **values: Column) -> DataFrame:
    """``rows`` with the sums of ``values`` over all rows of their keys that come before them by level and order.

    Rows are summed by level first and only the levels are run through by key; the rows of one level by themselves. So a key with very many rows is spread over its levels.
    """
    rows = rows.select("*", *(v.alias(f"__{n}") for n, v in values.items()))
    levels = rows.groupBy(*keys, level).agg(*(F.sum(f"__{n}").alias(n) for n in values))
    before = W.partitionBy(*keys).orderBy(level).rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy(*keys, level).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = levels.select(*keys, level, *(F.coalesce(F.sum(n).over(before), zero).alias(f"__before_{n}") for n in values))
    rows = rows.select("*", *(F.coalesce(F.sum(f"__{n}").over(inside), zero).alias(f"__inside_{n}") for n in values)).join(sums, [*keys, level])
    return rows.withColumns({n: F.col(f"__before_{n}") + F.col(f"__inside_{n}") for n in values}).drop(*(f"__{x}{n}" for n in values for x in ("", "before_", "inside_")))


def better(orders: DataFrame) -> DataFrame:
    """Orders with number, lots and quote of all strictly better orders of their side, by price and then nonce."""
    sign = F.when(F.col("is_ask") == 1, F.lit(1)).otherwise(F.lit(-1))
    rows = orders.withColumn("__level", F.col("price") * sign).withColumn("__turn", F.col("nonce") * sign)
    one = F.lit(1).cast("long")
    return running(rows, ["market", "is_ask"], "__level", ["__turn"], better_orders=one, better_base=F.col("base"), better_quote=F.col("base") * F.col("price")).drop("__level", "__turn")


def ranked(orders: DataFrame) -> DataFrame:
    """Orders with their rank from 1."""
    return better(orders).select("market", "is_ask", "price", "nonce", "base", (F.col("better_orders") + 1).cast("int").alias("rank"))


def best_orders(orders: DataFrame) -> DataFrame:
    """The best order of each side, by one aggregate that combines before the shuffle."""
    sign = F.when(F.col("is_ask") == 1, F.lit(1)).otherwise(F.lit(-1))
    best = F.min(F.struct((F.col("price") * sign).alias("p"), (F.col("nonce") * sign).alias("n"), "base"))
    return orders.groupBy("market", "is_ask").agg(best.alias("b")).select("market", "is_ask", F.abs("b.p").alias("price"), F.abs("b.n").alias("nonce"), F.col("b.base").alias("base"))


def depth(orders: DataFrame) -> DataFrame:
    """For each order the lots and quote of all strictly better orders of its side."""
    return better(orders).select("market", "is_ask", "price", "nonce", "better_base", "better_quote")


def impact_prices(orders: DataFrame, target: int | Column) -> DataFrame:
    """The average price of taking ``target`` quote (a number, or a column of the orders) from each side; 0 where the side holds less.

    The last order is filled in part: ceil(remaining / price) lots. The quotient is rounded down on bids and up on asks.
    """
    zero, want = F.lit(0).cast("long"), (target if isinstance(target, Column) else F.lit(target)).cast("long")
    rows = better(orders.withColumn("want", want)).select("market", "is_ask", "price", "base", "want", F.col("better_base").alias("b"), F.col("better_quote").alias("q"))
    hit = rows.where((F.col("q") < F.col("want")) & (F.col("q") + F.col("base") * F.col("price") >= F.col("want")))
    lots = ceil_div(F.col("want") - F.col("q"), F.col("price"))
    quote, base = F.col("q") + lots * F.col("price"), F.col("b") + lots
    price = F.when(F.col("is_ask") == 1, ceil_div(quote, base)).otherwise(F.call_function("div", quote, base))
    sides = orders.select("market", "is_ask").distinct()
    return sides.join(hit.select("market", "is_ask", price.alias("impact")), ["market", "is_ask"], "left").select("market", "is_ask", F.coalesce("impact", zero).alias("impact"))


def impact_mid(impacts: DataFrame) -> DataFrame:
    """Both impact prices and their middle, rounded down; 0 unless both are there."""
    zero = F.lit(0).cast("long")
    side = lambda v: F.coalesce(F.max(F.when(F.col("is_ask") == v, F.col("impact"))), zero)
    both = impacts.groupBy("market").agg(side(1).alias("ask"), side(0).alias("bid"))
    mid = F.when((F.col("ask") != 0) & (F.col("bid") != 0), F.call_function("div", F.col("ask") + F.col("bid"), F.lit(2).cast("long"))).otherwise(zero)
    return both.withColumn("mid", mid)


def next_nonces(orders: DataFrame) -> DataFrame:
    """Order nonces by arrival: asks count up from 1, bids down from 2^48 - 1."""
    rows = running(orders, ["market", "is_ask"], "ts", ["nonce"], n=F.lit(1).cast("long"))
    return rows.select("market", "is_ask", F.col("nonce").alias("order_id"), F.when(F.col("is_ask") == 1, F.col("n") + 1).otherwise(F.lit(FIRST_BID_NONCE) - F.col("n")).alias("nonce"))


def packed_indices(orders: DataFrame) -> DataFrame:
    """Order indices and what they unpack to."""
    index = order_index(F.col("market"), F.col("nonce"))
    return orders.select("nonce", index.alias("order_index"), order_market(index).alias("unpacked_market"), order_nonce(index).alias("unpacked_nonce"))


def locked_balances(orders: DataFrame, size_unit: int = 10, quote_unit: int = 1) -> DataFrame:
    """What open orders lock: asks base x size unit, bids base x price x quote unit, by account and side; ``fits`` tells whether that stays below 2^96, as a balance must."""
    wide = lambda x: (x if isinstance(x, Column) else F.lit(Decimal(x))).cast("decimal(38,0)")
    lock = F.when(F.col("is_ask") == 1, wide(F.col("base") * wide(size_unit))).otherwise(wide(F.col("base") * F.col("price") * wide(quote_unit)))
    out = orders.groupBy("account", "is_ask").agg(F.sum(lock).cast("decimal(38,0)").alias("locked"), F.count("*").alias("n_orders"))
    return out.withColumn("fits", F.col("locked") < wide(2**LOCK_BITS))


def tied_size(position: Column, limit: Column | int, price: Column, multiplier: int = 1) -> Column:
    """Size of a position-tied order: the least of |position|, the largest order, and the quote limit over the price."""
    most = F.lit(limit) if isinstance(limit, int) else limit
    return F.least(F.abs(position), F.lit(MAX_BASE), F.call_function("div", F.call_function("div", most.cast("long"), F.lit(multiplier).cast("long")), price))


def crossings(orders: DataFrame) -> DataFrame:
    """Markets whose best bid reaches their best ask."""
    best = best_orders(orders)
    ask = F.max(F.when(F.col("is_ask") == 1, F.col("price")))
    bid = F.max(F.when(F.col("is_ask") == 0, F.col("price")))
    return best.groupBy("market").agg(bid.alias("bid"), ask.alias("ask")).withColumn("crossed", F.coalesce(F.col("bid") >= F.col("ask"), F.lit(False)))


def size_checks(orders: DataFrame, min_base: int, min_quote: int, limit: int) -> DataFrame:
    """Orders by the size rule they break: ``over_limit``, ``too_small`` (unless ``twap`` or ``immediate``) or ``ok``."""
    quote = F.col("base") * F.col("price")
    small = ((F.col("base") < min_base) | (quote < min_quote)) & ~(F.col("twap") | F.col("immediate"))
    rule = F.when(quote > limit, "over_limit").when(small, "too_small").otherwise("ok")
    return orders.groupBy("market", rule.alias("rule")).agg(F.count("*").alias("n"))


def impact_target(least_fraction: Column, multiplier: Column) -> Column:
    """Quote of an impact order: the impact notional at the market's largest leverage, in units of its quote multiplier."""
    return F.call_function("div", F.call_function("div", F.lit(MARGIN_TICK * IMPACT_NOTIONAL).cast("long"), least_fraction), multiplier)


def updated_impacts(markets: DataFrame, impacts: DataFrame) -> DataFrame:
    """Markets ``(market, flag, status, is_perps, ask, bid, mid)`` with new impact prices where flagged, active and perpetual, else with their old ones."""
    new = impact_mid(impacts).select("market", *(F.col(c).alias(f"new_{c}") for c in ("ask", "bid", "mid")))
    on = F.col("flag") & (F.col("status") == 1) & F.col("is_perps")
    return markets.join(new, "market", "left").select("market", *(F.when(on, F.coalesce(f"new_{c}", F.lit(0))).otherwise(F.col(c)).alias(c) for c in ("ask", "bid", "mid")))


def account_orders(book: DataFrame, own: DataFrame) -> DataFrame:
    """Book orders with the account's own order of the same market, price and nonce, and whether their sizes agree."""
    mine = own.select("market", "price", "nonce", F.col("base").alias("own_base"), "account")
    return book.select("market", "price", "nonce", "base").join(mine, ["market", "price", "nonce"]).withColumn("agrees", F.col("base") == F.col("own_base"))
