"""The analytical tables read as exchange state.

The mapping is synthetic: it gives the operators rows of the right shape, no exchange's history.
Accounts are customers, markets are parts, fills are line items (taker: the order's customer, maker: the supplier),
resting orders are orders, and oracle samples are events. Money is in integer cents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import millis
from ..model.units import FIRST_SUB_ACCOUNT, INSURANCE_FUND, MASTER, PUBLIC_POOL

EVENTS_AFTER = 725_000_000_000  # by so many milliseconds events come after orders


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(name: str):
    """A money column in integer cents."""
    return F.round(F.col(name) * 100).cast("long")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(account, kind_name, collateral)``."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account"), F.col("c_nationkey").alias("nation"), (cents("c_acctbal") * 1000).alias("collateral"))


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(market, brand, mark, lots)``."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("market"), F.col("p_brand").alias("brand"), cents("p_retailprice").alias("mark"), F.col("p_size").cast("long").alias("lots"))


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(taker, maker, market, side, base, quote, fee_rate, ts, ok, ln)``; side is the taker's. Integers are made before the join, as they move in less than what they are made of."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("maker"), F.col("l_partkey").alias("market"),
        F.when(F.col("l_linestatus") == "O", F.lit(1)).otherwise(F.lit(-1)).cast("long").alias("side"),
        F.round("l_quantity").cast("long").alias("base"), cents("l_extendedprice").alias("quote"),
        F.round(F.col("l_tax") * 1_000_000).cast("long").alias("fee_rate"), millis("l_shipdate").alias("ts"),
        F.col("l_orderkey").alias("ok"), F.col("l_linenumber").cast("long").alias("ln"),
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ok"), F.col("o_custkey").alias("taker"))
    return lines.join(orders, "ok").select("taker", "maker", "market", "side", "base", "quote", "fee_rate", "ts", "ok", "ln")


def fill_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(market, ts)`` of all line items, also of those without an order, which are no fills."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("market"), millis("l_shipdate").alias("ts"))


def resting_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(market, is_ask, price, base, nonce, order_id, ts)``: one market a priority-and-day-free bucket of customers' orders.

    Market: customer mod 25. Price ticks: total price in whole units mod 500 + 1, asks 400 above. Lots: order key mod 50 + 1. Nonce: order key.
    """
    o = table(spark, sf_dir, "orders")
    ask = F.col("o_orderstatus") == "O"
    return o.select(
        (F.col("o_custkey") % 25).alias("market"), ask.cast("int").alias("is_ask"),
        (F.floor("o_totalprice") % 500 + 1 + F.when(ask, 400).otherwise(0)).cast("long").alias("price"),
        (F.col("o_orderkey") % 50 + 1).alias("base"), F.col("o_orderkey").alias("nonce"), F.col("o_custkey").alias("account"), millis("o_orderdate").alias("ts"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(market, ts, value, event_id, kind)``: event values in cents, one market for each user mod 10."""
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 10).alias("market"), millis("ts").alias("ts"), cents("value").alias("value"), "event_id", F.col("event_type").alias("kind"), F.col("user_id").alias("account"))


def margin_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(account, account_type, collateral, open_orders)``; the collateral is scaled to the positions that ``margin_positions`` gives."""
    kind = F.when(F.col("c_custkey") % 40 == 0, F.lit(INSURANCE_FUND)).when(F.col("c_custkey") % 40 == 1, F.lit(PUBLIC_POOL)).otherwise(F.lit(MASTER))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account"), kind.cast("long").alias("account_type"), (cents("c_acctbal") * 100_000_000).alias("collateral"), F.greatest(F.col("c_custkey") % 5 - 2, F.lit(0).cast("long")).alias("open_orders"))


def perps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(market, mark, multiplier, status, default_fraction, least_fraction, maintenance, close_out, prefix, strategy)``; parts of size 5 or less are expired (status 0)."""
    part = table(spark, sf_dir, "part")
    long = lambda c: c.cast("long")
    return part.select(
        F.col("p_partkey").alias("market"), cents("p_retailprice").alias("mark"), long(F.lit(1)).alias("multiplier"), long((F.col("p_size") > 5)).alias("status"),
        long(F.lit(500)).alias("default_fraction"), long(F.when(F.col("p_size") > 45, 1000).otherwise(300)).alias("least_fraction"), long(F.lit(300)).alias("maintenance"), long(F.lit(200)).alias("close_out"),
        ((F.col("p_partkey") % 201 - 100) * 1_000_000).alias("prefix"), (F.col("p_partkey") % 4).alias("strategy"),
    )


def nets(fills: DataFrame) -> DataFrame:
    """Net lots and cash ``(account, market, position, net)`` of the takers."""
    return fills.groupBy(F.col("taker").alias("account"), "market").agg(F.sum(F.col("side") * F.col("base")).alias("position"), F.sum(F.col("side") * F.col("quote")).alias("net"))


def margin_positions(fills: DataFrame) -> DataFrame:
    """``(account, market, position, entry_quote, last_prefix, fraction, isolated, allocated, open_orders)`` of the takers; the entry quote is the size of the net cash."""
    return held(nets(fills))


def held(nets: DataFrame, *also: str) -> DataFrame:
    """``margin_positions`` of net lots and cash ``(account, market, position, net)``, with the columns ``also``; insurance funds have no isolated positions."""
    net = nets.withColumn("net", F.abs("net"))
    entry = F.when(F.col("position") == 0, F.lit(0).cast("long")).otherwise(F.col("net"))
    isolated = ((F.col("account") + F.col("market")) % 4 == 0) & (F.col("account") % 40 != 0)
    out = net.select("account", "market", "position", entry.alias("entry_quote"), ((F.col("account") % 201 - 100) * 1_000_000).alias("last_prefix"), F.when(F.col("account") % 3 == 0, 800).otherwise(0).cast("long").alias("fraction"), isolated.alias("isolated"), *also)
    allocated = F.when(F.col("isolated"), F.col("entry_quote") * 100_000).otherwise(F.lit(0).cast("long"))
    return out.select("*", allocated.alias("allocated"), ((F.col("account") + F.col("market")) % 5 == 0).cast("long").alias("open_orders"))


def strategy_balances(accounts: DataFrame) -> DataFrame:
    """``(account, strategy, collateral)`` of the insurance funds among ``margin_accounts``: four strategies of a quarter each, and some more in later ones."""
    four = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))
    rows = accounts.where(F.col("account_type") == INSURANCE_FUND).select("account", four.alias("strategy"), F.col("collateral"))
    return rows.select("account", "strategy", (F.call_function("div", F.col("collateral"), F.lit(4).cast("long")) + F.col("strategy") * 7_000_000).alias("collateral"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a transaction log: ``(seq, ts, account, market, value, slot, tx_type)`` and the fields that single kinds carry."""
    e = samples(spark, sf_dir)
    out = e.select(F.col("event_id").alias("seq"), "ts", "account", "market", F.abs("value").alias("value"), (F.col("account") % 17).alias("slot"), (F.col("event_id") % 45).alias("tx_type"))
    even, turn = F.col("seq") % 2 == 0, F.call_function("div", F.col("seq"), F.lit(45).cast("long"))
    return out.withColumns({
        "strategy": F.col("value") % 8, "cooldown": F.when(even, F.col("value")), "pool": F.when(~even, F.col("account")), "index": F.col("seq") + FIRST_SUB_ACCOUNT,
        "from_strategy": F.col("slot") % 4, "to_strategy": F.col("market") % 4, "limit": F.lit(8_000).cast("long"), "least": F.lit(2_000).cast("long"),
        "direction": turn % 2, "position": turn % 5 - 1, "isolated": (F.col("account") + F.col("market")) % 4 != 0, "market_status": (F.col("market") != 9).cast("long"),
        "cross_available": (F.col("account") % 100 + 1) * 200_000_000, "isolated_available": F.col("seq") % 7 * 2_000_000_000,
        "pool_total": F.col("slot") * 7 + 1_000_003, "pool_value": F.col("market") * 1_001 + 2_000_029,
    })


def stakes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events as stakes and unstakes of 17 pools, with the pools and holdings at first, as ``operators.shares`` takes them; accounts up to 16 are the pools' operators."""
    e, pool, v = samples(spark, sf_dir), F.col("account") % 17, F.abs("value")
    rows = e.select(
        pool.alias("pool"), F.col("event_id").alias("seq"), "ts", F.col("account").alias("holder"), F.when(F.col("event_id") * 7 % 5 < 3, "stake").otherwise("unstake").alias("kind"),
        v.alias("shares"), (F.col("account") < 17).alias("is_operator"), F.when(F.col("event_id") % 13 == 0, 100_000_000).alias("available"), F.when(F.col("event_id") % 11 == 0, v * 300).alias("bound"),
    )
    total = F.col("pool") + 1_000_000
    long = lambda x: F.lit(x).cast("long")
    pools = e.select(pool.alias("pool")).distinct().select("pool", total.alias("total"), (total * 30_007).alias("balance"), long(400_000).alias("operator_shares"), long(3_000).alias("min_rate"), (F.col("pool") % 8 == 7).alias("frozen"), (F.col("pool") % 3 * 86_400_000).alias("lockup"))
    holdings = e.where("account >= 17 AND account % 5 = 0").select(pool.alias("pool"), F.col("account").alias("holder")).distinct()
    return rows, pools, holdings.withColumns({"shares": F.col("holder") * 100, "principal": F.col("holder") * 1_000})


def config_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(account, seq, mode, account_type, balance, locked, tav, im, funded)``: every third event asks for an asset mode, in a state that is made up."""
    e = samples(spark, sf_dir).where(F.col("event_id") % 3 == 0)
    v = F.col("value")
    return e.select(
        "account", F.col("event_id").alias("seq"), (F.col("event_id") % 2).alias("mode"), (F.col("account") % 5).alias("account_type"), (F.abs(v) * 7).alias("balance"),
        F.when(F.col("event_id") % 7 == 0, F.abs(v)).otherwise(0).cast("long").alias("locked"), (v * 3).alias("tav"), F.col("account").alias("im"), (v * 2 - F.col("account")).alias("funded"),
    )


def pool_requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same events as requests to 17 public pools: one in ten marks the pool's value, four buy, five give back, one of these forced."""
    rows, pools, holdings = stakes(spark, sf_dir)
    k, value = F.col("seq") * 7 % 10, samples(spark, sf_dir).select(F.col("event_id").alias("seq"), "value")
    kind = F.when(k == 0, "mark").when(k < 5, "mint").when(k < 9, "burn").otherwise("force_burn")
    available = F.when(k == 0, F.col("value") * 20_000).otherwise(F.col("available").cast("long"))
    free = F.when(F.col("seq") % 3 == 0, F.col("shares") * 40_000)
    rows = rows.join(value, "seq").withColumns({"kind": kind, "available": available, "free": free, "bound": F.lit(None).cast("long")}).drop("value")
    return rows, pools.withColumns({"lockup": F.lit(0).cast("long"), "fee_rate": F.lit(100_000).cast("long"), "cooldown": F.col("pool") % 2 * 40_000_000}), holdings


def funding_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(market, ts, prefix)`` of 25 markets: the running sum of daily rates, which are made of the day's order totals."""
    o = table(spark, sf_dir, "orders")
    days = o.groupBy((F.col("o_custkey") % 25).alias("market"), millis("o_orderdate").alias("ts")).agg(F.sum(cents("o_totalprice") % 2001 - 1000).alias("rate"))
    w = W.partitionBy("market").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)  # one row a market and day
    return days.select("market", "ts", F.sum("rate").over(w).alias("prefix"))


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(seq, kind, account, to, asset, amount, fee)``: events as deposits, transfers (to the account of half the number) and withdrawals in two assets."""
    e = samples(spark, sf_dir)
    k, v = F.col("event_id") % 6, F.abs("value")
    kind = F.when(k < 2, "deposit").when(k < 4, "transfer").when(k == 4, "l1_withdraw").otherwise("l2_withdraw")
    half = lambda x: F.call_function("div", x, F.lit(2).cast("long"))
    return e.select(
        F.col("event_id").alias("seq"), kind.alias("kind"), "account", half(F.col("account")).alias("to"), (F.call_function("div", F.col("event_id"), F.lit(6).cast("long")) % 2 + 1).alias("asset"),
        F.when(k < 2, v).when(k < 4, half(v)).otherwise(v * 2).alias("amount"), F.when(k.between(2, 3), 25).otherwise(0).cast("long").alias("fee"),
    )


def timer_arms(orders: DataFrame, events: DataFrame) -> DataFrame:
    """``(kind, account, id, ts, due)`` of tables or streams: expiries of orders, dead-man switches of their owners, and unlocks made of events, whose times are moved among those of orders."""
    key, day = F.col("o_orderkey"), 86_400_000
    ts = millis("o_orderdate")
    none = F.lit(0).cast("long")
    row = lambda kind, i, due: F.struct(F.lit(kind).alias("kind"), i.alias("id"), due.alias("due"))
    armed = F.array(row("expiry", key, F.when(key % 3 > 0, ts + (key % 60 + 1) * day).otherwise(none)), row("switch", none, F.when(key % 4 > 0, ts + (key % 90 + 1) * day).otherwise(none)))
    first = orders.select(F.col("o_custkey").alias("account"), ts.alias("ts"), F.explode(armed).alias("a")).select("a.kind", "account", "a.id", "ts", "a.due")
    moved = millis("ts") - EVENTS_AFTER
    second = events.select(F.lit("unlock").alias("kind"), F.col("user_id").alias("account"), F.col("event_id").alias("id"), moved.alias("ts"), (moved + F.col("event_id") % 400 * day + 1).alias("due"))
    return first.unionByName(second)


def ordered_fills(fills: DataFrame) -> DataFrame:
    """``(account, market, seq, d, q)`` of both parties (makers from -2 down); ``seq`` follows the fills' order by day, order and line."""
    seq = F.call_function("div", F.col("ts"), F.lit(86_400_000).cast("long")) * 2**48 + F.col("ok") * 8 + F.col("ln")
    d = F.col("side") * F.col("base")
    rows = F.array(F.struct(F.col("taker").alias("account"), d.alias("d")), F.struct((-F.col("maker") - 2).alias("account"), (-d).alias("d")))
    return fills.select("market", seq.alias("seq"), F.col("quote").alias("q"), F.inline(rows)).select("account", "market", "seq", "d", "q")


#: The same in SQL, as common table expressions.
SQL = {
    "accounts": "accounts AS (SELECT c_custkey AS account, c_nationkey AS nation, CAST(round(c_acctbal * 100) AS BIGINT) * 1000 AS collateral FROM customer)",
    "markets": "markets AS (SELECT p_partkey AS market, p_brand AS brand, CAST(round(p_retailprice * 100) AS BIGINT) AS mark, CAST(p_size AS BIGINT) AS lots FROM part)",
    "fills": """fills AS (SELECT o_custkey AS taker, l_suppkey AS maker, l_partkey AS market, CAST(CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS BIGINT) AS side,
 CAST(round(l_quantity) AS BIGINT) AS base, CAST(round(l_extendedprice * 100) AS BIGINT) AS quote, CAST(round(l_tax * 1000000) AS BIGINT) AS fee_rate,
 epoch_us(l_shipdate) // 1000 AS ts, l_orderkey AS ok, CAST(l_linenumber AS BIGINT) AS ln FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "book": """book AS (SELECT o_custkey % 25 AS market, CAST(o_orderstatus = 'O' AS INTEGER) AS is_ask,
 CAST(floor(o_totalprice) AS BIGINT) % 500 + 1 + CASE WHEN o_orderstatus = 'O' THEN 400 ELSE 0 END AS price, o_orderkey % 50 + 1 AS base, o_orderkey AS nonce, o_custkey AS account, epoch_us(o_orderdate) // 1000 AS ts FROM orders)""",
    "owners": "owners AS (SELECT c_custkey AS account, CAST(CASE WHEN c_custkey % 40 = 0 THEN 3 WHEN c_custkey % 40 = 1 THEN 2 ELSE 0 END AS BIGINT) AS account_type, CAST(round(c_acctbal * 100) AS BIGINT) * 100000000 AS collateral, greatest(c_custkey % 5 - 2, 0) AS open_orders FROM customer)",
    "perps": """perps AS (SELECT p_partkey AS market, CAST(round(p_retailprice * 100) AS BIGINT) AS mark, CAST(p_size > 5 AS BIGINT) AS status, CASE WHEN p_size > 45 THEN 1000 ELSE 300 END AS least_fraction,
 (p_partkey % 201 - 100) * 1000000 AS prefix, p_partkey % 4 AS strategy FROM part)""",
    "held": """held AS (SELECT account, market, position, CASE WHEN position = 0 THEN 0 ELSE net END AS entry_quote, (account % 201 - 100) * 1000000 AS last_prefix, CASE WHEN account % 3 = 0 THEN 800 ELSE 0 END AS fraction,
 (account + market) % 4 = 0 AND account % 40 <> 0 AS isolated, CASE WHEN (account + market) % 4 = 0 AND account % 40 <> 0 AND position <> 0 THEN net * 100000 ELSE 0 END AS allocated, CAST((account + market) % 5 = 0 AS BIGINT) AS open_orders
 FROM (SELECT taker AS account, market, CAST(sum(side * base) AS BIGINT) AS position, CAST(abs(sum(side * quote)) AS BIGINT) AS net FROM fills GROUP BY 1, 2))""",
    "marks": "marks AS (SELECT market, ts, CAST(sum(rate) OVER (PARTITION BY market ORDER BY ts) AS BIGINT) AS prefix FROM (SELECT o_custkey % 25 AS market, epoch_us(o_orderdate) // 1000 AS ts, sum(CAST(round(o_totalprice * 100) AS BIGINT) % 2001 - 1000) AS rate FROM orders GROUP BY 1, 2))",
    "operations": """operations AS (SELECT event_id AS seq, CASE WHEN event_id % 6 < 2 THEN 'deposit' WHEN event_id % 6 < 4 THEN 'transfer' WHEN event_id % 6 = 4 THEN 'l1_withdraw' ELSE 'l2_withdraw' END AS kind, account, account // 2 AS dest,
 event_id // 6 % 2 + 1 AS asset, CASE WHEN event_id % 6 < 2 THEN abs(value) WHEN event_id % 6 < 4 THEN abs(value) // 2 ELSE abs(value) * 2 END AS amount, CASE WHEN event_id % 6 BETWEEN 2 AND 3 THEN 25 ELSE 0 END AS fee FROM samples)""",
    "arms": f"""arms AS (SELECT 'expiry' AS kind, account, nonce AS id, ts, CASE WHEN nonce % 3 > 0 THEN ts + (nonce % 60 + 1) * 86400000 ELSE 0 END AS due FROM book
 UNION ALL SELECT 'switch', account, 0, ts, CASE WHEN nonce % 4 > 0 THEN ts + (nonce % 90 + 1) * 86400000 ELSE 0 END FROM book
 UNION ALL SELECT 'unlock', account, event_id, ts - {EVENTS_AFTER}, ts - {EVENTS_AFTER} + event_id % 400 * 86400000 + 1 FROM samples)""",
    "configs": "configs AS (SELECT account, event_id AS seq, event_id % 2 AS mode, account % 5 AS account_type, abs(value) * 7 AS balance, CASE WHEN event_id % 7 = 0 THEN abs(value) ELSE 0 END AS locked, value * 3 AS tav, account AS im, value * 2 - account AS funded FROM samples WHERE event_id % 3 = 0)",
    "samples": "samples AS (SELECT user_id % 10 AS market, epoch_us(ts) // 1000 AS ts, CAST(round(value * 100) AS BIGINT) AS value, event_id, event_type AS kind, user_id AS account FROM events)",
}


def sql(*names: str, body: str) -> str:
    """A query over some of these."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n" + body
