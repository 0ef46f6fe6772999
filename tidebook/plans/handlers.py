"""Queries over a transaction log read from the events: handlers, rules, blocks, joins and exact arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import join_bytes, le_bytes, packed_fields, rotl32, selects
from ..functions.wide import isolated_margin_change
from ..model import schemas
from ..model.units import TX_TYPES
from ..operators import book, handlers, ledger, orders, pools, positions, rules
from ..sources import blocks, telemetry
from ..sources.tables import accounts, config_changes, fills, resting_orders, samples, sql, transactions
from ..streaming.windows import funding_hours, tumbling
from .books import PRIORITY

NOW = 870_000_000_000
TXS = "txs AS (SELECT event_id AS seq, ts, account, market, abs(value) AS value, account % 17 AS slot, event_id % 45 AS tx_type FROM samples)"
KINDS = ["l2_create_order", "l2_transfer", "l1_deposit", "l1_withdraw", "l2_withdraw", "l1_create_order"]
ROWS = """rows AS (SELECT event_id AS seq, event_id // 50 AS block, account, market, abs(value) AS v, event_id % 7 AS k, account % 3 AS key, ts FROM samples),
judged AS (SELECT *, CASE k WHEN 0 THEN 'l2_create_order' WHEN 1 THEN 'l2_transfer' WHEN 2 THEN 'l1_deposit' WHEN 3 THEN 'l1_withdraw' WHEN 4 THEN 'l2_withdraw' WHEN 5 THEN 'l1_create_order' END AS kind,
 CASE k WHEN 0 THEN v > 0 WHEN 5 THEN v > 0 AND market <= 254 WHEN 1 THEN account <> account // 2 AND v % 5 > 0 WHEN 2 THEN v >= 100 WHEN 3 THEN v % 9 > 0 WHEN 4 THEN v % 9 > 0 ELSE false END AS ok FROM rows)"""


_txs = transactions


def _documents(spark, d):
    """Events as JSON block documents of 50 transactions, parsed again by the block schema."""
    e = samples(spark, d)
    v, k = F.abs("value"), F.col("event_id") % 7
    codes = F.element_at(F.array(*(F.lit(TX_TYPES[n]) for n in KINDS), F.lit(99)), (k + 1).cast("int")).cast("long")
    struct = lambda t, **f: F.struct(*((f[x.name] if x.name in f else F.lit(None)).cast(x.dataType).alias(x.name) for x in t))
    fields = {
        "tx_type": codes, "account_index": F.col("account"), "api_key_index": F.col("account") % 3, "nonce": F.col("event_id"),
        "create_order": F.when(k.isin(0, 5), struct(schemas.ORDER, market_index=F.col("market"), price=v, base_amount=F.lit(5))),
        "transfer": F.when(k == 1, struct(schemas.TRANSFER, from_account_index=F.col("account"), to_account_index=F.call_function("div", F.col("account"), F.lit(2).cast("long")), asset_index=F.col("market"), amount=v % 5)),
        "deposit": F.when(k == 2, struct(schemas.DEPOSIT, account_index=F.col("account"), asset_index=F.col("market"), amount=v, accepted_amount=F.greatest(v - 1, F.lit(100)))),
        "withdraw": F.when(k.isin(3, 4), struct(schemas.WITHDRAW, account_index=F.col("account"), asset_index=F.col("market"), amount=v % 9)),
    }
    tx = struct(schemas.TX, **fields)
    sizes = e.select(F.call_function("div", F.col("event_id"), F.lit(50).cast("long")).alias("block_number"), "ts", F.struct(F.col("event_id").alias("at"), tx.alias("tx")).alias("t"))
    grouped = sizes.groupBy("block_number").agg(F.min("ts").alias("created_at"), F.transform(F.array_sort(F.collect_list("t")), lambda t: t["tx"]).alias("txs"))
    return blocks.parsed(grouped.select(F.to_json(F.struct("block_number", "created_at", "txs")).alias("value")))


def _judged(spark, d):
    return rules.status(blocks.transactions(_documents(spark, d)), {n: r for n, r in rules.basic_rules().items() if n != "not_expired"})


def _batches(spark, d):
    log = samples(spark, d).select(F.col("event_id").alias("seq"), "ts", "kind", "account", "value")
    merged = ledger.batches(ledger.block_summary(ledger.blocks(log, 64)), 4)
    return merged.select("batch", "first_block", "last_block", "first_ts", "last_ts", (F.col("first_block") % 7).alias("old_root"), ((F.col("last_block") + 1) % 7 + (F.col("batch") % 5 == 0).cast("long")).alias("new_root"))


def _quotes(spark, d):
    return resting_orders(spark, d).withColumn("target", book.impact_target(500 + F.col("market") % 5 * 100, F.lit(25_000).cast("long")))


def _impact_updates(spark, d):
    impacts = book.impact_prices(_quotes(spark, d), F.col("target"))
    old = resting_orders(spark, d).groupBy("market").agg(F.min("price").alias("bid"), F.max("price").alias("ask"))
    return book.updated_impacts(old.select("market", (F.col("market") % 3 > 0).alias("flag"), (F.col("market") % 7 > 0).cast("int").alias("status"), (F.col("market") % 11 > 0).alias("is_perps"), "ask", "bid", F.lit(0).cast("long").alias("mid")), impacts)


def _timers(spark, d):
    o, e = resting_orders(spark, d), samples(spark, d)
    expiry = o.select(F.lit("expiry").alias("kind"), "account", F.when(F.col("nonce") % 3 > 0, F.col("ts") + 86_400_000).otherwise(0).alias("at"))
    switch = o.select(F.lit("switch").alias("kind"), "account", (F.col("ts") * (F.col("nonce") % 2)).alias("at"))
    return handlers.due_timers(expiry.unionByName(switch).unionByName(e.select(F.lit("unlock").alias("kind"), "account", (F.col("ts") - 800_000_000_000).alias("at"))), NOW)


def _wide(spark, d):
    a, b = F.col("quote") * F.col("side"), F.col("base") * 1_000_000
    left_over, borrow = selects.try_subtract(a, b)
    return fills(spark, d).select(
        "ok", "ln", selects.abs_diff(a, b).alias("abs_diff"), selects.abs_sum(a, b).alias("abs_sum"), selects.negated(a).alias("negated"), selects.compared(a, b).alias("compared"), F.least(selects.wide(a), selects.wide(b)).alias("least"), F.greatest(selects.wide(a), selects.wide(b)).alias("most"),
        left_over.alias("left_over"), borrow.alias("borrow"), selects.mul_add(a, F.col("ln"), b).alias("mul_add"), selects.fits(a, 23).alias("fits"),
    )


def _lines(spark, d):
    e = samples(spark, d)
    text = F.when(F.col("event_id") % 3 == 0, F.concat_ws("", "kind", F.lit(": time: "), (F.abs("value") / 100).cast("decimal(12,2)"), F.lit("s"))).when(F.col("event_id") % 3 == 1, F.concat_ws("", "kind", F.lit(": elapsed_ms="), F.abs("value"))).otherwise(F.lit("noise"))
    return telemetry.parsed(e.select(text.alias("value"))).groupBy("stage").agg(F.count("*").alias("n"), F.round(F.sum("seconds"), 3).alias("seconds"))


def _wall(spark, d):
    e = samples(spark, d)
    w = telemetry.wall((F.col("event_id") % 2 * F.abs("value")).cast("double"), (F.col("event_id") % 3 * 10).cast("double"), F.col("event_id").cast("double"), F.lit(4.0))
    return e.select("event_id", w.alias("wall"))


def _exact(query):
    return lambda s, d: (df := query(s, d)).select(*(F.col(c).cast("string").alias(c) if t.startswith("decimal") else c for c, t in df.dtypes))


def _isolated(spark, d):
    rows = fills(spark, d).select("ok", "ln", (F.col("taker") % 21 - 10).alias("p"), (F.col("maker") % 21 - 10).alias("new"), (F.col("quote") % 5000 + 1).alias("allocated"), (F.col("quote") % 7000 + 1).alias("value"), (F.col("quote") % 3000).alias("new_value"), F.col("base").alias("requirement"), F.col("ln").alias("increase"), (F.col("ln") - 3).alias("profit"))
    return rows.select("ok", "ln", isolated_margin_change(*(F.col(c) for c in ("p", "new", "allocated", "value", "new_value", "requirement", "increase", "profit"))).alias("moved"))


QUERIES = {
    "api_key_changes": lambda s, d: handlers.api_keys(_txs(s, d)),
    "market_settings": lambda s, d: handlers.market_settings(_txs(s, d)).fillna(-1),
    "asset_settings": lambda s, d: handlers.asset_settings(_txs(s, d)),
    "system_settings": lambda s, d: handlers.system_settings(_txs(s, d)).fillna(-1),
    "sub_accounts": lambda s, d: handlers.sub_accounts(_txs(s, d)),
    "pool_fee_changes": lambda s, d: handlers.pool_fees(_txs(s, d)),
    "leverage_changes": lambda s, d: handlers.leverages(_txs(s, d)),
    "margin_moves": lambda s, d: handlers.margin_moves(_txs(s, d)),
    "staked_shares": lambda s, d: handlers.stakes(_txs(s, d)),
    "minted_shares": lambda s, d: handlers.minted(_txs(s, d)),
    "account_mode_changes": lambda s, d: handlers.account_modes(config_changes(s, d)),
    "strategy_moves": lambda s, d: handlers.strategy_moves(_txs(s, d)),
    "metadata_stamps": lambda s, d: handlers.stamps(samples(s, d).withColumnRenamed("event_id", "seq")),
    "due_timers": _timers,
    "merged_batches": lambda s, d: handlers.merged_batches(_batches(s, d)),
    "delta_sequence": lambda s, d: handlers.delta_sequence(positions.position_changes(fills(s, d), F.col("ok") % 2 == 0), 128),
    "transaction_statuses": lambda s, d: _judged(s, d).groupBy("block_number", "status").agg(F.count("*").alias("n")),
    "transaction_balances": lambda s, d: rules.balance_changes(_judged(s, d)),
    "whitelist_faults": lambda s, d: rules.whitelist(_judged(s, d), accounts(s, d).select(F.col("account").alias("account_index"), (F.col("account") % 3).alias("account_type")), s.createDataFrame([(0, k) for k in KINDS] + [(1, "l2_transfer")], "account_type long, kind string")).groupBy("account_type", "kind").agg(F.count("*").alias("n")),
    "transaction_nonce_faults": lambda s, d: rules.nonce_faults(_judged(s, d)).select("account_index", "api_key_index", "before", "nonce"),
    "book_account_orders": lambda s, d: book.account_orders(resting_orders(s, d).where(F.col("nonce") % 2 == 0), resting_orders(s, d).withColumn("base", F.col("base") - (F.col("nonce") % 8 == 0).cast("int"))),
    "trade_parties": lambda s, d: positions.trade_parties(fills(s, d), accounts(s, d), "nation", 1).groupBy("taker_nation", "maker_nation", "fee_nation").agg(F.count("*").alias("n")),
    "pool_share_lookup": lambda s, d: pools.share_lookup(accounts(s, d).select("account", F.col("nation").alias("pool")), fills(s, d).where("taker % 2 = 0").select(F.col("taker").alias("account"), (F.col("market") % 25).cast("int").alias("pool"), F.col("base").alias("shares"))),
    "impact_targets": lambda s, d: book.impact_prices(_quotes(s, d), F.col("target")),
    "impact_updates": _impact_updates,
    "wide_arithmetic": _wide,
    "isolated_margin_changes": _isolated,
    "staking_values": lambda s, d: accounts(s, d).select("account", pools.staking_value(F.col("account") % 97, F.abs("collateral"), F.lit(1_000).cast("long"), 7).alias("value"), pools.redeemable(F.abs("collateral"), F.col("account") + 5, F.abs("collateral") % 1_000 + 1).alias("burnable")),
    "mint_limits": lambda s, d: fills(s, d).select("ok", "ln", pools.may_mint(F.col("quote"), F.col("base") * 10_000, (F.col("fee_rate") * 5 + F.col("quote") % 300_000) * 60).alias("may_mint")),
    "hourly_windows": lambda s, d: tumbling(samples(s, d).withColumn("at", F.timestamp_millis("ts")), "at").withColumn("start", F.unix_millis("start")),
    "hourly_averages": lambda s, d: funding_hours(samples(s, d).withColumn("at", F.timestamp_millis("ts")), "at").withColumn("start", F.unix_millis("start")),
    "log_stages": _lines,
    "wall_seconds": _wall,
    "array_selection": lambda s, d: accounts(s, d).select("account", F.array_join(selects.select(F.col("account") % 2 == 0, F.array(F.col("account"), F.col("nation").cast("long")), F.array(F.lit(0).cast("long"), F.col("account") * 2)), ":").alias("items")),
    "record_selection": lambda s, d: resting_orders(s, d).select("nonce", selects.select_fields(F.col("is_ask") == 1, {"price": F.col("price"), "size": F.col("base")}, {"price": -F.col("price"), "size": F.col("base") * 2}).alias("r")).select("nonce", "r.price", "r.size"),
    "last_child_orders": lambda s, d: resting_orders(s, d).groupBy("account").agg(F.coalesce(F.max(F.when(F.col("is_ask") == 1, F.col("nonce"))), F.lit(0)).alias("last_ask")),
    "word_rotations": lambda s, d: resting_orders(s, d).select("nonce", rotl32(F.col("nonce"), 5).alias("left5"), rotl32(F.col("nonce"), 27).alias("right5"), F.bitwise_not("nonce").bitwiseAND(F.lit(2**32 - 1)).alias("inverted"), join_bytes(le_bytes(F.col("nonce"), 6)).alias("joined")),
    "packed_fields": lambda s, d: resting_orders(s, d).select("nonce", packed_fields(12, (F.lit(7), 1), (F.col("account"), 6), (F.col("price"), 4)).alias("packed"), F.conv(F.hex("nonce"), 16, 2).alias("bits")),
}
QUERIES = {name: _exact(query) for name, query in QUERIES.items()}


def _tx(body: str) -> str:
    return sql("samples", body=f", {TXS} {body}")


def _move(*parts: str, where: str) -> str:
    rows = " UNION ALL ".join(f"SELECT {a} AS account, {p} AS place, {x} AS x FROM txs WHERE {where}" for a, p, x in (part.split("|") for part in parts))
    return _tx(f"SELECT account, CAST(place AS BIGINT) AS place, CAST(sum(CAST(x AS HUGEINT)) AS VARCHAR) AS amount FROM ({rows}) GROUP BY 1, 2 HAVING sum(x) <> 0")


GOAL = "(5000000000000 // (500 + market % 5 * 100) // 25000)"
TARGETS = f"""w AS (SELECT market, is_ask, price, base, {GOAL} AS t, coalesce(sum(base) OVER b, 0) AS b, coalesce(sum(base * price) OVER b, 0) AS q FROM book WINDOW b AS ({PRIORITY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
hit AS (SELECT market, is_ask, b + (t - q + price - 1) // price AS lots, q + (t - q + price - 1) // price * price AS quote FROM w WHERE q < t AND q + base * price >= t),
impacts AS (SELECT s.market, s.is_ask, CAST(coalesce(CASE WHEN s.is_ask = 1 THEN (quote + lots - 1) // lots ELSE quote // lots END, 0) AS BIGINT) AS impact FROM (SELECT DISTINCT market, is_ask FROM book) s LEFT JOIN hit h ON s.market = h.market AND s.is_ask = h.is_ask)"""
WORTH = "CAST(value AS HUGEINT) * (market * 1001 + 2000029) // (slot * 7 + 1000003)"
MARGIN = "value * 1000000 * (seq // 45 % 2 * 2 - 1)"
SQL = {
    "api_key_changes": _tx("SELECT account, slot, value, tx_type FROM txs WHERE tx_type IN (2, 8) QUALIFY row_number() OVER (PARTITION BY account, slot ORDER BY seq DESC) = 1"),
    "market_settings": _tx("SELECT market, max(seq) FILTER (WHERE tx_type = 3) AS created, coalesce(arg_max(value % 8, seq) FILTER (WHERE tx_type = 44), -1) AS strategy, arg_max(value, seq) FILTER (WHERE tx_type IN (3, 4)) AS fraction FROM txs WHERE tx_type IN (3, 4, 44) GROUP BY market HAVING count(*) FILTER (WHERE tx_type = 3) > 0"),
    "asset_settings": _tx(", f AS (SELECT *, min(seq) FILTER (WHERE tx_type = 31) OVER (PARTITION BY slot) AS first FROM txs WHERE tx_type IN (31, 32)) SELECT slot, value, seq FROM f WHERE seq >= first QUALIFY row_number() OVER (PARTITION BY slot ORDER BY seq DESC) = 1"),
    "system_settings": _tx("SELECT coalesce(arg_max(value, seq) FILTER (WHERE seq % 2 = 0), -1) AS cooldown, coalesce(arg_max(account, seq) FILTER (WHERE seq % 2 = 1), -1) AS pool FROM txs WHERE tx_type = 38"),
    "sub_accounts": _tx("SELECT account, count(*) AS n, min(seq) + 140737488355328 AS first_index, max(seq) + 140737488355328 AS last_index FROM txs WHERE tx_type = 9 GROUP BY account"),
    "pool_fee_changes": _tx("SELECT slot, seq, value, coalesce(value <= min(value) OVER (PARTITION BY slot ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS taken FROM txs WHERE tx_type IN (10, 11, 33)"),
    "leverage_changes": _tx("SELECT account, market, value FROM txs WHERE tx_type = 20 AND value >= 2000 QUALIFY row_number() OVER (PARTITION BY account, market ORDER BY seq DESC) = 1"),
    "margin_moves": _move(f"account|-1|-({MARGIN})", f"account|market|{MARGIN}", where="tx_type = 29 AND market <> 9 AND (account + market) % 4 <> 0 AND seq // 45 % 5 <> 1 AND value > 0 AND value * 1000000 <= CASE WHEN seq // 45 % 2 = 1 THEN (account % 100 + 1) * 200000000 ELSE seq % 7 * 2000000000 END"),
    "staked_shares": _tx(f"SELECT account, CAST(sum(sign * value) AS VARCHAR) AS shares, CAST(sum(sign * ({WORTH})) AS VARCHAR) AS staked FROM (SELECT *, CASE WHEN tx_type = 35 THEN 1 ELSE -1 END AS sign FROM txs WHERE tx_type IN (35, 36) AND value > 0) GROUP BY account"),
    "minted_shares": _move("account|slot|CASE WHEN tx_type = 18 THEN value ELSE -value END", f"account|-1|CASE WHEN tx_type = 18 THEN -({WORTH}) ELSE {WORTH} END", where="tx_type IN (18, 19, 30, 40)"),
    "account_mode_changes": sql("samples", "configs", body=""", c AS (SELECT *, CASE WHEN account_type IN (0, 1) AND (mode = 1 OR (locked = 0 AND tav >= im AND funded >= 0)) THEN mode END AS sure FROM configs),
m AS (SELECT *, coalesce(last_value(sure IGNORE NULLS) OVER (PARTITION BY account ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c),
t AS (SELECT *, sure IS NOT NULL AND before <> mode AS taken FROM m)
SELECT account, seq, taken, CASE WHEN taken THEN mode ELSE before END AS mode, CASE WHEN taken AND mode = 1 THEN balance ELSE 0 END AS to_collateral FROM t"""),
    "strategy_moves": _move("account|slot % 4|-value", "account|market % 4|value", where="tx_type = 43 AND value BETWEEN 1 AND 8000 AND slot % 4 <> market % 4"),
    "metadata_stamps": sql("samples", body="""SELECT market, event_id AS seq, row_number() OVER h = 1 AS funding, row_number() OVER m = 1 AS premium, first(ts) OVER h AS last_funding, ts AS last_oracle, first(ts) OVER m AS last_premium FROM samples
WINDOW h AS (PARTITION BY market, ts // 3600000 ORDER BY ts, event_id), m AS (PARTITION BY market, ts // 60000 ORDER BY ts, event_id)"""),
    "due_timers": sql("book", "samples", body=f""", t AS (SELECT 'expiry' AS kind, account, CASE WHEN nonce % 3 > 0 THEN ts + 86400000 ELSE 0 END AS due FROM book UNION ALL SELECT 'switch', account, ts * (nonce % 2) FROM book UNION ALL SELECT 'unlock', account, ts - 800000000000 FROM samples)
SELECT kind, count(*) AS n, min(due) AS earliest, count(DISTINCT account) AS accounts FROM t WHERE due <> 0 AND due <= {NOW} GROUP BY kind"""),
    "merged_batches": sql("samples", body=""", b AS (SELECT event_id // 64 // 4 AS batch, min(event_id // 64) AS first_block, max(event_id // 64) AS last_block, arg_min(mn, event_id // 64) AS first_ts, arg_max(mx, event_id // 64) AS last_ts FROM (SELECT event_id, min(ts) OVER (PARTITION BY event_id // 64) AS mn, max(ts) OVER (PARTITION BY event_id // 64) AS mx FROM samples) GROUP BY 1),
r AS (SELECT *, first_block % 7 AS old_root, (last_block + 1) % 7 + CAST(batch % 5 = 0 AS BIGINT) AS new_root FROM b)
SELECT x.batch, x.last_block, y.first_block AS next_block, CASE WHEN y.first_block <> x.last_block + 1 THEN 'height' WHEN y.first_ts < x.last_ts THEN 'time' WHEN y.old_root <> x.new_root THEN 'root' ELSE 'none' END AS fault FROM r x JOIN r y ON y.batch = x.batch + 1"""),
    "delta_sequence": sql("fills", body=""", c AS (SELECT taker AS account, market, CAST(sum(side * base) AS BIGINT) AS delta FROM fills WHERE ok % 2 <> 0 GROUP BY 1, 2 HAVING sum(side * base) <> 0),
g AS (SELECT account, count(*) AS n, string_agg(market || ':' || delta, ' ' ORDER BY market) AS entries FROM c GROUP BY account) SELECT account, account - coalesce(lag(account) OVER (ORDER BY account), 0) AS step, n, entries FROM g"""),
    "transaction_statuses": sql("samples", body=f", {ROWS} SELECT block AS block_number, CASE WHEN ok THEN 'applied' WHEN kind IN ('l1_withdraw', 'l1_create_order') THEN 'noop' ELSE 'violation' END AS status, count(*) AS n FROM judged GROUP BY 1, 2"),
    "transaction_balances": sql("samples", body=f""", {ROWS}, m AS (SELECT account, market AS asset, greatest(v - 1, 100) AS x FROM judged WHERE ok AND k = 2 UNION ALL SELECT account, market, -(v % 9) FROM judged WHERE ok AND k IN (3, 4) UNION ALL SELECT account, market, -(v % 5) FROM judged WHERE ok AND k = 1 UNION ALL SELECT account // 2, market, v % 5 FROM judged WHERE ok AND k = 1)
SELECT account, asset, CAST(sum(x) AS VARCHAR) AS amount FROM m GROUP BY 1, 2"""),
    "whitelist_faults": sql("samples", "accounts", body=f""", {ROWS} SELECT a.account % 3 AS account_type, kind, count(*) AS n FROM judged j JOIN accounts a ON j.account = a.account
WHERE NOT (coalesce(a.account % 3 = 0 AND kind IS NOT NULL, false) OR coalesce(a.account % 3 = 1 AND kind = 'l2_transfer', false)) GROUP BY 1, 2"""),
    "transaction_nonce_faults": sql("samples", body=f", {ROWS}, n AS (SELECT account AS account_index, key AS api_key_index, lag(seq) OVER (PARTITION BY account, key ORDER BY seq) AS before, seq AS nonce FROM rows) SELECT * FROM n WHERE nonce <> before + 1"),
    "book_account_orders": sql("book", body="SELECT market, price, nonce, base, base - CAST(nonce % 8 = 0 AS INTEGER) AS own_base, account, nonce % 8 <> 0 AS agrees FROM book WHERE nonce % 2 = 0"),
    "trade_parties": sql("fills", "accounts", body="SELECT t.nation AS taker_nation, m.nation AS maker_nation, f.nation AS fee_nation, count(*) AS n FROM fills JOIN accounts t ON t.account = taker JOIN accounts m ON m.account = maker JOIN accounts f ON f.account = 1 GROUP BY 1, 2, 3"),
    "pool_share_lookup": sql("accounts", "fills", body="SELECT a.account, a.nation AS pool, CAST(coalesce(sum(base), 0) AS BIGINT) AS shares FROM accounts a LEFT JOIN fills f ON f.taker = a.account AND f.market % 25 = a.nation AND f.taker % 2 = 0 GROUP BY 1, 2"),
    "impact_targets": sql("book", body=f", {TARGETS} SELECT market, is_ask, impact FROM impacts"),
    "impact_updates": sql("book", body=f""", {TARGETS},
o AS (SELECT market, min(price) AS bid, max(price) AS ask, coalesce(market % 3 > 0 AND market % 7 > 0 AND market % 11 > 0, false) AS onn FROM book GROUP BY market),
i AS (SELECT market, coalesce(max(impact) FILTER (WHERE is_ask = 1), 0) AS a, coalesce(max(impact) FILTER (WHERE is_ask = 0), 0) AS b FROM impacts GROUP BY market)
SELECT market, CASE WHEN onn THEN a ELSE ask END AS ask, CASE WHEN onn THEN b ELSE bid END AS bid, CASE WHEN onn AND a <> 0 AND b <> 0 THEN (a + b) // 2 ELSE 0 END AS mid FROM o JOIN i USING (market)"""),
    "wide_arithmetic": sql("fills", body=""", x AS (SELECT ok, ln, CAST(quote * side AS HUGEINT) AS a, CAST(base * 1000000 AS HUGEINT) AS b FROM fills)
SELECT ok, ln, CAST(abs(a - b) AS VARCHAR) AS abs_diff, CAST(abs(a) + abs(b) AS VARCHAR) AS abs_sum, CAST(-a AS VARCHAR) AS negated, CAST(sign(a - b) AS INTEGER) AS compared, CAST(least(a, b) AS VARCHAR) AS "least", CAST(greatest(a, b) AS VARCHAR) AS most,
 CAST(CASE WHEN abs(a) >= b THEN abs(a) - b ELSE 0 END AS VARCHAR) AS left_over, abs(a) < b AS borrow, CAST(a * ln + b AS VARCHAR) AS mul_add, abs(a) < 8388608 AS fits FROM x"""),
    "isolated_margin_changes": sql("fills", body=""", x AS (SELECT ok, ln, taker % 21 - 10 AS p, maker % 21 - 10 AS n, quote % 5000 + 1 AS al, quote % 7000 + 1 AS v, quote % 3000 AS nv, base AS r FROM fills)
SELECT ok, ln, CAST(CASE WHEN n = 0 THEN -greatest(al, 0) WHEN (p > 0) <> (n > 0) AND p <> 0 THEN r - nv WHEN abs(n) >= abs(p) THEN greatest(ln - (ln - 3), 0)
 ELSE -least(greatest(nv - greatest((v * abs(n) + abs(p) - 1) // abs(p), r), 0), greatest(al, 0)) END AS VARCHAR) AS moved FROM x"""),
    "staking_values": sql("accounts", body="SELECT account, CAST(CAST(account % 97 AS HUGEINT) * abs(collateral) // 7000 AS VARCHAR) AS value, CAST(CAST(abs(collateral) AS HUGEINT) * (account + 5) // (abs(collateral) % 1000 + 1) AS VARCHAR) AS burnable FROM accounts"),
    "mint_limits": sql("fills", body="SELECT ok, ln, (quote + base * 10000) * 100 <= (fee_rate * 5 + quote % 300000) * 600 AS may_mint FROM fills"),
    "hourly_windows": sql("samples", body="SELECT market, ts // 3600000 * 3600000 AS start, CAST(sum(value) AS BIGINT) AS total, count(*) AS n, min(value) AS least, max(value) AS most FROM samples GROUP BY 1, 2"),
    "hourly_averages": sql("samples", body="SELECT market, start, CAST(sign(t) AS BIGINT) * (abs(t) // 60) AS average FROM (SELECT market, ts // 3600000 * 3600000 AS start, CAST(sum(value) AS BIGINT) AS t FROM samples GROUP BY 1, 2)"),
    "log_stages": sql("samples", body="SELECT kind AS stage, count(*) AS n, round(sum(CASE WHEN event_id % 3 = 0 THEN abs(value) / 100.0 ELSE abs(value) / 1000.0 END), 3) AS seconds FROM samples WHERE event_id % 3 < 2 GROUP BY kind"),
    "wall_seconds": sql("samples", body="SELECT event_id, coalesce(nullif(CAST(event_id % 2 * abs(value) AS DOUBLE), 0), nullif(CAST(event_id % 3 * 10 AS DOUBLE), 0), event_id / 4.0) AS wall FROM samples"),
    "array_selection": sql("accounts", body="SELECT account, CASE WHEN account % 2 = 0 THEN account || ':' || nation ELSE '0:' || account * 2 END AS items FROM accounts"),
    "record_selection": sql("book", body="SELECT nonce, CASE WHEN is_ask = 1 THEN price ELSE -price END AS price, CASE WHEN is_ask = 1 THEN base ELSE base * 2 END AS size FROM book"),
    "last_child_orders": sql("book", body="SELECT account, coalesce(max(nonce) FILTER (WHERE is_ask = 1), 0) AS last_ask FROM book GROUP BY account"),
    "word_rotations": sql("book", body='SELECT nonce, ((nonce << 5) & 4294967295) | (nonce >> 27) AS left5, ((nonce << 27) & 4294967295) | (nonce >> 5) AS right5, 4294967295 - nonce AS inverted, nonce AS joined FROM book'),
    "packed_fields": sql("book", body="SELECT nonce, rpad(lower('07' || lpad(to_hex(account), 12, '0') || lpad(to_hex(price), 8, '0')), 24, '0') AS packed, bin(nonce) AS bits FROM book"),
}
