"""Queries over the ordered log, transfers, unlocks and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import in_bits, to_hour
from ..operators import ledger, pools, positions
from ..sources.tables import accounts, fills, resting_orders, samples, sql

LOG = "log AS (SELECT event_id AS seq, ts, kind, account, value, event_id // 64 AS block FROM samples)"
SUMMARY = """summary AS (SELECT block, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, CAST(sum(value) AS BIGINT) AS amount, arg_max(value, seq) FILTER (WHERE value > 0) AS last_positive FROM log GROUP BY block)"""
NOW = 870_000_000_000


def _log(spark, d):
    return samples(spark, d).select(F.col("event_id").alias("seq"), "ts", "kind", "account", "value")


def _blocks(spark, d):
    return ledger.blocks(_log(spark, d), 64)


def _transfers(spark, d):
    return fills(spark, d).select(F.col("taker").alias("sender"), (F.col("maker") + 1_000_000).alias("receiver"), F.col("quote").alias("amount"))


def _unlocks(spark, d):
    return resting_orders(spark, d).select("account", "ts", F.col("nonce").alias("seq"), F.col("base").alias("amount"))


def _holdings(spark, d):
    pool = F.col("nation").cast("long")
    return accounts(spark, d).select(pool.alias("pool"), F.col("account").alias("holder"), (F.col("account") % 97 + 1).alias("shares"), (F.col("account") % 13 * 100_000).alias("principal"), (F.col("account") * 1000).alias("entered"), (pool * 10 + 1000).alias("total"), (F.abs("collateral") + 1).alias("tav"), F.lit(100_000).cast("long").alias("rate"), (F.col("account") % 50 == 0).alias("is_operator"))


QUERIES = {
    "pool_redemptions": lambda s, d: pools.redemptions(_holdings(s, d), 1_000_000, 300_000, 4).withColumns({"value": F.col("value").cast("long"), "fee": F.col("fee").cast("long")}),
    "merged_shares": lambda s, d: pools.merged_shares(accounts(s, d).select("account", F.col("nation").alias("pool"), (F.col("account") % 7).alias("shares")), fills(s, d).select(F.col("taker").alias("account"), (F.col("market") % 25).cast("int").alias("pool"), (F.col("side") * F.col("base")).alias("shares"))),
    "block_summaries": lambda s, d: ledger.block_summary(_blocks(s, d)),
    "block_batches": lambda s, d: ledger.batches(ledger.block_summary(_blocks(s, d)), 10),
    "sequence_continuity": lambda s, d: ledger.continuity(_log(s, d), 64),
    "kinds_more_than_once": lambda s, d: ledger.more_than_once(_blocks(s, d), "signup"),
    "kinds_by_hour": lambda s, d: ledger.kinds_by_hour(_log(s, d), to_hour(F.col("ts"))),
    "transfer_double_entry": lambda s, d: ledger.double_entry(_transfers(s, d), -1),
    "soft_withdrawals": lambda s, d: ledger.soft_withdrawals(fills(s, d).join(accounts(s, d), F.col("taker") == F.col("account")).select("account", (F.col("quote") - 500_000).alias("amount"), F.greatest(F.col("collateral"), F.lit(0).cast("long")).alias("available"))),
    "fifo_unlock_heads": lambda s, d: ledger.fifo_heads(_unlocks(s, d), NOW).fillna(0, ["head_ts", "head_amount"]),
    "delta_encoded_accounts": lambda s, d: ledger.delta_encoded(accounts(s, d), 128),
    "account_deltas": lambda s, d: positions.position_changes(fills(s, d), F.col("ok") % 2 == 0),
    "last_market_updates": lambda s, d: ledger.last_values(samples(s, d), ["market"], ["ts", "event_id"], ["ts", "value", "kind"]),
    "account_nonce_gaps": lambda s, d: ledger.nonce_gaps(_log(s, d)),
    "range_check_report": lambda s, d: ledger.rule_report(fills(s, d), {"base_5_bits": in_bits(F.col("base"), 5), "quote_23_bits": in_bits(F.col("quote"), 23), "fee_16_bits": in_bits(F.col("fee_rate"), 16), "own_account": F.col("taker") != F.col("maker")}),
    "operator_least_shares": lambda s, d: accounts(s, d).groupBy(F.col("nation").cast("long").alias("pool")).agg(F.max("collateral").alias("operator"), F.sum(F.abs("collateral")).alias("total")).withColumn("min_rate", F.lit(300).cast("long")).withColumn("enough", pools.holds_least(F.col("operator"), F.col("total"), F.col("min_rate"))),
}

SQL = {
    "pool_redemptions": sql("accounts", body=""", h AS (SELECT CAST(nation AS BIGINT) AS pool, account AS holder, CAST(account % 97 + 1 AS HUGEINT) AS shares, account % 13 * 100000 AS principal, account * 1000 AS entered, CAST(nation AS HUGEINT) * 10 + 1000 AS total, CAST(abs(collateral) AS HUGEINT) + 1 AS tav, account % 50 = 0 AS op FROM accounts),
v AS (SELECT *, shares * tav // total AS value FROM h)
SELECT pool, holder, CAST(value AS BIGINT) AS value, CAST(CASE WHEN op THEN 0 ELSE greatest(value - principal, 0) * 100000 * total // (tav * 1000000) END AS BIGINT) AS fee, op OR pool <> 4 OR 1000000 >= entered + 300000 AS free FROM v"""),
    "merged_shares": sql("accounts", "fills", body="""SELECT account, CAST(pool AS INTEGER) AS pool, CAST(sum(x) AS BIGINT) AS shares FROM (SELECT account, nation AS pool, account % 7 AS x FROM accounts UNION ALL SELECT taker, market % 25, side * base FROM fills) GROUP BY 1, 2 HAVING sum(x) <> 0"""),
    "block_summaries": sql("samples", body=f", {LOG}, {SUMMARY} SELECT * FROM summary"),
    "block_batches": sql("samples", body=f""", {LOG}, {SUMMARY} SELECT block // 10 AS batch, min(block) AS first_block, max(block) AS last_block, arg_min(first_ts, block) AS first_ts, arg_max(last_ts, block) AS last_ts, CAST(sum(n) AS BIGINT) AS n, CAST(sum(amount) AS BIGINT) AS amount, count(*) AS n_blocks, max(block) - min(block) + 1 = count(*) AS whole FROM summary GROUP BY 1"""),
    "sequence_continuity": sql("samples", body=f", {LOG} SELECT seq, ts < before AS backwards FROM (SELECT seq, ts, lag(ts) OVER (ORDER BY seq) AS before FROM log) WHERE before IS NOT NULL"),
    "kinds_more_than_once": sql("samples", body=f", {LOG} SELECT block, count(*) AS n FROM log WHERE kind = 'signup' GROUP BY block HAVING count(*) > 1"),
    "kinds_by_hour": sql("samples", body=f", {LOG} SELECT kind, ts // 3600000 * 3600000 AS hour, count(*) AS n, CAST(sum(value) AS BIGINT) AS amount FROM log GROUP BY 1, 2"),
    "transfer_double_entry": sql("fills", body=""", t AS (SELECT taker AS s, maker + 1000000 AS r, quote AS a, quote // 1000 AS f FROM fills)
SELECT CAST(account AS BIGINT) AS account, CAST(sum(x) AS BIGINT) AS balance FROM (SELECT s AS account, -a - f AS x FROM t UNION ALL SELECT r, a FROM t UNION ALL SELECT -1, f FROM t) GROUP BY 1"""),
    "soft_withdrawals": sql("fills", "accounts", body=""", r AS (SELECT quote - 500000 AS amount, greatest(collateral, 0) AS available FROM fills JOIN accounts ON taker = account)
SELECT CASE WHEN amount <= 0 THEN 'violation' WHEN amount <= available THEN 'applied' ELSE 'noop' END AS status, count(*) AS n, CAST(sum(CASE WHEN amount > 0 AND amount <= available THEN -amount ELSE 0 END) AS BIGINT) AS debit FROM r GROUP BY 1"""),
    "fifo_unlock_heads": sql("book", body=f"""SELECT account, coalesce(min(ts) FILTER (WHERE ts <= {NOW}), 0) AS head_ts, coalesce(first(base ORDER BY ts, nonce) FILTER (WHERE ts <= {NOW}), 0) AS head_amount, CAST(coalesce(sum(base) FILTER (WHERE ts <= {NOW}), 0) AS BIGINT) AS matured, CAST(coalesce(sum(base) FILTER (WHERE ts > {NOW}), 0) AS BIGINT) AS pending FROM book GROUP BY account"""),
    "delta_encoded_accounts": sql("accounts", body="SELECT account, account - coalesce(lag(account) OVER (ORDER BY account), 0) AS delta FROM (SELECT DISTINCT account FROM accounts)"),
    "account_deltas": sql("fills", body="SELECT taker AS account, market, CAST(sum(side * base) AS BIGINT) AS delta FROM fills WHERE ok % 2 <> 0 GROUP BY 1, 2 HAVING sum(side * base) <> 0"),
    "last_market_updates": sql("samples", body="SELECT market, ts, value, kind FROM samples QUALIFY row_number() OVER (PARTITION BY market ORDER BY ts DESC, event_id DESC) = 1"),
    "account_nonce_gaps": sql("samples", body=f", {LOG} SELECT account, count(*) AS n, min(seq) AS low, max(seq) AS high, max(seq) - min(seq) + 1 - count(*) AS missing FROM log GROUP BY account"),
    "range_check_report": sql("fills", body="""SELECT rule, count(*) AS violations FROM (SELECT unnest([CASE WHEN base > 31 THEN 'base_5_bits' END, CASE WHEN quote > 8388607 THEN 'quote_23_bits' END, CASE WHEN fee_rate > 65535 THEN 'fee_16_bits' END, CASE WHEN taker = maker THEN 'own_account' END]) AS rule FROM fills) WHERE rule IS NOT NULL GROUP BY rule"""),
    "operator_least_shares": sql("accounts", body="SELECT pool, operator, total, min_rate, operator * 10000 >= total * min_rate AS enough FROM (SELECT CAST(nation AS BIGINT) AS pool, max(collateral) AS operator, CAST(sum(abs(collateral)) AS BIGINT) AS total, CAST(300 AS BIGINT) AS min_rate FROM accounts GROUP BY 1)"),
}
