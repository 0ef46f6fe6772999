"""Batches, sequences, deltas, transfers, unlocks and transaction rules: operators over the ordered log.

``log`` has ``(seq, ts, kind, account, value)``: ordered rows with an integer amount.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .debits import written


def blocks(log: DataFrame, size: int) -> DataFrame:
    """The log cut into groups of ``size`` consecutive rows."""
    return log.withColumn("block", F.call_function("div", F.col("seq"), F.lit(size).cast("long")))


def block_summary(log: DataFrame) -> DataFrame:
    """One row a block: first and last time, row count, amount, and the last payload of the flagged rows (value over 0)."""
    return log.groupBy("block").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"), F.sum("value").alias("amount"), F.max_by("value", F.when(F.col("value") > 0, F.col("seq"))).alias("last_positive"))


def batches(summary: DataFrame, size: int) -> DataFrame:
    """Consecutive blocks merged: first of the first, last of the last, sums; ``whole`` if no block is missing."""
    b = F.call_function("div", F.col("block"), F.lit(size).cast("long"))
    merged = summary.groupBy(b.alias("batch")).agg(F.min("block").alias("first_block"), F.max("block").alias("last_block"), F.min_by("first_ts", "block").alias("first_ts"), F.max_by("last_ts", "block").alias("last_ts"), F.sum("n").alias("n"), F.sum("amount").alias("amount"), F.count("*").alias("n_blocks"))
    return merged.withColumn("whole", F.col("last_block") - F.col("first_block") + 1 == F.col("n_blocks"))


def edges(groups: DataFrame, value: str, parts: int = 64) -> DataFrame:
    """``(g, edge)``: for each group number ``g`` the ``value`` of the nearest earlier group, by windows over ``parts`` ranges of groups and one over the ranges. The groups are written, so that they are worked out once."""
    groups = written(groups.select("g", value), "groups")
    low, high = groups.agg(F.min("g"), F.max("g")).first()
    width = max(1, ((high or 0) - (low or 0)) // parts + 1)
    rows = groups.select("g", value, F.call_function("div", F.col("g") - (low or 0), F.lit(width).cast("long")).alias("part"))
    ends = rows.groupBy("part").agg(F.max_by(value, "g").alias("last"))  # at most as many rows as parts
    before = ends.select("part", F.lag("last").over(W.orderBy("part")).alias("before"))
    inside = F.lag(value).over(W.partitionBy("part").orderBy("g"))
    return rows.withColumn("inside", inside).join(F.broadcast(before), "part").select("g", F.coalesce("inside", "before").alias("edge"))


def continuity(log: DataFrame, group: int) -> DataFrame:
    """Rows whose time is before that of the row before, found per group of ``group`` rows and across the groups' edges.

    The row before is the last of the same group, or of the nearest earlier group that has rows; no window holds the whole log.
    """
    g = blocks(log, group)
    inside = F.lag("ts").over(W.partitionBy("block").orderBy("seq"))
    rows = g.select("seq", "ts", "block", inside.alias("before"))
    ends = edges(g.groupBy(F.col("block").alias("g")).agg(F.max_by("ts", "seq").alias("last")), "last")
    joined = rows.join(ends.withColumnRenamed("g", "block"), "block", "left").withColumn("before", F.coalesce("before", "edge"))
    return joined.select("seq", (F.col("ts") < F.col("before")).alias("backwards")).where("backwards IS NOT NULL")


def more_than_once(log: DataFrame, kind: str) -> DataFrame:
    """Blocks that hold a kind of row more than once, which a rule forbids."""
    return log.where(F.col("kind") == kind).groupBy("block").agg(F.count("*").alias("n")).where("n > 1")


def kinds_by_hour(log: DataFrame, hour: Column) -> DataFrame:
    """Rows and amounts by kind and hour."""
    return log.groupBy("kind", hour.alias("hour")).agg(F.count("*").alias("n"), F.sum("value").alias("amount"))


def double_entry(transfers: DataFrame, fee_account: int, fee_parts: int = 1000) -> DataFrame:
    """Balances from transfers ``(sender, receiver, amount)``: four signed rows each, which sum to 0 over all accounts."""
    fee = F.call_function("div", F.col("amount"), F.lit(fee_parts).cast("long"))
    row = lambda account, amount: F.struct(account.alias("account"), amount.alias("amount"))
    rows = F.array(row(F.col("sender"), -F.col("amount")), row(F.col("sender"), -fee), row(F.col("receiver"), F.col("amount")), row(F.lit(fee_account).cast("long"), fee))
    return transfers.select(F.inline(rows)).groupBy("account").agg(F.sum("amount").alias("balance"))


def soft_withdrawals(requests: DataFrame) -> DataFrame:
    """Withdrawal requests ``(account, amount, available)`` by outcome: debited if the balance suffices, else a no-op."""
    ok = (F.col("amount") > 0) & (F.col("amount") <= F.col("available"))
    status = F.when(F.col("amount") <= 0, "violation").when(ok, "applied").otherwise("noop")
    return requests.groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.sum(F.when(ok, -F.col("amount")).otherwise(F.lit(0).cast("long"))).alias("debit"))


def fifo_heads(unlocks: DataFrame, now: int) -> DataFrame:
    """For each account the oldest matured unlock and the sums matured and pending; ``(account, ts, seq, amount)``."""
    ready = F.col("ts") <= now
    head = F.min(F.when(ready, F.struct("ts", "seq", "amount")))
    zero = F.lit(0).cast("long")
    out = unlocks.groupBy("account").agg(head.alias("h"), F.sum(F.when(ready, F.col("amount")).otherwise(zero)).alias("matured"), F.sum(F.when(~ready, F.col("amount")).otherwise(zero)).alias("pending"))
    return out.select("account", F.col("h.ts").alias("head_ts"), F.col("h.amount").alias("head_amount"), "matured", "pending")


def delta_encoded(accounts: DataFrame, group: int = 4096) -> DataFrame:
    """Sorted distinct account numbers as differences from the one before (the first: from 0).

    The account before is the last of the same group of ``group`` numbers, or of the nearest earlier group.
    """
    a = accounts.select("account").distinct().withColumn("g", F.call_function("div", F.col("account"), F.lit(group).cast("long")))
    inside = F.lag("account").over(W.partitionBy("g").orderBy("account"))
    edge = edges(a.groupBy("g").agg(F.max("account").alias("last")), "last")
    rows = a.select("account", "g", inside.alias("before")).join(edge, "g")
    return rows.select("account", (F.col("account") - F.coalesce("before", "edge", F.lit(0).cast("long"))).alias("delta"))


def account_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """Net change of every account and market between two states of ``(account, market, position)``, without zeros."""
    return state_deltas(before, after, ["account", "market"], "position")


def state_deltas(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Net change of ``value`` by ``keys`` between two states, without zeros: of positions by market, balances by asset, or shares by pool."""
    kind = after.schema[value].dataType
    both = after.select(*keys, F.col(value).alias("d")).unionByName(before.select(*keys, (-F.col(value)).cast(kind).alias("d")))
    return both.groupBy(*keys).agg(F.sum("d").cast(kind if kind.typeName() == "decimal" else "long").alias("delta")).where("delta <> 0")


def not_rising(rows: DataFrame, group: int) -> DataFrame:
    """Rows ``(seq, account)`` of a list that must be sorted and without repeats, whose account is not above that of the row before; with that one as ``before``.

    Found per group of ``group`` rows and across the groups' edges, like ``continuity``.
    """
    g = blocks(rows, group)
    inside = F.lag("account").over(W.partitionBy("block").orderBy("seq"))
    ends = edges(g.groupBy(F.col("block").alias("g")).agg(F.max_by("account", "seq").alias("last")), "last")
    joined = g.select("seq", "account", "block", inside.alias("before")).join(ends.withColumnRenamed("g", "block"), "block", "left").withColumn("before", F.coalesce("before", "edge"))
    return joined.where("account <= before").select("seq", "account", "before")


def last_values(updates: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The last update of each key."""
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("v")).select(*keys, "v.*")


def last_fields(updates: DataFrame, keys: list[str], order: str, fields: list[str]) -> DataFrame:
    """The last value of each field of each key, where updates set some fields and leave the others null; without keys, one row."""
    return updates.groupBy(*keys).agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields))


def nonce_gaps(log: DataFrame) -> DataFrame:
    """For each account the rows, the lowest and highest number and how many numbers between them are missing."""
    return log.groupBy("account").agg(F.count("*").alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high")).withColumn("missing", F.col("high") - F.col("low") + 1 - F.col("n"))


def rule_report(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Violations by rule, in one pass: an array of the broken rules is exploded and counted."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(F.explode(broken).alias("rule")).groupBy("rule").agg(F.count("*").alias("violations"))
