"""Premiums, funding rates and oracle updates of a market.

``samples`` has ``(market, ts, value)``; times are milliseconds. All divisions are of magnitudes with the sign put back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clamp, next_hour, sgn, to_hour, to_minute, trunc_div
from ..model.units import FUNDING_PERIODS, FUNDING_TICK, MAX_POSITION, MAX_PRICE, MINUTE_MS, PREMIUM_SAMPLES


def premium(bid: Column, ask: Column, index: Column) -> Column:
    """Premium of the impact prices (0: none, read as the index) over the index, in 1e-6."""
    b, a = F.when(bid == 0, index).otherwise(bid), F.when(ask == 0, index).otherwise(ask)
    zero = F.lit(0).cast("long")
    x = F.greatest(zero, b - index) - F.greatest(zero, index - a)
    return trunc_div(x * FUNDING_TICK, index)


def minute_premiums(samples: DataFrame, index: int) -> DataFrame:
    """One premium a market and minute: its last sample of even number is the impact bid, its last of odd number the ask (none: 0, read as the index)."""
    key, bid = F.struct("ts", "event_id"), F.col("event_id") % 2 == 0
    last = samples.groupBy("market", to_minute(F.col("ts")).alias("minute")).agg(F.max_by("value", F.when(bid, key)).alias("bid"), F.max_by("value", F.when(~bid, key)).alias("ask"))
    zero = F.lit(0).cast("long")
    return last.select("market", "minute", premium(F.coalesce("bid", zero), F.coalesce("ask", zero), F.lit(index).cast("long")).alias("premium"))


def premium_sums(minutes: DataFrame) -> DataFrame:
    """The running sum of premiums, reset every hour."""
    w = W.partitionBy("market", to_hour(F.col("minute"))).orderBy("minute").rowsBetween(W.unboundedPreceding, 0)
    return minutes.select("market", "minute", F.sum("premium").over(w).alias("premium_sum"))


def hourly_rate(total: Column, interest: int, small: int, big: int) -> Column:
    """The hour's funding rate: average over a fixed 60, pulled to the interest rate within ``small``, held within ``big``, an eighth paid."""
    avg = trunc_div(total, PREMIUM_SAMPLES)
    f = clamp(avg + clamp(F.lit(interest).cast("long") - avg, -small, small), -big, big)
    return sgn(f) * F.call_function("div", F.abs(f), F.lit(FUNDING_PERIODS).cast("long"))


def funding_prefix(minutes: DataFrame, index: int, interest: int = 100, small: int = 500, big: int = 40_000) -> DataFrame:
    """Hourly rate and the running sum of rate x index price, by market."""
    hours = minutes.groupBy("market", to_hour(F.col("minute")).alias("hour")).agg(F.sum("premium").alias("s"), F.count("*").alias("n"))
    rated = hours.select("market", "hour", "n", hourly_rate(F.col("s"), interest, small, big).alias("rate"))
    w = W.partitionBy("market").orderBy("hour").rowsBetween(W.unboundedPreceding, 0)
    return rated.select("market", "hour", "n", "rate", F.sum(F.col("rate") * index).over(w).alias("prefix"))


def funding_due(created: Column, last_funding: Column) -> Column:
    """Whether a whole hour began since the last funding."""
    return created >= next_hour(last_funding)


def premium_due(created: Column, last_premium: Column) -> Column:
    """Whether two whole minutes passed since the last premium."""
    return to_minute(created) - to_minute(last_premium) >= 2 * MINUTE_MS


def premium_permitted(created: Column, last_premium: Column) -> Column:
    """Whether the block is in a later minute than the last premium."""
    return to_minute(created) > to_minute(last_premium)


def due_flags(samples: DataFrame) -> DataFrame:
    """Each sample, against the one before it in its market: is funding due, is a premium due, is one permitted.

    The sample before is the last of the same hour, or of the nearest earlier hour that has samples, taken from a table of one row an hour.
    """
    rows = samples.withColumn("hour", to_hour(F.col("ts")))
    ends = rows.groupBy("market", "hour").agg(F.max("ts").alias("end"))
    ends = ends.select("market", "hour", F.lag("end").over(W.partitionBy("market").orderBy("hour")).alias("edge"))
    inside = F.lag("ts").over(W.partitionBy("market", "hour").orderBy("ts", "event_id"))
    rows = rows.select("market", "hour", "event_id", "ts", inside.alias("inside")).join(ends, ["market", "hour"]).withColumn("last", F.coalesce("inside", "edge")).where("last IS NOT NULL")
    return rows.select("market", "event_id", funding_due(F.col("ts"), F.col("last")).alias("funding"), premium_due(F.col("ts"), F.col("last")).alias("premium"), premium_permitted(F.col("ts"), F.col("last")).alias("permitted"))


def oracle_rule(index: Column, mark: Column, open_interest: Column, multiplier: int = 1) -> Column:
    """Whether an oracle update is taken: both prices set, and open interest x mark within the largest notional."""
    most = F.least(F.lit(MAX_PRICE), F.call_function("div", F.call_function("div", F.lit(MAX_POSITION), open_interest), F.lit(multiplier).cast("long")))
    return (index != 0) & (mark != 0) & F.when(open_interest > 0, mark <= most).otherwise(F.lit(True))


def hourly_ohlc(samples: DataFrame) -> DataFrame:
    """First, highest, lowest and last value of each market and hour."""
    key = F.struct("ts", "event_id")
    return samples.groupBy("market", to_hour(F.col("ts")).alias("hour")).agg(F.min_by("value", key).alias("first"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", key).alias("last"), F.count("*").alias("n"))
