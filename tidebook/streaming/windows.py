"""Tumbling windows over oracle samples; lateness is bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(samples: DataFrame, ts: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Sum, count, least and greatest ``value`` by market and window; works on batches and streams alike."""
    rows = samples.withWatermark(ts, late) if samples.isStreaming else samples
    out = rows.groupBy("market", F.window(ts, width)).agg(F.sum("value").alias("total"), F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    return out.select("market", F.col("window.start").alias("start"), "total", "n", "least", "most")


def funding_hours(premiums: DataFrame, ts: str, late: str = "10 minutes") -> DataFrame:
    """The hour's premium sum over the fixed 60, rounded toward zero, by market."""
    out = tumbling(premiums, ts, "1 hour", late)
    avg = F.when(F.col("total") < 0, -F.call_function("div", -F.col("total"), F.lit(60).cast("long"))).otherwise(F.call_function("div", F.col("total"), F.lit(60).cast("long")))
    return out.select("market", "start", avg.alias("average"))
