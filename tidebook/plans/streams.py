"""Queries that run streams over files, until all that is there is taken in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import fills, ordered_fills, samples, sql, timer_arms
from ..streaming import positions, runs, timers
from .positions import SQL as POSITION_SQL


def _timers(spark: SparkSession, d: str) -> DataFrame:
    out = runs.shared_path(spark, "timers")
    arms = timer_arms(runs.read_stream(spark, f"{d}/orders.parquet"), runs.read_stream(spark, f"{d}/events.parquet"))
    with runs.conf(spark, spark__sql__streaming__stateStore__providerClass=runs.ROCKSDB):
        runs.run_to_files(timers.timer_fires(arms), out, f"{out}-checkpoint")
    return spark.read.schema(timers.FIRED).parquet(out)


def _resumed(spark: SparkSession, d: str) -> DataFrame:
    """Half of the fills, in five markets; the last batch again, as after a crash; then the other half."""
    place = runs.shared_path(spark, "fills")
    rows = ordered_fills(fills(spark, d)).withColumn("market", F.col("market") % 5)
    low, high = rows.agg(F.min("seq"), F.max("seq")).first()
    middle = ((low or 0) + (high or 0)) // 2
    rows.where(F.col("seq") < middle).write.parquet(f"{place}/in/part=0")
    fold = lambda: runs.run_versions(positions.fold_positions(runs.read_stream(spark, f"{place}/in")), f"{place}/out", f"{place}/checkpoint")
    fold()
    runs.forget_commit(spark, f"{place}/checkpoint")
    rows.where(F.col("seq") >= middle).write.parquet(f"{place}/in/part=1")
    fold()
    return runs.latest(spark, f"{place}/out", ["account", "market"]).drop("late")


def _late(spark: SparkSession, d: str) -> DataFrame:
    """Events as fills that come in three shuffled parts, a part a batch; those that a later row of their key overtook."""
    place = runs.shared_path(spark, "events")
    rows = samples(spark, d).select("account", "market", F.col("event_id").alias("seq"), (F.col("event_id") % 7 - 3).alias("d"), F.abs("value").alias("q"))
    for part in range(3):
        rows.where(F.pmod(F.col("seq") * 7, F.lit(3 * 64)).between(part * 64, part * 64 + 63)).write.parquet(f"{place}/in/part={part}")
        runs.run_versions(positions.fold_positions(runs.read_stream(spark, f"{place}/in")), f"{place}/out", f"{place}/checkpoint")
    return positions.late_rows(spark.read.parquet(f"{place}/out"))


QUERIES = {"timer_fires": _timers, "resumed_positions": _resumed, "late_rows": _late}
SQL = {
    "resumed_positions": POSITION_SQL["entry_quotes"].replace("account, market, ts, ok, ln, side", "account, market % 5 AS market, ts, ok, ln, side").replace("SELECT -maker - 2, market,", "SELECT -maker - 2, market % 5,").replace("CAST(r AS VARCHAR) AS realised FROM", "CAST(r AS VARCHAR) AS realised, n FROM"),
    "timer_fires": sql("book", "samples", "arms", body=""", n AS (SELECT *, coalesce(lead(ts) OVER (PARTITION BY kind, account, id ORDER BY ts, due), (SELECT max(ts) FROM arms)) AS after FROM arms)
SELECT kind, account, id, due FROM n WHERE due <> 0 AND due <= after"""),
    "late_rows": sql("samples", body=""", p AS (SELECT account, market, event_id AS seq, event_id * 7 % 192 // 64 AS part FROM samples),
b AS (SELECT *, max(seq) OVER (PARTITION BY account, market ORDER BY part RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM p) SELECT account, market, seq FROM b WHERE seq <= done"""),
}
