"""Run telemetry: JSON summaries and text logs to grouped statistics, written as JSON and CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import schemas


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Summaries under a path (a glob), without byte-identical copies; ``run`` and ``machine`` come from the path.

    The path's last folders are ``<benchmark>/<release>/<machine>/<yyyymmdd-hhmmss>/``.
    """
    raw = spark.read.option("wholetext", True).text(path).withColumn("path", F.col("_metadata.file_path")).groupBy(F.sha2(F.col("value"), 256).alias("digest")).agg(F.min("path").alias("path"), F.any_value("value").alias("value"))
    at = lambda k: F.element_at(F.split("path", "/"), k)
    rows = raw.select(F.from_json("value", schemas.SUMMARY).alias("s"), at(-5).alias("benchmark"), at(-4).alias("release"), at(-3).alias("machine"), F.regexp_extract("path", r"(\d{8}-\d{6})", 1).alias("run"))
    return rows.select("benchmark", "release", "machine", "run", "s.*")


def wall(pipelined: Column, wall_seconds: Column, txs: Column, tps: Column) -> Column:
    """The first of pipelined time, wall time, and transactions over their rate, that is there and not 0."""
    return F.coalesce(F.nullif(pipelined, F.lit(0.0)), F.nullif(wall_seconds, F.lit(0.0)), txs / F.nullif(tps, F.lit(0.0)))


def grouped(summaries: DataFrame) -> DataFrame:
    """Shortest, longest and mean wall time and number of runs by benchmark, release, machine and run."""
    w = wall(F.col("pipelined_seconds"), F.col("wall_seconds"), F.col("total_txs"), F.col("tps"))
    return summaries.withColumn("w", w).groupBy("benchmark", "release", "machine", "run").agg(F.min("w").alias("least"), F.max("w").alias("most"), F.round(F.avg("w"), 8).alias("mean"), F.count("w").alias("n"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Stages and seconds of log lines like ``stage: time: 6.39s`` or ``stage: elapsed_ms=120``; other lines are dropped."""
    return parsed(spark.read.text(path))


def parsed(line: DataFrame) -> DataFrame:
    """The same from lines in the column ``value``."""
    seconds = F.coalesce(F.regexp_extract("value", r"time: ([0-9.]+)s", 1).try_cast("double"), F.regexp_extract("value", r"elapsed_ms\D+(\d+)", 1).try_cast("double") / 1000)
    return line.select(F.regexp_extract("value", r"^\s*([^:]+):", 1).alias("stage"), seconds.alias("seconds")).where("seconds IS NOT NULL")


def with_defaults(rows: DataFrame, defaults: DataFrame) -> DataFrame:
    """Configuration rows with nulls filled from the one row of defaults that has the same columns."""
    one = defaults.limit(1).select(*(F.col(c).alias(f"__{c}") for c in defaults.columns))
    joined = rows.join(F.broadcast(one))
    return joined.select(*(F.coalesce(c, f"__{c}").alias(c) if c in defaults.columns else F.col(c) for c in rows.columns))


def write_report(report: DataFrame, path: str) -> None:
    """The report as JSON and as CSV with a header."""
    report.write.mode("overwrite").json(f"{path}/json")
    report.write.mode("overwrite").csv(f"{path}/csv", header=True)
