"""Maximal runs of consecutive batches, merged where every seam holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asof import as_of

PIECES = 64


def seams(batches: DataFrame) -> DataFrame:
    """``batches`` ``(first_block, last_block, first_ts, last_ts, old_root, new_root, ...)`` with ``fault``: why each doesn't follow the one before it (null: it does)."""
    before = batches.select((F.col("last_block") + 1).alias("first_block"), F.col("last_ts").alias("__ts"), F.col("new_root").alias("__root"))
    fault = F.when(F.col("__ts").isNull(), "height").when(F.col("__ts") > F.col("first_ts"), "time").when(~F.col("__root").eqNullSafe(F.col("old_root")), "root")
    return batches.join(before, "first_block", "left").withColumn("fault", fault).drop("__ts", "__root")


def merged_runs(batches: DataFrame, sums: list[str]) -> DataFrame:
    """One row a run: its blocks, times, roots, number of batches, the sums of the columns ``sums``, and the fault that it begins with.

    A run begins at each faulty seam. Blocks are cut into ``PIECES`` ranges; every batch finds its run's first block inside its own range, or in
    the ranges before it by a table of one row a range. Merging is associative, so runs are summed before the shuffle, however long.
    """
    rows = seams(batches)
    low, high = rows.agg(F.min("first_block"), F.max("first_block")).first()
    width = max(1, ((high or 0) - (low or 0)) // PIECES + 1)
    starts = rows.where("fault IS NOT NULL").select("first_block", F.col("first_block").alias("run"))
    placed = as_of(rows, starts, [], "first_block", "run", width)
    ends = {"first_ts": F.min_by("first_ts", "first_block"), "last_ts": F.max_by("last_ts", "first_block"), "old_root": F.min_by("old_root", "first_block"), "new_root": F.max_by("new_root", "first_block"), "fault": F.min_by("fault", "first_block")}
    return placed.groupBy("run").agg(F.max("last_block").alias("last_block"), F.count("*").alias("n_batches"), *(c.alias(n) for n, c in ends.items()), *(F.sum(c).alias(c) for c in sums)).withColumnRenamed("run", "first_block")
