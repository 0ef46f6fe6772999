"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Every row gets its global number r in key order; a seeded permutation p of 0..N-1 shuffles the
numbers, and p(r) gives shard ``p(r) % shards`` and slot ``p(r) // shards``. Anyone who knows r, N and
the seed can compute a row's place without reading data, and shard sizes differ by one row at most.

Null keys are numbered first; equal keys are numbered in the order of their text checksum and size,
so rows that tie in all of these are interchangeable. An empty table gives an empty result; null texts count as empty, very long ones
only by checksum and size, as texts are not moved; extra columns are carried along, but for ``shard`` and ``slot``, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

ROUNDS, SEED, PRIME = 6, 42, 4294967291


def halves(n: int) -> int:
    """Bits of each half of the smallest even-width block that holds ``n`` numbers."""
    return max(1, ((max(1, n - 1)).bit_length() + 1) // 2)


def round_key(k: int, seed: int = SEED) -> int:
    """The key of round ``k``."""
    return ((seed + 1) * 7919 + (k + 1) * 104729) * 15485863 % 1048573


def permuted(numbers: pd.Series, n: int, seed: int = SEED) -> pd.Series:
    """The Feistel permutation of 0..n-1; values that leave the range are sent through again."""
    bits = halves(n)
    mask = (1 << bits) - 1
    x = numbers.to_numpy("int64", copy=True)
    todo = x >= 0
    while todo.any():
        left, right = x[todo] >> bits, x[todo] & mask
        for k in range(ROUNDS):
            key = round_key(k, seed)
            left, right = right, left ^ (((right + key) * (right + key) % PRIME * 40503 >> 11) & mask)
        x[todo] = (left << bits) | right
        todo &= x >= n
    return pd.Series(x, index=numbers.index)


def numbered(df: DataFrame, *order: str, name: str = "row_number") -> DataFrame:
    """``df`` with the global row number (from 0) in ``order``, without a window over all rows.

    Rows are range-partitioned and sorted; each partition's row count is known after that, and the
    running sum of the counts (one row a partition) gives every partition's first number.
    """
    cols = [F.col(c).asc_nulls_first() for c in order]
    tagged = written(
        df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("__at", F.monotonically_increasing_id()), "numbered"
    ).withColumn("__part", F.shiftright("__at", 33))
    counts = {r["__part"]: r["n"] for r in tagged.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    first, total = {}, 0
    for part in sorted(counts):
        first[part], total = total, total + counts[part]
    spark = df.sparkSession
    firsts = spark.createDataFrame(list(first.items()) or [(0, 0)], "__part long, __first long")
    out = tagged.join(F.broadcast(firsts), "__part")
    return out.withColumn(name, F.col("__first") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__part", "__first", "__at")


def feistel_shards(df: DataFrame, shards: int, *order: str, seed: int = SEED) -> DataFrame:
    """``df`` with ``shard`` and ``slot`` of each row; columns of these names are replaced."""
    rows = numbered(df.drop("shard", "slot"), *order, name="__row")
    n = rows.count()

    def places(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for numbers in batches:
            yield permuted(numbers, n, seed)

    placed = rows.withColumn("__place", F.pandas_udf(places, "long")("__row"))
    return placed.withColumn("shard", (F.col("__place") % shards).cast("int")).withColumn("slot", F.expr(f"__place div {shards}")).drop("__row", "__place")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards under the law ``rows`` (a null text: no bytes)."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return feistel_shards(docs, 16, "doc_id", "text_crc32", "size").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def query_nocrc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without the checksum, which the SQL check engine lacks, and the column that this law leaves empty."""
    return query(spark, sf_dir).drop("text_crc32", "grown_shard")


def oracle() -> str:
    """The permutation in SQL: a recursive walk of every number until it is in range."""
    step = "SELECT r, a, b, n, h FROM x"
    for k in range(ROUNDS):
        key = round_key(k)
        step = f"SELECT r, b AS a, xor(a, (((b + {key}) * (b + {key}) % {PRIME} * 40503) >> 11) & ((1::BIGINT << h) - 1)) AS b, n, h FROM ({step})"
    half = "greatest(1, (length(bin(greatest(1, n - 1))) + 1) // 2)"
    return f"""
WITH RECURSIVE base AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
         row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM documents),
start AS (SELECT r, r AS p, n, CAST({half} AS BIGINT) AS h FROM base),
walk AS (
  SELECT r, p, n, h, 0 AS turn FROM start
  UNION ALL
  SELECT r, (a << h) | b AS p, n, h, 1 AS turn FROM (
    WITH x AS (SELECT r, p >> h AS a, p & ((1::BIGINT << h) - 1) AS b, n, h FROM walk WHERE turn = 0 OR p >= n) {step}))
SELECT doc_id, size, 'rows' AS law, CAST(p % 16 AS INTEGER) AS shard, CAST(p // 16 AS BIGINT) AS slot
FROM base JOIN walk USING (r) WHERE turn = 1 AND p < base.n
"""
