"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source with target share w and n of the N rows has the mean repetition rate w N / n. Each document
draws its count from the Poisson distribution of that mean, by inverting the distribution at a number
in (0, 1) hashed from seed and identifier, is repeated that often, and all copies are sorted by a hash.
Nothing is random: a lost task that runs again draws the same counts.

Rates have no upper end: one above ``MOST_RATE`` is split into the fewest equal parts that are not, as Poisson counts add
up; each part draws at a number of its own, hashed from seed, identifier and part (the first part without its number). A
part's count is found by bisection in its source's cumulative distribution, which has some 800 steps at most.

Shuffle: the sort key is a uniform 48-bit hash, so its ranges are known beforehand. Copies are dealt to the range of their
key and sorted there: one pass and one shuffle, without a sample of the keys.

Defined cases: a null source is a source of its own; a null identifier is hashed as empty text, so
such rows of one source share a draw, as do rows that repeat an identifier within a source; sources without a weight (when weights are given) have rate 0;
an empty table gives an empty one; null, empty and very long texts are carried along like other columns, whatever
their names, but for ``copy`` and ``shuffle_key``, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SEED, POWER, MOST_RATE, DIGITS, STEPS, RUN = 42, 0.5, 500.0, 12, 2_000_000, 4096


def hashed(*parts: Column) -> Column:
    """A 48-bit number hashed from the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, DIGITS), 16, 10).cast("long")


def rates(df: DataFrame, weights: dict[str | None, float] | None = None, power: float = POWER) -> DataFrame:
    """Rows ``(source, n, rate, parts, ladder)``; ``ladder`` holds the cumulative distribution of one of ``parts`` equal parts from count 0 on.

    Without ``weights`` the target share of a source is in proportion to n to the ``power``.
    """
    counts = df.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        counts = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(power)))
    else:
        given = df.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()] or [(None, 0.0)], "s string, w double")
        counts = counts.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumn("w", F.coalesce("w", F.lit(0.0)))
    whole = counts.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()
    rate = F.col("w") / F.lit(whole["w"]) * F.lit(whole["n"]) / F.col("n") if whole["w"] else F.lit(0.0)
    known = counts.withColumn("rate", rate).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST_RATE)).cast("long")).withColumn("part", F.col("rate") / F.col("parts"))
    most = F.ceil(F.col("part") + 12 * F.sqrt("part") + 30).cast("int")
    first = F.exp(-F.col("part"))
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("ladder"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * F.col("part") / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["ladder"], F.array(acc["c"] + p)).alias("ladder"))

    return known.select("source", "n", "rate", "parts", F.aggregate(F.sequence(F.lit(1), most), start, step)["ladder"].alias("ladder"))


def below(ladder: Column, u: Column) -> Column:
    """How many of the ascending ``ladder``'s values are below ``u``, by bisection."""
    steps = F.array(*[F.lit(1 << k) for k in range(10, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.coalesce(F.get(ladder, at + s - 1) < u, F.lit(False)), at + s).otherwise(at))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as keep them apart from the columns of ``df``."""
    taken, mark = {c.lower() for c in df.columns}, "__"
    while any(f"{mark}{n}" in taken for n in names):
        mark += "_"
    return [f"{mark}{n}" for n in names]


def poisson_mix(df: DataFrame, weights: dict[str | None, float] | None = None, power: float = POWER, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """``df`` with each row repeated by its draw and shuffled globally.

    Adds ``copy`` (from 0) and ``shuffle_key``, by which the result is sorted. The table of sources is
    broadcast only if its ladders have at most ``STEPS`` steps in all, which take 16 MB; beyond, it is joined by source.
    """
    own, parts_, ladder, n_, first = free_names(df, "source", "parts", "ladder", "n", "first")
    known = rates(df, weights, power).where(F.col("ladder")[0] < 1)
    known = known.select(F.col("source").alias(own), F.col("parts").alias(parts_), F.col("ladder").alias(ladder))
    steps = known.agg(F.sum(F.size(ladder) + 8)).first()[0] or 0
    known = F.broadcast(known) if steps <= STEPS else known
    draws = F.transform(F.sequence(F.lit(0).cast("long"), F.col(parts_) - 1), lambda p: (F.when(p == 0, hashed(F.lit(seed), F.col(key))).otherwise(hashed(F.lit(seed), F.col(key), p)) + F.lit(0.5)) / F.lit(float(16**DIGITS)))
    n = F.aggregate(draws, F.lit(0).cast("long"), lambda acc, u: acc + below(F.col(ladder), u))
    drawn = df.drop("copy", "shuffle_key").join(known, F.col("source").eqNullSafe(F.col(own))).withColumn(n_, n).drop(ladder, own, parts_)
    # in runs, so that no array holds all copies of a document
    starts = F.when(F.col(n_) > 0, F.sequence(F.lit(0).cast("long"), F.col(n_) - 1, F.lit(RUN).cast("long")))
    runs = drawn.withColumn(first, F.explode(starts))
    copies = runs.withColumn("copy", F.explode(F.sequence(F.col(first), F.least(F.col(first) + RUN, F.col(n_)) - 1))).withColumn("copy", F.col("copy").cast("int")).drop(n_, first)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = copies.withColumn("shuffle_key", hashed(F.lit(seed + 1), F.col(key), F.col("copy")))
    return keyed.repartitionById(parts, F.floor(F.col("shuffle_key") / F.lit(float(16**DIGITS)) * parts).cast("int")).sortWithinPartitions("shuffle_key", key, "copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to shares in proportion to the square root of their source's size."""
    return poisson_mix(table(spark, sf_dir, "documents"))


def oracle(power: float = POWER) -> str:
    """The same in SQL; the recursion sums each source's distribution."""
    number = "CAST('0x' || substr(md5({0}), 1, 12) AS BIGINT)"
    return f"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n, pow(CAST(count(*) AS DOUBLE), {power}) AS w FROM documents GROUP BY source),
whole AS (SELECT source, w / (SELECT sum(w) FROM counts) * (SELECT sum(n) FROM counts) / n AS rate FROM counts),
rates AS (SELECT source, CAST(greatest(1, ceil(rate / {MOST_RATE})) AS BIGINT) AS parts, rate / greatest(1, ceil(rate / {MOST_RATE})) AS rate FROM whole),
ladder AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM ladder WHERE k < ceil(rate + 12 * sqrt(rate) + 30)),
parts AS (SELECT d.doc_id, d.source, unnest(range(0, parts)) AS part FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
drawn AS (SELECT *, ({number.format("concat_ws('|', '42', coalesce(CAST(doc_id AS VARCHAR), ''), CASE WHEN part > 0 THEN CAST(part AS VARCHAR) END)")} + 0.5) / {float(16**DIGITS)} AS u FROM parts),
counted AS (SELECT d.doc_id, count(*) FILTER (WHERE l.c < d.u) AS n FROM drawn d JOIN ladder l ON d.source IS NOT DISTINCT FROM l.source GROUP BY d.doc_id),
copies AS (SELECT doc_id, unnest(range(0, n)) AS copy FROM counted WHERE n > 0)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(copy AS INTEGER) AS copy,
       {number.format("concat_ws('|', '43', CAST(doc_id AS VARCHAR), CAST(copy AS VARCHAR))")} AS shuffle_key
FROM copies JOIN documents d USING (doc_id)
"""
