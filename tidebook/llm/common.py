"""What the operators share: table reading, word normalisation, scratch tables and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_BYTES, HOT_ROWS, HOT_KEYS = 8_000_000, 1000, 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Lower-cased words (runs of letters and digits) joined by single spaces; null becomes empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def letters_of(text: Column) -> Column:
    """Lower-cased runs of letters joined by single spaces; null becomes empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " "))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine is a temporary folder set; elsewhere that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidebook-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def hash_bound(n: int, k: int) -> int:
    """A bound that all but surely at least ``k`` of ``n`` distinct 64-bit hashes do not exceed, and few more.

    Filtering by it before taking the ``k`` smallest keeps what tasks hand over small, however many tasks there are.
    """
    share = min(1.0, (k + 8 * k**0.5 + 16) / max(n, 1))
    return min(2**63 - 1, int(-(2**63) + share * 2**64))


def bounded(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches held to ``BATCH_BYTES``, so that a task's memory does not grow with the texts' lengths."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name) in ("-1", "-1b") or int(conf.get(name).rstrip("b")) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    This cuts lineage: what follows survives lost executors without recomputing, and later actions
    see one fixed set of rows.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_from(total: int) -> int:
    """A key of more of ``total`` rows than this is hot."""
    return max(HOT_ROWS, total // HOT_KEYS)


def spread_join(rows: DataFrame, values: DataFrame, key: str, by: str, total: int, largest: int | None = None) -> DataFrame:
    """The inner join of ``rows`` with ``values``, which has few rows a key, each with the key's number of ``rows`` as ``n``; ``n`` is dropped.

    A key of more than ``HOT_ROWS`` (and ``total`` / ``HOT_KEYS``) rows is split by a hash of the column ``by`` into pieces of about
    that many, and its value is repeated for each piece. Only hot keys and their counts are broadcast: at most ``HOT_KEYS`` rows
    of two numbers, as ``total`` is the number of ``rows`` (or more). No key has more than ``largest`` rows, if that is known; where none can be hot,
    it is a plain join, as each exchange costs the driver a stage and a thread.
    """
    most = hot_from(total)
    if min(total, total if largest is None else largest) <= most:
        return rows.drop("n").join(values.drop("n"), key)
    pieces = F.coalesce(F.ceil(F.col("n") / most), F.lit(1)).cast("int")
    hot = values.where(F.col("n") > most).select(key, "n").distinct()
    left = rows.join(F.broadcast(hot), key, "left").withColumn("__piece", F.pmod(F.xxhash64(by), pieces).cast("int")).drop("n")
    right = values.withColumn("__piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("n")
    return left.join(right, [key, "__piece"]).drop("__piece")


def edge_state(edges: DataFrame) -> tuple[int, int, int]:
    """The number of edges ``(u, v)``, the most that meet in one node, and a sum of the edges' hashes, by one query."""
    both = edges.select(F.explode(F.array("u", "v")).alias("id"), F.xxhash64("u", "v").cast("decimal(38,0)").alias("h"))
    found = both.groupBy("id").agg(F.count("*").alias("n"), F.sum("h").alias("h")).agg(F.sum("n"), F.max("n"), F.sum("h")).first()
    return (found[0] or 0) // 2, found[1] or 0, int(found[2] or 0)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list: rows ``(id, component)``.

    ``component`` is the smallest id reachable. Each round links the larger neighbours of every node
    to its smallest neighbour, then the smaller ones (large star and small star), until no edge
    changes; every round is written to the shared folder. Only ids with an edge are returned.
    Edges with a null end and self loops are ignored. Each node's minimum is found by an aggregate
    that combines before the shuffle and joined back, in pieces where it has very many neighbours, so that such a node is no single task's group.
    Both stars are written, so that the second's plan does not hold the first's several times.
    """
    now = written(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges",
    )
    state, before = edge_state(now), None
    while state[0] and state != before:
        total, largest = 2 * state[0], state[1]
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = spread_join(both, least, "u", "v", total, largest).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))  # a node has as many rows as smaller neighbours, at most
        small = spread_join(large, least, "u", "v", total, largest).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, state = state, edge_state(now)
    found = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    roots = found.select(F.col("component").alias("id"), "component").distinct()
    return found.unionByName(roots)
