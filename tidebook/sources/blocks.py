"""Block documents: one JSON document a block, its transactions in order, its accounts with sparse positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nil_to_null
from ..model import schemas, units


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks under a path, one document a file."""
    return spark.read.schema(schemas.BLOCK).option("multiLine", True).json(path)


def parsed(lines: DataFrame) -> DataFrame:
    """Blocks from JSON documents in the column ``value``."""
    return lines.select(F.from_json("value", schemas.BLOCK).alias("b")).select("b.*")


def transactions(blocks: DataFrame) -> DataFrame:
    """One row a transaction with its place in the block and the name of its type; sentinels are null."""
    names = F.create_map(*[x for name, code in units.TX_TYPES.items() for x in (F.lit(code).cast("long"), F.lit(name))])
    rows = blocks.select("block_number", "created_at", F.posexplode("txs").alias("position", "tx"))
    rows = rows.select("block_number", "created_at", "position", "tx.*")
    return rows.withColumns({"kind": F.try_element_at(names, F.col("tx_type")), "account_index": nil_to_null(F.col("account_index"), units.NIL_ACCOUNT), "api_key_index": nil_to_null(F.col("api_key_index"), units.NIL_API_KEY)})


def positions(blocks: DataFrame) -> DataFrame:
    """One row a position that is not empty: the sparse map is exploded, never filled up."""
    accounts = blocks.select("block_number", F.explode("accounts").alias("a"))
    rows = accounts.select("block_number", F.col("a.account_index").alias("account"), F.explode("a.positions").alias("market", "p"))
    return rows.select("block_number", "account", F.col("market").cast("long").alias("market"), "p.*").where("position <> 0")


def continuity(blocks: DataFrame) -> DataFrame:
    """Blocks whose predecessor is missing, later in time or ends in another state; a self join on the number, no global window."""
    before = blocks.select((F.col("block_number") + 1).alias("block_number"), F.col("created_at").alias("t"), F.col("new_state_root").alias("root"))
    first = blocks.agg(F.min("block_number").alias("first"))
    rows = blocks.join(before, "block_number", "left").join(F.broadcast(first))
    fault = F.when(F.col("t").isNull(), "missing").when(F.col("created_at") < F.col("t"), "backwards").when(F.col("old_state_root") != F.col("root"), "state")
    return rows.where(F.col("block_number") > F.col("first")).select("block_number", fault.alias("fault")).where("fault IS NOT NULL")
