"""Risk kept up to date from what changed: positions and per-account sums as versions.

A version holds only the keys that it changed. Sums of cross positions (gain, funding, requirements, number) are differences: what the changed positions add now less
what they added before. So a batch reads the newest versions of its own accounts' keys, and writes these alone; nobody else's positions are summed again. A change of a market
changes the positions in that market.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.runs import shared_path
from .risk import SUMMED, cross_sums, position_terms, wide

NETS = "account long, market long, position long, net long"
SUMS = "account long, " + ", ".join(f"{c} decimal(38,0)" for c in SUMMED) + ", n_positions long"


class Versions:
    """Tables of net positions and of sums, as folders of versions in the shared folder; a repeated batch overwrites its own."""

    def __init__(self, spark: SparkSession, held: Callable[[DataFrame], DataFrame], path: str | None = None):
        self.spark, self.held, self.path, self.numbers = spark, held, path or shared_path(spark, "versions"), []

    def _read(self, kind: str, schema: str, among: DataFrame | None, on: list[str], before: int | None = None) -> DataFrame:
        """The newest version of each key, of those in ``among`` only (None: all) and before a version."""
        use = [n for n in self.numbers if before is None or n < before]
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{kind}/{n}").withColumn("v", F.lit(n)) for n in use]
        if not parts:
            return self.spark.createDataFrame([], schema)
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        rows = rows if among is None else rows.join(among, on, "left_semi")
        keys = ["account", "market"] if kind == "nets" else ["account"]
        fields = [c for c in rows.columns if c not in (*keys, "v")]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), "v").alias("s")).select(*keys, "s.*")

    def update(self, number: int, fills: DataFrame, old_markets: DataFrame, new_markets: DataFrame) -> None:
        """Take in a batch of fills and the markets as they are now; ``old_markets`` are those of the version before."""
        came = fills.groupBy(F.col("taker").alias("account"), "market").agg(F.sum(F.col("side") * F.col("base")).alias("position"), F.sum(F.col("side") * F.col("quote")).alias("net"))
        moved = new_markets.join(old_markets, new_markets.columns, "left_anti").select("market")
        own = self._read("nets", NETS, came.select("account", "market"), ["account", "market"], number)
        quoted = self._read("nets", NETS, moved, ["market"], number)
        before = own.unionByName(quoted).distinct().withColumn("old", F.lit(True))
        keys = ["account", "market"]
        both = before.select(*keys, F.col("position").alias("p0"), F.col("net").alias("n0"), "old").join(came, keys, "full")
        zero = F.lit(0).cast("long")
        both = both.select(*keys, "p0", "n0", "old", (F.coalesce("p0", zero) + F.coalesce("position", zero)).alias("position"), (F.coalesce("n0", zero) + F.coalesce("net", zero)).alias("net"))
        both.select(*keys, "position", "net", "p0", "n0", "old").write.mode("overwrite").parquet(f"{self.path}/changes/{number}")
        both = self.spark.read.parquet(f"{self.path}/changes/{number}")
        both.select(*keys, "position", "net").write.mode("overwrite").parquet(f"{self.path}/nets/{number}")
        sums = lambda nets, markets: cross_sums(position_terms(self.held(nets), markets), "account")
        plus = sums(both.select(*keys, "position", "net"), new_markets)
        minus = sums(both.where("old").select(*keys, F.col("p0").alias("position"), F.col("n0").alias("net")), old_markets)
        minus = minus.select("account", *(wide(-F.col(c)).alias(c) for c in SUMMED), (-F.col("n_positions")).alias("n_positions"))
        touched = both.select("account").distinct()
        rows = plus.unionByName(minus).unionByName(self._read("sums", SUMS, touched, ["account"], number))
        added = rows.groupBy("account").agg(*(wide(F.sum(c)).alias(c) for c in SUMMED), F.sum("n_positions").alias("n_positions"))
        added.write.mode("overwrite").parquet(f"{self.path}/sums/{number}")
        self.numbers = sorted({*self.numbers, number})

    def sums(self) -> DataFrame:
        """The newest sums of every account, as ``cross_sums`` would give them."""
        return self._read("sums", SUMS, None, ["account"])
