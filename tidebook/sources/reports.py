"""Telemetry documents as files, from their bytes to a partitioned report.

Documents lie under ``benchmark=../release=../machine=../run=<yyyymmdd-hhmmss>/``, one a file. They are read as bytes and known by their digests, so that
byte-identical copies count once, before anything is parsed; many small ones are better kept ``packed``. What can't be parsed or has no time is left out and can be listed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import schemas
from .telemetry import wall

KEYS = ["benchmark", "release", "machine", "run"]
REPORT = "release string, machine string, run string, n bigint, least double, most double, mean double, machines_for_10 double, minutes double, benchmark string"


def write_documents(rows: DataFrame, path: str, packed: bool = False) -> None:
    """Rows ``(benchmark, release, machine, run, document)`` as one file each; ``packed``: as rows of Parquet files in the same folders, so that the number of files doesn't grow with that of documents."""
    out = rows.select(*KEYS, F.col("document").alias("value"))
    if packed:
        out.write.partitionBy(*KEYS).parquet(path)
    else:
        out.write.partitionBy(*KEYS).option("maxRecordsPerFile", 1).text(path)


def read_documents(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """``(benchmark, release, machine, run, digest, copies, content)`` of the distinct documents under ``path``; of copies the first path gives the keys."""
    if packed:
        lines = spark.read.schema("value string").option("recursiveFileLookup", True).parquet(path)
        files = lines.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("content"))
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(path)
    ones = files.groupBy(F.sha2("content", 256).alias("digest")).agg(F.min_by(F.struct("path", "content"), "path").alias("f"), F.count("*").alias("copies"))
    key = lambda k: F.url_decode(F.regexp_extract("f.path", f"/{k}=([^/]*)/", 1)).alias(k)
    return ones.select(*map(key, KEYS), "digest", "copies", F.trim(F.col("f.content").cast("string")).alias("content"))


def summaries(documents: DataFrame) -> DataFrame:
    """The documents' fields and ``wall``, the time of each run; ``fault`` says why a document can't be used: ``json``, ``release`` (not a version), ``wall`` (no time) or null."""
    rows = documents.withColumn("s", F.from_json("content", schemas.SUMMARY, {"columnNameOfCorruptRecord": "corrupt"}))
    rows = rows.withColumn("wall", F.round(wall(F.col("s.pipelined_seconds"), F.col("s.wall_seconds"), F.col("s.total_txs"), F.col("s.tps")), 8).try_cast("decimal(18,8)"))
    broken = F.col("s").isNull() | ~F.col("content").rlike(r"\}$")
    fault = F.when(broken, "json").when(~F.col("release").rlike("^(v0\\.0|radix)"), "release").when(F.coalesce("wall", F.lit(0)) == 0, "wall")
    return rows.select(*KEYS, "digest", "copies", "wall", fault.alias("fault"))


def run_statistics(rows: DataFrame) -> DataFrame:
    """Statistics of the usable ``summaries`` by benchmark, release, machine and run; ``machines_for_10`` is the machines that ten blocks a second would take."""
    n = F.count("*")
    mean = F.round(F.sum("wall").cast("decimal(28,8)") / n, 8).cast("decimal(18,8)")
    out = rows.where("fault IS NULL").groupBy(*KEYS).agg(n.alias("n"), F.min("wall").alias("least"), F.max("wall").alias("most"), mean.alias("mean"))
    # quotients of decimals, so that halves are rounded up whatever the order of the sums
    out = out.withColumns({"machines_for_10": F.round(F.col("mean") * 10 / F.col("n"), 2), "minutes": F.round(F.col("mean") / 60, 8)})
    return out.select(*KEYS, "n", *(F.col(c).cast("double").alias(c) for c in ("least", "most", "mean", "machines_for_10", "minutes")))


def write_report(report: DataFrame, path: str) -> None:
    """The report as JSON and CSV, partitioned by benchmark; only the benchmarks that it has are overwritten."""
    for kind in ("json", "csv"):
        out = report.write.mode("overwrite").partitionBy("benchmark").option("partitionOverwriteMode", "dynamic")
        (out.option("header", True) if kind == "csv" else out).format(kind).save(f"{path}/{kind}")


def read_report(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """The report as it was written."""
    return spark.read.schema(REPORT).option("header", True).format(kind).load(f"{path}/{kind}")
