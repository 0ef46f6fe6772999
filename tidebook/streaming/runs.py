"""Running streams over files: what is there is taken in, then the stream ends, and can be resumed from its checkpoint."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that ``spark.checkpoint.dir`` names; on one machine a temporary folder where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidebook-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def conf(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots as double underscores) for the time of a block."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    old = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """The Parquet files under ``path``, or the one file that it is, as a stream, ``files`` a batch at most (None: all that are there)."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        path = f"{path[:-1]}[{path[-1]}]"  # a stream takes a file only as what a pattern matches
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Take in what is there and append what comes out to ``path``; files that a failed batch left are ignored by readers of ``path``."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def versions(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``: each batch has a folder of its own, which a repeated batch overwrites, so that it counts once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def run_versions(stream: DataFrame, path: str, checkpoint: str) -> list[int]:
    """Take in what is there into ``versions`` of ``path``; the numbers of the batches that ran."""
    ran: list[int] = []
    write = versions(path)

    def sink(batch: DataFrame, number: int) -> None:
        ran.append(number)
        write(batch, number)

    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    return ran


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest version of each key among the batches under ``path``; without batches an empty table without columns."""
    try:
        rows = spark.read.option("basePath", path).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], "batch long")
    fields = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), "batch").alias("v")).select(*keys, "v.*")


def forget_commit(spark: SparkSession, checkpoint: str) -> int | None:
    """Take back the record that the last batch was committed, as if the driver had died between the sink's write and that record; the batch's number."""
    jvm = spark._jvm.org.apache.hadoop.fs
    folder = jvm.Path(f"{checkpoint}/commits")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    numbers = [int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit()]
    if not numbers:
        return None
    fs.delete(jvm.Path(f"{checkpoint}/commits/{max(numbers)}"), False)
    return max(numbers)
