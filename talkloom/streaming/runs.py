"""Streams from and to folders that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession

#: The state store that transformWithState asks for.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Portions that a table may arrive in: a loop over them runs on the driver.
MOST_PORTIONS = 100


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below spark.checkpoint.dir that nothing uses yet; only where that is
    unset and all runs in one process, below a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.sparkContext.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it wants it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, laid down as a Parquet table in the shared folder."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def with_state_store(spark: SparkSession) -> Iterator[None]:
    """Sets the state store for queries that start within."""
    key, value = STATE_STORE
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def spool(stream: DataFrame, path: str, checkpoint: str):
    """A streaming query that lays rows down as they come; a restart from the same
    checkpoint goes on without loss or repeats."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def _run(stream: DataFrame, path: str) -> None:
    """Processes all that has arrived, from where the last run to this path stopped."""
    with with_state_store(stream.sparkSession):
        query = spool(stream, path, f"{path}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def replayed(df: DataFrame, name: str, arrival: Column, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a streaming operator gives for the rows of df, as a table.

    Rows arrive in portions, by the whole number `arrival`, smallest first: each is
    written, and a run of the query from its checkpoint processes it, before the next
    comes. So state crosses micro-batches and restarts. Portions are few
    (MOST_PORTIONS); one may hold any number of rows, which no single task gathers."""
    spark = df.sparkSession
    arriving, out = new_folder(spark, name), new_folder(spark, f"{name}-out")
    portions = sorted(r[0] for r in df.select(arrival.alias("_portion")).distinct().limit(MOST_PORTIONS + 1).collect())
    if len(portions) > MOST_PORTIONS:
        raise ValueError(f"rows arrive in more than {MOST_PORTIONS} portions")
    fs, place = file_system(spark, arriving)
    fs.mkdirs(place)
    stream = operator(spark.readStream.schema(df.schema).parquet(arriving))
    for portion in portions:
        df.where(arrival == portion).write.mode("append").parquet(arriving)
        _run(stream, out)
    return spark.read.schema(stream.schema).parquet(out) if portions else spark.createDataFrame([], stream.schema)


def finished(stream: DataFrame, name: str) -> DataFrame:
    """All that a stream gives for what has arrived so far, as a table."""
    path = new_folder(stream.sparkSession, name)
    _run(stream, path)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
