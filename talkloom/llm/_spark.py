"""Spark helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Keys that a broadcast may hold (16 bytes each).
HOT_KEYS = 1_000_000
#: Bytes of a row group of intermediate tables: writers hold one in memory.
ROW_GROUP = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, only where that
    is unset and all runs in one process (tests), a new temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(f"file://{found}")
        found = f"file://{found}"
    return found.rstrip("/")


def new_table(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: cuts
    the lineage, and survives the loss of any executor. The table lies in a folder
    of the application, which nobody needs once that has ended. A path of
    new_table() may be given, to write a table piece by piece."""
    path = path or new_table(df.sparkSession, name)
    df.write.mode("append").option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Has Spark delete the shuffle files of each write within as soon as it ends,
    not some time after the driver's garbage collection. No frame that shuffles may
    be run twice within."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Has Spark delete the shuffle files of each write within as soon as it ends,
    not some time after the driver's garbage collection. Nothing that is written
    here may be run again from the same frame."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def discard(df: DataFrame) -> None:
    """Removes the table of stored() that df reads and nothing else needs."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0].rsplit("/", 1)[0]) if df.inputFiles() else None
    if path is not None:
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Hands memory that a finished task's Python worker holds unused back to the
    system: workers are kept for later tasks, of other stages too."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def tidy(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """fn over a task's batches, then give_back(), once fn holds nothing more."""

    def run(batches):
        yield from fn(batches)
        give_back()

    return run


class Sets:
    """Disjoint sets of 0 .. n - 1."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, k: int) -> int:
        parent = self.parent
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    def join(self, i: int, j: int) -> bool:
        """Whether i and j were apart until now."""
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Cuts batches that are sorted by an integer `key` into one table a key; holds
    one group and one batch at most."""
    held: list[pa.Table] = []
    held_key = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        keys = table[key].to_numpy()
        cuts = [0, *(i + 1 for i in (keys[1:] != keys[:-1]).nonzero()[0]), len(keys)] if len(keys) else [0]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and keys[a] != held_key:
                yield pa.concat_tables(held)
                held = []
            held_key = keys[a]
            held.append(table.slice(a, b - a))
    if held:
        yield pa.concat_tables(held)


def map_groups(df: DataFrame, key: str, fn: Callable[[pa.Table], pa.RecordBatch | None], schema: str, order: list[str] = (), partitions: int | None = None) -> DataFrame:
    """Hash-partitions df by `key`, sorts, and applies fn to each key's rows. The
    partition number is left to Spark, so adaptive execution can size it, unless a
    group's work is no matter of its size."""

    def run(batches):
        for table in groups(batches, key):
            if (out := fn(table)) is not None:
                yield out

    dealt = df.repartition(partitions, key) if partitions else df.repartition(key)
    return dealt.sortWithinPartitions(key, *order).mapInArrow(tidy(run), schema)


def block_tasks(df: DataFrame, group: str, weight: str, member: str, limit: int) -> DataFrame:
    """Splits groups whose total `weight` exceeds `limit` into blocks that tasks
    compare two by two, so that no task holds more than about two blocks.

    Adds `block` (the row's own) and `task`, `task_a`, `task_b`: a task holds the
    blocks a <= b and compares a with b (within a, if they are equal). A row goes
    to one task in a group of one block, else to one for each block. `weight`
    must already hold the group's total."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col(weight) / F.lit(limit))).cast("int")
    return (
        df.withColumn("_blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64(F.lit(17), F.col(member)), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumn("task_a", F.least("block", "_other"))
        .withColumn("task_b", F.greatest("block", "_other"))
        .withColumn("task", F.xxhash64(F.lit(23), F.col(group), "task_a", "task_b"))
        .drop("_blocks", "_other")
    )


def scatter(df: DataFrame, key: str, buckets: int, rows: int, seed: int, into: str) -> DataFrame:
    """Deals the `rows` rows of df into `buckets` by a seeded hash of `key`, long
    column `into`. A key that holds more than an eighth of a bucket's share of rows
    is scattered by row position as well."""
    # no more than HOT_KEYS keys can be held so often: they are broadcast
    often = max(1, rows // min(8 * buckets, HOT_KEYS))
    hot = df.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n")).where(F.col("__n") > often).select("__key", F.lit(True).alias("__hot"))
    dealt = df.withColumn("__row", F.monotonically_increasing_id()).join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("__key")), "left")
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.when(F.col("__hot"), F.col("__row")).otherwise(0)), F.lit(buckets)).cast("long")
    return dealt.withColumn(into, bucket).drop("__row", "__key", "__hot")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of the undirected edges (u, v): one row (node, root)
    for each node, root the smallest node of its component.

    Alternates large-star and small-star contraction; every step is a min by node
    (combined before the shuffle) and a join, so that no node's neighbours are
    ever gathered. Each round is written to the shared folder. Loops and repeated
    edges are allowed; a node that has a loop alone is its own root."""
    nodes = edges.select(F.col("u").alias("node")).union(edges.select(F.col("v").alias("node")))
    e = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    before = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(low)
        e, old = stored(small.distinct(), name), e
        discard(old)
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
