"""Operator 1: two-pass external shuffle into shards.

Pass one scatters the rows uniformly into memory-sized buckets by a seeded hash;
pass two shuffles each bucket (Fisher-Yates) and writes it. The buckets, one
after another, are a random permutation of the table, and each shard is a
contiguous run of it: shard sizes are at most one row apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import groups, scatter, stored, tidy

SEED = 20_240_607
#: Text bytes a bucket holds on average; a task needs about three times that.
BUCKET_BYTES = 64 << 20
#: Tasks that shuffle at most, each bucket after bucket: map tasks times these are
#: the blocks of the shuffle.
MAX_TASKS = 20_000
#: Text bytes handed back to Spark at once, or one row.
BATCH_BYTES = 4 << 20


def _fisher_yates(seed: int):
    def shuffle(batches):
        # a bucket's rows come sorted, so that its order depends on the seed alone
        for table in groups(batches, "__bucket"):
            rows = np.arange(len(table))
            np.random.default_rng([seed, table["__bucket"][0].as_py()]).shuffle(rows)
            upto = np.cumsum(table["__size"].to_numpy()[rows])
            at = 0
            while at < len(rows):
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BATCH_BYTES, "right")))
                out = table.take(pa.array(rows[at:end])).drop_columns(["__id", "__crc", "__size"])
                yield from out.append_column("__place", pa.array(np.arange(at, end))).combine_chunks().to_batches()
                at = end

    return shuffle


def shard_rows(table: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows of `table`, each with `shard` (int, 0 to shards - 1) and `slot`
    (long, gapless from 0 in its shard): a uniform random order for the seed.

    All rows stay, whole: nulls in any column, empty and long texts, and repeated
    rows, each of which gets a slot of its own. Columns named shard or slot are
    replaced. A key that holds more than an eighth of a bucket's share of rows is
    scattered by row position as well; a row's place then depends on the layout of
    the files read, otherwise on its key, its text and the seed alone. An empty table
    gives an empty result."""
    table = table.drop("shard", "slot")
    columns = table.columns
    size = F.octet_length(F.coalesce(F.col(text).cast("string"), F.lit(""))) + 1
    rows, total = table.agg(F.count("*"), F.sum(size.cast("long"))).first()
    n_buckets = max(1, -(-(total or 0) // bucket_bytes))
    scattered = scatter(table, key, n_buckets, rows, seed, "__bucket").withColumns(
        {"__id": F.xxhash64(F.lit(seed + 1), F.col(key)), "__crc": F.crc32(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")), "__size": size.cast("long")}
    )
    schema = scattered.drop("__id", "__crc", "__size").withColumn("__place", F.lit(0).cast("long")).schema
    tasks = min(n_buckets, MAX_TASKS)
    dealt = scattered.repartitionById(tasks, (F.col("__bucket") % tasks).cast("int")).sortWithinPartitions("__bucket", "__id", "__crc")
    written = stored(dealt.mapInArrow(tidy(_fisher_yates(seed)), schema), "shards")
    # one row a bucket: 16 bytes for each bucket_bytes of text
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = written.groupBy("__bucket").agg(F.count("*").alias("__n")).select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    place = F.col("__first") + F.col("__place")
    shard = F.expr(f"((__at + 1) * {shards} - 1) div {max(rows, 1)}")
    return (
        written.join(F.broadcast(first), "__bucket")
        .withColumn("__at", place)
        .withColumn("shard", shard.cast("int"))
        .withColumn("slot", F.expr(f"__at - (shard * {rows}L) div {shards}"))
        .select(*columns, "shard", "slot")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, its rows in slot order within every file."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
