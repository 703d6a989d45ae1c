"""Calendar events and the meeting title they suggest."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOOKBACK, LOOKAHEAD = 15, 10


def minutes(value: object, default: int) -> int:
    """A whole number of minutes; default for what is none, negative or zero."""
    try:
        out = int(value or default)
    except (TypeError, ValueError):
        return default
    return default if out < 0 else out


def valid_events(events: DataFrame) -> DataFrame:
    """Events with title and start; an end that is missing or not later is an hour
    after the start."""
    end = F.when(F.col("end") > F.col("start"), F.col("end")).otherwise(F.col("start") + F.expr("interval 1 hour"))
    return events.where((F.coalesce("title", F.lit("")) != "") & F.col("start").isNotNull()).withColumn("end", end)


def merge_events(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for other in sources[1:]:
        out = out.unionByName(other)
    return out


def store_events(events: DataFrame, path: str) -> None:
    """Lays events (title, start, end) down by day, each under every day it touches."""
    days = F.sequence(F.to_date("start"), F.greatest(F.to_date("start"), F.to_date("end")))
    events.where("start is not null and end is not null").withColumn("day", F.explode(days)).repartition("day").write.partitionBy("day").mode("append").parquet(path)


def events_between(spark: SparkSession, path: str, begin: datetime, stop: datetime) -> DataFrame:
    """Stored events that touch begin to stop, each once. Only the window's days are
    read: an event counts on the first of them that it touches."""
    begin, stop = F.lit(begin).cast("timestamp"), F.lit(stop).cast("timestamp")
    stored = spark.read.parquet(path)
    days = stored.where((F.col("day") >= F.to_date(begin)) & (F.col("day") <= F.to_date(stop)))
    first = F.col("day") == F.greatest(F.to_date("start"), F.to_date(begin))
    return days.where((F.col("start") <= stop) & (F.col("end") >= begin) & first).drop("day")


def title_hints(moments: DataFrame, events: DataFrame, lookback: int = LOOKBACK, lookahead: int = LOOKAHEAD) -> DataFrame:
    """Adds `hint` to (moment_id, now): the title of the event in progress that began
    last, else of the nearest one from lookback minutes before to lookahead after.
    Events (title, start, end) end after they start, as valid_events() has them.

    No moment is compared with each event near it: distinct moments and events meet in
    buckets of the window's length, where both are sorted by time and one pass (_sweep)
    keeps the events that may still be a hint. A moment has one bucket; an event is in
    all that its own window touches."""
    back, ahead = 60_000_000 * lookback, 60_000_000 * lookahead
    width = max(60_000_000, back + ahead)
    start, stop, now = F.unix_micros(F.col("start").cast("timestamp")), F.unix_micros(F.col("end").cast("timestamp")), F.unix_micros(F.col("now").cast("timestamp"))
    bucket = lambda c: F.floor(c / width)
    known = events.where("start is not null and end is not null").select("title", start.alias("at"), stop.alias("stop"))
    placed = known.select(F.explode(F.sequence(bucket(F.col("at") - ahead), bucket(F.greatest("at", "stop") + back))).alias("bucket"), "at", "stop", "title", F.lit(False).alias("asks"))
    asked = moments.where("now is not null").select(now.alias("at")).distinct().select(bucket(F.col("at")).alias("bucket"), "at", F.lit(0).cast("long").alias("stop"), F.lit("").alias("title"), F.lit(True).alias("asks"))
    # an event that starts at a moment comes before it; of events that start together the first title comes last
    met = placed.unionByName(asked).repartition("bucket").sortWithinPartitions("bucket", "at", "asks", F.desc("title"))
    found = met.mapInPandas(_sweep(back, ahead), "at long, hint string")
    return moments.withColumn("_at", now).join(found.withColumnRenamed("at", "_at"), "_at", "left").select(*moments.columns, F.coalesce("hint", F.lit("")).alias("hint"))


def _sweep(back: int, ahead: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Answers the moments of sorted buckets in one pass. What it holds: events that no
    later one outlasts, and the moments since the last event that none of them answers
    in progress."""

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, running, recent, waiting, coming, out = None, [], [], [], None, []

        def settle() -> None:
            for at, past in waiting:
                gap = at - past[0] if past else None
                if coming and coming[0] <= at + ahead and (gap is None or coming[0] - at < gap):
                    out.append((at, coming[1]))
                elif past:
                    out.append((at, past[1]))
            waiting.clear()

        for batch in batches:
            for bucket, at, stop, title, asks in zip(*(batch[c].tolist() for c in ("bucket", "at", "stop", "title", "asks")), strict=True):
                if bucket != place:
                    settle()
                    place, coming = bucket, None
                    running.clear(), recent.clear()
                if asks:
                    if coming:
                        settle()
                        coming = None
                    while running and running[-1][2] < at:
                        running.pop()
                    if running:
                        out.append((at, running[-1][1]))
                        continue
                    while recent and recent[-1][2] < at - back:
                        recent.pop()
                    waiting.append((at, recent[-1] if recent else None))
                    continue
                if waiting:
                    if coming and coming[0] < at:
                        settle()
                    coming = (at, title) if waiting else None
                event = (at, title, stop)
                # of those that start together the one that ends last is in progress, the first title is the nearest
                while running and running[-1][2] <= stop:
                    running.pop()
                if not running or running[-1][0] < at:
                    running.append(event)
                while recent and recent[-1][2] <= stop:
                    recent.pop()
                recent.append(event)
            if out:
                yield pd.DataFrame(out, columns=["at", "hint"])
                out.clear()
        settle()
        if out:
            yield pd.DataFrame(out, columns=["at", "hint"])

    return sweep


def titled(hint: Column, generated: Column) -> Column:
    """The calendar's title, or the generated one where it has none."""
    return F.coalesce(F.nullif(hint, F.lit("")), generated)


