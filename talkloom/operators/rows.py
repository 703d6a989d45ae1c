"""Operators over labelled rows: (meeting_id, ord, st, en, label, txt).

`ord` is a row's place in its meeting's input and settles ties. All operators
partition by meeting, so that meetings run in parallel and none leaves its task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.functions import text as T
from talkloom.streaming.runs import stored

#: The two channels' labels and texts that silence tends to yield.
MIC, SYSTEM = "あなた", "相手"
OUTROS = ("ご視聴ありがとうございました", "ご清聴ありがとうございました", "ありがとうございました")
#: Fixed value: fragments that are noise when they stand alone.
DROP_IF_ALONE = ("っ", "の", "を", "8", "五")


def transcript(rows: DataFrame, *more: Column) -> DataFrame:
    """meeting_id and transcript: `**label**: text` lines by start, ties in order; and
    further aggregates of a meeting's rows."""
    line = F.concat(F.lit("**"), F.col("label"), F.lit("**: "), F.col("txt"))
    lines = F.array_sort(F.collect_list(F.struct("st", "ord", line.alias("line"))))
    return rows.groupBy("meeting_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("transcript"), *more)


def in_time_order(rows: DataFrame) -> DataFrame:
    """Adds place, from 1: a row's place in its meeting by start, then label, then
    order of input."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("meeting_id").orderBy("st", "label", "ord")))


def merge_channels(*channels: DataFrame) -> DataFrame:
    """Rows of several channels in one table."""
    out = channels[0]
    for other in channels[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def corrected(rows: DataFrame, rules: Sequence[Sequence[str]], drop: Sequence[str] = DROP_IF_ALONE) -> DataFrame:
    """Rows with corrected texts; empty ones and lone noise fragments go."""
    return rows.withColumn("txt", T.correct("txt", rules)).where((F.col("txt") != "") & ~F.col("txt").isin(*drop))


def with_first_confidence(events: DataFrame, key: str = "meeting_id") -> DataFrame:
    """Events (key, ord, text, confidence): repeats of a text share the confidence
    of its first event."""
    first = Window.partitionBy(key, "text").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("confidence", F.first("confidence").over(first))


def recognised(results: DataFrame, rules: Sequence[Sequence[str]], drop: Sequence[str] = DROP_IF_ALONE, key: str = "meeting_id") -> DataFrame:
    """What a file's recogniser results (key, ord, text, confidence) give: texts are
    normalised, empty ones go; all that is left is normalised again, noise goes, and
    each takes the first event of its file that has this text after the first pass, with
    that event's confidence. A text that the second pass still changes equals no event,
    unless another says the same, and is lost."""
    once = results.withColumn("text", T.correct("text", rules)).where("text <> ''").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    twice = once.withColumn("said", T.correct("text", rules)).where((F.col("said") != "") & ~F.col("said").isin(*drop)).select(key, "ord", F.col("said").alias("text"))
    first = once.groupBy(key, "text").agg(F.min_by("confidence", "ord").alias("confidence"))
    return twice.join(first, [key, "text"]).select(key, "ord", "text", "confidence")


def is_outro(text: Column | str) -> Column:
    """Whether a text, without blanks and marks, is a known closing phrase."""
    return F.regexp_replace(F.coalesce(T.col(text), F.lit("")), r"(?U)[\s。．、,.!！?？]+", "").isin(*OUTROS)


def without_outros(rows: DataFrame) -> DataFrame:
    """Closing phrases go from meetings with two or more labels, unless nothing else
    is left."""
    meeting = Window.partitionBy("meeting_id")
    labels = F.size(F.collect_set("label").over(meeting))
    good = F.sum(F.when(is_outro("txt"), 0).otherwise(1)).over(meeting)
    return rows.withColumn("_labels", labels).withColumn("_good", good).where((F.col("_labels") < 2) | (F.col("_good") == 0) | ~is_outro("txt")).drop("_labels", "_good")


def without_adjacent_repeats(rows: DataFrame) -> DataFrame:
    """In order of (st, label, txt), of successive rows with one label and text the
    one that ends last stays, the earliest of those on ties."""
    order = Window.partitionBy("meeting_id").orderBy("st", "label", "txt", "ord")
    same = F.lag("label").over(order).eqNullSafe(F.col("label")) & F.lag("txt").over(order).eqNullSafe(F.col("txt"))
    placed = rows.withColumn("_at", F.row_number().over(order)).withColumn("_new", F.when(same, 0).otherwise(1))
    islands = placed.withColumn("_island", F.sum("_new").over(Window.partitionBy("meeting_id").orderBy("_at")))
    best = Window.partitionBy("meeting_id", "_island").orderBy(F.desc("en"), "_at")
    return islands.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_at", "_new", "_island", "_rank")


def latest(rows: DataFrame, n: int, key: str = "meeting_id", order: str = "ord") -> DataFrame:
    """The last n rows of each key."""
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= n).drop("_back")


def recent_history(turns: DataFrame, n: int = 6) -> DataFrame:
    """The last n turns; blank ones are dropped only afterwards."""
    return latest(turns, n).where(F.coalesce("txt", F.lit("")) != "")


def final_rows(events: DataFrame) -> DataFrame:
    """(meeting_id, ord, st, label, txt) of final events."""
    return events.where("kind = 'final'").select("meeting_id", "ord", "st", "label", "txt")


def captions(events: DataFrame) -> DataFrame:
    """One caption text for each meeting: its events' lines in order."""
    line = T.live_line(F.col("kind"), F.col("label"), F.col("txt"))
    lines = F.array_sort(F.collect_list(F.struct("ord", line.alias("line"))))
    kept = F.filter(F.transform(lines, lambda x: x["line"]), lambda x: x.isNotNull())
    return events.groupBy("meeting_id").agg(F.array_join(kept, "\n").alias("caption"))


def newly_present(snapshots: DataFrame, key: str, at: str, member: str) -> DataFrame:
    """Members of each snapshot (key, at, member) that the one before lacked. The
    first snapshot's members are all new."""
    times = snapshots.select(key, at).distinct().withColumn("_before", F.lag(at).over(Window.partitionBy(key).orderBy(at)))
    earlier = snapshots.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.col(member).alias("_member")).distinct()
    now = snapshots.select(key, at, member).distinct().join(times, [key, at])
    was = (F.col(key) == F.col("_key")) & (F.col("_before") == F.col("_at")) & (F.col(member) == F.col("_member"))
    return now.join(earlier, was, "left_anti").drop("_before")


def first_of_each(df: DataFrame, value: str, order: str, *keys: str) -> DataFrame:
    """Distinct values of each key, each at its first place."""
    return df.groupBy(*keys, value).agg(F.min(order).alias(order))


def in_order(df: DataFrame, into: str, *order: str) -> DataFrame:
    """Adds `into`, the place from 1 in the given order. Rows are range-partitioned
    and numbered within partitions; only one count a partition meets in one task. They
    are laid down with these numbers: ranges come from samples, and partitions are
    coalesced by size, so that rows placed again for the counts would lie otherwise."""
    placed = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()), "in-order")
    part, row = F.shiftright("_row", 33), F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(into, F.col("_before") + row + 1).drop("_row", "_part", "_before")
