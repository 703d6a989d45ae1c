"""Speakers: assigning turns to segments, building and scoring conversations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: silence between utterances of a built conversation, in seconds.
GAP = 0.7
#: Frames of the buckets by which turns are scored.
BUCKET_FRAMES = 400


def assign_speakers(segments: DataFrame, turns: DataFrame, bucket_seconds: float = 30.0) -> DataFrame:
    """segments (meeting_id, ord, st, en, label) with `speaker` and the label that
    tells speakers apart: label plus speaker + 1 where a meeting's turns (meeting_id,
    turn_ord, ts, te, spk) name two speakers or more.

    The turn of greatest overlap speaks, the first on ties; without overlap the
    nearest one, the first on ties. Overlaps are joined by meeting and time bucket, so
    that a long meeting is not compared as a whole; the nearest turn is the last that
    ends before or the next that starts after. Both sides are shuffled once for that
    join; its best pairs, segments and turns then meet once by meeting, and what comes
    out is partitioned by it."""
    bucket = lambda c: F.floor(F.col(c) / bucket_seconds)
    cut = lambda df, a, b: df.withColumn("_bucket", F.explode(F.sequence(bucket(a), F.greatest(bucket(a), bucket(b)))))
    overlap = F.least("en", "te") - F.greatest("st", "ts")
    pairs = cut(segments.select("meeting_id", "ord", "st", "en"), "st", "en").join(cut(turns, "ts", "te"), ["meeting_id", "_bucket"]).where("ts < en and te > st")
    # marks in time: of turns before a segment the one that ends last is nearest, of
    # those after it, looked at backwards, the one that starts first
    turn = lambda edge, nth: F.struct(F.col(edge).cast("double").alias("edge"), nth.cast("int").alias("turn_ord"), F.col("spk").cast("int").alias("spk"))
    no_turn, no_pair, no_row = (F.lit(None).cast(kind) for kind in ("struct<edge:double,turn_ord:int,spk:int>", "struct<less:double,turn_ord:int,spk:int>", segments.select(F.struct(*segments.columns)).schema[0].dataType.simpleString()))
    mark = lambda side, at, kind, found, row: F.struct(F.lit(side).alias("side"), at.cast("double").alias("at"), F.lit(kind).alias("kind"), found.alias("turn"), row.alias("row"))
    row = F.struct(*[F.col(c) for c in segments.columns])
    of_segments = segments.select("meeting_id", "ord", F.inline(F.array(mark("before", F.col("st"), 1, no_turn, row), mark("after", -F.col("en"), 1, no_turn, no_row))), no_pair.alias("pair"))
    of_turns = turns.select("meeting_id", F.lit(None).cast(segments.schema["ord"].dataType).alias("ord"), F.inline(F.array(mark("before", F.col("te"), 0, turn("te", -F.col("turn_ord")), no_row), mark("after", -F.col("ts"), 0, turn("ts", F.col("turn_ord")), no_row))), no_pair.alias("pair"))
    best = pairs.groupBy("meeting_id", "_bucket", "ord").agg(F.min(F.struct((-overlap).cast("double").alias("less"), F.col("turn_ord").cast("int").alias("turn_ord"), F.col("spk").cast("int").alias("spk"))).alias("pair"))
    of_pairs = best.select("meeting_id", "ord", F.lit("pair").alias("side"), F.lit(0.0).alias("at"), F.lit(2).alias("kind"), no_turn.alias("turn"), no_row.alias("row"), "pair")
    met = of_segments.unionByName(of_turns).unionByName(of_pairs).repartition("meeting_id")
    along = Window.partitionBy("meeting_id", "side").orderBy("at", "kind")
    seen = met.withColumns({"b": F.max("turn").over(along), "a": F.min("turn").over(along), "_speakers": F.size(F.collect_set("turn.spk").over(Window.partitionBy("meeting_id")))})
    side = lambda name, found: F.max(F.when(F.col("side") == name, F.col(found))).alias(found)
    found = seen.where("kind > 0").groupBy("meeting_id", "ord").agg(F.collect_list("row").alias("rows"), F.min("pair").alias("pair"), side("before", "b"), side("after", "a"), F.max("_speakers").alias("_speakers"))
    others = [F.col("row")[c].alias(c) for c in segments.columns if c != "meeting_id"]  # meeting_id is the key's own: rows stay partitioned by it
    each = found.select("meeting_id", "pair", "a", "b", "_speakers", F.explode("rows").alias("row")).select("meeting_id", *others, "pair", "a", "b", "_speakers")
    left, right = F.greatest(F.col("st") - F.col("b.edge"), F.lit(0.0)), F.greatest(F.col("a.edge") - F.col("en"), F.lit(0.0))
    nearest = F.when(F.col("a").isNull(), F.col("b.spk")).when(F.col("b").isNull(), F.col("a.spk")).when(left < right, F.col("b.spk")).when(left > right, F.col("a.spk")).when(-F.col("b.turn_ord") <= F.col("a.turn_ord"), F.col("b.spk")).otherwise(F.col("a.spk"))
    speaker = F.coalesce("pair.spk", nearest)
    label = F.when(F.col("_speakers") >= 2, F.concat("label", (speaker + 1).cast("string"))).otherwise(F.col("label"))
    return each.select(*segments.columns, speaker.alias("speaker"), label.alias("speaker_label"))


def conversation_turns(utterances: DataFrame) -> DataFrame:
    """Turns of utterances (meeting_id, ord, spk, seconds) played one after another
    with gaps: ts and te."""
    order = Window.partitionBy("meeting_id").orderBy("ord")
    before = F.coalesce(F.sum(F.col("seconds") + GAP).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return utterances.withColumn("ts", before).withColumn("te", F.col("ts") + F.col("seconds"))


def best_mapping(hits: np.ndarray) -> np.ndarray:
    """The column of each row under the one-to-one mapping of the greatest sum (-1: no
    column is left for it). Shortest augmenting paths over prices of rows and columns:
    rows join one at a time, so time grows with the cube of the number of speakers."""
    if hits.shape[0] > hits.shape[1]:
        rows = best_mapping(hits.T)
        out = np.full(hits.shape[0], -1)
        out[rows] = np.arange(len(rows))
        return out
    cost = hits.max(initial=0) - hits.astype(np.float64)
    n, m = cost.shape
    row_price, column_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for new in range(n):
        # cheapest way to each column by exchanging what is mapped so far
        way, came = np.full(m, np.inf), np.full(m, -1)
        done = np.zeros(m, bool)
        row, column = new, -1
        paid = 0.0
        while True:
            step = paid + cost[row] - row_price[row] - column_price
            better = ~done & (step < way)
            way[better], came[better] = step[better], column
            column = int(np.where(done, np.inf, way).argmin())
            paid = way[column]
            if owner[column] < 0:
                break
            done[column] = True
            row = owner[column]
        reached = np.flatnonzero(done)
        row_price[owner[reached]] += paid - way[reached]
        column_price[reached] -= paid - way[reached]
        row_price[new] += paid
        while column >= 0:
            before = came[column]
            owner[column] = owner[before] if before >= 0 else new
            column = before
    out = np.full(n, -1)
    out[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return out


def shared_frames(truth: DataFrame, found: DataFrame, hop: float = 0.01) -> DataFrame:
    """meeting_id, t, h and n: in how many frames the truth's speaker is t and the found
    one h (null: none). Turns are (meeting_id, turn_ord, ts, te, spk); where turns overlap
    the later one counts.

    Nothing is made for single frames. Turns are cut by bucket; within one, ends cut time
    into intervals in which nothing changes, and each turn meets those that it covers. Of
    turns that cover the same part of a bucket the latest is left, so that a bucket holds
    a bounded number of them however many there are."""
    frame = lambda c: F.floor(F.col(c) / hop)
    bucket = lambda c: F.floor(F.col(c) / BUCKET_FRAMES)
    start = F.col("bucket") * BUCKET_FRAMES

    def parts(df: DataFrame, side: str) -> DataFrame:
        turns = df.select("meeting_id", F.lit(side).alias("side"), "turn_ord", "spk", frame("ts").alias("a"), frame("te").alias("b")).where("b > a")
        cut = turns.withColumn("bucket", F.explode(F.sequence(bucket("a"), F.floor((F.col("b") - 1) / BUCKET_FRAMES))))
        return cut.select("meeting_id", "bucket", "side", "turn_ord", "spk", F.greatest("a", start).alias("a"), F.least("b", start + BUCKET_FRAMES).alias("b"))

    latest = parts(truth, "t").unionByName(parts(found, "h")).groupBy("meeting_id", "bucket", "side", "a", "b").agg(F.max_by("spk", "turn_ord").alias("spk"), F.max("turn_ord").alias("turn_ord"))
    held = latest.groupBy("meeting_id", "bucket").agg(F.collect_list(F.struct("side", "a", "b", "spk", "turn_ord")).alias("turns"))
    edges = held.withColumn("edges", F.array_sort(F.array_union("turns.a", "turns.b")))
    covered = edges.select("meeting_id", "bucket", "edges", F.inline("turns")).select(
        "meeting_id", "bucket", "side", "spk", "turn_ord", F.explode(F.filter(F.arrays_zip(F.col("edges").alias("a"), F.slice("edges", 2, F.size("edges")).alias("b")), lambda e: (e["a"] >= F.col("a")) & (e["b"] <= F.col("b")))).alias("e")
    )
    of = lambda side, c: F.when(F.col("side") == side, F.col(c))
    intervals = covered.groupBy("meeting_id", "bucket", "e").agg(*[F.max_by(of(side, "spk"), of(side, "turn_ord")).alias(side) for side in "th"], F.max(F.col("side") == "t").alias("said"))
    return intervals.where("said").groupBy("meeting_id", "t", "h").agg(F.sum(F.col("e.b") - F.col("e.a")).alias("n"))


def frame_accuracy(truth: DataFrame, found: DataFrame, hop: float = 0.01) -> DataFrame:
    """meeting_id and accuracy: the share of truth frames that the best one-to-one
    mapping of found speakers gets right. Turns are as in shared_frames(). Frames are
    counted by pair of speakers in Spark; the counts of a meeting, one for each pair, go
    to one task."""
    pairs = shared_frames(truth, found, hop).groupBy("meeting_id").agg(F.collect_list(F.struct("t", "h", "n")).alias("pairs"))

    def right(pairs: list[dict]) -> int:
        known = [(p["t"], p["h"], p["n"]) for p in pairs if p["t"] is not None and p["h"] is not None]
        if not known:
            return 0
        row, column = ({x: k for k, x in enumerate(dict.fromkeys(side))} for side in list(zip(*known, strict=True))[:2])
        hits = np.zeros((len(row), len(column)), np.int64)
        for t, h, n in known:
            hits[row[t], column[h]] = n
        mapped = best_mapping(hits)
        return int(hits[np.flatnonzero(mapped >= 0), mapped[mapped >= 0]].sum())

    def best(batches):
        for batch in batches:
            accuracy = [right(x) / sum(p["n"] for p in x) for x in batch.column("pairs").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("meeting_id"), pa.array(accuracy, pa.float64())], ["meeting_id", "accuracy"])

    return pairs.mapInArrow(best, "meeting_id long, accuracy double")
