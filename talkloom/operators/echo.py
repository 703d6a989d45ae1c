"""Echo delay and echo cancelling over sample blocks (meeting_id, label, frame_ix,
samples), without bringing a channel together.

A meeting's time line is cut into segments; a task holds one segment of both channels
and the samples beside it that its frames reach into. What must be known of the whole
meeting (means, correlation by lag, the echo's path by frequency) are sums over
segments, combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.operators.channels import EPS, FRAME, HOP, MAX_LAG, RESIDUAL
from talkloom.operators.rows import MIC, SYSTEM

#: Blocks that are numbered together, least samples that tell a delay, and samples and
#: frames of a segment.
TOGETHER, LEAST, LAG_SEGMENT, FRAMES = 4096, 2048, 1 << 18, 64


def placed(blocks: DataFrame) -> DataFrame:
    """blocks with `at`: samples of the channel before the block. Counts are summed by
    runs of TOGETHER frames, runs are added up, and only a run's blocks meet."""
    counted = blocks.withColumn("_run", F.expr(f"frame_ix div {TOGETHER}"))
    runs = counted.groupBy("meeting_id", "label", "_run").agg(F.sum(F.size("samples")).alias("_n"))
    before = lambda *keys, by: Window.partitionBy("meeting_id", "label", *keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.withColumn("_start", F.coalesce(F.sum("_n").over(before(by="_run")), F.lit(0))).drop("_n")
    within = counted.withColumn("_in", F.coalesce(F.sum(F.size("samples")).over(before("_run", by="frame_ix")), F.lit(0)))
    return within.join(starts, ["meeting_id", "label", "_run"]).withColumn("at", (F.col("_start") + F.col("_in")).cast("long")).drop("_run", "_start", "_in")


def pairs(at: DataFrame) -> DataFrame:
    """Meetings with both channels: n, the samples that both have."""
    sizes = at.where(F.col("label").isin(MIC, SYSTEM)).groupBy("meeting_id", "label").agg(F.sum(F.size("samples")).alias("_n"))
    return sizes.groupBy("meeting_id").agg(F.min("_n").cast("long").alias("n"), F.count("*").alias("_both")).where("_both = 2").drop("_both")


def _segments(at: DataFrame, width: int, before: int, after: int, lag: Column) -> DataFrame:
    """Blocks of both channels (with n of their meeting) by segment: segment k covers
    k * width - before to (k + 1) * width + after. A block of the system is moved by
    `lag`, `t` is where a block then begins; one at an edge goes to both segments."""
    moved = at.where(F.col("label").isin(MIC, SYSTEM)).withColumn("t", F.col("at") + F.when(F.col("label") == SYSTEM, lag).otherwise(0))
    first = F.floor((F.col("t") - after - width) / width) + 1
    last = F.floor((F.col("t") + F.size("samples") - 1 + before) / width)
    segment = F.sequence(F.greatest(F.lit(0), first), F.least(F.floor((F.col("n") - 1) / width), last))
    inside = (F.size("samples") > 0) & (F.greatest(F.lit(0), first) <= F.least(F.floor((F.col("n") - 1) / width), last))
    return moved.where(inside).withColumn("segment", F.explode(segment)).select("meeting_id", "segment", "label", "t", "n", F.col("samples").cast("array<float>").alias("samples"))


def _signal(table: pa.Table, label: str, begin: int, length: int, fill: float = 0.0) -> np.ndarray:
    """The samples of a channel from `begin` on; `fill` where there are none."""
    out = np.full(length, fill, np.float32)
    labels, places, samples = table["label"].to_pylist(), table["t"].to_pylist(), table["samples"].combine_chunks()
    for k, (own, t) in enumerate(zip(labels, places, strict=True)):
        if own == label:
            x = np.asarray(samples[k].values, np.float32)
            a, b = max(t, begin), min(t + len(x), begin + length)
            if a < b:
                out[a - begin : b - begin] = x[a - t : b - t]
    return out


def _by_segment(rows: DataFrame, fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    return rows.groupBy("meeting_id", "segment").applyInArrow(fn, schema)


def delays(blocks: DataFrame, max_lag: int = MAX_LAG, least: int = LEAST, width: int = LAG_SEGMENT) -> DataFrame:
    """meeting_id, n and lag: the samples by which the system's channel must be delayed
    so that it correlates most with the microphone, within max_lag either way (the
    smallest, where several do equally); 0 for meetings too short to tell. Of meetings
    with both channels.

    A segment of the microphone is correlated with the part of the system that its lags
    reach; 2 * max_lag + 1 sums a segment are added up by lag."""
    at = placed(blocks)
    return _delays(at, pairs(at), max_lag, least, width)


def _delays(at: DataFrame, both: DataFrame, max_lag: int, least: int, width: int) -> DataFrame:
    cut = at.join(both, "meeting_id").where("at < n")
    own = F.slice("samples", F.lit(1), F.least(F.size("samples").cast("long"), F.col("n") - F.col("at")).cast("int"))
    sums = cut.groupBy("meeting_id").agg(*[F.sum(F.when(F.col("label") == label, F.aggregate(own, F.lit(0.0), lambda s, x: s + x.cast("double")))).alias(name) for label, name in ((MIC, "mic_sum"), (SYSTEM, "system_sum"))])
    told = cut.where(F.col("n") >= least).join(sums, "meeting_id")
    segments = _segments(told, width, max_lag, max_lag, F.lit(0).cast("long"))
    means = sums.join(both, "meeting_id").select("meeting_id", (F.col("mic_sum") / F.col("n")).alias("mic_mean"), (F.col("system_sum") / F.col("n")).alias("system_mean"))

    def correlate(table: pa.Table) -> pa.Table:
        k, n = table["segment"][0].as_py(), table["n"][0].as_py()
        mic_mean, system_mean = table["mic_mean"][0].as_py(), table["system_mean"][0].as_py()
        begin = k * width - max_lag
        length = width + 2 * max_lag
        place = begin + np.arange(length)
        real = (place >= 0) & (place < n)
        mic = np.where(real, _signal(table, MIC, begin, length).astype(np.float64) - mic_mean, 0.0)[max_lag : max_lag + width]
        system = np.where(real, _signal(table, SYSTEM, begin, length).astype(np.float64) - system_mean, 0.0)
        size = 1 << (length - 1).bit_length()
        found = np.fft.irfft(np.conj(np.fft.rfft(mic, size)) * np.fft.rfft(system, size), size)[: 2 * max_lag + 1]
        return pa.table({"meeting_id": table["meeting_id"][:1], "sums": pa.array([found[::-1]])})

    kind = segments.schema["meeting_id"].dataType.simpleString()
    parts = _by_segment(segments.join(means, "meeting_id"), correlate, f"meeting_id {kind}, sums array<double>")
    by_lag = parts.select("meeting_id", F.posexplode("sums").alias("at", "x")).groupBy("meeting_id", (F.col("at") - max_lag).alias("lag")).agg(F.sum("x").alias("x"))
    best = by_lag.groupBy("meeting_id").agg(F.max_by("lag", F.struct(F.abs("x"), -F.col("lag"))).alias("lag"))
    return both.join(best, "meeting_id", "left").select("meeting_id", "n", F.coalesce("lag", F.lit(0)).cast("int").alias("lag"))


def _frames(x: np.ndarray, frame: int, hop: int) -> np.ndarray:
    window = np.hanning(frame).astype(np.float32)
    return np.fft.rfft(np.lib.stride_tricks.sliding_window_view(x, frame)[::hop] * window, axis=1)


def _paths(cut: DataFrame, frame: int, hop: int, frames: int) -> DataFrame:
    """meeting_id, and by frequency the real and imaginary part of what becomes of the
    system's sound in the microphone: mean cross power over mean power."""
    width = frames * hop

    def powers(table: pa.Table) -> pa.Table:
        begin, n = table["segment"][0].as_py() * width, table["n"][0].as_py()
        whole = max(0, min(frames, (n - frame - begin) // hop + 1))
        length = (whole - 1) * hop + frame
        if not whole:
            return pa.table({"meeting_id": table["meeting_id"][:0], "frames": pa.array([], pa.int64()), "bins": pa.array([], pa.list_(pa.struct([(c, pa.float64()) for c in ("re", "im", "power")])))})
        m, r = (_frames(_signal(table, label, begin, length), frame, hop) for label in (MIC, SYSTEM))
        cross, power = (m * r.conj()).sum(0).astype(np.complex128), (r * r.conj()).sum(0).real.astype(np.float64)
        bins = pa.StructArray.from_arrays([pa.array(cross.real), pa.array(cross.imag), pa.array(power)], ["re", "im", "power"])
        return pa.table({"meeting_id": table["meeting_id"][:1], "frames": pa.array([whole], pa.int64()), "bins": pa.ListArray.from_arrays(pa.array([0, len(bins)], pa.int32()), bins)})

    kind = cut.schema["meeting_id"].dataType.simpleString()
    parts = _by_segment(_segments(cut, width, 0, frame, F.col("lag")), powers, f"meeting_id {kind}, frames long, bins array<struct<re:double,im:double,power:double>>")
    summed = parts.select("meeting_id", "frames", F.posexplode("bins").alias("bin", "b")).groupBy("meeting_id", "bin").agg(F.sum("b.re").alias("re"), F.sum("b.im").alias("im"), F.sum("b.power").alias("power"), F.sum("frames").alias("frames"))
    share = lambda c: F.col(c) / (F.col("power") + F.lit(EPS) * F.col("frames"))
    listed = F.array_sort(F.collect_list(F.struct("bin", share("re").alias("re"), share("im").alias("im"))))  # frame / 2 + 1 of them
    return summed.groupBy("meeting_id").agg(listed.alias("path")).select("meeting_id", F.col("path.re").alias("re"), F.col("path.im").alias("im"))


def cancel_echo_blocks(blocks: DataFrame, frame: int = FRAME, hop: int = HOP, max_lag: int = MAX_LAG, least: int = LEAST, frames: int = FRAMES, lag_segment: int = LAG_SEGMENT) -> DataFrame:
    """channels.remove_echo() over blocks: the microphone of each meeting without the
    system's echo, in blocks of frames * hop samples up to the shorter channel's end;
    all other channels as they are. The microphone stays as it is where the system is
    missing, or either has less than two frames.

    A segment also computes the frames beside it that reach into it, so that frames are
    added up without another shuffle."""
    at = placed(blocks)
    both = _delays(at, pairs(at), max_lag, least, lag_segment).where(F.col("n") >= 2 * frame)
    cut = at.join(both, "meeting_id")
    width, beside = frames * hop, frame - hop
    window = np.hanning(frame).astype(np.float32)
    segments = _segments(cut, width, beside, beside, F.col("lag"))
    path = segments.select("meeting_id", "segment", "n").distinct().join(_paths(cut, frame, hop, frames), "meeting_id")
    none = F.lit(None)
    rows = segments.withColumns({"re": none.cast("array<double>"), "im": none.cast("array<double>")}).unionByName(
        path.select("meeting_id", "segment", F.lit("path").alias("label"), F.lit(0).cast("long").alias("t"), "n", none.cast("array<float>").alias("samples"), "re", "im")
    )

    def clean(table: pa.Table) -> pa.Table:
        k, n = table["segment"][0].as_py(), table["n"][0].as_py()
        of = table["label"].to_pylist().index("path")
        h = np.asarray(table["re"][of].values, np.float64) + 1j * np.asarray(table["im"][of].values, np.float64)
        table = table.filter(pa.array([x != "path" for x in table["label"].to_pylist()]))
        # frames that touch the segment, of those that the meeting has
        first = max(0, k * width - beside)
        last = min((n - frame) // hop * hop, (k + 1) * width - hop)
        begin, end = k * width, min(n, (k + 1) * width)
        out, weight = np.zeros((2, max(end, last + frame) - first), np.float32)
        if last >= first:
            m, r = (_frames(_signal(table, label, first, last - first + frame), frame, hop) for label in (MIC, SYSTEM))
            echo = h * r
            near, power = m - echo, RESIDUAL * np.abs(echo) ** 2 + EPS
            kept = near * (np.abs(near) ** 2 / (np.abs(near) ** 2 + power))
            for j, one in enumerate(np.fft.irfft(kept, axis=1)):
                out[j * hop : j * hop + frame] += one * window
                weight[j * hop : j * hop + frame] += window**2
        found = (out / (weight + np.float32(1e-8)))[begin - first : end - first]
        return pa.table({"meeting_id": table["meeting_id"][:1], "label": [MIC], "frame_ix": pa.array([k], pa.int64()), "samples": pa.array([found])})

    kind = blocks.schema["meeting_id"].dataType.simpleString()
    cleaned = _by_segment(rows, clean, f"meeting_id {kind}, label string, frame_ix long, samples array<float>")
    as_they_are = blocks.join(both.select("meeting_id", F.lit(MIC).alias("label")), ["meeting_id", "label"], "left_anti")
    return as_they_are.select("meeting_id", "label", F.col("frame_ix").cast("long").alias("frame_ix"), F.col("samples").cast("array<float>").alias("samples")).unionByName(cleaned)
