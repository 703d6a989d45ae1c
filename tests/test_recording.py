"""Stateful operators over sample blocks: results do not depend on how blocks are split
into batches, nor on their order within the slack."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from talkloom.operators.rows import MIC, SYSTEM
from talkloom.streaming import live, recording, runs

SCHEMA = "meeting_id long, label string, frame_ix long, samples array<float>, arrival int"


def blocks(spark, arrivals: int, seed: int, shuffle: int = 0):
    """Two meetings of two channels, four samples a second, arriving in order but for
    `shuffle` frames."""
    draw = np.random.default_rng(7)
    place = random.Random(seed)
    rows = []
    for meeting in (1, 2):
        for frame in range(60):
            for label in (MIC, SYSTEM):
                loud = 0.3 if (frame // 6 + (label == MIC)) % 3 else 0.0005
                x = (loud * draw.normal(0, 1, 2)).astype(np.float32).tolist()
                rows.append((meeting, label, frame, x, min(arrivals - 1, (frame + place.randint(0, shuffle)) * arrivals // 60)))
    return spark.createDataFrame(rows, SCHEMA)


def replayed(df, operator):
    return runs.replayed(df, "test", F.col("arrival"), operator)


def recogniser():
    """Made here, so that workers need no test module."""

    def loud(samples):
        return [(k / 4, (k + 4) / 4, f" {abs(samples[k : k + 4]).sum():.2f} ") for k in range(0, len(samples), 4) if abs(samples[k : k + 4]).max() > 0.1]

    return loud


def by_hand(rows, rate=4, hop=1.2, window=8.0):
    """The live chain over all blocks of one meeting, without state or streams."""
    heard = {MIC: np.zeros(0, np.float32), SYSTEM: np.zeros(0, np.float32)}
    until, shown, out, step = {MIC: 0.0, SYSTEM: 0.0}, "", [], round(hop * rate)
    frames = sorted({r.frame_ix for r in rows})
    for frame in frames[:-1]:
        before = max(map(len, heard.values()))
        for r in rows:
            if r.frame_ix == frame:
                heard[r.label] = np.concatenate([heard[r.label], np.array(r.samples, np.float32)])
        if max(map(len, heard.values())) // step == before // step:
            continue
        levels = {}
        for label, x in heard.items():
            rms = np.sqrt((x[-3 * rate :].astype(np.float64) ** 2).mean())
            if len(x) >= 0.8 * rate and rms >= 0.001:
                levels[label] = rms
        if not levels:
            continue
        both = len(levels) == 2
        chosen = [SYSTEM] if both and levels[SYSTEM] >= 0.75 * levels[MIC] else [MIC] if both and levels[MIC] >= 1.6 * levels[SYSTEM] else sorted(levels, key=lambda k: k != SYSTEM)
        open_rows = []
        for label in chosen:
            x = heard[label]
            tail = x[-int(window * rate) :]
            begin = (len(x) - len(tail)) / rate
            said = [(begin + a, begin + b, t.strip()) for a, b, t in recogniser()(tail)]
            final, rest, until[label] = live.commit(said, len(x) / rate, until[label])
            out += [(label, *r, "final") for r in final]
            open_rows += [(label, *r, "provisional") for r in rest]
        text = "\n".join(f"{r[0]}: {r[3]}" for r in open_rows)
        if text != shown:
            out += open_rows
            shown = text
    return sorted(out)


@pytest.mark.parametrize(("arrivals", "slack", "shuffle"), [(1, 1, 0), (4, 5, 4)])
def test_transcription_does_not_depend_on_batches(spark, arrivals, slack, shuffle):
    df = blocks(spark, arrivals, arrivals, shuffle)
    found = replayed(df, lambda s: recording.live_transcription(s, recogniser(), rate=4, slack=slack)).collect()
    for meeting in (1, 2):
        rows = [r for r in df.where(F.col("meeting_id") == meeting).collect() if r.frame_ix <= 60 - slack]
        expected = by_hand(rows)
        assert sum(r[-1] == "final" for r in expected) > 10
        assert sorted((r.label, r.st, r.en, r.txt, r.kind) for r in found if r.meeting_id == meeting) == expected


@pytest.mark.parametrize(("arrivals", "shuffle"), [(4, 20)])
def test_the_buffer_after_any_split_is_the_ring(spark, arrivals, shuffle):
    df = blocks(spark, arrivals, 3, shuffle)
    states = replayed(df, lambda s: recording.buffered(s, rate=1)).collect()
    ring = live.ring(df, rate=1).groupBy("meeting_id", "label").agg(F.min("frame_ix"), F.max("frame_ix"), F.sum(F.size("samples"))).collect()
    for meeting, label, oldest, newest, held in ring:
        last = max((s for s in states if (s.meeting_id, s.label) == (meeting, label)), key=lambda s: s.captured)
        assert (last.captured, last.held, last.oldest, last.newest) == (120, held, oldest, newest)


def test_first_sound_of_samples_out_of_order(spark):
    quiet, noise = [0.0] * 8, [0.5, -0.5] * 4
    rows = [(1, "m", k, noise if k in (5, 6) else quiet, 1 if k == 5 else k // 7 * 2) for k in range(9)]
    rows += [(2, "m", k, quiet, k // 4) for k in range(7)] + [(3, "m", 0, noise, 0), (3, "m", 1, quiet, 1), (3, "m", 2, quiet, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    # 32 samples a second: the level is that of the last 8, enough is 4.8
    found = {r.meeting_id: r.captured for r in replayed(df, lambda s: recording.first_sound(s, rate=32, slack=2)).collect()}
    assert found == {1: 6 * 8 / 32, 3: 8 / 32}


def test_state_ends_after_a_timeout(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = blocks(spark, 2, 1).where("meeting_id = 1 and frame_ix < 10").drop("arrival")
    df.where("frame_ix < 5").coalesce(1).write.parquet(source)
    stream = recording.buffered(spark.readStream.schema(df.schema).parquet(source), rate=1, timeout=1.0)
    with runs.with_state_store(spark):
        query = runs.spool(stream, out, f"{out}-checkpoint").trigger(processingTime="500 milliseconds").start()
    # a query with timers runs batches on and on: its output is watched, with a deadline

    def wait_for(rows: int) -> None:
        deadline = time.time() + 60
        while time.time() < deadline:
            try:
                if spark.read.schema(stream.schema).parquet(out).count() >= rows:
                    return
            except AnalysisException:
                pass  # nothing is written yet
            time.sleep(1)

    try:
        wait_for(2)
        time.sleep(6)
        df.where("frame_ix >= 5").coalesce(1).write.mode("append").parquet(source)
        wait_for(4)
    finally:
        query.stop()
    held = sorted((r.label, r.captured, r.oldest) for r in spark.read.parquet(out).collect())
    assert held == sorted((label, 10, first) for label in (MIC, SYSTEM) for first in (0, 5))  # counted anew
