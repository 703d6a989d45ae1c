"""Functions of the caller, and channels that can be off."""

from __future__ import annotations

import pytest

from talkloom.operators import slots
from talkloom.sources import text as S

CHANNELS = [(1, "m", [0.5, 0.5]), (1, "s", []), (2, "m", None)]
SCHEMA = "meeting_id long, label string, samples array<double>"


def test_transcriber_drops_blank_texts_and_errors_fail(spark):
    def refuse(samples):
        raise ValueError("no model")

    heard = slots.transcribed(spark.createDataFrame(CHANNELS, SCHEMA), lambda x: [(0, 1, " a "), (1, 2, " "), (2, 3, None), (3, 4, f"{len(x)}")])
    got = sorted(tuple(r) for r in heard.collect())
    assert got == [(1, "m", 0, 0.0, 1.0, "a"), (1, "m", 1, 3.0, 4.0, "2"), (1, "s", 0, 0.0, 1.0, "a"), (1, "s", 1, 3.0, 4.0, "0"), (2, "m", 0, 0.0, 1.0, "a"), (2, "m", 1, 3.0, 4.0, "0")]
    with pytest.raises(Exception, match="no model"):
        slots.transcribed(spark.createDataFrame(CHANNELS[:1], SCHEMA), refuse).collect()


def test_diarizer_errors_give_no_turns(spark):
    def diarize(samples):
        return [(0, samples[0], 1)]  # fails where nothing is recorded

    got = slots.diarized(spark.createDataFrame(CHANNELS, SCHEMA), diarize).collect()
    assert [tuple(r) for r in got] == [(1, "m", 0, 0.0, 0.5, 1)]
    assert slots.diarized(spark.createDataFrame([], SCHEMA), diarize).count() == 0


def test_two_sources_and_one_that_is_off(spark):
    one, two = spark.range(2), spark.range(3)
    assert {(r["label"], r["n"]) for r in S.two_sources(one, two).groupBy("label").count().withColumnRenamed("count", "n").collect()} == {("あなた", 2), ("相手", 3)}
    assert S.two_sources(None, two).count() == 3
    with pytest.raises(ValueError, match="off"):
        S.two_sources(None, None)
