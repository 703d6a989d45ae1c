"""Echo delay and cancelling over blocks against whole channels."""

from __future__ import annotations

import numpy as np
import pytest

from talkloom.operators import channels, echo
from talkloom.operators.rows import MIC, SYSTEM

BLOCKS = "meeting_id long, label string, frame_ix long, samples array<float>"


def sound(seed: int, n: int, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """A microphone that hears near speech and the system, `lag` samples later."""
    draw = np.random.default_rng(seed)
    system = draw.normal(0, 0.1, n).astype(np.float32)
    near = 0.2 * np.sin(np.arange(n) / 11).astype(np.float32) * (np.arange(n) % 20_000 < 9_000)
    heard = np.roll(system, lag)
    heard[: max(lag, 0)] = 0
    heard[n + min(lag, 0) :] = 0
    return (near + 0.7 * heard + draw.normal(0, 0.001, n)).astype(np.float32), system


def cut(meeting: int, label: str, x: np.ndarray, size: int) -> list[tuple]:
    """Blocks of uneven sizes, numbered with gaps."""
    edges = [0]
    while edges[-1] < len(x):
        edges.append(min(len(x), edges[-1] + size + len(edges) % 7))
    return [(meeting, label, 3 * k + meeting, x[a:b].tolist()) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]


@pytest.fixture(scope="module")
def meetings(spark):
    whole = {1: sound(1, 70_000, 300), 2: sound(2, 50_001, -120), 3: sound(3, 12_000, 50), 4: sound(4, 1_500, 20)}
    mic, system = sound(5, 40_000, 77)
    whole[5] = (mic, system[:36_000])  # the shorter channel sets the end
    rows = [r for m, (a, b) in whole.items() for r in cut(m, MIC, a, 1600) + cut(m, SYSTEM, b, 977)]
    rows += cut(6, MIC, whole[1][0][:30_000], 1600)  # no system
    return whole, spark.createDataFrame(rows, BLOCKS).repartition(7)


def test_places_are_running_sums(spark, monkeypatch, meetings):
    monkeypatch.setattr(echo, "TOGETHER", 16)
    whole, blocks = meetings
    for r in echo.placed(blocks).where("meeting_id in (1, 5)").collect():
        x = whole[r.meeting_id][r.label != MIC]
        assert np.array_equal(x[r["at"] : r["at"] + len(r.samples)], np.array(r.samples, np.float32))


@pytest.mark.parametrize("width", [4096, 1 << 18])
def test_delays_are_those_of_whole_channels(meetings, width):
    whole, blocks = meetings
    found = {r.meeting_id: (r.n, r.lag) for r in echo.delays(blocks, max_lag=1000, width=width).collect()}
    assert found == {m: (n := min(map(len, pair)), 0 if n < 2048 else {1: 300, 2: -120, 3: 50, 5: 77}[m]) for m, pair in whole.items()}
    for m in (1, 2, 3, 5):
        n = found[m][0]
        assert channels.best_lag(whole[m][0][:n], whole[m][1][:n]) == found[m][1]


def test_cancelled_blocks_equal_whole_channels(meetings):
    whole, blocks = meetings
    rows = echo.cancel_echo_blocks(blocks, frames=4, lag_segment=1 << 14).orderBy("meeting_id", "label", "frame_ix").collect()
    joined = {}
    for r in rows:
        joined.setdefault((r.meeting_id, r.label), []).extend(r.samples)
        assert r.label != MIC or r.meeting_id not in (1, 2, 5) or len(r.samples) <= 4 * echo.HOP  # no task holds a channel
    for m, (mic, system) in whole.items():
        assert np.array_equal(np.array(joined[m, SYSTEM], np.float32), system)
        expected = channels.remove_echo(mic, system)
        found = np.array(joined[m, MIC], np.float32)
        assert found.shape == expected.shape and np.abs(found - expected).max() < 1e-4
    assert np.array_equal(np.array(joined[6, MIC], np.float32), whole[1][0][:30_000])
    mic, system = whole[1]
    tidy = np.array(joined[1, MIC])[9_000:20_000]  # where nobody near speaks
    assert np.abs(tidy).mean() < 0.3 * np.abs(mic[9_000:20_000]).mean()


def test_no_blocks_give_no_blocks(spark):
    assert echo.cancel_echo_blocks(spark.createDataFrame([], BLOCKS)).count() == 0
