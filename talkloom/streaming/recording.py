"""Operators with state over streamed sample blocks (meeting_id, label, frame_ix,
samples): the bounded buffer, live transcription and the first sound of a channel.

Blocks are taken in order of frame_ix, whatever batches they come in: a block waits
until one that is `slack` frames newer has come, and one that comes after later ones
were taken is late and goes. Blocks of all channels of a meeting share its frames.
State is kept by transformWithState, so a query that uses these needs the RocksDB
state store (runs.with_state_store sets it for the start of a query). A timeout, in
seconds of processing time, gives a key's state up after that long without blocks.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from talkloom.operators import channels
from talkloom.operators.rows import MIC, SYSTEM
from talkloom.operators.slots import Transcriber
from talkloom.streaming import live

BLOCK = "label string, frame_ix long, samples array<float>"
#: Fixed values, in seconds: how often a recording is looked at, how much there must
#: be of it, what its level is taken from, and what the first sound is taken from.
HOP, LEAST, LEVEL_TAIL, ACTIVITY_TAIL = 1.2, 0.8, 3.0, 0.25


class _Idle(StatefulProcessor):
    """Keeps one timer a key, which ends its state."""

    def __init__(self, timeout: float | None):
        self.timeout = timeout

    def init(self, handle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "at long")
        self.states = [self.timer, *self.made(handle)]

    def made(self, handle) -> list:
        raise NotImplementedError

    def put_off(self) -> None:
        if self.timeout is None:
            return
        if before := self.timer.get():
            self.handle.deleteTimer(before[0])
        at = int((time.time() + self.timeout) * 1000)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803  named by Spark
        for state in self.states:
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def _rows(rows: Iterator[Row]) -> list[tuple]:
    return [(r.label, r.frame_ix, np.asarray(r.samples if r.samples is not None else [], np.float32)) for r in rows]


def _in_state(blocks: list[tuple]) -> list[tuple]:
    return [(label, frame, samples.tolist()) for label, frame, samples in blocks]


class _Ring(_Idle):
    """A channel's newest blocks, as many whole ones as fit."""

    def __init__(self, most: int, timeout: float | None):
        super().__init__(timeout)
        self.most = most

    def made(self, handle) -> list:
        self.blocks = handle.getListState("blocks", BLOCK)
        self.counts = handle.getValueState("counts", "captured long, held long, gone long, oldest long, newest long")
        return [self.blocks, self.counts]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        come = sorted(_rows(rows), key=lambda b: b[1])
        captured, held, gone, oldest, newest = self.counts.get() or (0, 0, -1 << 62, None, None)
        captured += sum(len(b[2]) for b in come)
        come = [b for b in come if b[1] > gone]  # older than what is gone: gone as well
        new = sum(len(b[2]) for b in come)
        if come and held + new <= self.most and (newest is None or come[0][1] >= newest):
            self.blocks.appendList(_in_state(come))
            held, oldest, newest = held + new, come[0][1] if oldest is None else oldest, come[-1][1]
        elif come:
            ring = sorted([(label, frame, np.asarray(x, np.float32)) for label, frame, x in self.blocks.get()] + come, key=lambda b: b[1])
            held += new
            first = 0
            while first < len(ring) and held > self.most:
                held -= len(ring[first][2])
                gone = max(gone, ring[first][1])
                first += 1
            ring = ring[first:]
            self.blocks.put(_in_state(ring)) if ring else self.blocks.clear()
            oldest, newest = (ring[0][1], ring[-1][1]) if ring else (None, None)
        self.counts.update((captured, held, gone, oldest, newest))
        self.put_off()
        yield Row(meeting_id=key[0], label=key[1], captured=captured, held=held, oldest=oldest, newest=newest)


def _with_state(grouped, processor: _Idle, schema: str) -> DataFrame:
    return grouped.transformWithState(processor, schema, "Append", "ProcessingTime" if processor.timeout is not None else "None")


def buffered(blocks: DataFrame, rate: int = channels.RATE, window: float = live.WINDOW, timeout: float | None = None) -> DataFrame:
    """live.ring() of a stream: after each batch, for each channel of it, what the
    buffer holds: captured and held (samples so far, and now), oldest and newest
    frame_ix. The whole oldest blocks go while there is too much; a block older than
    one that has gone is counted as captured and goes as well, so that the buffer
    after all batches does not depend on how blocks were split among them."""
    most = int(max(live.RING_LEAST, window + live.RING_EXTRA) * rate)
    grouped = blocks.select(F.col("meeting_id").cast("long").alias("meeting_id"), "label", F.col("frame_ix").cast("long").alias("frame_ix"), F.col("samples").cast("array<float>").alias("samples")).groupBy("meeting_id", "label")
    return _with_state(grouped, _Ring(most, timeout), "meeting_id long, label string, captured long, held long, oldest long, newest long")


class _InOrder(_Idle):
    """Takes a key's blocks frame by frame."""

    def __init__(self, slack: int, timeout: float | None):
        super().__init__(timeout)
        self.slack = slack

    def made(self, handle) -> list:
        self.waiting = handle.getListState("waiting", BLOCK)
        self.place = handle.getValueState("place", "newest long, taken long")
        return [self.waiting, self.place, *self.more(handle)]

    def more(self, handle) -> list:
        raise NotImplementedError

    def take(self, key: tuple, blocks: list[tuple]) -> list[tuple]:
        """What blocks, in order, give. Called once a batch."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        newest, taken = self.place.get() or (-1 << 62, -1 << 62)
        come = [b for b in _rows(rows) if b[1] > taken]
        held = [(label, frame, np.asarray(x, np.float32)) for label, frame, x in self.waiting.get()] + come if self.slack else come  # without slack none waits
        newest = max([newest, *(b[1] for b in come)])
        ready = sorted((b for b in held if b[1] <= newest - self.slack), key=lambda b: (b[1], b[0]))
        rest = [b for b in held if b[1] > newest - self.slack]
        if self.slack:
            self.waiting.put(_in_state(rest)) if rest else self.waiting.clear()
        self.place.update((newest, max(taken, newest - self.slack)))
        self.put_off()
        if ready:
            yield from (Row(**dict(zip(self.columns, r, strict=True))) for r in self.take(key, ready))


class _FirstSound(_InOrder):
    """Fires once, when enough is captured and its last moment sounds."""

    columns = ["meeting_id", "label", "captured"]

    def __init__(self, rate: int, slack: int, timeout: float | None):
        super().__init__(slack, timeout)
        self.rate, self.tail = rate, max(1, round(ACTIVITY_TAIL * rate))

    def more(self, handle) -> list:
        # sums of the squares of the last moment's samples, block by block
        self.sums = handle.getValueState("sums", "captured long, fired boolean, squares array<double>")
        return [self.sums]

    def take(self, key: tuple, blocks: list[tuple]) -> list[tuple]:
        captured, fired, squares = self.sums.get() or (0, False, [])
        if fired:
            return []
        squares, out = np.asarray(squares if squares is not None else [], np.float64), []
        for _, _, samples in blocks:
            captured += len(samples)
            squares = np.concatenate([squares, samples.astype(np.float64) ** 2])[-self.tail :]
            if captured >= live.ACTIVITY_SECONDS * self.rate and len(squares) and np.sqrt(squares.mean()) >= live.ACTIVITY_RMS:
                fired, squares = True, squares[:0]
                out.append((*key, captured / self.rate))
                break
        self.sums.update((captured, fired, squares.tolist()))
        return out


def first_sound(blocks: DataFrame, rate: int = channels.RATE, slack: int = 0, timeout: float | None = None) -> DataFrame:
    """Fires once for each channel of a stream of blocks (meeting_id, label, captured:
    seconds): at the first block by which enough is captured and the level of the last
    quarter of a second is that of sound. Levels come from the samples themselves."""
    grouped = _blocks(blocks).groupBy("meeting_id", "label")
    return _with_state(grouped, _FirstSound(rate, slack, timeout), "meeting_id long, label string, captured double")


def _blocks(blocks: DataFrame) -> DataFrame:
    return blocks.select(F.col("meeting_id").cast("long").alias("meeting_id"), "label", F.col("frame_ix").cast("long").alias("frame_ix"), F.col("samples").cast("array<float>").alias("samples"))


def chosen_labels(levels: dict[str, float]) -> list[str]:
    """Channels to transcribe, of those that sound, by label: the system's alone if it
    is loud enough against the microphone, the microphone alone if that is far louder,
    else all, the system's first, then the louder."""
    if SYSTEM in levels and MIC in levels:
        if levels[SYSTEM] >= levels[MIC] * channels.LIVE_SYSTEM_SHARE:
            return [SYSTEM]
        if levels[MIC] >= levels[SYSTEM] * channels.LIVE_MIC_FACTOR:
            return [MIC]
    return sorted(levels, key=lambda k: (k != SYSTEM, -levels[k]))


class _Live(_InOrder):
    """The chain from samples to captions of one meeting: a ring for each channel, a
    look at it every hop, the caller's recogniser over the last seconds, and the rule
    by which rows settle."""

    columns = ["meeting_id", "label", "captured", "st", "en", "txt", "kind"]

    def __init__(self, transcribe: Transcriber, rate: int, hop: float, window: float, slack: int, timeout: float | None):
        super().__init__(slack, timeout)
        self.transcribe, self.rate = transcribe, rate
        self.hop, self.window = max(1, round(hop * rate)), int(window * rate)
        self.most = int(max(live.RING_LEAST, window + live.RING_EXTRA) * rate)

    def more(self, handle) -> list:
        self.rings = handle.getListState("rings", BLOCK)
        self.marks = handle.getMapState("marks", "label string", "captured long, until double")
        self.shown = handle.getValueState("shown", "text string")
        return [self.rings, self.marks, self.shown]

    def _tail(self, ring: list[tuple[int, np.ndarray]], n: int) -> np.ndarray:
        return np.concatenate([x for _, x in ring] or [np.zeros(0, np.float32)])[-n:] if n else np.zeros(0, np.float32)

    def take(self, key: tuple, blocks: list[tuple]) -> list[tuple]:
        rings: dict[str, list] = {}
        for label, frame, x in self.rings.get():
            rings.setdefault(label, []).append((frame, np.asarray(x, np.float32)))
        marks = {k[0]: list(v) for k, v in self.marks.iterator()}
        shown = (self.shown.get() or ("",))[0]
        out = []
        at = 0
        while at < len(blocks):
            frame, clock = blocks[at][1], max([0, *(c for c, _ in marks.values())])
            while at < len(blocks) and blocks[at][1] == frame:  # all channels of a frame
                label, _, samples = blocks[at]
                mark, ring = marks.setdefault(label, [0, 0.0]), rings.setdefault(label, [])
                mark[0] += len(samples)
                ring.append((frame, samples))
                held = sum(len(x) for _, x in ring)
                while ring and held > self.most:
                    held -= len(ring.pop(0)[1])
                at += 1
            if max(c for c, _ in marks.values()) // self.hop > clock // self.hop:
                rows, shown = self._look(key[0], rings, marks, shown)
                out += rows
        kept = [(label, frame, x.tolist()) for label, ring in rings.items() for frame, x in ring]
        self.rings.put(kept) if kept else self.rings.clear()
        for label, mark in marks.items():
            self.marks.updateValue((label,), tuple(mark))
        self.shown.update((shown,))
        return out

    def _look(self, meeting: int, rings: dict, marks: dict, shown: str) -> tuple[list[tuple], str]:
        levels = {}
        for label, (captured, _) in marks.items():
            tail = self._tail(rings[label], int(LEVEL_TAIL * self.rate)).astype(np.float64)
            if captured >= LEAST * self.rate and len(tail) and (rms := float(np.sqrt((tail**2).mean()))) >= channels.ACTIVE_RMS:
                levels[label] = rms
        out, open_rows = [], []
        for label in (chosen := chosen_labels(levels)):
            captured, until = marks[label]
            samples, seconds = self._tail(rings[label], self.window), captured / self.rate
            begin = max(0.0, seconds - len(samples) / self.rate)
            heard = [(begin + st, begin + en, text.strip()) for st, en, text in self.transcribe(samples) if text and text.strip()]
            final, rest, marks[label][1] = live.commit(heard, seconds, until)
            out += [(meeting, label, seconds, *r, "final") for r in final]
            open_rows += [(meeting, label, seconds, *r, "provisional") for r in rest]
        if not chosen:
            return out, shown
        text = "\n".join(f"{r[1]}: {r[5]}" for r in open_rows)
        return out + (open_rows if text != shown else []), text


def live_transcription(blocks: DataFrame, transcribe: Transcriber, rate: int = channels.RATE, hop: float = HOP, window: float = live.WINDOW, slack: int = 1, timeout: float | None = None) -> DataFrame:
    """Captions of a stream of sample blocks, recognised as they come: meeting_id,
    label, captured (seconds of the channel by then), st, en, txt and kind.

    Each `hop` seconds of a meeting (by its longest channel, once a frame is whole) the
    channels worth it are chosen by the level of their last seconds, and the caller's
    recogniser hears the last `window` seconds of each. Rows that settle (live.commit)
    come once, as final; those still open as provisional, whenever what they say
    together has changed. Samples beyond the bounded buffer are not kept. What comes out
    does not depend on how blocks are split into batches; frames less than `slack` older
    than the newest wait for more. A recogniser's error fails the batch, and Spark tries
    it again from the last state."""
    grouped = _blocks(blocks).groupBy("meeting_id")
    return _with_state(grouped, _Live(transcribe, rate, hop, window, slack, timeout), "meeting_id long, label string, captured double, st double, en double, txt string, kind string")
