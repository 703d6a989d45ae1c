"""Live captions as stateful streams, keyed by meeting and channel."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Fixed values, in seconds.
STABLE_MARGIN, SETTLED = 1.5, 0.05
WINDOW, RING_LEAST, RING_EXTRA = 8.0, 30.0, 5.0
ACTIVITY_SECONDS, ACTIVITY_RMS = 0.15, 0.01


def _timing(timeout: str | None):
    return GroupStateTimeout.ProcessingTimeTimeout if timeout else GroupStateTimeout.NoTimeout


def _put_off(state: GroupState, timeout: str | None) -> None:
    """A key's state ends this long after its last rows."""
    if timeout:
        state.setTimeoutDuration(pd.Timedelta(timeout) // pd.Timedelta("1ms"))


CAPTION = "meeting_id long, label string, st double, en double, txt string, kind string"


def commit(rows: list[tuple[float, float, str]], captured: float, until: float) -> tuple[list, list, float]:
    """Splits recognised rows (start, end, text) into those that settle now and the
    rest still open. A row settles once it ends STABLE_MARGIN before the captured
    end and beyond what has settled; rows that end within that are late or seen
    before and go. Also gives how far things have settled."""
    final = []
    for row in rows:
        if row[1] <= max(0.0, captured - STABLE_MARGIN) and row[1] > until + SETTLED:
            final.append(row)
            until = max(until, row[1])
    return final, [row for row in rows if row[1] > until + SETTLED], until


def live_captions(results: DataFrame, timeout: str | None = "10 minutes") -> DataFrame:
    """Captions of a stream of recognition results (meeting_id, label, captured, st,
    en, txt): each evaluation of the window is rows of one `captured`. Rows that
    settle come once as kind final; open ones as provisional, only when their text
    changed. A channel's evaluations are taken by `captured` within a batch, and whole: one
    that comes after later ones changes nothing that has settled. State ends after `timeout` without results; with None it stays. A run
    with trigger availableNow ends only with None: a timeout asks for batches on."""

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        meeting, label = key
        if state.hasTimedOut:
            state.remove()
            return
        until, shown = state.get if state.exists else (0.0, "")
        out = []
        rows = pd.concat(list(batches), ignore_index=True)
        for captured, part in rows.sort_values(["captured", "st", "en"], kind="stable").groupby("captured"):
            spoken = [(r.st, r.en, r.txt) for r in part.itertuples() if r.txt]
            final, rest, until = commit(spoken, float(captured), until)
            text = "\n".join(r[2] for r in rest)
            out += [(meeting, label, *r, "final") for r in final]
            if text != shown:
                out += [(meeting, label, *r, "provisional") for r in rest]
                shown = text
        state.update((until, shown))
        _put_off(state, timeout)
        if out:
            yield pd.DataFrame(out, columns=["meeting_id", "label", "st", "en", "txt", "kind"])

    return results.groupBy("meeting_id", "label").applyInPandasWithState(update, CAPTION, "until double, shown string", "append", _timing(timeout))


def shown_text(events: DataFrame, timeout: str | None = None) -> DataFrame:
    """What a channel of a stream shows (meeting_id, label, ord, type, text): a row (meeting_id, label, ord, txt, kind) whenever
    what a channel shows changes. Results always show, as final; a hypothesis unless
    it repeats the last result or what is shown; detected speech, as status, only
    before any text. Events of a channel are taken by ord within a batch; one that comes
    after later ones were taken is late and goes. Blank texts do not count. State ends
    after `timeout` without events; with None it stays."""

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        said, shown, last = state.get if state.exists else ("", "", -1)
        out = []
        for r in pd.concat(list(batches), ignore_index=True).sort_values("ord", kind="stable").itertuples():
            if r.ord <= last:
                continue
            last = r.ord
            text = r.text if r.text and r.text.strip() else ""
            if r.type == "result" and text:
                said = shown = text
                out.append((*key, r.ord, text, "final"))
            elif r.type == "hypothesis" and text and text not in (said, shown):
                shown = text
                out.append((*key, r.ord, text, "provisional"))
            elif r.type == "status" and not shown:
                shown = "..."
                out.append((*key, r.ord, shown, "status"))
        state.update((said, shown, last))
        _put_off(state, timeout)
        if out:
            yield pd.DataFrame(out, columns=["meeting_id", "label", "ord", "txt", "kind"])

    return events.groupBy("meeting_id", "label").applyInPandasWithState(update, "meeting_id long, label string, ord int, txt string, kind string", "said string, shown string, last int", "append", _timing(timeout))


def ring(blocks: DataFrame, rate: int = 16_000, window: float = WINDOW) -> DataFrame:
    """Blocks (meeting_id, label, frame_ix, samples) that a bounded buffer holds:
    from the newest back while those before fit; whole blocks go."""
    most = max(RING_LEAST, window + RING_EXTRA) * rate
    back = Window.partitionBy("meeting_id", "label").orderBy(F.desc("frame_ix")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocks.withColumn("_n", F.sum(F.size("samples")).over(back)).where(F.col("_n") <= most).drop("_n")


def windowed_levels(blocks: DataFrame, window: str = "8 seconds", slide: str = "1 second", delay: str = "10 seconds") -> DataFrame:
    """Hopping evaluation of a stream of blocks (ts, meeting_id, label, samples): RMS
    of each window, with a watermark for late blocks."""
    square = F.aggregate("samples", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    sums = blocks.withWatermark("ts", delay).groupBy(F.window("ts", window, slide), "meeting_id", "label").agg(F.sum(square).alias("square"), F.sum(F.size("samples")).alias("n"))
    return sums.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "meeting_id", "label", F.sqrt(F.col("square") / F.col("n")).alias("rms"))


def newly_running(snapshots: DataFrame, timeout: str | None = None) -> DataFrame:
    """Members of each snapshot of a stream (host, at, members array<string>) that the
    one before lacked, sorted. Snapshots of a host are taken in order of `at` within a
    batch; one that comes after later ones were taken is late and goes. State ends
    after `timeout` without snapshots; with None it stays."""

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before, last = (set(state.get[0]), state.get[1]) if state.exists else (set(), None)
        out = []
        for r in pd.concat(list(batches), ignore_index=True).sort_values("at", kind="stable").itertuples():
            if last is not None and r.at <= last:
                continue
            now = set(r.members)
            out += [(key[0], r.at, m) for m in sorted(now - before)]
            before, last = now, r.at
        state.update((sorted(before), last))
        _put_off(state, timeout)
        if out:
            yield pd.DataFrame(out, columns=["host", "at", "member"])

    return snapshots.groupBy("host").applyInPandasWithState(update, "host string, at long, member string", "members array<string>, at long", "append", _timing(timeout))
