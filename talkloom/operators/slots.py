"""Functions of the caller over whole channels: recognisers and speaker models."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: From samples to rows of start and end in seconds and a text.
Transcriber = Callable[[np.ndarray], Sequence[tuple[float, float, str]]]
#: From samples to turns of start and end in seconds and a speaker's number.
Diarizer = Callable[[np.ndarray], Sequence[tuple[float, float, int]]]


def _each(channels: DataFrame, found: Callable, columns: list[str], schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r.meeting_id, r.label, k, *x) for r in batch.itertuples() for k, x in enumerate(found(np.asarray(r.samples if r.samples is not None else [], np.float64)))]
            yield pd.DataFrame(rows, columns=["meeting_id", "label", *columns])

    return channels.select(F.col("meeting_id").cast("long").alias("meeting_id"), "label", "samples").mapInPandas(run, schema)


def transcribed(channels: DataFrame, transcribe: Transcriber) -> DataFrame:
    """Labelled rows of channels (meeting_id, label, samples), each recognised on its
    own; texts are trimmed and blank ones go. A recogniser's error fails the task, so
    that Spark tries it again."""

    def found(samples: np.ndarray) -> list:
        return [(float(st), float(en), text.strip()) for st, en, text in transcribe(samples) if (text or "").strip()]

    return _each(channels, found, ["ord", "st", "en", "txt"], "meeting_id long, label string, ord int, st double, en double, txt string")


def diarized(channels: DataFrame, diarize: Diarizer) -> DataFrame:
    """Speaker turns of channels (meeting_id, label, samples). A channel on which the
    model fails has none: its rows keep the channel's label."""

    def found(samples: np.ndarray) -> list:
        try:
            return [(float(ts), float(te), int(speaker)) for ts, te, speaker in diarize(samples)]
        except Exception:  # noqa: BLE001  whatever a caller's model raises
            return []

    return _each(channels, found, ["turn_ord", "ts", "te", "spk"], "meeting_id long, label string, turn_ord int, ts double, te double, spk int")
