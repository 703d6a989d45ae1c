"""From labelled rows to stored summary: one lazy plan keyed by meeting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.operators import rows as R
from talkloom.operators import speakers, summary


def labelled(rows: DataFrame, turns: DataFrame) -> DataFrame:
    """Rows whose system channel is told apart by speaker."""
    found = speakers.assign_speakers(rows, turns)
    return found.withColumn("label", F.when(F.col("label") == R.SYSTEM, F.col("speaker_label")).otherwise(F.col("label"))).drop("speaker", "speaker_label")


def summarised(rows: DataFrame, turns: DataFrame, language: str = "ja") -> DataFrame:
    """meeting_id, n_rows, last_start, transcript, title, body and document."""
    kept = R.without_outros(labelled(rows, turns))
    told = R.transcript(kept, F.count("*").alias("n_rows"), F.max("st").alias("last_start"))
    made = summary.fast_summary(told, language)
    return made.withColumn("document", summary.document(F.col("title"), F.col("body"), F.col("transcript")))
