"""Text sinks: documents of meetings, with a second folder if the first fails."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_documents(documents: DataFrame, path: str) -> None:
    """(name, text) as text files, partitioned by name: one folder for each document."""
    documents.select("name", F.col("text").alias("value")).write.partitionBy("name").option("lineSep", "\n").text(path)


def write_text(path: str, text: str, fallback_folder: str) -> tuple[str, str]:
    """Writes one document; where that fails, under fallback_folder. Gives the path
    written and the error, empty if there was none."""
    target = Path(path)
    try:
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text, encoding="utf-8")
        return str(target), ""
    except OSError as e:
        second = Path(fallback_folder) / target.name
        second.parent.mkdir(parents=True, exist_ok=True)
        second.write_text(text, encoding="utf-8")
        return str(second), str(e)


def notify(stream: DataFrame, on_rows, checkpoint: str):
    """A streaming query that hands each micro-batch's rows to a callback."""
    return stream.writeStream.foreachBatch(lambda df, epoch: on_rows(df, epoch)).option("checkpointLocation", checkpoint).outputMode("append")
