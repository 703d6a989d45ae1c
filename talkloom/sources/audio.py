"""Whole WAV and spool files as sample arrays, on any path that Spark reads; wav.py
reads large ones by ranges, and writes."""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: file types that an import offers; only WAV is read without codecs.
IMPORTABLE = ("wav", "mp3", "m4a", "flac", "ogg", "mp4", "aac")
#: Samples in one block: a tenth of a second.
BLOCK = 1600
SAMPLES = "path string, rate int, frame_ix int, samples array<float>"


def samples_of(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples, -1 to 1, of a 16-bit WAV file's first channel."""
    with wave.open(io.BytesIO(data), "rb") as f:
        values = np.frombuffer(f.readframes(f.getnframes()), "<i2")[:: f.getnchannels()]
        return f.getframerate(), values.astype(np.float32) / 32768


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of all WAV files at a path; a file that is none has rate -1 and no
    samples."""

    def parse(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rate, x = samples_of(data)
                except (wave.Error, EOFError):
                    rate, x = -1, np.zeros(0, np.float32)
                blocks = [x[k : k + BLOCK].tolist() for k in range(0, max(1, len(x)), BLOCK)]
                n = len(blocks)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array([rate] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(blocks, pa.list_(pa.float32()))], ["path", "rate", "frame_ix", "samples"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[wW][aA][vV]").load(path)
    return files.select("path", "content").mapInArrow(parse, SAMPLES)


def decoded_spool(files: DataFrame) -> DataFrame:
    """Samples of raw float32 spool files (binaryFile rows), in blocks."""

    def parse(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                x = np.frombuffer(data[: len(data) // 4 * 4], "<f4")
                blocks = [x[k : k + BLOCK].tolist() for k in range(0, len(x), BLOCK)]
                n = len(blocks)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array(blocks, pa.list_(pa.float32()))], ["path", "frame_ix", "samples"])

    return files.select("path", "content").mapInArrow(parse, "path string, frame_ix int, samples array<float>")


def importable(files: DataFrame, wav_only: bool = False) -> DataFrame:
    """binaryFile rows whose type an import accepts."""
    kind = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))
    return files.where(kind.isin("wav") if wav_only else kind.isin(*IMPORTABLE))
