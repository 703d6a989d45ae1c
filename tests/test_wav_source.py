"""Sample files by byte ranges, and the sink that publishes whole files."""

from __future__ import annotations

import os
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkloom.sources import wav
from talkloom.sources.audio import BLOCK, read_wav

BLOCKS = "meeting_id long, label string, frame_ix int, samples array<float>"


@pytest.fixture
def folder(spark, tmp_path):
    wav.register(spark)
    draw = np.random.default_rng(2)
    for name, n, channels in (("long", 100_123, 1), ("two", 5_000, 2), ("none", 0, 1)):
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as f:
            f.setnchannels(channels), f.setsampwidth(2), f.setframerate(16_000)
            f.writeframes(draw.integers(-32768, 32767, n * channels).astype("<i2").tobytes())
    (tmp_path / "broken.WAV").write_bytes(b"RIFF")
    (tmp_path / "long.f32").write_bytes(draw.normal(0, 1, 30_001).astype("<f4").tobytes() + b"xx")
    (tmp_path / "other.txt").write_text("x")
    return str(tmp_path)


def by_path(df) -> dict[str, np.ndarray]:
    out = {}
    for r in df.orderBy("path", "frame_ix").collect():
        out.setdefault(os.path.basename(r.path), []).append(np.array(r.samples, np.float32))
    return {k: np.concatenate(v) for k, v in out.items()}


def test_a_large_file_is_read_by_several_tasks(spark, folder):
    whole = by_path(read_wav(spark, folder))
    split = spark.read.format("talkloom_wav").option("split", 20_000).load(folder)
    assert split.rdd.getNumPartitions() > 12
    found = by_path(split)
    assert set(found) == {"long.wav", "two.wav", "none.wav", "broken.WAV"}
    assert all(np.array_equal(found[k], whole[k]) for k in whole)
    rates = {os.path.basename(r.path): r.rate for r in split.select("path", "rate").distinct().collect()}
    assert rates == {"long.wav": 16_000, "two.wav": 16_000, "none.wav": 16_000, "broken.WAV": -1}
    longest = split.where("path like '%long.wav'")
    assert longest.agg(F.max("frame_ix"), F.max(F.size("samples"))).first() == (-(-100_123 // BLOCK) - 1, BLOCK)


def test_filters_choose_the_ranges(spark, folder):
    split = spark.read.format("talkloom_wav").option("split", 3200).load(folder)
    path = split.where("path like '%long.wav'").first().path
    some = split.where((F.col("path") == path) & (F.col("frame_ix") >= 10) & (F.col("frame_ix") < 13))
    assert some.rdd.getNumPartitions() == 3  # of one range a block
    whole = by_path(read_wav(spark, folder))["long.wav"]
    assert np.array_equal(by_path(some)["long.wav"], whole[10 * BLOCK : 13 * BLOCK])
    assert split.where("frame_ix > 1000000").count() == 0
    assert split.where((F.col("path") == path) & (F.size("samples") < BLOCK)).count() == 1  # not pushed, still applied


def test_a_raw_spool_is_read_by_ranges(spark, folder):
    spool = spark.read.format("talkloom_spool").option("split", 12_800).option("rate", 8000).load(folder)
    assert spool.rdd.getNumPartitions() > 8 and spool.first().rate == 8000
    x = np.fromfile(f"{folder}/long.f32", "<f4", 30_001)
    assert np.array_equal(by_path(spool)["long.f32"], x)


def test_channels_become_whole_files(spark, tmp_path):
    draw = np.random.default_rng(4)
    whole = {(1, "mic"): draw.normal(0, 0.5, 9000), (1, "sys"): np.array([2.0, -2.0, np.nan, np.inf, 0.5]), (2, "mic"): np.zeros(0)}
    rows = [(m, lab, k, x[k * 700 : k * 700 + 700].tolist()) for (m, lab), x in whole.items() for k in range(max(1, -(-len(x) // 700)))]
    out = str(tmp_path / "out")
    wav.write_channels(spark.createDataFrame(rows, BLOCKS).repartition(5), out, rate=8000)
    assert sorted(os.listdir(out)) == ["1_mic.wav", "1_sys.wav", "2_mic.wav"] and wav.errors_of(out) == {}
    found = by_path(spark.read.format("talkloom_wav").load(out))
    expected = np.trunc(np.clip(whole[1, "mic"].astype(np.float32).astype(np.float64) * 32767, -32768, 32767)) / 32768
    assert np.abs(found["1_mic.wav"] - expected).max() < 1e-7
    assert (found["1_sys.wav"] * 32768).tolist() == [32767, -32768, 0, 32767, 16383] and len(found["2_mic.wav"]) == 0
    with wave.open(f"{out}/1_mic.wav") as f:
        assert (f.getframerate(), f.getnframes()) == (8000, 9000)


def test_a_failed_job_leaves_nothing_and_an_error_stops_no_other_file(spark, tmp_path):
    out = str(tmp_path / "out")
    good = spark.createDataFrame([("a", 2, [0.1, 0.2]), ("b", 5, [0.1]), ("c", 1 << 33, [0.0])], "name string, total long, samples array<float>")
    wav.register(spark)
    boom = F.when(F.col("name") == "b", F.raise_error(F.lit("lost"))).otherwise(F.col("total")).cast("long")
    with pytest.raises(Exception, match="lost"):
        good.withColumn("total", boom).coalesce(1).write.format("talkloom_wav_files").mode("append").save(out)
    assert not os.path.exists(out) or os.listdir(out) == []
    good.coalesce(1).write.format("talkloom_wav_files").mode("append").save(out)
    assert sorted(f for f in os.listdir(out) if f.endswith(".wav")) == ["a.wav"]
    assert wav.errors_of(out) == {"b": "4 samples are missing", "c": "more samples than a WAV file can tell"}


def test_of_a_task_that_ran_twice_one_file_is_published(tmp_path):
    import pyarrow as pa

    writer = wav._Files(str(tmp_path), 16_000)
    rows = [pa.RecordBatch.from_arrays([pa.array(["x"]), pa.array([2], pa.int64()), pa.array([[0.5, 0.25]], pa.list_(pa.float32()))], ["name", "total", "samples"])]
    writer.write(iter(rows))  # an attempt whose message is lost
    message = writer.write(iter(rows))
    assert os.listdir(tmp_path) == [f"_tmp-{writer.job}"]
    writer.commit([message, None])
    assert os.listdir(tmp_path) == ["x.wav"]
