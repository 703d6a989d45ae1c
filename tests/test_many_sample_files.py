"""Many small sample files: few tasks read them, and the driver opens none."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from talkloom.sources import wav


def written(spark, folder, n):
    blocks = spark.range(2 * n).select((F.col("id") % n).alias("meeting_id"), F.lit("mic").alias("label"), F.col("id").alias("frame_ix"), F.array((F.col("id") + 1) / 32767, F.lit(-0.5)).alias("samples"))
    wav.write_channels(blocks, folder)
    return spark.read.format("talkloom_wav").option("split", 1 << 20).load(folder)


def test_small_files_are_read_several_to_a_task(spark, tmp_path):
    n = 600
    read = written(spark, str(tmp_path / "out"), n)
    assert read.rdd.getNumPartitions() <= 4
    found = {int(r.path.rsplit("/", 1)[1].split("_")[0]): (r.rate, r.frame_ix, [round(x * 32768) for x in r.samples]) for r in read.collect()}
    assert found == {k: (16_000, 0, [k + 1, -16383, k + n + 1, -16383]) for k in range(n)}


def test_the_driver_opens_no_small_file(spark, tmp_path, monkeypatch):
    written(spark, str(tmp_path), 3)
    (tmp_path / "none.wav").write_bytes(b"")
    reader = wav._WavReader(str(tmp_path), 1 << 20, (".wav",))
    monkeypatch.setattr(reader, "layout", None)  # cannot be called
    parts = reader.partitions()
    monkeypatch.undo()
    assert len(parts) == 1 and sum(len(b) for b in reader.read(parts[0])) == 4


def test_no_block_stands_before_the_first(spark, tmp_path):
    read = written(spark, str(tmp_path), 3)
    (tmp_path / "none.wav").write_bytes(b"")
    assert read.where("frame_ix < 0").count() == 0 and read.where("frame_ix <= 0").count() == 4 and read.where("frame_ix > 0").count() == 0


def test_blocks_without_samples_are_left_out(tmp_path):
    writer = wav._Files(str(tmp_path), 16_000)
    table = pa.table({"name": ["x", "a", "a", "b", "b", "b"], "total": [1, 3, 3, 0, 0, 0], "samples": pa.array([[9.0], [0.5, None], [1.0], None, [], None], pa.list_(pa.float64()))})
    writer.commit([writer.write(iter(table.slice(1).to_batches(max_chunksize=2)))])
    assert wav.errors_of(str(tmp_path)) == {} and sorted(p.name for p in tmp_path.iterdir()) == ["a.wav", "b.wav"]
    reader = wav._WavReader(str(tmp_path), 1 << 20, (".wav",))
    found = [[round(x * 32768) for x in r["samples"]] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert found == [[16383, 0, 32767], []]
