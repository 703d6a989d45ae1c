"""Sources, sinks, settings and streams."""

from __future__ import annotations

import json
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from talkloom.operators import channels
from talkloom.sources import audio, settings, sinks, wav
from talkloom.sources import text as S
from talkloom.streaming import live


def test_wav_round_trip(spark, tmp_path):
    x = np.sin(np.arange(4000) / 20).astype(np.float32)
    df = spark.createDataFrame([(7, "mic", x.tolist()), (7, "sys", [2.0, -2.0, 0.0])], "meeting_id long, label string, samples array<float>")
    wav.write_channels(df.withColumn("frame_ix", F.lit(0)), str(tmp_path))
    (tmp_path / "broken.wav").write_bytes(b"RIFF")
    blocks = audio.read_wav(spark, str(tmp_path))
    rows = blocks.orderBy("path", "frame_ix").collect()
    got = np.concatenate([r["samples"] for r in rows if r["path"].endswith("7_mic.wav")])
    assert len(got) == 4000 and np.abs(got - x).max() < 1e-4
    assert [r["samples"] for r in rows if r["path"].endswith("7_sys.wav")][0] == [np.float32(32767 / 32768), -1.0, 0.0]
    assert [r["rate"] for r in rows if "broken" in r["path"]] == [-1]
    q = df.select(channels.quantised("samples").alias("q")).collect()[1]["q"]
    assert q == [32767, -32768, 0]
    (tmp_path / "spool.f32").write_bytes(x.astype("<f4").tobytes())
    spool = spark.read.format("binaryFile").load(str(tmp_path / "spool.f32"))
    assert audio.decoded_spool(spool).agg(F.sum(F.size("samples"))).first()[0] == 4000
    files = S.catalogue(spark, str(tmp_path))
    assert audio.importable(files).count() == 3 and audio.importable(files, wav_only=True).count() == 3


def test_recogniser_events(spark, tmp_path):
    lines = ['{"type":"result","text":"a","confidence":0.5}', "not json", '{"type":"result","text":"  "}', '{"type":"error","error":"e1"}', '{"type":"hypothesis","text":"h"}']
    (tmp_path / "e.json").write_text("\n".join(lines))
    events = S.read_events(spark, str(tmp_path))
    assert events.count() == 4 and [r["text"] for r in S.results(events).collect()] == ["a"]
    assert S.failed(events, 1).first()["failed"] is False and S.failed(events, 1).first()["errors"] == "e1"
    assert S.failed(events.where("type = 'error'"), 1).first()["failed"] is True and S.failed(events.where("type = 'error'"), 0).first()["failed"] is False


def test_corpus_and_dictionary(spark, tmp_path):
    from talkloom.operators.phrases import corpus_lines

    (tmp_path / "summary_1.md").write_text("# 題\n\n- item\n**相手**: はい\n---\n", encoding="utf-8")
    lines = corpus_lines(S.read_corpus(spark, f"{tmp_path}/summary_*.md")).orderBy("ord")
    assert [r["text"] for r in lines.collect()] == ["題", "はい"]
    S.write_dictionary(str(tmp_path / "d.json"), [["a", "b"]], ["c"], ["d"], ["e"])
    (tmp_path / "bad.json").write_text("{")
    got = S.read_dictionary(str(tmp_path / "d.json"), str(tmp_path / "none.json"), str(tmp_path / "bad.json"), str(tmp_path / "d.json"))
    assert got == {"regex": [["a", "b"]] * 2, "drop_if_alone": ["c"] * 2, "grammar_phrases": ["d"] * 2}
    sf = "/root/testdata/sf0.001/pages.parquet"
    assert S.read_column(spark, sf, "url", 5).count() == 5


def test_settings(tmp_path):
    raw = {"live_window_sec": "9.5", "calendar_lookback_min": -3, "fast_summary": "false", "summary_sections": " a, ,b ", "unknown": 1, "live_interval_sec": "x", "language": 5}
    got = settings.coerce(raw)
    assert (got["live_window_sec"], got["calendar_lookback_min"], got["fast_summary"], got["summary_sections"], got["live_interval_sec"], got["language"]) == (9.5, 15, False, ["a", "b"], 1.2, "5")
    path = tmp_path / "s.json"
    assert settings.load(str(path)) == settings.DEFAULTS
    settings.save(got | {"_note": 1}, str(path))
    assert settings.load(str(path)) == got and "_note" not in json.loads(path.read_text())
    path.write_text("[1]")
    broken = settings.load(str(path))
    assert broken["_load_error"] and not path.exists() and broken["language"] == "ja"
    assert settings.live_backend(settings.DEFAULTS, True) == "rolling" and settings.live_backend(settings.DEFAULTS, False) == "native"
    assert settings.live_backend({"live_backend": "auto", "record_mic": False}, False) == "off"
    assert settings.fallback_backend("native", True, False) == "rolling" and settings.fallback_backend("native", True, True) == "off"


def test_document_sinks(spark, tmp_path):
    (tmp_path / "file").write_text("")
    path, error = sinks.write_text(str(tmp_path / "file" / "x.md"), "t", str(tmp_path / "second"))
    assert error and path == str(tmp_path / "second" / "x.md")
    assert sinks.write_text(str(tmp_path / "ok" / "x.md"), "t", "")[1] == ""
    sinks.write_documents(spark.createDataFrame([("a", "1\n2"), ("b", "3")], "name string, text string"), str(tmp_path / "docs"))
    assert {r["value"] for r in spark.read.text(str(tmp_path / "docs")).collect()} == {"1", "2", "3"}


def test_commit_rule_at_its_edges():
    rows = [(0.0, 1.0, "a"), (1.0, 2.5, "b"), (2.5, 2.51, "c"), (3.0, 4.0, "d")]
    final, rest, until = live.commit(rows, 4.0, 0.0)
    assert [r[2] for r in final] == ["a", "b"] and until == 2.5 and [r[2] for r in rest] == ["d"]
    assert live.commit(rows, 4.0, 2.5)[0] == []
    assert live.commit([(0.0, 0.05, "x")], 9.0, 0.0)[0] == []


def run_stream(spark, rows, schema, transform, tmp_path, batches, mode="append"):
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    for k, part in enumerate(batches):
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.mode("append").parquet(str(source))
    query = transform(stream).writeStream.format("memory").queryName("out_" + tmp_path.name.replace("-", "_")).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.sql("SELECT * FROM out_" + tmp_path.name.replace("-", "_")).collect()


def test_live_captions_settle_once(spark, tmp_path):
    schema = "meeting_id long, label string, captured double, st double, en double, txt string"
    rows = [(1, "m", 2.0, 0.0, 0.4, "a"), (1, "m", 2.0, 0.5, 1.9, "b?"), (1, "m", 4.0, 0.0, 0.4, "a"), (1, "m", 4.0, 0.5, 2.0, "b"), (1, "m", 4.0, 2.1, 3.9, "c?")]
    out = run_stream(spark, rows, schema, lambda s: live.live_captions(s, timeout=None), tmp_path, [(0, 1), (2, 3, 4)])
    assert sorted((r["txt"], r["kind"]) for r in out) == [("a", "final"), ("b", "final"), ("b?", "provisional"), ("c?", "provisional")]


def test_new_members_of_streams(spark, tmp_path):
    snapshots = [("h", 1, ["x"]), ("h", 2, ["x", "y"]), ("h", 3, ["y"]), ("h", 4, ["z", "x", "y"])]
    out = run_stream(spark, snapshots, "host string, at long, members array<string>", live.newly_running, tmp_path, [(0, 1), (2, 3)])
    assert sorted((r["at"], r["member"]) for r in out) == [(1, "x"), (2, "y"), (4, "x"), (4, "z")]


def test_late_snapshots_go(spark, tmp_path):
    snapshots = [("h", 1, ["x"]), ("h", 5, ["x", "y"]), ("h", 3, ["z"]), ("h", 6, ["y"]), ("h", 7, ["y", "x"])]
    out = run_stream(spark, snapshots, "host string, at long, members array<string>", live.newly_running, tmp_path, [(0, 1), (2, 3), (4,)])
    assert sorted((r["at"], r["member"]) for r in out) == [(1, "x"), (5, "y"), (7, "x")]


def test_hopping_levels_with_late_blocks(spark, tmp_path):
    start = pd.Timestamp("2026-01-01", tz="UTC")
    rows = [((start + pd.Timedelta(seconds=k)).to_pydatetime(), 1, "m", [0.5, -0.5]) for k in range(40)]
    out = run_stream(spark, rows, "ts timestamp, meeting_id long, label string, samples array<float>", live.windowed_levels, tmp_path, [range(20), range(20, 40)])
    assert out and all(abs(r["rms"] - 0.5) < 1e-6 for r in out)


def test_ring_is_bounded(spark):
    rows = [(1, "m", k, [0.0] * 10) for k in range(20)]
    df = spark.createDataFrame(rows, "meeting_id long, label string, frame_ix int, samples array<float>")
    kept = sorted(r["frame_ix"] for r in live.ring(df, rate=2, window=1.0).collect())
    assert kept == list(range(14, 20))  # 30 s at 2 Hz


def test_shown_text_of_events(spark, tmp_path):
    schema = "meeting_id long, label string, ord int, type string, text string"
    rows = [(1, "m", 0, "status", ""), (2, "m", 0, "hypothesis", "he"), (2, "m", 1, "hypothesis", "hello"), (3, "m", 0, "hypothesis", "hi"), (3, "m", 1, "result", "hi"), (3, "m", 2, "hypothesis", "hi"), (4, "m", 1, "result", "x"), (4, "m", 0, "status", "")]
    out = run_stream(spark, rows, schema, live.shown_text, tmp_path, [(0, 1, 3), (2, 4, 6), (5, 7)])
    assert sorted((r["meeting_id"], r["ord"], r["txt"], r["kind"]) for r in out) == [(1, 0, "...", "status"), (2, 0, "he", "provisional"), (2, 1, "hello", "provisional"), (3, 0, "hi", "provisional"), (3, 1, "hi", "final"), (4, 1, "x", "final")]


def test_rows_reach_a_callback(spark, tmp_path):
    seen = []
    (tmp_path / "in").mkdir()
    spark.range(3).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    sinks.notify(stream, lambda df, epoch: seen.extend(r["id"] for r in df.collect()), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(seen) == [0, 1, 2] and random.random() < 1
