"""What went wrong on larger tables only."""

from __future__ import annotations

import random
import time
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from talkloom.operators import calendar, library
from talkloom.operators.rows import in_order
from talkloom.plans import catalogue
from talkloom.sources import text, wav

LARGER = "/root/testdata/check_s"


@pytest.mark.parametrize("name", ["chunk_scores", "chunks_within_budget"])
def test_no_filter_on_a_score_is_planned_where_there_is_no_text(spark, name):
    found = catalogue.QUERIES[name](spark, LARGER)
    plan = (found.where("score > 0") if "score" in found.columns else found)._jdf.queryExecution().executedPlan().toString()
    assert "!Filter" not in plan and "!Project" not in plan  # Spark's mark of an operator whose columns are missing


def test_hints_of_crowded_calendars_are_those_of_all_pairs(spark):
    draw = random.Random(5)
    at = lambda m: datetime(2026, 5, 1, tzinfo=UTC) + timedelta(minutes=m)
    events = [(draw.choice("abcdef"), s, s + draw.choice([1, 2, 5, 20, 90])) for s in (draw.choice([draw.randrange(240), draw.randrange(600)]) for _ in range(200))]
    moments = [(k, draw.randrange(-30, 720)) for k in range(600)]

    def hint(now):
        near = [(t, s, e) for t, s, e in events if s <= now + 10 and e >= now - 15]
        key = lambda x: (0, -x[1], -x[2], x[0]) if x[1] <= now <= x[2] else (1, abs(x[1] - now), x[1], x[0])
        return min(near, key=key)[0] if near else ""

    found = calendar.title_hints(
        spark.createDataFrame([(k, at(m)) for k, m in moments] + [(-1, None)], "moment_id long, now timestamp"),
        spark.createDataFrame([(t, at(s), at(e)) for t, s, e in events] + [("none", None, None)], "title string, start timestamp, end timestamp"),
    )
    assert sorted((r.moment_id, r.hint) for r in found.collect()) == sorted([(k, hint(m)) for k, m in moments] + [(-1, "")])


def test_a_hint_takes_no_pairs_of_moments_and_events(spark):
    now = lambda: F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 600)
    moments = spark.range(20_000).select(F.col("id").alias("moment_id"), now().alias("now"))
    events = spark.range(20_000).select(F.concat(F.lit("e"), "id").alias("title"), now().alias("start"), (now() + F.expr("interval 1 hour")).alias("end"))
    began = time.time()
    assert calendar.title_hints(moments, events).where("hint <> ''").count() == 20_000  # of 400 million pairs
    assert time.time() - began < 30


def test_places_are_right_where_rows_are_wide(spark):
    # ranges of wide rows stay apart, those of their keys alone are coalesced
    wide = F.concat(*[F.sha2(F.concat("id", F.lit(str(k))), 256) for k in range(16)])
    df = spark.range(30_000).select(((F.col("id") * 7919) % 30_011).alias("id")).withColumn("text", wide)
    found = in_order(df, "nth", "id").select("id", "nth", "text").toPandas().sort_values("id")
    assert found.nth.tolist() == list(range(1, 30_001)) and found.text.str.len().eq(1024).all()


def test_all_ranked_meetings_are_found(spark, tmp_path):
    spark.range(70).select(F.col("id").alias("doc_id"), F.concat(F.lit("here and the is, no "), "id").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    assert catalogue.QUERIES["searched_meetings"](spark, str(tmp_path)).count() == 70
    spark.range(70).select(F.col("id").alias("doc_id"), F.concat(F.lit("here andXthe, is no "), "id").alias("text")).write.parquet(f"{tmp_path}/other/documents.parquet")
    assert catalogue.QUERIES["searched_meetings"](spark, f"{tmp_path}/other").count() == 50  # none is ranked: the newest that contain the text


def test_samples_are_cut_off_from_doubles(spark, tmp_path):
    steps = list(range(1000, 1200))
    blocks = spark.createDataFrame([(1, "mic", k, [(k - 1e-6) / 32767]) for k in steps], "meeting_id long, label string, frame_ix int, samples array<double>")
    wav.write_channels(blocks, str(tmp_path / "out"))
    read = spark.read.format("talkloom_wav").load(str(tmp_path / "out")).select(F.explode("samples").alias("x")).collect()
    assert [round(r.x * 32768) for r in read] == [k - 1 for k in steps]


def test_postings_are_not_shuffled(spark):
    m = spark.createDataFrame([(1, "B a b", "", "a"), (2, None, "ä", None)], "id long, title string, summary_md string, transcript_md string")
    found = library.postings(m)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in found.collect()) == [(1, "title", "a", [1], 3), (1, "title", "b", [0, 2], 3), (1, "transcript_md", "a", [0], 1), (2, "summary_md", "a", [0], 1)]


def test_a_capped_column_is_read_by_many_tasks(spark, tmp_path):
    path = str(tmp_path / "pages.parquet")
    spark.range(0, 30, 1, 3).select(F.when(F.col("id") % 10 > 0, F.concat(F.lit(" t"), "id")).alias("html")).write.parquet(path)
    found = text.read_column(spark, path, "html", 1 << 30)
    assert found.count() == 27 and "Limit" not in found._jdf.queryExecution().executedPlan().toString()
    assert text.read_column(spark, path, "html", 25).count() == 22 and text.read_column(spark, path, "html", 0).count() == 0
    assert [r.text for r in text.read_column(spark, path, "html", 3).collect()] == ["t1", "t2"]
