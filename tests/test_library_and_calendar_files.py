"""Versions of a library of files, and a calendar stored by day."""

from __future__ import annotations

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from talkloom.operators import calendar, library
from talkloom.streaming.runs import file_system

MEETING = "title string, summary_md string, transcript_md string, save_dir string, duration int, ts string"


def meetings(spark, *titles):
    return spark.createDataFrame([(t, f"sum {t}", f"said {t} twice {t}", "d", 60, f"20260{1 + k}01_120000") for k, t in enumerate(titles)], MEETING)


def ids(df) -> dict:
    return {r.title: r.id for r in df.collect()}


def test_versions_are_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/library"
    assert library.published(spark, path)["meetings"].count() == 0
    assert library.publish(meetings(spark, "alpha", "beta"), path) == 1
    before = library.published(spark, path)
    with monkeypatch.context() as broken:  # fails between the writes: postings are there, lengths are not
        broken.setattr(library, "lengths", lambda m: m.select(F.raise_error(F.lit("disk full")).alias("id")))
        with pytest.raises(Exception, match="disk full"):
            library.publish(meetings(spark, "lost"), path)
    with monkeypatch.context() as broken:  # fails before the manifest: all three are there
        broken.setattr(library, "_announce", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            library.publish(meetings(spark, "lost too"), path)
    seen = library.published(spark, path)
    assert ids(seen["meetings"]) == {"alpha": 1, "beta": 2} and seen["lengths"].count() == 2
    assert seen["postings"].where("term = 'lost'").count() == 0
    assert library.publish(meetings(spark, "gamma"), path) == 2
    seen = library.published(spark, path)
    assert ids(seen["meetings"]) == {"alpha": 1, "beta": 2, "gamma": 3} and ids(before["meetings"]) == {"alpha": 1, "beta": 2}
    assert {r.id for r in seen["postings"].where("term = 'gamma'").collect()} == {3}
    assert [r.title for r in library.search(seen["meetings"], seen["postings"], "twice gamma", 5, seen["lengths"]).collect()] == ["gamma"]


def test_of_two_writers_one_follows_the_other(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/library"
    real, first = library._newest, []

    def slow(*a):
        """What one writer has read is old by the time it publishes."""
        found = real(*a)
        if not first:
            first.append(True)
            library.publish(meetings(spark, "other"), path)
        return found

    monkeypatch.setattr(library, "_newest", slow)
    assert library.publish(meetings(spark, "mine"), path) == 2
    assert ids(library.published(spark, path)["meetings"]) == {"other": 1, "mine": 2}


def test_a_manifest_that_was_cut_off_is_passed_over(spark, tmp_path):
    path = f"file://{tmp_path}/library"
    library.publish(meetings(spark, "alpha"), path)
    fs, place = file_system(spark, f"{path}/manifests/{2:010d}.json")
    out = fs.create(place, False)
    out.write(bytearray(b'[{"version": "x'))
    out.close()
    assert ids(library.published(spark, path)["meetings"]) == {"alpha": 1}
    assert library.publish(meetings(spark, "beta"), path) == 3
    assert ids(library.published(spark, path)["meetings"]) == {"alpha": 1, "beta": 2}


def test_a_window_of_stored_events_reads_its_days(spark, tmp_path):
    at = lambda d, h: datetime(2026, 3, d, h, tzinfo=UTC)
    rows = [(f"e{d}", at(d, 9), at(d, 10)) for d in range(1, 21)] + [("long", at(2, 8), at(19, 8)), ("long", at(2, 8), at(19, 8)), ("night", at(9, 23), at(10, 1)), ("none", None, None)]
    events = spark.createDataFrame(rows, "title string, start timestamp, end timestamp")
    path = str(tmp_path / "calendar")
    calendar.store_events(events, path)
    found = calendar.events_between(spark, path, at(10, 0), at(11, 9))
    assert sorted(r.title for r in found.collect()) == ["e10", "e11", "long", "long", "night"]
    scan = found._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert "PartitionFilters: [isnotnull(day" in found._jdf.queryExecution().executedPlan().toString()
    assert scan.metrics().apply("numPartitions").value() == 2  # of 20 days
    # the same titles from the window's events as from all of them
    moments = spark.createDataFrame([(1, at(10, 0)), (2, at(11, 8)), (3, at(10, 9))], "moment_id long, now timestamp")
    hints = lambda e: sorted((r.moment_id, r.hint) for r in calendar.title_hints(moments, e).collect())
    assert hints(found) == hints(calendar.valid_events(events)) and hints(found)[0] == (1, "night")
