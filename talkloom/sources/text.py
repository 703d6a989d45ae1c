"""Text sources: recogniser events, calendars, corpora, dictionaries, catalogues."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkloom.operators.calendar import valid_events
from talkloom.operators.rows import MIC, SYSTEM, in_order, merge_channels

EVENT = "type string, text string, confidence double, error string, ts long"
#: Time zones that calendars name in another way.
TIME_ZONES = {
    "tokyo standard time": "Asia/Tokyo",
    "utc": "UTC",
    "gmt standard time": "Europe/London",
    "w. europe standard time": "Europe/Berlin",
    "romance standard time": "Europe/Paris",
    "eastern standard time": "America/New_York",
    "central standard time": "America/Chicago",
    "pacific standard time": "America/Los_Angeles",
}


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Recogniser events of JSON-lines files; lines that do not parse go."""
    rows = spark.read.schema(EVENT + ", _bad string").option("columnNameOfCorruptRecord", "_bad").option("mode", "PERMISSIVE").json(path)
    return rows.where("_bad is null and type is not null").drop("_bad")


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream of files."""
    return spark.readStream.schema(EVENT).json(path).where("type is not null")


def dispatched(events: DataFrame) -> DataFrame:
    """Events by what they say: kind final (results with text), provisional
    (hypotheses with text), status or error, and txt; others go."""
    text = F.trim(F.coalesce("text", F.lit("")))
    kind = F.when((F.col("type") == "result") & (text != ""), "final").when((F.col("type") == "hypothesis") & (text != ""), "provisional").when(F.col("type").isin("status", "error"), F.col("type"))
    txt = F.when(kind == "error", F.coalesce("error", F.lit(""))).when(kind == "status", F.lit("...")).otherwise(text)
    return events.withColumn("kind", kind).withColumn("txt", txt).where("kind is not null").drop("type", "text", "error")


def two_sources(microphone: DataFrame | None, system: DataFrame | None) -> DataFrame:
    """Streams or tables of both channels as one, with their labels; a channel that is
    off is None."""
    on = [df.withColumn("label", F.lit(label)) for df, label in ((microphone, MIC), (system, SYSTEM)) if df is not None]
    if not on:
        raise ValueError("both channels are off")
    return merge_channels(*on)


def results(events: DataFrame) -> DataFrame:
    """Recognised texts that are not blank."""
    return events.where("type = 'result' and trim(coalesce(text, '')) <> ''")


def failed(events: DataFrame, exit_code: int) -> DataFrame:
    """One row: whether a recogniser run failed (it ended with an error and gave no
    result) and its errors, joined."""
    good = F.count(F.when((F.col("type") == "result") & (F.trim(F.coalesce("text", F.lit(""))) != ""), 1))
    errors = F.array_join(F.collect_list(F.when(F.col("type") == "error", F.col("error"))), "\n")
    return events.agg((F.lit(exit_code != 0) & (good == 0)).alias("failed"), errors.alias("errors"))


def ics_time(value: Column, zone: Column, local: str) -> Column:
    """Instant of an iCalendar date or date-time: midnight for dates, UTC with a Z,
    else in its zone, or the local one if it has none that is known."""
    value = F.trim(value)
    known = F.lower(F.trim(F.replace(F.coalesce(zone, F.lit("")), F.lit('"'), F.lit(""))))
    named = F.lit(local)
    for windows, iana in TIME_ZONES.items():
        named = F.when(known == windows, iana).otherwise(named)
    given = F.when(F.regexp_like(known, F.lit(r"^[a-z_]+/[a-z_/+-]+$")), F.trim(F.replace(zone, F.lit('"'), F.lit("")))).otherwise(named)
    day = F.try_to_timestamp(F.when(F.regexp_like(value, F.lit(r"^\d{8}$")), value), F.lit("yyyyMMdd"))
    time = F.try_to_timestamp(F.when(F.regexp_like(value, F.lit(r"^\d{8}T\d{6}Z?$")), F.left(value, F.lit(15))), F.lit("yyyyMMdd'T'HHmmss"))
    at = F.to_utc_timestamp(F.coalesce(day, time), F.when(F.endswith(value, F.lit("Z")), "UTC").otherwise(given))
    return at


def unescape_ics(c: Column) -> Column:
    out = c
    for a, b in ((r"\n", " "), (r"\N", " "), (r"\,", ","), (r"\;", ";"), (r"\\", "\\")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(out)


def ics_events(texts: DataFrame, local: str = "UTC") -> DataFrame:
    """(path, text) of iCalendar files as path, title, start, end: events with title
    and start, without recurrences. The session's time zone must be UTC."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "^﻿", ""), "\r\n?", "\n"), "\n+[ \t]", "")
    blocks = F.regexp_extract_all(plain, F.lit(r"(?s)(?:^|\n)BEGIN:VEVENT\n(.*?)\nEND:VEVENT"), 1)
    block = texts.select("path", F.posexplode(blocks).alias("nth", "block"))

    def last(name: str) -> Column:
        found = F.regexp_extract_all("block", F.lit(rf"(?im)^({name}(?:;[^:\n]*)?:.*)$"), 1)
        return F.element_at(found, F.when(F.size(found) > 0, -1))

    value = lambda p: F.regexp_extract(p, r"^[^:]*:(.*)$", 1)
    zone = lambda p: F.regexp_extract(p, r"(?i)^[^:]*;TZID=([^;:]*)", 1)
    lines = block.select("path", last("SUMMARY").alias("s"), last("DTSTART").alias("b"), last("DTEND").alias("e"))
    events = lines.select("path", unescape_ics(value(F.col("s"))).alias("title"), ics_time(value(F.col("b")), zone(F.col("b")), local).alias("start"), ics_time(value(F.col("e")), zone(F.col("e")), local).alias("end"))
    return valid_events(events)


def read_ics(spark: SparkSession, path: str, local: str = "UTC") -> DataFrame:
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return ics_events(texts, local)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Lines of Markdown files in order: ord, value."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("at", "value"))
    return whole.withColumn("ord", F.struct("path", "at")).select("ord", "value")


def read_column(spark: SparkSession, path: str, column: str, rows: int) -> DataFrame:
    """Texts of one Parquet column that are not blank, among the first `rows`: by path
    of file, then by place in it. Only the file where they end is known to the driver;
    a limit would bring all of them to one task."""
    table = spark.read.parquet(path)
    files = table.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))
    upto = files.withColumn("upto", F.sum("n").over(Window.orderBy("file")))
    end = upto.where(F.col("upto") > rows).orderBy("file").select("file", (F.col("n") - F.col("upto") + rows).alias("left")).first()
    if end is not None:
        file, place = F.col("_metadata.file_path"), F.col("_metadata.row_index")
        table = table.where((file < end["file"]) | ((file == end["file"]) & (place < end["left"])))
    return table.select(F.trim(F.col(column)).alias("text")).where("text <> ''")


def catalogue(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length and modificationTime of files; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


def read_dictionary(*paths: str) -> dict[str, list]:
    """Correction rules, noise fragments and phrases of JSON files, one after
    another, duplicates kept; files that are missing or do not parse are skipped."""
    out: dict[str, list] = {"regex": [], "drop_if_alone": [], "grammar_phrases": []}
    for path in paths:
        try:
            data = json.loads(Path(path).read_text(encoding="utf-8"))
        except (OSError, ValueError):
            continue
        for key in out:
            out[key] += data.get(key) or []
    return out


def write_dictionary(path: str, rules: Sequence, drop: Sequence[str], phrases: Sequence[str], top: Sequence[str]) -> None:
    data = {"regex": list(rules), "drop_if_alone": list(drop), "grammar_phrases": list(phrases), "top_phrases": list(top)}
    Path(path).write_text(json.dumps(data, ensure_ascii=False, indent=2), encoding="utf-8")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Adds ord, the place in the given order."""
    return in_order(df, "ord", *order)
