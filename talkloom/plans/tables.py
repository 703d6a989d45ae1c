"""Conversation tables derived from the shared test tables, in Spark and in SQL.

The test tables hold no timed speech; times, channels and speakers are whole-number
functions of their keys, so that both engines derive the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.operators.rows import MIC, SYSTEM


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows (meeting_id, ord, st, en, label, txt) of conversations."""
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id AS meeting_id",
        "CAST(turn AS INT) AS ord",
        "(turn * 8 + (conv_id * 3 + turn * 5) % 7) / 2D AS st",
        "(turn * 8 + (conv_id * 3 + turn * 5) % 7 + 3 + (conv_id + turn * 3) % 5) / 2D AS en",
        f"CASE WHEN role = 'user' THEN '{MIC}' ELSE '{SYSTEM}' END AS label",
        "text AS txt",
    )


ROWS_SQL = f"""r AS (SELECT conv_id AS meeting_id, CAST(turn AS INTEGER) AS ord,
 (turn * 8 + (conv_id * 3 + turn * 5) % 7) / 2.0::DOUBLE AS st,
 (turn * 8 + (conv_id * 3 + turn * 5) % 7 + 3 + (conv_id + turn * 3) % 5) / 2.0::DOUBLE AS en,
 CASE WHEN role = 'user' THEN '{MIC}' ELSE '{SYSTEM}' END AS label, text AS txt FROM conversations)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speaker turns (meeting_id, turn_ord, ts, te, spk) of conversations; every fifth
    comes 1000 seconds late, so that some rows overlap none."""
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id AS meeting_id",
        "CAST(turn AS INT) AS turn_ord",
        "(if((conv_id + turn) % 5 = 0, 2000, 0) + turn * 8 + (conv_id * 5 + turn) % 9) / 2D AS ts",
        "(if((conv_id + turn) % 5 = 0, 2000, 0) + turn * 8 + (conv_id * 5 + turn) % 9 + 2 + (conv_id + turn) % 4) / 2D AS te",
        "CAST((conv_id + turn) % (1 + conv_id % 3) AS INT) AS spk",
    )


TURNS_SQL = """t AS (SELECT conv_id AS meeting_id, CAST(turn AS INTEGER) AS turn_ord,
 (if((conv_id + turn) % 5 = 0, 2000, 0) + turn * 8 + (conv_id * 5 + turn) % 9) / 2.0::DOUBLE AS ts,
 (if((conv_id + turn) % 5 = 0, 2000, 0) + turn * 8 + (conv_id * 5 + turn) % 9 + 2 + (conv_id + turn) % 4) / 2.0::DOUBLE AS te,
 CAST((conv_id + turn) % (1 + conv_id % 3) AS INTEGER) AS spk FROM conversations)"""


def said_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations in which every turn is repeated at once: conv_id, turn (twice
    the given one, and one more), role, text."""
    return table(spark, sf_dir, "conversations").selectExpr("conv_id", "explode(array(2 * turn, 2 * turn + 1)) AS turn", "role", "text")


SAID_TWICE_SQL = "d AS (SELECT conv_id, unnest([2 * turn, 2 * turn + 1]) AS turn, role, text FROM conversations)"


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample blocks (meeting_id, label, frame_ix, samples) of events: two samples
    each, the channel by kind of event, loudness by meeting."""
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS meeting_id",
        f"CASE WHEN event_type IN ('click', 'view') THEN '{MIC}' ELSE '{SYSTEM}' END AS label",
        "event_id AS frame_ix",
        "array(value / (10 + 90 * (user_id % 4)), - value / (20 + 2000 * (user_id % 3))) AS samples",
    )


BLOCKS_SQL = f"""b AS (SELECT user_id AS meeting_id,
 CASE WHEN event_type IN ('click', 'view') THEN '{MIC}' ELSE '{SYSTEM}' END AS label, event_id AS frame_ix,
 [value / (10 + 90 * (user_id % 4)), - value / (20 + 2000 * (user_id % 3))] AS samples FROM events)"""

LEVELS_SQL = BLOCKS_SQL + """, s AS (SELECT meeting_id, label, unnest(samples) AS x FROM b),
l AS (SELECT meeting_id, label, sqrt(avg(x * x)) AS rms, avg(CASE WHEN abs(x) >= CAST(0.98 AS FLOAT) THEN 1.0 ELSE 0.0 END) AS clip FROM s GROUP BY ALL)"""


def meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library rows of documents: the first line is the title."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.left(F.get(F.split("text", "\n"), F.lit(0)), F.lit(60)).alias("title"),
        F.left("text", F.lit(400)).alias("summary_md"),
        F.col("text").alias("transcript_md"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 7919 % 100_003).alias("created_at"),
    )


MEETINGS_SQL = """m AS (SELECT doc_id AS id, left(string_split(text, chr(10))[1], 60) AS title, left(text, 400) AS summary_md,
 text AS transcript_md, make_timestamp((1700000000 + doc_id * 7919 % 100003) * 1000000) AS created_at FROM documents)"""
