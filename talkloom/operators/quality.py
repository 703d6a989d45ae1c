"""Scoring and choosing among candidate transcripts of a meeting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.functions import text as T

#: Terms that speak for a text, and the least scores.
DOMAIN_TERMS = ("ライブ", "文字起こし", "停止後", "Windows", "音声認識")
ACCEPTED, SECOND_LEAST, SECOND_SHARE = 4.0, 6.0, 0.55


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def quality(text: Column, confidence: Column, live: Column, terms: Sequence[str] = DOMAIN_TERMS) -> Column:
    """Score of a text: length, share of Japanese, known terms and confidence speak
    for it; Latin letters, stuttered kana, shortness and low confidence against."""
    n = F.length(text)
    hits = sum((F.when(F.contains(text, F.lit(t)), 1).otherwise(0) for t in terms), F.lit(0))
    sure = F.coalesce(confidence.cast("double"), F.lit(0.0))
    score = (
        F.least(n, F.lit(120)) / 8.0
        + 20.0 * count_of(text, "[ぁ-んァ-ン一-龯]") / F.greatest(F.lit(1), n)
        + 8.0 * hits
        + 35.0 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure))
        + F.when(live, 4.0).otherwise(0.0)
        - 2.5 * count_of(text, "[A-Za-z]")
        - 1.2 * count_of(text, "[ッっー]{2,}|[ァ-ン]{1,2}(?=[ァ-ン]{1,2})")
        - F.when(n < 6, 12.0).otherwise(0.0)
        - F.when(~live & (sure != 0) & (sure < 0.18), 28.0).otherwise(0.0)
    )
    return F.when(F.coalesce(n, F.lit(0)) == 0, -100.0).otherwise(score)


def scored_candidates(rows: DataFrame, terms: Sequence[str] = DOMAIN_TERMS) -> DataFrame:
    """Candidates from rows (meeting_id, cand, cand_ord, live, ord, st, label, txt,
    confidence): mean confidence (null: 0) and score of their texts joined by 。."""
    texts = F.array_sort(F.collect_list(F.when(F.coalesce("txt", F.lit("")) != "", F.struct("ord", "txt"))))
    joined = F.array_join(F.transform(texts, lambda x: x["txt"]), "。")
    spaced = F.array_join(F.transform(texts, lambda x: x["txt"]), " ")
    grouped = rows.groupBy("meeting_id", "cand", "cand_ord", "live").agg(F.avg(F.coalesce("confidence", F.lit(0.0))).alias("confidence"), joined.alias("joined"), spaced.alias("spaced"))
    return grouped.withColumn("score", quality(F.col("joined"), F.col("confidence"), F.col("live"), terms))


def chosen_rows(rows: DataFrame, policy: str = "auto_dedupe", terms: Sequence[str] = DOMAIN_TERMS) -> DataFrame:
    """Rows of the candidates that count: under all_active all accepted ones, else the
    best and those good enough against it that say something else. A meeting is
    compared with its one best candidate."""
    accepted = scored_candidates(rows, terms).where((F.col("joined") != "") & (F.col("score") >= ACCEPTED))
    if policy != "all_active":
        rank = Window.partitionBy("meeting_id").orderBy(F.desc("score"), "cand_ord")
        first = rank.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ranked = accepted.withColumns({"_rank": F.row_number().over(rank), "_best": F.first("score").over(first), "_text": F.first("spaced").over(first)})
        good = (F.col("score") >= F.greatest(F.lit(SECOND_LEAST), F.col("_best") * SECOND_SHARE)) & ~T.similar(F.col("_text"), F.col("spaced"))
        accepted = ranked.where((F.col("_rank") == 1) | good)
    return rows.join(accepted.select("meeting_id", "cand"), ["meeting_id", "cand"], "left_semi")
