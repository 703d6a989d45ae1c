"""Markdown documents: lines, verdicts, secrets, manifests, language tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.functions import text as T

#: Marks of secrets and suffixes of files that hold no text.
SECRET_MARKS = ("sk-", "ghp_", "github_pat_", "xoxb-", "AKIA", "-----BEGIN PRIVATE KEY-----")
BINARY_SUFFIXES = ("exe", "dll", "pyd", "pyc", "wav", "zip", "ico", "png", "pdf", "docx")
PLACEHOLDER = "Windows音声認識の確定結果がありません"
VERDICT_OUTROS = ("ご視聴ありがとうございました", "ご清聴ありがとうございました")
MIC_LINE = r"(?m)^\*\*あなた\*\*:"


def classified_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, text) as doc_id, line_no, kind and plain text of each line that is not
    blank or a rule: heading1 to heading3, bullet, numbered, paragraph."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    line = F.regexp_replace("raw", r"(?U)\s+$", "")
    bare = F.regexp_replace(line, r"^(?U)\s+", "")
    kinds = [
        (F.startswith(line, F.lit("### ")), "heading3", F.substring(line, F.lit(5), F.length(line))),
        (F.startswith(line, F.lit("## ")), "heading2", F.substring(line, F.lit(4), F.length(line))),
        (F.startswith(line, F.lit("# ")), "heading1", F.substring(line, F.lit(3), F.length(line))),
        (F.startswith(bare, F.lit("- ")) | F.startswith(bare, F.lit("* ")), "bullet", F.substring(bare, F.lit(3), F.length(bare))),
        (F.regexp_like(bare, F.lit(r"^\d+\.\s")), "numbered", F.regexp_replace(bare, r"^\d+\.\s", "")),
        (F.regexp_like(line, F.lit("^[-—–= ]+$")), "rule", F.lit("")),
    ]
    kind, text = F.lit("paragraph"), line
    for test, name, value in reversed(kinds):
        kind, text = F.when(test, name).otherwise(kind), F.when(test, value).otherwise(text)
    return lines.where(line != "").select("doc_id", "line_no", kind.alias("kind"), T.plain_inline(text).alias("text")).where("kind <> 'rule'")


def verdicts(documents: DataFrame, expected: Sequence[Sequence[str]] = ()) -> DataFrame:
    """Adds to (doc_id, text) what its transcript section holds, and `accepted`.
    expected: for each group, one of its phrases must occur."""
    heading = "文字起こし"
    part = F.col("transcript")
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(part, w))
    texts = F.lit(True)
    for group in expected:
        texts = texts & has(group)
    judged = documents.withColumn("transcript", T.markdown_section(F.col("text"), heading)).withColumns(
        {
            "has_transcript_section": F.length(part) > 20,
            "has_transcript_label": F.regexp_like(part, F.lit(r"(?m)^\*\*[^*]+\*\*:")),
            "has_expected_text": texts,
            "has_placeholder": F.contains(part, F.lit(PLACEHOLDER)),
            "has_outro": has(VERDICT_OUTROS),
            "has_unexpected_mic_row": F.regexp_like(part, F.lit(MIC_LINE)),
        }
    )
    good = F.expr("has_transcript_section and has_transcript_label and has_expected_text and not has_placeholder and not has_outro and not has_unexpected_mic_row")
    return judged.withColumn("accepted", good)


def with_secrets(files: DataFrame) -> DataFrame:
    """Paths of text files (path, text) that hold a mark of a secret, each once."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    marked = F.exists(F.array(*[F.lit(m) for m in SECRET_MARKS]), lambda m: F.contains(F.col("text"), m))
    return files.where(~suffix.isin(*BINARY_SUFFIXES) & ~F.contains("path", F.lit("__pycache__")) & marked).select("path").distinct().orderBy("path")


def manifest(files: DataFrame) -> DataFrame:
    """path, length and SHA-256 of binaryFile rows."""
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def resolved_language(requested: Column, supported: Column, default: Column) -> Column:
    """The requested tag if supported (or nothing is listed), else the first tag of
    its primary language, else the default."""
    primary = lambda tag: F.lower(F.get(F.split(tag, "-"), F.lit(0)))
    near = F.filter(supported, lambda tag: primary(tag) == primary(requested))
    return F.when((F.size(supported) == 0) | F.array_contains(supported, requested), requested).otherwise(F.coalesce(F.get(near, F.lit(0)), default))


def newest_file(files: DataFrame) -> DataFrame:
    return files.orderBy(F.desc("modificationTime"), "path").limit(1)


def largest_file(files: DataFrame) -> DataFrame:
    return files.orderBy(F.desc("length"), "path").limit(1)


def medians(measures: DataFrame, key: str, value: str) -> DataFrame:
    """Exact median of value for each key."""
    return measures.groupBy(key).agg(F.median(value).alias("median"))


def not_ready(statuses: DataFrame, first: int = 3) -> DataFrame:
    """The first rows (ord, name, ok, hint) of what is not ready."""
    return statuses.where(~F.col("ok")).orderBy("ord").limit(first)
