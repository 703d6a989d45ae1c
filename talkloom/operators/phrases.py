"""Phrase statistics of a corpus and the dictionary they make."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.functions import text as T

#: Fixed value: what counts as a phrase in running text.
PHRASE_PATTERN = "[一-龯ぁ-んァ-ンA-Za-z0-9０-９ー]{4,24}"


def phrase_counts(texts: DataFrame, terms: Sequence[str] = ()) -> DataFrame:
    """phrase, n and first place (of texts: ord, text): once for each text that holds
    a term, and once for each cleaned run of 4 to 24 characters."""
    said = lambda phrase, term: F.struct(phrase.alias("phrase"), F.lit(term).alias("term"))
    held = F.transform(F.filter(F.array(*[F.lit(t) for t in terms]).cast("array<string>"), lambda t: F.contains(F.col("text"), t)), lambda t: said(t, True))
    # a run needs no cleaning, but for runs of digits alone: those go once counted
    runs = F.transform(F.regexp_extract_all("text", F.lit(PHRASE_PATTERN), 0), lambda r: said(r, False))
    # what a phrase is travels with it: nothing looks at the text again
    each = texts.select("ord", F.posexplode(F.concat(held, runs)).alias("at", "said")).select("ord", "at", "said.phrase", "said.term")
    counted = each.groupBy("phrase").agg(F.count("*").alias("n"), F.count_if("term").alias("held"), F.min(F.struct("ord", "at")).alias("first"), F.min(F.when(F.col("term"), F.struct("ord", "at"))).alias("first_held"))
    digits = F.regexp_like("phrase", F.lit("^[0-9０-９]+$"))
    n, first = F.when(digits, F.col("held")).otherwise(F.col("n")), F.when(digits, F.col("first_held")).otherwise(F.col("first"))
    return counted.select("phrase", n.alias("n"), first.alias("first")).where("n > 0")


def most_common(counts: DataFrame, n: int = 500) -> DataFrame:
    """The n most frequent phrases, ties by first place."""
    return counts.orderBy(F.desc("n"), "first").limit(n).select("phrase", "n")


def distinct_phrases(phrases: DataFrame, limit: int, clean: bool = False) -> DataFrame:
    """(ord, phrase) of 3 to 28 characters, each once at its first place, the first
    `limit` of them."""
    text = T.clean_phrase("phrase") if clean else T.strip("phrase")
    good = phrases.select("ord", text.alias("phrase")).where(F.length("phrase").between(3, 28))
    return good.groupBy("phrase").agg(F.min("ord").alias("ord")).orderBy("ord").limit(limit)


def expanded_rules(counts: DataFrame, base: Sequence[Sequence[str]], extra: Sequence[tuple[Sequence[str], Sequence[Sequence[str]]]]) -> DataFrame:
    """Rules (ord, pattern, replacement): the base, then each extra block of rules
    one of whose trigger phrases occurs in counts."""
    spark = counts.sparkSession
    blocks = [(k, j, None, *rule) for k, rules in enumerate([base]) for j, rule in enumerate(rules)]
    blocks += [(k + 1, j, list(triggers), *rule) for k, (triggers, rules) in enumerate(extra) for j, rule in enumerate(rules)]
    rules = spark.createDataFrame(blocks, "block int, nth int, triggers array<string>, pattern string, replacement string")
    present = counts.where(F.col("phrase").isin([t for triggers, _ in extra for t in triggers])).agg(F.collect_set("phrase").alias("present"))
    kept = rules.crossJoin(F.broadcast(present)).where(F.col("triggers").isNull() | F.arrays_overlap("triggers", "present"))
    return kept.select((F.col("block") * 1000 + F.col("nth")).alias("ord"), "pattern", "replacement")


def corpus_lines(lines: DataFrame) -> DataFrame:
    """Texts of Markdown lines (ord, value): without heading marks and speaker labels;
    list items, rules and blank lines go."""
    bare = T.strip(F.regexp_replace(T.strip(F.regexp_replace("value", r"^#+(?U)\s*", "")), r"^\*\*[^*]+\*\*:(?U)\s*", ""))
    return lines.select("ord", bare.alias("text")).where((F.col("text") != "") & ~F.startswith("text", F.lit("-")))
