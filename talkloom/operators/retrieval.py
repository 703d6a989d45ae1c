"""Selecting the parts of a transcript that a question needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.functions import text as T

CHUNK_CHARS, CONTEXT_CHARS, LEAST_EXCERPT = 8000, 24_000, 1200


def _selected(scores: Column, sizes: Column, budget: int) -> Column:
    """Indices: first and last chunk, then by score until the sum reaches budget."""
    n = F.size(scores)
    order = F.array_sort(F.transform(scores, lambda s, k: F.struct((-s).alias("s"), k.alias("k"))))
    start = F.struct(F.array_distinct(F.array(F.lit(0), n - 1)).alias("picked"), F.lit(False).alias("done"))
    total = lambda picked: F.aggregate(picked, F.lit(0), lambda t, k: t + F.get(sizes, k))

    def step(state, x):
        stops = state["done"] | (x["s"] >= 0)
        picked = F.when(stops | F.array_contains(state["picked"], x["k"]), state["picked"]).otherwise(F.array_append(state["picked"], x["k"]))
        return F.struct(picked.alias("picked"), (stops | (total(picked) >= budget)).alias("done"))

    picked = F.aggregate(order, start, step, lambda s: s["picked"])
    return F.array_sort(F.when((F.size(picked) <= 2) & (n > 2), F.array_union(picked, F.array(F.floor(n / 2).cast("int")))).otherwise(picked))


def context(questions: DataFrame, chunk_chars: int = CHUNK_CHARS, budget: int = CONTEXT_CHARS) -> DataFrame:
    """Adds `context` to (question, transcript, ...): the whole transcript if it is
    short, else excerpts of its first, last and best-scoring chunks."""
    prepared = questions.withColumn("_chunks", T.chunks("transcript", chunk_chars)).withColumn("_terms", T.query_terms("question"))
    sized = prepared.withColumn("_sizes", F.transform("_chunks", F.length)).withColumn("_all", F.aggregate("_sizes", F.lit(0), lambda t, n: t + n))
    short = (F.size("_chunks") <= 2) | (F.col("_all") <= budget)
    scored = sized.withColumn("_scores", F.when(~short, F.transform("_chunks", lambda c: T.term_score(c, F.col("_terms")))))
    picked = scored.withColumn("_picked", F.when(~short, _selected(F.col("_scores"), F.col("_sizes"), budget)))
    limit = F.greatest(F.lit(LEAST_EXCERPT), F.floor(F.lit(budget) / F.size("_picked")).cast("int"))
    n = F.size("_chunks").cast("string")
    part = lambda k: F.struct(k.alias("k"), T.excerpt(F.get("_chunks", k), F.col("_terms"), limit).alias("x"))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("total"))

    def keep(s, p):
        size = F.length(p["x"])
        skip = (s["total"] + size > budget) & (F.size(s["out"]) > 0)
        text = F.concat(F.lit("[chunk "), (p["k"] + 1).cast("string"), F.lit("/"), n, F.lit("]\n"), p["x"])
        return F.when(skip, s).otherwise(F.struct(F.array_append(s["out"], text).alias("out"), (s["total"] + size).alias("total")))

    long = F.aggregate(F.transform("_picked", part), start, keep, lambda s: F.array_join(s["out"], "\n\n...\n\n"))
    return picked.withColumn("context", F.when(short, F.array_join("_chunks", "\n")).otherwise(long)).select(*questions.columns, "context")


def chunk_scores(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """chunks (doc_id, idx, text, ...) by terms (term): doc_id, idx, what other columns
    there are, and score, the sum of occurrences times length. The terms of a question
    are a few rows and become literals: a filter on the score of a cross join is
    sometimes pushed to the terms' side, where there is no text."""
    listed = F.array(*[F.lit(r[0]) for r in terms.select("term").where("term is not null").collect()]).cast("array<string>")
    kept = [c for c in chunks.columns if c != "text"]
    return chunks.select(*kept, T.term_score(F.col("text"), listed).alias("score"))


def within_budget(scored: DataFrame, budget: int) -> DataFrame:
    """Per document, chunks (doc_id, idx, score, size) by falling score until those
    before already reach the budget; scores of 0 never."""
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "idx")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return scored.where("score > 0").withColumn("_before", before).where(F.col("_before") < budget).drop("_before")
