"""Operator 10: toxicity by maximum-scoring segments.

Each token has a log-odds score of toxic against clean documents, shrunk by a
Dirichlet prior and its own uncertainty, less a drift that makes clean text score
below zero. One linear scan finds all maximal scoring segments of a text. Extreme
value theory says how high clean text of that length scores by chance; segments
beyond that are significant, and a logistic curve turns their evidence into a
probability.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._spark import stored, tidy

#: Labelled documents the scorer is fitted on at most; a quarter calibrates it.
SAMPLE_DOCS = 20_000
CALIBRATION = 4
#: Prior mass of a token: a constant and a share of its documents in the sample;
#: deviations that count as noise; what each token costs.
PRIOR, PRIOR_SHARE, NOISE, DRIFT = 0.5, 0.01, 2.5, 0.5
#: Documents of the sample in which a token stands at least: with SAMPLE_DOCS this
#: bounds the tokens that are broadcast (16 bytes each).
MIN_DOCS = 4
#: Least shingle hashes that copies must share to count once in the sample.
SKETCH = 3
#: Expected number of chance segments below which a segment is significant.
SIGNIFICANT = 0.05


class Scorer(NamedTuple):
    """Sorted token hashes and their scores; extreme-value rate and log K;
    logistic intercept and slopes; share of toxic documents."""

    tokens: np.ndarray
    scores: np.ndarray
    rate: float
    log_k: float
    curve: tuple[float, ...]
    base: float


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score), in order, in linear time.

    Runs of positive scores, and of others, are summed first. A candidate holds the
    running total before it and at its end, and a link to the latest candidate that
    begins lower; a new run joins that one if it ends higher."""
    positive = scores > 0
    if not positive.any():
        return []
    cuts = np.concatenate([[0], np.flatnonzero(positive[1:] != positive[:-1]) + 1, [len(scores)]])
    sums = np.add.reduceat(scores, cuts[:-1])
    found: list[tuple[int, int, float, float, int]] = []
    total = 0.0
    for first, end, s in zip(cuts[:-1].tolist(), cuts[1:].tolist(), sums.tolist(), strict=True):
        before, total = total, total + s
        if s <= 0:
            continue
        k = len(found) - 1
        while True:
            while k >= 0 and found[k][2] >= before:
                k = found[k][4]
            if k < 0 or found[k][3] >= total:
                break
            at = k
            first, _, before, _, k = found[at]
            del found[at:]
        found.append((first, end, before, total, k))
    return [(a, b, hi - lo) for a, b, lo, hi, _ in found]


def token_scores(w: T.Words, scorer: Scorer) -> np.ndarray:
    """Score of each word; -DRIFT for those without one of their own."""
    if not len(scorer.tokens) or not len(w.hash):
        return np.full(len(w.hash), -DRIFT)
    at = np.minimum(np.searchsorted(scorer.tokens, w.hash), len(scorer.tokens) - 1)
    return np.where(scorer.tokens[at] == w.hash, scorer.scores[at], 0.0) - DRIFT


def _segments(column: pa.Array, scorer: Scorer):
    """Per text: its number of tokens, and (start, end, score) of each maximal
    segment in code points."""
    for part in T.slices(column):
        w = T.words(part, T.alphanumeric)
        scores = token_scores(w, scorer)
        first = np.searchsorted(w.text, np.arange(part.hi - part.lo + 1))
        chars = T.char_offsets(part)
        for k in range(part.hi - part.lo):
            a, b = first[k], first[k + 1]
            origin = chars[part.offsets[k]]
            yield int(b - a), [(int(chars[w.start[a + x]] - origin), int(chars[w.end[a + y - 1]] - origin), s) for x, y, s in maximal_segments(scores[a:b])]


def evidence(n: int, scores: list[float], scorer: Scorer) -> tuple[float, float]:
    """log(1 + nats beyond chance) of all significant segments; and what the best
    segment says, significant or not: its nats beyond chance, in logs on either side."""
    chance = scorer.log_k + math.log(max(n, 1))
    nats = [x for s in scores if (x := scorer.rate * s - chance) > -math.log(SIGNIFICANT)]
    best = scorer.rate * max(scores, default=0.0) - chance
    return math.log1p(sum(nats)), math.copysign(math.log1p(abs(best)), best)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Intercept and slopes by Newton's method, slopes held by a small ridge."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    hold = np.diag([1e-9] + [ridge] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p) + 1e-9)[:, None]) + hold, a.T @ (p - y) + hold @ w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def _count(batches):
    """Documents of each label that hold a token."""
    for batch in batches:
        toxic = batch.column("toxic").to_numpy()
        for part in T.slices(batch.column("text")):
            w = T.words(part, T.alphanumeric)
            pairs = np.unique(np.stack([w.hash, w.text.astype(np.uint64)]), axis=1)
            tokens, at, docs = np.unique(pairs[0], return_inverse=True, return_counts=True)
            ones = np.bincount(at, weights=toxic[part.lo + pairs[1].astype(np.int64)], minlength=len(tokens)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(docs - ones), pa.array(ones)], ["token", "clean", "toxic"])


def _sketch(batches):
    """Adds a digest of the SKETCH least hashes of a text's 5-word shingles: most
    copies with few changes agree in all of them, other texts do not."""
    for batch in batches:
        least = []
        for part in T.slices(batch.column("text")):
            sets, offsets = T.shingles(T.words(part), part.hi - part.lo, 5)
            least += [int(T.mix(sets[a : min(b, a + SKETCH)], 5).sum(dtype=np.uint64).view(np.int64)) for a, b in zip(offsets, offsets[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], [*batch.schema.names, "sketch"])


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether a document's label is never learnt from; a null doc_id's may be."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Scorer:
    """Learns token scores, extreme values and the curve from at most sample_docs
    labelled documents (the first by hash) that are not held out. Of repeated labels
    the highest counts, null ones do not. Without labels of both kinds every score
    is the share of toxic labels."""
    named = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and __id is not null")
    known = named.groupBy("__id").agg(F.max("toxic").alias("toxic")).where(~held_out("__id"))
    known = known.orderBy(F.xxhash64(F.lit(3), "__id"), "__id").limit(sample_docs)
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), F.col("doc_id") == F.col("__id"))
    # one document of near copies with one label, or each of their words would count
    # as often
    once = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", "text").mapInArrow(tidy(_sketch), "doc_id long, toxic int, text string, sketch long").groupBy("sketch", "toxic").agg(F.min(F.struct("doc_id", "toxic", "text")).alias("d"))
    sample = stored(once.select("d.toxic", (F.pmod(F.xxhash64(F.lit(4), "sketch"), F.lit(CALIBRATION)) == 0).alias("calibrates"), "d.text"), "toxic-sample")
    rows, ones = sample.agg(F.count("*"), F.sum("toxic")).first()
    nothing = Scorer(np.zeros(0, np.uint64), np.zeros(0), 1.0, 0.0, (0.0, 0.0, 0.0), (ones or 0) / max(rows, 1))
    if not ones or ones == rows:
        return nothing
    counts = stored(sample.where("not calibrates").select("toxic", "text").mapInArrow(tidy(_count), "token long, clean long, toxic long").groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "toxic-tokens")
    n0, n1 = counts.agg(F.sum("clean"), F.sum("toxic")).first()
    if not n0 or not n1:
        return nothing
    prior = F.lit(PRIOR) + PRIOR_SHARE * (F.col("clean") + F.col("toxic"))
    mass = PRIOR * counts.count() + PRIOR_SHARE * (n0 + n1)
    odds = lambda y, n: F.log((F.col(y) + prior) / (F.lit(n + mass) - F.col(y) - prior))
    judged = counts.where(F.col("clean") + F.col("toxic") >= MIN_DOCS).select("token", "clean", (odds("toxic", n1) - odds("clean", n0)).alias("odds"), F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior)).alias("deviation"))
    # odds inside the noise count as none, others lose the noise
    shrunk = judged.withColumn("score", F.signum("odds") * F.greatest(F.lit(0.0), F.abs("odds") - NOISE * F.col("deviation"))).where("score <> 0")
    top = shrunk.collect()  # no more than the sample's tokens over MIN_DOCS
    tokens = np.array([r["token"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(tokens)
    scores = np.array([r["score"] for r in top])[order]
    clean = np.array([r["clean"] for r in top], float)[order]
    if not (scores > DRIFT).any():
        return nothing
    scorer = nothing._replace(tokens=tokens[order], scores=scores, rate=_rate(scores - DRIFT, (clean + 0.5) / (n0 + 1.0)))
    calibrating = sample.where("calibrates").select("toxic", "text")
    # at most SAMPLE_DOCS / CALIBRATION rows, about, of two or three numbers
    best = calibrating.mapInArrow(tidy(_best_segments(scorer)), "toxic int, n long, best double").collect()
    chance = [scorer.rate * r["best"] - math.log(max(r["n"], 1)) for r in best if not r["toxic"]]
    scorer = scorer._replace(log_k=(float(np.mean(chance)) if chance else 0.0) - 0.5772156649)
    held = calibrating.mapInArrow(tidy(_evidence(scorer)), "toxic int, x array<double>").collect()
    x = np.array([r["x"] for r in held]).reshape(-1, 2)
    y = np.array([r["toxic"] for r in held], float)
    return scorer._replace(curve=_logistic(x, y)) if len(set(y)) > 1 else nothing


def _best_segments(scorer: Scorer):
    def run(batches):
        for batch in batches:
            found = [(n, max((s for *_, s in x), default=0.0)) for n, x in _segments(batch.column("text"), scorer)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], ["toxic", "n", "best"])

    return run


def _evidence(scorer: Scorer):
    def run(batches):
        for batch in batches:
            x = [list(evidence(n, [s for *_, s in found], scorer)) for n, found in _segments(batch.column("text"), scorer)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    return run


def _rate(scores: np.ndarray, shares: np.ndarray) -> float:
    """The rate at which clean text's segment scores thin out: the positive root of
    sum(share * exp(rate * score)) = 1; tokens beyond the vocabulary score -DRIFT."""
    rest = max(0.0, 1 - shares.sum())
    excess = lambda r: float((shares * np.exp(np.minimum(r * scores, 600))).sum()) + rest * math.exp(-r * DRIFT) - 1
    low, high = 1e-3, 1.0
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return high


SEGMENTS = "array<struct<start:long,end:long,nats:double>>"


def score_toxicity(documents: DataFrame, scorer: Scorer) -> DataFrame:
    """The rows of `documents` with toxic_score (0 to 1), toxic (1 from 0.5, else 0)
    and toxic_segments, the significant passages: start and end (code points, end
    exclusive) and nats beyond chance.

    Whole texts are read, in linear time; null and empty texts score as text without
    any passage. Columns of those three names are replaced, others pass; repeated
    rows score alike. An empty table gives an empty result."""
    documents = documents.drop("toxic_score", "toxic", "toxic_segments")
    sent = documents.sparkSession.sparkContext.broadcast(scorer)
    schema = documents.withColumn("text", F.col("text").cast("string")).withColumn("toxic_score", F.lit(0.0)).withColumn("toxic_segments", F.lit(None).cast(SEGMENTS)).schema
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("nats", pa.float64())]))

    def run(batches):
        scorer = sent.value
        for batch in batches:
            scores, segments = [], []
            for n, found in _segments(batch.column("text"), scorer):
                chance = scorer.log_k + math.log(max(n, 1))
                nats = [(a, b, x) for a, b, s in found if (x := scorer.rate * s - chance) > -math.log(SIGNIFICANT)]
                segments.append([{"start": a, "end": b, "nats": x} for a, b, x in nats])
                one, best = evidence(n, [s for *_, s in found], scorer)
                b0, b1, b2 = scorer.curve
                scores.append(1 / (1 + math.exp(-min(30.0, max(-30.0, b0 + b1 * one + b2 * best)))) if len(scorer.tokens) else scorer.base)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(segments, kind)], [*batch.schema.names, "toxic_score", "toxic_segments"])

    scored = documents.withColumn("text", F.col("text").cast("string")).mapInArrow(tidy(run), schema)
    return scored.withColumn("toxic", (F.col("toxic_score") >= 0.5).cast("int"))
