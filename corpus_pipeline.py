"""Corpus pipeline: each stage takes the documents that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.llm import queries
from talkloom.llm._spark import stored
from talkloom.llm.mixing import mix_sources
from talkloom.llm.ngram_join import one_of_each_class
from talkloom.llm.packing import pack_documents
from talkloom.llm.pii import redact_personal_data
from talkloom.llm.toxicity import fit, score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents it rejects go. Learnt from the labels of docs."""
    scorer = fit(docs, queries.table(spark, sf_dir, "labels"))
    return score_toxicity(docs, scorer).where("toxic = 0").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each class of near copies one document stays."""
    return one_of_each_class(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: personal data is replaced by its kind; n_chars follows."""
    return redact_personal_data(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents by target weights, once for each epoch."""
    return mix_sources(docs, queries.WEIGHTS, queries.mix_levels()).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: pieces of all documents in sequences of at most 4096 tokens."""
    return pack_documents(docs, remembered=64 << 20)  # executors still hold what earlier stages needed


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("personal_data", redact),
    ("mixing", mix),
    ("packing", pack),
]

#: Trees, tokenizer and verified similarity are beyond SQL: tests compare each
#: stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what one returns is written to the
    shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
