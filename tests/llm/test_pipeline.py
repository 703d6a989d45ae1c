"""Each stage of the corpus pipeline on its own input, and the whole run."""

from __future__ import annotations

from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_model_operators import plain_spans  # noqa: E402
from test_text_operators import brute_links, check_packed  # noqa: E402

from talkloom.llm import queries as Q  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    """Input and output of each stage, written and read again."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = (docs, after)
        docs = after
    return out


def test_stages_and_columns(steps):
    assert list(steps) == ["toxicity", "ngram_jaccard_join", "personal_data", "mixing", "packing"]
    assert all(after.columns == COLUMNS for name, (_, after) in steps.items() if name != "packing")


def test_toxic_documents_go_and_clean_ones_stay(spark, sf, steps):
    before, after = steps["toxicity"]
    judged = {r["doc_id"]: r["predicted"] for r in Q.op10_toxicity(spark, sf).collect()}
    assert {r["doc_id"] for r in after.collect()} == {d for d, p in judged.items() if not p}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    gone = {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in after.collect()}
    assert gone and sum(1 - labels.get(d, 1) for d in gone) <= 0.1 * len(gone)


def test_one_document_of_each_class_stays(steps):
    before, after = steps["ngram_jaccard_join"]
    want = {c for _, c, _ in brute_links(before.collect())}
    assert Counter(r["doc_id"] for r in after.collect()) == Counter(want)


def test_personal_data_is_gone(steps):
    before, after = steps["personal_data"]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    rows = after.collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        assert r["n_chars"] == len(r["text"])
        found = plain_spans(texts[r["doc_id"]])
        assert all(texts[r["doc_id"]][a:b] not in r["text"] for _, a, b in found)
    assert sum(r["text"] != texts[r["doc_id"]] and not plain_spans(texts[r["doc_id"]]) for r in rows) <= 0.005 * len(rows)


def test_the_mix_keeps_to_its_budget(steps):
    before, after = steps["mixing"]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    taken = Counter(r["doc_id"] for r in after.collect())
    words = {d: len(t.split()) for d, t in texts.items()}
    budget = sum(words.values()) * 6 // 10
    assert max(taken.values()) <= 2 and set(taken) <= set(texts)
    used = sum(words[d] * n for d, n in taken.items())
    assert 0.8 * budget < used <= budget * 1.01  # words() also splits at rare blanks


def test_all_of_the_mix_is_packed(steps):
    before, after = steps["packing"]
    check_packed(after.collect(), 4096, [(r["doc_id"], r["text"]) for r in before.collect()])


def test_run_gives_what_the_stages_give(spark, sf, steps):
    key = lambda df: sorted((r["doc_id"], r["start"], r["length"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf)) == key(steps["packing"][1])


def test_stages_take_awkward_rows(spark, sf, awkward):
    docs = awkward
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf)
        assert docs.columns == awkward.columns
    assert corpus_pipeline.STAGES[4][1](spark, docs, sf).count() > 0
