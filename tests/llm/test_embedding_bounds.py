"""Operator 5: what lies on disk grows with the input, whatever the data."""

from __future__ import annotations

import numpy as np
import pytest

import talkloom.llm.embedding_dedup as E


@pytest.fixture
def laid_down(monkeypatch):
    """Rows of the tables that operator 5 stores, by name, and of its shuffles to tasks."""
    tables, waves = {}, []
    stored, map_groups = E.stored, E.map_groups

    def store(df, name, *path):
        out = stored(df, name, *path)
        tables[name] = (out.count(), out.select("cell").distinct().count() if "cell" in out.columns else 0)
        return out

    def deal(df, *args):
        waves.append(df.count())
        return map_groups(df, *args)

    monkeypatch.setattr(E, "stored", store)
    monkeypatch.setattr(E, "map_groups", deal)
    monkeypatch.setattr(E, "CELL_ROWS", 8)
    monkeypatch.setattr(E, "CELL_BLOCK", 64)
    return tables, waves


def links(x, threshold):
    return ((x @ x.T >= threshold).sum(1) - 1).tolist()


def test_vectors_without_clusters_are_not_copied_at_large(spark, laid_down):
    tables, waves = laid_down
    n = 600
    x = E.unit(np.random.default_rng(3).standard_normal((n, 32)))
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = [r["n_links"] for r in E.embedding_near_dedup(df, 0.6).orderBy("vec_id").collect()]
    assert got == links(x, 0.6) and sum(got) > 0
    assert tables["embedding-cells"][0] <= 1.5 * n
    assert len(waves) > 1 and max(waves) <= 2 * tables["embedding-cells"][0]  # ten blocks of one cell


def test_clusters_are_cut_by_pivots(spark, laid_down):
    tables, _ = laid_down
    n, draw = 320, np.random.default_rng(4)
    x = E.unit(np.eye(16)[np.arange(n) % 16] + 0.02 * draw.standard_normal((n, 16)))
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = E.embedding_near_dedup(df).orderBy("vec_id").collect()
    assert [r["n_links"] for r in got] == links(x, 0.98) and [r["component_id"] for r in got] == [k % 16 for k in range(n)]
    rows, cells = tables["embedding-cells"]
    assert rows <= 1.5 * n and cells > 2
