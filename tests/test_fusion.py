"""Fusion on two overlapping lists, with values worked out by hand."""

import pytest

from lumenfold.operators import fusion

HITS = [("vector", 1, "c1", 0.95), ("vector", 2, "c2", 0.85), ("vector", 3, "c3", 0.75), ("lazy", 1, "c2", 0.90), ("lazy", 2, "c4", 0.80), ("lazy", 3, "c5", 0.70)]


@pytest.fixture
def hits(spark):
    return spark.createDataFrame(HITS, "method string, rank int, id string, score double")


def scores(df):
    return {r["id"]: r["score"] for r in df.collect()}


@pytest.mark.parametrize(
    ("method", "dialect", "id", "score"),
    [
        ("comb_sum", "query", "c2", 1.75), ("comb_mnz", "query", "c2", 3.5), ("max", "query", "c1", 0.95), ("rrf", "query", "c2", 0.032522), ("rrf", "query", "c1", 0.016393), ("rrf", "query", "c3", 0.015873),
        ("weighted", "query", "c2", 0.875), ("weighted", "search", "c1", 0.5), ("weighted", "search", "c2", 0.947368),
    ],
)
def test_scores(hits, method, dialect, id, score):
    found = scores(fusion.fuse(hits, method, dialect))
    assert len(found) == 5
    assert found[id] == pytest.approx(score, abs=1e-6)


def test_order_and_ties(hits):
    assert [r["id"] for r in fusion.fuse(hits).collect()] == ["c2", "c1", "c4", "c3", "c5"]


def test_interleave(hits):
    keyed = hits.withColumnRenamed("id", "key")
    out = fusion.interleave(keyed, ["vector", "lazy"]).orderBy("position").collect()
    assert [r["key"] for r in out] == ["c1", "c2", "c4", "c3", "c5"]


def test_zero_scores_count_by_rank(spark):
    rows = spark.createDataFrame([("a", 4, "k", 0.0), ("b", 2, "k", 0.5)], "method string, rank int, key string, score double")
    assert fusion.controller_weighted(rows).first()["score"] == 0.75


def test_empty(spark):
    rows = spark.createDataFrame([], "method string, rank int, id string, score double")
    for method in fusion.METHODS:
        assert fusion.fuse(rows, method).count() == 0


def test_unknown_method(hits):
    with pytest.raises(ValueError):
        fusion.fuse(hits, "median")
