"""The bucketed index: touched buckets only, one commit, any split into batches."""

import pytest
from pyspark.sql import functions as F

from lumenfold.sources import buckets
from lumenfold.sources.buckets import BucketedIndex, Conflict

ROWS = "document_id long, text string, version int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1)[:3] for r in rows], ROWS)


def held(index):
    return {r["document_id"]: (r["content_hash"], r["units"]) for r in index.read("state").collect()}, {r["id"]: r["text"] for r in index.read("units").collect()}


def test_few_documents_write_few_buckets(spark, tmp_path):
    index = BucketedIndex(spark, str(tmp_path / "a"), 64)
    first = [(i, f"text of {i} " * 3) for i in range(300)]
    assert len(index.update(frame(spark, first))) > 50
    before = index.manifest()
    changed = [(i, f"new text of {i}") for i in range(10)]
    assert len(index.update(frame(spark, changed + first[50:60]))) <= 10  # ten are as they were
    after = index.manifest()
    moved = [b for b, f in after["tables"]["units"].items() if before["tables"]["units"].get(b) != f]
    assert 0 < len(moved) <= 10
    assert index.update(frame(spark, changed)) == [] and index.manifest() == after
    whole = BucketedIndex(spark, str(tmp_path / "b"), 8)
    whole.update(frame(spark, first[10:] + changed))
    assert held(index) == held(whole)
    assert index.read("state", manifest=before).count() == 300  # an earlier version can be read still
    found = index.lookup("units", [3, 250])
    assert {r["document_id"] for r in found.collect()} == {3, 250}
    assert index.strategy(frame(spark, changed)) == "none" and index.strategy(frame(spark, [(3, "x")])) == "replace"
    assert index.vacuum() > 0 and held(index) == held(whole)


def test_an_update_that_breaks_off_leaves_the_old_version(spark, tmp_path, monkeypatch):
    index = BucketedIndex(spark, str(tmp_path), 4)
    index.update(frame(spark, [(1, "one"), (2, "two")]))
    before, seen = held(index), index.versions()
    other = BucketedIndex(spark, str(tmp_path), 4, lambda d: buckets.chunks_of(d).withColumn("text", F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception, match="lost"):
        other.update(frame(spark, [(1, "changed")]))
    monkeypatch.setattr(index, "_commit", lambda m: (_ for _ in ()).throw(OSError("between files")))
    with pytest.raises(OSError, match="between files"):
        index.update(frame(spark, [(1, "changed")]))
    monkeypatch.undo()
    assert held(index) == before and index.versions() == seen
    index.update(frame(spark, [(1, "changed")]))
    assert held(index)[1].keys() == before[1].keys() and held(index) != before
    stale = index.manifest() | {"version": index.versions()[-1]}
    with pytest.raises(Conflict):
        index._commit(stale)


def test_last_row_deletions_and_repeated_batches(spark, tmp_path):
    index = BucketedIndex(spark, str(tmp_path), 4)
    rows = [(1, "zzz old", 1), (1, "aaa new", 2), (2, "only", 1), (None, "x", 1), (3, None, 1), (4, "gone", 1)]
    index.update(frame(spark, rows), batch=("s", 0))
    assert {r["text"] for r in index.read("units").collect()} == {"aaa new", "only", "gone"}
    assert index.update(frame(spark, [(1, "again", 3)]), batch=("s", 0)) == []
    assert len(index.update(frame(spark, [(5, "five", 1)]), deleted=spark.createDataFrame([(4,), (77,)], "document_id long"), batch=("s", 1))) in (1, 2)
    assert set(held(index)[0]) == {1, 2, 5}
    index.update(frame(spark, []), deleted=spark.createDataFrame([(1,), (2,), (5,)], "document_id long"))
    assert index.read("state") is None
