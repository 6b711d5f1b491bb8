"""Index updates: the last row of a document counts. Budgets: a prefix of the rows."""

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import retrieval
from lumenfold.sources.store import Store
from lumenfold.streaming import updates


@pytest.mark.parametrize("versions", [False, True])
def test_last_row_counts(spark, tmp_path, versions):
    store = Store(spark, str(tmp_path))
    rows = [(1, "zzz old", 1), (1, "aaa new", 2), (2, "only", 1)]
    df = spark.createDataFrame(rows if not versions else rows[::-1], "document_id long, text string, version int").coalesce(1)
    df = df if versions else df.drop("version")
    updates.update_index(store, df)
    assert {r["text"] for r in store.read("text_units").collect()} == {"aaa new", "only"}
    updates.update_index(store, df)
    assert store.count("text_units") == 2
    updates.update_index(store, spark.createDataFrame([(1, "newest", 3)], "document_id long, text string, version int"))
    assert {r["text"] for r in store.read("text_units").collect()} == {"newest", "only"}


def test_budget(spark):
    rows = [(i, 7 * i % 13, 0 if i % 3 else i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, score long, tokens long")
    ordered, expected, spent = sorted(rows, key=lambda r: (-r[1], r[0])), [], 0
    for r in ordered:
        spent += r[2]
        if spent > 20:
            break
        expected.append(r[0])
    assert sorted(r["id"] for r in retrieval.within_budget(df, 20, ["-score", "id"]).collect()) == sorted(expected)
    assert retrieval.within_budget(df, 10_000, ["-score", "id"]).count() == 200
    assert retrieval.within_budget(df.where(F.lit(False)), 10, ["id"]).count() == 0
