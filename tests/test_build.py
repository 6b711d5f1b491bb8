"""One index build from documents, through all levels, in steps, and what each level holds."""

from pyspark.sql import functions as F

from lumenfold.sources.build import build_index
from lumenfold.sources.store import Store

TEXTS = [
    "Graph networks, transformer attention, graph networks, deep learning, transformer attention.",
    "Random forests, decision trees. Random forests, small tables, decision trees, small tables.",
    "Graph networks, transformer attention, deep learning; random forests, decision trees.",
]


def test_levels_in_steps(spark, tmp_path):
    documents = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "document_id long, text string")
    store = Store(spark, str(tmp_path))
    say = lambda names, size, edges: F.concat(F.lit("about "), names)
    assert build_index(store, documents, 0) == [0]
    assert build_index(store, documents.limit(0), 3, write=say) == [1, 2, 3]  # all that is above comes from the store
    assert build_index(store, documents, 3) == []
    assert store.count("text_units") == store.count("embeddings") == 3
    nodes = {r["phrase"]: r["frequency"] for r in store.read("noun_phrase_nodes").collect()}
    assert nodes["graph networks"] == 3
    ends = {n for r in store.read("noun_phrase_edges").collect() for n in (r["source"], r["target"])}
    assert ends and ends <= set(nodes)
    homes = {(r["level"], r["node"]) for r in store.read("communities_l1").collect()}
    assert {n for _, n in homes} == ends
    reports = store.read("community_reports").collect()
    assert reports and all(r["summary"].startswith("about ") for r in reports)
    names = {r["name"]: r["n_units"] for r in store.read("entities").collect()}
    pairs = {(r["source"], r["target"]): r["weight"] for r in store.read("relationships").collect()}
    assert all(a < b and a in names and b in names and w <= min(names[a], names[b]) for (a, b), w in pairs.items())


def test_tables_are_written_once(spark, tmp_path, monkeypatch):
    """Units, phrases and edges go to the store and to no table beside it."""
    from lumenfold.sources import build
    from lumenfold.sources.store import Store

    beside = []
    monkeypatch.setattr(build, "materialise", lambda df: beside.append(df.columns) or df)
    docs = spark.createDataFrame([(1, "red fox, red fox, blue sky, blue sky")], "document_id long, text string")
    edges = lambda e: e.select(F.lit(1).alias("level"), F.col("src").alias("node"), F.col("src").alias("community"))
    store = Store(spark, str(tmp_path))
    assert build.build_index(store, docs, 1, detect=edges) == [0, 1]
    assert len(beside) == 1 and store.built() == [0, 1]
    assert store.versions("text_units") == store.versions("nlp_features") == store.versions("noun_phrase_edges") == [1]


def test_phrases_are_numbers_to_label_propagation(spark, tmp_path, monkeypatch):
    """Labels of the built index are those of the phrases themselves, of which none is dealt out in the rounds."""
    from lumenfold.operators import graph
    from lumenfold.plans import source_queries

    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    plain, seen = graph.label_propagation, []
    monkeypatch.setattr(graph, "label_propagation", lambda e, rounds: seen.append(e.schema["src"].dataType.typeName()) or plain(e, rounds))
    store, _ = source_queries.indexed(spark, str(tmp_path), 1)
    edges = store.read("noun_phrase_edges").selectExpr("source AS src", "target AS dst", "weight")
    homes = {(r["node"], r["community"]) for r in store.read("communities_l1").collect()}
    assert homes and homes == {(r["node"], r["community"]) for r in plain(edges, 2).collect()}
    assert seen == ["long"]
