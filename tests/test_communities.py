"""Leiden communities against the plain version, and what they promise."""

import random

from pyspark.sql import functions as F

from lumenfold.operators import graph
from lumenfold.plans import graph_queries, registry
from tests import plain_graphs
from tests.twins import FOLDER


def random_edges(seed):
    rng = random.Random(seed)
    n = rng.randint(12, 40)
    return [(rng.randrange(n), rng.randrange(n), rng.randint(1, 3)) for _ in range(int(n * rng.choice([1.3, 1.8, 2.5])))]


def labels_by_level(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["level"], {})[r["node"]] = r["community"]
    return [out[k] for k in sorted(out)]


def connected(edges, labels):
    near = plain_graphs.weights(edges)
    return all(len(plain_graphs.parts_of(near, nodes)) == 1 for nodes in plain_graphs.groups(labels).values())


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long, weight long")


#: A graph in which a node leaves and takes with it what held a community of `louvain` together.
BRIDGE = 295


def test_bridge_that_moved_away(spark):
    edges = random_edges(BRIDGE)
    loose = plain_graphs.leiden(edges, levels=2, refine=False)[-1]
    found = labels_by_level(graph.leiden(frame(spark, edges), levels=2))
    assert found == plain_graphs.leiden(edges, levels=2)
    assert not connected(edges, loose)
    assert connected(edges, found[-1])
    assert plain_graphs.modularity(edges, found[-1]) > plain_graphs.modularity(edges, loose)


def test_promises_on_many_graphs():
    firm = loose = 0.0
    for seed in range(150):
        edges = random_edges(seed)
        found = plain_graphs.leiden(edges, levels=3)
        assert all(connected(edges, labels) for labels in found)
        firm += plain_graphs.modularity(edges, found[-1])
        loose += plain_graphs.modularity(edges, plain_graphs.leiden(edges, levels=3, refine=False)[-1])
    assert firm > loose


def test_parts_and_phrases_of_the_tables(spark):
    parts = [(r["src"], r["dst"], 1.0) for r in graph_queries.parts(spark, FOLDER).collect()]
    plain = plain_graphs.leiden(parts, rounds=graph_queries.ROUNDS, levels=graph_queries.LEVELS)[-1]
    found = {r["node"]: r["community"] for r in registry.QUERIES["g12_leiden"](spark, FOLDER).collect()}
    assert found == plain and connected(parts, found)
    phrases = [(r["src"], r["dst"], float(r["weight"])) for r in graph_queries.weighted_phrases(spark, FOLDER).collect()]
    plain = plain_graphs.leiden(phrases, rounds=graph_queries.ROUNDS, levels=graph_queries.LEVELS)
    assert labels_by_level(registry.QUERIES["g12_phrase_leiden"](spark, FOLDER)) == plain


def test_phrases_without_refinement(spark):
    phrases = [(r["src"], r["dst"], float(r["weight"])) for r in graph_queries.weighted_phrases(spark, FOLDER).collect()]
    plain = plain_graphs.leiden(phrases, rounds=graph_queries.ROUNDS, levels=graph_queries.LEVELS, refine=False)
    assert labels_by_level(registry.QUERIES["g12_phrase_communities"](spark, FOLDER)) == plain


def test_resolution_levels(spark):
    edges = random_edges(5)
    rows = graph.hierarchy(graph.resolution_levels(frame(spark, edges), (4.0, 2.0, 1.0), rounds=3)).collect()
    for level, resolution in enumerate((4.0, 2.0, 1.0), 1):
        named = lambda n, level=level: f"{{{level}, {n}}}"  # noqa: E731  a node's name decides in which rounds it stays
        assert {r["node"]: r["community"] for r in rows if r["level"] == level} == plain_graphs.leiden(edges, resolution, rounds=3, named=named)[-1]
    assert all((r["parent"] is None) == (r["level"] == 3) for r in rows)


def test_entity_communities(spark):
    edges = [(1, 2, 2), (2, 3, 2), (1, 3, 2), (4, 5, 1), (3, 4, 1), (4, 6, 1), (5, 6, 3)]
    nodes = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 5, 6, 7, 7)], "node long")
    found = {r["community"]: r for r in graph.entity_communities(frame(spark, edges), nodes, rounds=3, least=1).collect()}
    assert {c: (r["size"], r["internal_edges"], r["density"]) for c, r in found.items()} == {1: (3, 3, 1.0), 4: (3, 3, 1.0), 7: (1, 0, 0.0)}
    assert {r["modularity"] for r in found.values()} == {round(plain_graphs.modularity(edges, {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}), 6)}


def test_pagerank_reaches_its_tolerance_at_any_size(spark):
    """The ranks of a chain and of many copies of it differ by the number of copies only."""
    one = spark.range(12).select("id", (F.col("id") + 1).alias("next"))
    rank = lambda df: graph.pagerank(df, alpha=0.5, tolerance=1e-3)
    single = {r["node"]: r["pagerank"] for r in rank(one.select(F.col("id").alias("src"), F.col("next").alias("dst"))).collect()}
    many = spark.range(3000).select(F.col("id").alias("copy")).crossJoin(one).select((F.col("copy") * 100 + F.col("id")).alias("src"), (F.col("copy") * 100 + F.col("next")).alias("dst"))
    assert all(abs(r["pagerank"] * 3000 - single[r["node"]]) < 1e-3 for r in rank(many).where("node < 100").collect())


def test_phrases_are_numbered_before_they_are_paired(spark):
    edges, names = graph_queries.numbered_phrases(spark, FOLDER)
    name = {r["node"]: r["name"] for r in names.collect()}
    assert [name[n] for n in sorted(name)] == sorted(name.values())
    found = {(name[r["src"]], name[r["dst"]], r["weight"]) for r in edges.collect()}
    assert found == {tuple(r) for r in graph_queries.weighted_phrases(spark, FOLDER).collect()}
