"""Graphs small enough to work out by hand."""

import collections
import itertools
import random
from difflib import SequenceMatcher

import duckdb
import numpy as np
import pytest

from lumenfold.operators import chunking, citation, cooccurrence, fuzzy, graph, merging
from lumenfold.operators.components import components
from lumenfold.plans import registry
from tests.twins import rows_of, sql_rows


def edges(spark, pairs, kind="string"):
    return spark.createDataFrame(pairs, f"src {kind}, dst {kind}")


DIAMOND = [("A", "C"), ("A", "D"), ("B", "C"), ("B", "D"), ("C", "E"), ("D", "E")]


def test_co_citation(spark):
    found = {(r["doc"], r["other"]): r["score"] for r in citation.co_citation(edges(spark, DIAMOND)).collect()}
    assert found == {("C", "D"): 1.0, ("D", "C"): 1.0}


def test_co_citation_least(spark):
    sparse = edges(spark, [("A", "C"), ("A", "D")])
    assert citation.co_citation(sparse).count() == 0
    assert citation.co_citation(sparse, 1, "C").first()["other"] == "D"


def test_coupling(spark):
    found = {(r["doc"], r["other"]): (r["shared"], r["score"]) for r in citation.coupling(edges(spark, DIAMOND)).collect()}
    assert found == {("A", "B"): (2, 1.0), ("B", "A"): (2, 1.0)}


def test_paths(spark):
    paths = [r["path"] for r in graph.simple_paths(edges(spark, DIAMOND), "A", "E").orderBy("path").collect()]
    assert paths == ["A>C>E", "A>D>E"]
    short = graph.shortest_path(edges(spark, DIAMOND), "A", "E").first()
    assert (short["path"], short["length"]) == ("A>C>E", 2)
    assert graph.shortest_path(edges(spark, DIAMOND), "E", "A").count() == 0


def test_components(spark):
    two = edges(spark, [("c1_a", "c1_b"), ("c2_a", "c2_b")])
    assert {r["node"]: r["component"] for r in components(two).collect()} == {"c1_a": "c1_a", "c1_b": "c1_a", "c2_a": "c2_a", "c2_b": "c2_a"}


def test_components_of_a_long_path(spark):
    path = edges(spark, [((i * 37) % 101, ((i + 1) * 37) % 101) for i in range(100)], "long")
    assert {r["component"] for r in components(path).collect()} == {0}
    assert components(path).count() == 101


def test_components_empty(spark):
    assert components(edges(spark, [])).count() == 0


def test_strong_components(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4)], "long")
    assert {r["node"]: r["component"] for r in graph.strong_components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


TRIANGLES = [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6)]


def test_two_triangles(spark):
    e = edges(spark, TRIANGLES, "long")
    labels = {r["node"]: r["community"] for r in graph.label_propagation(e).collect()}
    assert len({labels[1], labels[2], labels[3]}) == 1
    assert labels[1] != labels[4]
    split = spark.createDataFrame([(n, 1 if n < 4 else 4) for n in range(1, 7)], "node long, community long")
    assert graph.modularity(e, split).first()["modularity"] == 0.5


def test_long_paths(spark):
    chain = edges(spark, [(i, i + 1) for i in range(30)], "long")
    assert graph.shortest_path(chain, 0, 30).first()["length"] == 30
    assert graph.shortest_path(chain, 0, 99).count() == 0
    assert {r["node"]: r["distance"] for r in graph.distances_from(chain, 3).collect()} == {i: i - 3 for i in range(3, 31)}


@pytest.mark.parametrize("pairs", [[(1, 2), (2, 3), (3, 4)], [(1, 2), (2, 3), (3, 4), (4, 5)], [(2, 1), (3, 2)], [(1, 2), (2, 4), (1, 3), (3, 4)]])
def test_shortest_path_as_far_as_its_sql(spark, tmp_path, pairs):
    lines = [(order, line, part, 1, 1.0, 1.0, "1995-01-01") for order, pair in enumerate(pairs) for line, part in enumerate(pair)]
    names = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate string"
    path = f"{tmp_path}/lineitem.parquet"
    spark.createDataFrame(lines, names).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{path}/*.parquet')")
    expected = sql_rows(con, registry.ORACLES["g5_shortest_path"])[1]
    assert rows_of(registry.QUERIES["g5_shortest_path"](spark, str(tmp_path))) == expected


def plain_modularity(pairs, labels):
    m = len(pairs)
    inner, degree = collections.Counter(), collections.Counter()
    for a, b in pairs:
        inner[labels[a]] += labels[a] == labels[b]
        degree[labels[a]] += 1
        degree[labels[b]] += 1
    return sum(inner[c] / m - (degree[c] / (2 * m)) ** 2 for c in degree)


def test_louvain(spark):
    names = [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z"), ("c", "x")]
    labels = {r["node"]: r["community"] for r in graph.top_level(graph.louvain(edges(spark, names))).collect()}
    assert labels == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "x"}
    alone = {r["community"] for r in graph.top_level(graph.louvain(edges(spark, names), resolution=50.0)).collect()}
    assert len(alone) == 6
    heavy = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 9.0), ("c", "d", 1.0)], "src string, dst string, weight double")
    held = {r["node"]: r["community"] for r in graph.top_level(graph.louvain(heavy)).collect()}
    assert held["b"] == held["c"]
    assert graph.louvain(edges(spark, [])).count() == 0


def test_louvain_beats_label_propagation(spark):
    rng = random.Random(8)
    pairs = sorted({tuple(sorted((rng.randrange(15) + 15 * g, rng.randrange(15) + 15 * g))) for g in range(6) for _ in range(45)} | {tuple(sorted(rng.sample(range(90), 2))) for _ in range(40)})
    pairs = [(a, b) for a, b in pairs if a != b]
    e = edges(spark, pairs, "long")
    found = {r["node"]: r["community"] for r in graph.top_level(graph.louvain(e)).collect()}
    spread = {r["node"]: r["community"] for r in graph.label_propagation(e).collect()}
    assert plain_modularity(pairs, found) >= plain_modularity(pairs, spread)
    assert plain_modularity(pairs, found) > 0.5
    labels = spark.createDataFrame(list(found.items()), "node long, community long")
    assert graph.modularity(e, labels).first()["modularity"] == pytest.approx(plain_modularity(pairs, found), abs=1e-6)


def test_densities(spark):
    split = spark.createDataFrame([(n, 1 if n < 4 else 4) for n in range(1, 7)], "node long, community long")
    assert {r["density"] for r in graph.community_sizes(edges(spark, TRIANGLES, "long"), split).collect()} == {1.0}


def test_pagerank_sums_to_one(spark):
    ranks = graph.pagerank(edges(spark, [("A", "B"), ("C", "B")]), 20).collect()
    assert sum(r["pagerank"] for r in ranks) == pytest.approx(1)
    assert max(ranks, key=lambda r: r["pagerank"])["node"] == "B"


def test_ego(spark):
    chain = edges(spark, [(1, 2), (2, 3), (3, 4)], "long")
    assert {(r["src"], r["dst"]) for r in graph.ego_network(chain, 2, 1).collect()} == {(1, 2), (2, 3)}


def test_phrase_graph(spark):
    rows = [(1, 1, 0, "deep learning"), (1, 1, 1, "neural network"), (2, 1, 0, "neural network"), (2, 1, 1, "attention mechanism")]
    phrases = spark.createDataFrame(rows, "unit long, doc_id long, pos int, phrase string")
    assert cooccurrence.edges(cooccurrence.neighbours(phrases)).count() == 2
    often = cooccurrence.frequent(phrases)
    assert [r["phrase"] for r in often.select("phrase").distinct().collect()] == ["neural network"]
    assert cooccurrence.edges(cooccurrence.neighbours(often)).count() == 0


def test_resolution(spark):
    docs = spark.createDataFrame([(1, "10.1234/paper1", "Paper One"), (2, "10.1234/PAPER2", "Paper Two"), (3, None, "Machine Learning Survey")], "doc_id long, doi string, title string")
    refs = spark.createDataFrame([(0, 1, "See 10.1234/paper2 for details"), (1, 1, 'X. Y, "Machine learning survey!", 2020'), (2, 1, 'Z, "Machine learning surveys", 2020'), (3, 1, "External paper"), (4, 1, "See 10.1234/paper1")], "ref_id long, doc_id long, reference string")
    found = {r["ref_id"]: (r["match"], r["status"]) for r in citation.resolve(refs, docs).collect()}
    assert found == {0: (2, "matched_doi"), 1: (3, "matched_title"), 2: (3, "matched_fuzzy"), 3: (None, "unresolved"), 4: (None, "unresolved")}
    graph_edges = citation.citation_edges(citation.resolve(refs, docs))
    assert {r["is_internal"] for r in graph_edges.collect()} == {True, False}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("measure", ["levenshtein", "sequence"])
def test_fuzzy_titles_lose_nothing(spark, measure):
    rng = random.Random(3)
    words = ["attention", "graphs", "learning", "deep", "of", "notes", "a", "large", "corpora"]
    titles = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 7))) for _ in range(120)] + ["attenton notes", "deep learning for graph", "x", "ab"]
    wanted = []
    for t in rng.sample(titles, 70):
        letters = list(t)
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(letters) + 1)
            letters[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "e", "s"])
        wanted.append("".join(letters))
    wanted += ["very large corpora of notes with attenton", "deep learning for graphs", "x"]
    docs = spark.createDataFrame(list(enumerate(titles)), "doc_id long, title string")
    refs = spark.createDataFrame([(i, i % 50, t) for i, t in enumerate(wanted)], "ref_id long, doc_id long, title string")
    found = {r["ref_id"]: (r["match"], r["similarity"]) for r in citation.fuzzy_matches(refs, docs, measure=measure).collect()}
    normal = lambda t: " ".join(t.split())
    expected = {}
    for i, t in enumerate(wanted):
        a, best = normal(t), None
        for k, title in enumerate(titles):
            b = normal(title)
            if not a or not b or k == i % 50:
                continue
            s = 1 - edits(a, b) / max(len(a), len(b)) if measure == "levenshtein" else SequenceMatcher(None, a, b).ratio()
            if s >= 0.85 and (best is None or s > best[1]):
                best = (k, s)
        if best:
            expected[i] = (best[0], round(best[1], 6))
    assert found == expected


def test_fuzzy_candidates_stay_few(spark):
    """Titles that share nearly all of their text: the shared part is no key."""
    titles = [f"text of documents {i}" for i in range(1000, 3000)]
    held = spark.createDataFrame(list(enumerate(titles)), "b_id long, b string")
    asked = [f"text of document {i}" for i in range(1000, 3000, 40)]
    counts = collections.Counter(g for t in titles for q in fuzzy.GRAM_SIZES for g in [t[i : i + q] for i in range(len(t) - q + 1)])
    rows = [(k, a, len(a), 1, [counts[a[i : i + q]] for q in fuzzy.GRAM_SIZES if q > 1 for i in range(len(a) - q + 1)]) for k, a in enumerate(asked)]
    open_ = spark.createDataFrame(rows, "a_id long, a string, n int, d int, counts array<long>")
    found = {(r["a_id"], r["b_id"]) for r in fuzzy.candidate_pairs(open_, held).collect()}
    matches = {(k, i) for k, a in enumerate(asked) for i, t in enumerate(titles) if edits(a, t) <= 1}
    assert matches <= found
    assert len(found) <= 20 * len(matches) + len(titles)
    assert len(found) < 0.05 * len(asked) * len(titles)


def test_titles_are_never_broadcast(spark, tmp_path):
    """A small file of titles has many grams and variants; neither they nor the titles go through the driver."""
    spark.range(1000).selectExpr("id AS b_id", "concat('text of documents ', id) AS b").write.parquet(f"{tmp_path}/held")
    held = spark.read.parquet(f"{tmp_path}/held")
    asked = spark.range(1000).selectExpr("id AS a_id", "concat('text of document ', id) AS a").selectExpr("*", "length(a) AS n", "2 AS d", "array(IF(a_id % 2 = 0, 0, 2), 17, 18, 3) AS chosen")
    asked.write.parquet(f"{tmp_path}/asked")
    plan = fuzzy.candidate_pairs(spark.read.parquet(f"{tmp_path}/asked"), held)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_fuzzy_numbers_are_met_by_what_is_left_of_them(spark):
    """Two and more edits away within numbers behind a common beginning: few candidates, and the smallest of equally similar titles."""
    titles = [f"text of documents {i}" for i in range(1001, 3000, 2)]
    asked = [f"text of document {i}" for i in range(1000, 3000, 80)]
    held = spark.createDataFrame(list(enumerate(titles)), "b_id long, b string")
    counts = collections.Counter(g for t in titles for q in fuzzy.GRAM_SIZES for g in [t[i : i + q] for i in range(len(t) - q + 1)])
    rows = [(k, a, len(a), 2, [counts[a[i : i + q]] for q in fuzzy.GRAM_SIZES if q > 1 for i in range(len(a) - q + 1)]) for k, a in enumerate(asked)]
    pairs = fuzzy.candidate_pairs(spark.createDataFrame(rows, "a_id long, a string, n int, d int, counts array<long>"), held).count()
    assert pairs < 0.2 * len(asked) * len(titles)
    docs = spark.createDataFrame(list(enumerate(titles)), "doc_id long, title string")
    refs = spark.createDataFrame([(i, -1, t) for i, t in enumerate(asked)], "ref_id long, doc_id long, title string")
    found = {r["ref_id"]: (r["match"], r["similarity"]) for r in citation.fuzzy_matches(refs, docs, measure="sequence").collect()}
    for i, a in enumerate(asked):
        best = max((SequenceMatcher(None, a, t).ratio(), -k) for k, t in enumerate(titles))
        assert found[i] == (-best[1], round(best[0], 6))


def test_probes_grow_with_the_edits_only():
    for n in (40, 80, 150):
        total, places = fuzzy.cheapest(np.arange(n - 2) % 17, 3, n // 8)
        assert len(places) == n // 8 and all(b - a >= 3 for a, b in itertools.pairwise(places))
    assert fuzzy.cheapest(np.array([9, 1, 9, 9, 0, 9]), 2, 2) == (1.0, [1, 4])
    assert fuzzy.cheapest(np.array([5, 0, 5]), 2, 2) == (10.0, [0, 2])


def dealt_out(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_pairs_of_phrases_are_dealt_out_once(spark):
    rows = [(unit, unit // 3, pos, f"p{(unit * 7 + pos * pos) % 5}") for unit in range(12) for pos in range(9)]
    found = cooccurrence.edges(cooccurrence.neighbours(spark.createDataFrame(rows, "unit long, doc_id long, pos int, phrase string"), 2))
    assert dealt_out(found) == 2  # the phrases by document, the pairs by pair
    pairs = collections.defaultdict(list)
    for unit in range(12):
        listed = [r[3] for r in rows if r[0] == unit]
        for i, a in enumerate(listed):
            for b in listed[i + 1 : i + 3]:
                if a != b:
                    pairs[min(a, b), max(a, b)].append(unit // 3)
    assert {(r["source"], r["target"]): (r["weight"], r["n_docs"]) for r in found.collect()} == {k: (len(v), len(set(v))) for k, v in pairs.items()}


def test_links_are_dealt_out_twice_a_round(spark, monkeypatch):
    """Once by each end; the other seven are of nodes."""
    plans = []
    kept = graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df: plans.append((df.columns, dealt_out(df))) or kept(df))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        graph.louvain(edges(spark, [(a, b) for a in range(4) for b in range(a)], "long"), rounds=2, levels=1)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert max(n for columns, n in plans if "moved" in columns) <= 9
    assert plans[-1][0] != ["src", "dst", "w"]  # no graph for a level that does not come


def test_numbers_are_in_the_order_of_names(spark):
    pairs = [("b", "aa"), ("\u00e9", "b"), ("z", "\U0001f600"), ("aa", "z")]
    numbered, names = graph.numbered(edges(spark, pairs))
    name = {r["node"]: r["name"] for r in names.collect()}
    assert sorted(name.values(), key=str.encode) == [name[k] for k in sorted(name)]
    assert sorted((name[r["src"]], name[r["dst"]]) for r in numbered.collect()) == sorted(pairs)
    plain = {(r["level"], r["node"], r["community"]) for r in graph.leiden(edges(spark, pairs)).collect()}
    assert {(r["level"], r["node"], r["community"]) for r in graph.renamed(graph.leiden(numbered, names=names), names).collect()} == plain


def test_sections_are_chunked_in_their_row(spark):
    """Two rows of one id stay apart, as do blank sections."""
    rows = [(1, "", [], "a b c d e f g"), (1, "", [], "h"), (2, "x y", [("intro", " \n"), ("body", "p q r s")], "never"), (3, None, None, None)]
    docs = spark.createDataFrame(rows, "document_id long, abstract string, sections array<struct<section_type:string,content:string>>, raw_text string")
    found = chunking.section_chunks(docs, 4, 1)
    assert dealt_out(found) == 0
    expected = [("1_0", 1, 0, "body", 4, "a b c d"), ("1_0", 1, 0, "body", 1, "h"), ("1_1", 1, 1, "body", 4, "d e f g"), ("2_0", 2, 0, "abstract", 2, "x y"), ("2_1", 2, 1, "body", 4, "p q r s")]
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_relations_are_dealt_out_once(spark):
    rows = [(1, 5), (1, 3), (1, 5), (1, 9), (2, 3), (None, 1), (None, 2), (3, None), (3, 4), (3, 2)]
    found = merging.extract_relations(spark.createDataFrame(rows, "chunk long, entity long"))
    assert dealt_out(found) == 1
    assert sorted((r["chunk"], r["source"], r["target"]) for r in found.collect()) == [(1, 3, 5), (1, 3, 9), (1, 5, 9), (3, 2, 4)]


def test_co_citation_counts_one_way(spark):
    rng = random.Random(3)
    pairs = sorted({(rng.randrange(9), rng.randrange(7)) for _ in range(40)}) + [(0, 0), (None, 1), (None, 2), (4, None)]
    found = citation.co_citation(edges(spark, pairs, "int"), 2)
    assert found._jdf.queryExecution().executedPlan().toString().count("Join") == 1  # the citers of the first one
    cites = {d: {s for s, t in pairs if t == d and s is not None} for d in range(7)}
    shared = {(a, b): len(cites[a] & cites[b]) for a in range(7) for b in range(7) if a != b}
    whole = {d: sum(1 for p in set(pairs) if p[1] == d) for d in range(7)}
    assert {(r["doc"], r["other"]): (r["shared"], r["score"]) for r in found.collect()} == {k: (n, round(n / whole[k[0]], 6)) for k, n in shared.items() if n >= 2}
