"""Text functions, chunking, search and state on small inputs."""

import collections
import io
import math
import random
import re
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import text as X
from lumenfold.operators import chunking, incremental, keywords, lazy, merging, metrics, retrieval, routing, vectors
from lumenfold.plans import registry
from lumenfold.sources import files
from lumenfold.sources.store import Store
from lumenfold.streaming import updates
from tests.twins import rows_of, sql_rows


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("n", "starts"), [(0, None), (1, [0]), (100, [0]), (101, [0, 80]), (180, [0, 80]), (181, [0, 80, 160])])
def test_chunk_starts(spark, n, starts):
    assert value(spark, chunking.window_starts(F.lit(n), 100, 20)) == starts


def test_chunk_starts_reject(spark):
    with pytest.raises(ValueError):
        chunking.window_starts(F.lit(5), 10, 10)


def test_chunks_of_null_and_empty(spark):
    docs = spark.createDataFrame([(1, None), (2, "  "), (3, "a b")], "doc_id long, text string")
    assert [(r["doc_id"], r["chunk"]) for r in chunking.token_chunks(docs).collect()] == [(3, "a b")]


def test_identifiers(spark):
    assert value(spark, X.doi(F.lit("DOI: 10.1234/abc123"))) == "10.1234/abc123"
    assert value(spark, X.doi(F.lit("https://doi.org/10.5678/xyz"))) == "10.5678/xyz"
    assert value(spark, X.doi(F.lit("none"))) is None
    assert value(spark, X.arxiv_id(F.lit("ARXIV:2401.01234v2 x"))) == "2401.01234v2"


def test_titles_and_headings(spark):
    assert value(spark, X.normalise_title(F.lit(" A:  Study, of x! "))) == "a study of x"
    assert value(spark, X.heading_level(F.lit("1.2.3 x"))) == 3
    assert value(spark, X.section_class(F.lit("Background"))) == "related_work"
    assert value(spark, X.author_names(F.lit("Ann Lee*, Bo and X9"))) == ["Ann Lee", "Bo"]


def test_answers(spark):
    assert value(spark, X.citation_marks(F.lit("[3] [1] [9] [1]"), F.lit(3))) == [1, 3]
    assert value(spark, X.answer_confidence(F.array(F.lit(1.0), F.lit(0.5)), F.lit(4))) == pytest.approx(0.5625)


def test_rake(spark):
    docs = spark.createDataFrame([(1, "Deep neural networks are deep neural models. The 2020 data")], "doc_id long, text string")
    phrases = {r["phrase"] for r in keywords.candidates(docs).collect()}
    assert phrases == {"deep neural networks", "deep neural models", "data"}
    top = keywords.rake(docs, 1).first()
    assert (top["phrase"], top["score"]) == ("deep neural models", 9.0)


def test_cosine(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0])], "vec_id long, embedding array<float>")
    found = vectors.cosine_top_k(table, [1.0, 0.0], 4).collect()
    assert [(r["vec_id"], r["score"]) for r in found] == [(1, 1.0), (3, 0.707107), (2, 0.0), (4, 0.0)]
    assert vectors.cosine_top_k(table, [1.0, 0.0], 2, 0.8).count() == 1
    batch = vectors.batch_top_k(table, table.where("vec_id = 1").select(F.col("vec_id").alias("query_id"), "embedding"), 2).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(batch, key=lambda r: r["rank"])] == [(1, 1.0), (3, 0.707107)]


def test_local_search(spark):
    entities = spark.createDataFrame([(1, "Transformer", "a model"), (2, "Self-Attention", "a mechanism"), (3, "BERT", "Representations from Transformers.")], "entity_id long, name string, description string")
    relations = spark.createDataFrame([(1, 2), (3, 1)], "source_id long, target_id long")
    found = {r["entity_id"]: (r["hop"], r["score"]) for r in retrieval.traverse(entities, relations, "Transformer").collect()}
    assert found == {1: (0, 1.0), 3: (0, 1.0), 2: (1, 0.5)}


def test_budget_stops_at_first_overflow(spark):
    rows = spark.createDataFrame([(1, 5), (2, 9), (3, 1)], "pos int, tokens int")
    assert [r["pos"] for r in retrieval.within_budget(rows, 10, ["pos"]).collect()] == [1]


def test_asking_for_the_accuracy_explores_nothing(spark):
    """However often else a text says `what is`, as inside of other words."""
    rows = spark.createDataFrame([(1, "what is the accuracy of it\nerwhat is ble"), (2, "What is  the difference? what is a graph"), (3, "erwhat is\nthe main"), (4, "it is")], "id int, query string")
    found = {r["id"]: (r["type"], r["n"]) for r in rows.select("id", routing.classify(F.col("query")).alias("c")).select("id", "c.*").collect()}
    assert found == {1: ("factoid", 1), 2: ("comparison", 1), 3: ("exploration", 1), 4: ("unknown", 0)}


def test_nothing_to_reduce_is_null(spark):
    partial = spark.createDataFrame([(1, "No relevant information here", 0.9), (2, "short", 0.1)], "community_id long, answer string, relevance double")
    assert retrieval.reduce_answers(partial).collect() == [(None,)]
    assert retrieval.reduce_answers(partial.selectExpr("community_id", "'a' answer", "relevance")).collect() == [("a",)]


def test_answers_of_long_contexts(spark, tmp_path):
    """A community of more than 8,000 tokens has its answer in the whole, too."""
    customers = spark.range(2100).selectExpr("id AS c_custkey", "concat('Customer number ', id) AS c_name", "if(id < 2000, 3, 4) AS c_nationkey", "'BUILDING' AS c_mktsegment")
    customers.write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    for name, n in (("v20_global_reduce", 1), ("v19_global_map", 1), ("f12_reducible", 1)):
        found = rows_of(registry.QUERIES[name](spark, str(tmp_path)))
        assert len(found) == n
        assert found == sql_rows(con, registry.ORACLES[name])[1]
    assert registry.QUERIES["v20_global_reduce"](spark, str(tmp_path)).first()["answer"].count("\n\n") == 1


def test_routing(spark):
    rows = spark.createDataFrame([("Compare A vs B",), ("tell me",), ("手法の比較と違い",)], "query string")
    found = routing.route(rows, 3).collect()
    assert [(r["query_type"], r["mode"]) for r in found] == [("comparison", "hybrid"), ("unknown", "lazy"), ("comparison", "hybrid")]
    assert found[0]["confidence"] == pytest.approx(0.8)
    assert value(spark, routing.fallback(F.lit("graphrag"), F.lit(0))) == "vector"
    assert routing.buildable([], 2) == [0, 1, 2]
    assert routing.buildable([0, 1], 2) == [2]
    with pytest.raises(RuntimeError):
        routing.run_with_fallback({}, "lazy")


def test_changes(spark):
    old = spark.createDataFrame([("d1", "h1", ["u1", "u2"]), ("d2", "h2", ["u3"]), ("d4", "h", ["u9"])], "document_id string, content_hash string, units array<string>")
    new = spark.createDataFrame([("d1", "h1", ["u1", "u2"]), ("d2", "hx", ["u3", "u4"]), ("d3", "h3", ["u5"])], "document_id string, content_hash string, units array<string>")
    changes = incremental.classify(old, new)
    assert {r["document_id"]: r["change_type"] for r in changes.collect()} == {"d1": "UNCHANGED", "d2": "MODIFIED", "d3": "ADDED", "d4": "DELETED"}
    units = {r["document_id"]: (r["to_add"], r["to_remove"]) for r in incremental.unit_changes(changes).collect()}
    assert units == {"d1": ([], []), "d2": (["u4"], []), "d3": (["u5"], []), "d4": ([], ["u9"])}
    assert incremental.strategy(old, changes) == "replace"
    assert incremental.strategy(old, changes, dry_run=True) == "none"


def test_percentiles_by_position(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in range(1, 101)] + [("b", 5.0)], "k string, v double")
    found = {r["k"]: (r["p50"], r["p95"], r["p99"]) for r in metrics.histogram(rows, "k", "v").collect()}
    assert found == {"a": (51.0, 96.0, 100.0), "b": (5.0, 5.0, 5.0)}


def test_claims(spark):
    rows = spark.createDataFrame([(1, "the cat sat on the mat today now", "s1"), (2, "The cat sat on the mat today now", "s2"), (3, "other words", "s3")], "claim_id long, claim string, source string")
    merged = {r["claim"]: r["sources"] for r in lazy.merged_claims(rows).collect()}
    assert merged == {"the cat sat on the mat today now": "s1,s2", "other words": "s3"}


def test_entities(spark):
    rows = [(0, "a", "BERT", "MODEL", "x", "c1", None, 1.0), (1, "b", "bert ", "PAPER", "longer", "c2", 2018, 1.0), (2, "c", "GPT", "MODEL", "y", "c1", None, 0.7)]
    found = {r["key"]: r for r in merging.merge_entities(spark.createDataFrame(rows, "pos int, id string, name string, type string, description string, chunk string, year int, confidence double")).collect()}
    assert (found["bert"]["id"], found["bert"]["description"], found["bert"]["chunks"], found["bert"]["year"], found["bert"]["confidence"]) == ("a", "longer", "c1|c2", 2018, 0.9)
    assert found["gpt"]["confidence"] == 0.7


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read("text_units") is None
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    store.write("text_units", rows)
    store.write("text_units", rows.where("id = 1"), append=True)
    assert store.count("text_units") == 3
    store.delete("text_units", rows.where("id = 1"))
    assert [r["id"] for r in store.read("text_units").collect()] == [2]
    assert store.by_ids("text_units", range(1000)).count() == 1
    store.clear("text_units")
    assert store.count("text_units") == 0
    assert {r["name"]: r["n_rows"] for r in store.stats().collect()} == {"text_units": 0}
    assert store.built() == []


def test_stream_of_updates(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    first = spark.createDataFrame([(1, "one two"), (2, "x y")], "document_id long, text string")
    updates.update_index(store, first)
    updates.update_index(store, spark.createDataFrame([(1, "one three"), (3, "new")], "document_id long, text string"))
    updates.update_index(store, spark.createDataFrame([(1, "one three")], "document_id long, text string"))
    assert {(r["document_id"], r["text"]) for r in store.read("text_units").collect()} == {(1, "one three"), (2, "x y"), (3, "new")}


def test_token_buffer(spark):
    tokens = spark.createDataFrame([(1, i, t) for i, t in enumerate(["abc", "defgh", "ijk", "l"])], "answer_id int, pos int, token string")
    assert [r["chunk"] for r in updates.buffered(tokens, 8).orderBy("flush").collect()] == ["abcdefgh", "ijkl"]


def office(parts):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return held.getvalue()


def test_office(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    p = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    docx = office({"word/document.xml": f"<w:document {w}><w:body>{p('My paper', 'Title')}{p('Methods', 'Heading1')}{p('body')}</w:body></w:document>"})
    pptx = office({"ppt/slides/slide1.xml": f"<x {a}><a:p><a:t>Hello</a:t></a:p><a:p><a:t>more</a:t></a:p></x>"})
    got = {r["path"]: r for r in files.parse_office(spark.createDataFrame([("/a.docx", bytearray(docx)), ("/b.pptx", bytearray(pptx)), ("/c.docx", bytearray(b"no"))], "path string, content binary")).collect()}
    assert (got["/a.docx"]["title"], got["/a.docx"]["sections"][0]["section_type"], got["/a.docx"]["sections"][0]["content"]) == ("My paper", "methods", "body\n")
    assert got["/b.pptx"]["sections"][0]["heading"] == "Slide 1: Hello"
    assert got["/c.docx"]["title"].startswith("unreadable")


def test_histories(spark):
    turns = spark.createDataFrame([(1, 0, "assistant", "hi"), (1, 1, "user", "q1"), (1, 2, "assistant", "a1"), (1, 3, "user", "q2")], "conv_id long, turn int, role string, text string")
    assert [(r["question"], r["answers"]) for r in lazy.qa_turns(turns).orderBy("qa").collect()] == [("q1", "a1"), ("q2", "")]
    assert lazy.expanded("q", []) == ["q"]


def test_a_model_may_override_what_rules_are_unsure_of(spark):
    rows = spark.createDataFrame([("tell me a story",), ("what is the accuracy of it",), ("compare a versus b, the difference",)], "query string")
    say = lambda q: F.struct(F.when(q.contains("story"), "survey").when(q.contains("accuracy"), "nonsense").otherwise("factoid").alias("type"), F.lit(0.9).alias("confidence"))
    found = [(r["query_type"], r["mode"], r["confidence"]) for r in routing.route(rows, 3, override=say).collect()]
    plain = [(r["query_type"], r["mode"], r["confidence"]) for r in routing.route(rows, 3).collect()]
    assert found[0] == ("survey", "graphrag", 0.9) and plain[0][0] == "unknown"
    assert found[1:] == plain[1:]


def test_tf_idf_deals_out_word_lists(spark):
    """Terms are counted where the words of a row are, and weighed rows are dealt out once; null and short texts have no long terms."""
    docs = spark.createDataFrame([(1, "graphs learn graphs"), (2, None), (3, "graphs"), (4, ""), (5, "deep nets learn")], "doc_id long, text string")
    found = keywords.tf_idf(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 5
    assert {(r["doc_id"], r["term"]) for r in found.collect()} == {(1, "graphs"), (1, "learn"), (1, "graphs learn"), (1, "learn graphs"), (1, "graphs learn graphs"), (3, "graphs"), (5, "deep"), (5, "nets"), (5, "learn"), (5, "deep nets"), (5, "nets learn"), (5, "deep nets learn")}


def plain_tf_idf(docs, k):
    """(key, term): (score, rank), worked out row by row."""
    tf = collections.defaultdict(collections.Counter)
    for key, body in docs:
        w = [x for x in re.findall(r"\w+", (body or "").lower()) if len(x) >= 2 and x not in keywords.STOP_WORDS]
        tf[key].update(" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    df = collections.Counter(t for terms in tf.values() for t in terms)
    out = {}
    for key, terms in tf.items():
        weight = {t: c * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, c in terms.items() if df[t] <= 0.95 * len(docs)}
        norm = math.sqrt(sum(x * x for x in weight.values()))
        scored = sorted((-round(x / norm, 6), t) for t, x in weight.items())[:k]
        out |= {(key, t): (-x, rank) for rank, (x, t) in enumerate(scored, 1)}
    return out


def test_tf_idf_deals_out_no_terms(spark, monkeypatch):
    """Blocks exchange hashes with buckets; the same for repeated and null keys, ties, and words of any script."""
    monkeypatch.setattr(keywords, "BLOCK", 200)
    rng = random.Random(5)
    vocabulary = ["graph", "graphs", "a1", "über", "straße", "zz_top", "データ", "node", "the", "of", "x"]
    docs = [(i // 2 if i % 5 else None, " ".join(rng.choices(vocabulary, k=rng.randrange(30))) + rng.choice(["", ".", "\n\n"])) for i in range(60)] + [(77, None), (78, "of the x")]
    found = keywords.tf_idf(spark.createDataFrame(docs, "doc_id long, text string"), k=5)
    assert "hashpartitioning(term" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r["doc_id"], r["term"]): (r["score"], r["rank"]) for r in found.collect()} == plain_tf_idf(docs, 5)
    assert keywords.tf_idf(spark.createDataFrame([], "doc_id long, text string")).collect() == []
