"""Local, global and lazy search, merging, change detection, routing and statistics over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenfold.functions import text as X
from lumenfold.operators import fusion, incremental, lazy, lexical, merging, metrics, questions, retrieval, routing
from lumenfold.plans.catalog import query, table
from lumenfold.plans.graph_queries import PAIRS, cooccurrence, phrase_edges, placed
from lumenfold.plans.search_queries import DWORDS

# entities: regions, nations, suppliers; relations between them; chunks: orders, with their suppliers
ENTITIES = """en AS (SELECT r_regionkey + 10000000 AS entity_id, r_name AS name, 'region ' || r_name AS description FROM region UNION ALL SELECT n_nationkey + 20000000, n_name, 'nation ' || n_name FROM nation
  UNION ALL SELECT s_suppkey, s_name, 'supplier of nation ' || s_nationkey FROM supplier),
re AS (SELECT n_nationkey + 20000000 AS source_id, n_regionkey + 10000000 AS target_id FROM nation UNION ALL SELECT s_suppkey, s_nationkey + 20000000 FROM supplier)"""


def entities(spark, sf_dir):
    region = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 10000000).cast("long").alias("entity_id"), F.col("r_name").alias("name"), F.concat(F.lit("region "), "r_name").alias("description"))
    nation = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 20000000).cast("long").alias("entity_id"), F.col("n_name").alias("name"), F.concat(F.lit("nation "), "n_name").alias("description"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name"), F.concat(F.lit("supplier of nation "), F.col("s_nationkey").cast("string")).alias("description"))
    return region.unionByName(nation).unionByName(supplier)


def relations(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 20000000).cast("long").alias("source_id"), (F.col("n_regionkey") + 10000000).cast("long").alias("target_id"))
    return nation.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), (F.col("s_nationkey") + 20000000).cast("long").alias("target_id")))


def chunk_entities(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_suppkey").alias("entity_id")).distinct()


WALK = f"""WITH {ENTITIES}, b AS (SELECT source_id AS a, target_id AS z FROM re UNION SELECT target_id, source_id FROM re),
h0 AS (SELECT entity_id FROM en WHERE contains(lower(name), 'region') OR contains(lower(description), 'region ') ORDER BY entity_id LIMIT 2),
h1 AS (SELECT DISTINCT z AS entity_id FROM b JOIN h0 ON a = entity_id WHERE z NOT IN (SELECT entity_id FROM h0)),
h2 AS (SELECT DISTINCT z AS entity_id FROM b JOIN h1 ON a = entity_id WHERE z NOT IN (SELECT entity_id FROM h0) AND z NOT IN (SELECT entity_id FROM h1)),
m AS (SELECT entity_id, 0 AS hop, 1.0::DOUBLE AS score FROM h0 UNION ALL SELECT entity_id, 1, 0.5 FROM h1 UNION ALL SELECT entity_id, 2, 1.0 / 3 FROM h2)"""


def walk(spark, sf_dir):
    return retrieval.traverse(entities(spark, sf_dir), relations(spark, sf_dir), "Region ", 2, 2)


@query("v14_local_traversal", WALK + " SELECT entity_id::BIGINT AS entity_id, hop::INT AS hop, round(score, 6)::DOUBLE AS score FROM m")
def v14(spark, sf_dir):
    return walk(spark, sf_dir).withColumn("score", F.round("score", 6))


CHUNKS = WALK + """, ce AS (SELECT DISTINCT l_orderkey AS chunk_id, l_suppkey AS entity_id FROM lineitem), fw AS (SELECT ce.*, hop, row_number() OVER (PARTITION BY ce.entity_id ORDER BY chunk_id) AS nth FROM ce JOIN m USING (entity_id) QUALIFY nth <= 5),
ck AS (SELECT chunk_id, min((hop, entity_id, nth)) AS k FROM fw GROUP BY chunk_id ORDER BY k, chunk_id LIMIT 20), pl AS (SELECT chunk_id, (row_number() OVER (ORDER BY k, chunk_id))::INT AS place FROM ck)"""


@query("v15_chunk_collection", CHUNKS + """, fi AS (SELECT o_orderkey AS chunk_id, row_number() OVER (ORDER BY o_orderkey) AS nth FROM (SELECT DISTINCT o_orderkey FROM orders) WHERE o_orderkey NOT IN (SELECT chunk_id FROM pl))
SELECT chunk_id, place FROM pl UNION ALL SELECT chunk_id, (nth + (SELECT count(*) FROM pl))::INT FROM fi WHERE nth + (SELECT count(*) FROM pl) <= 20""")
def v15(spark, sf_dir):
    chosen = retrieval.collect_chunks(walk(spark, sf_dir), chunk_entities(spark, sf_dir))
    return retrieval.filled(chosen, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id")))


BUDGET = CHUNKS + ", tk AS (SELECT chunk_id, place, floor(o_totalprice / 1000)::BIGINT AS tokens, o_orderpriority FROM pl JOIN orders ON o_orderkey = chunk_id), bu AS (SELECT *, sum(tokens) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) AS upto FROM tk)"


def budgeted(spark, sf_dir):
    chosen = retrieval.collect_chunks(walk(spark, sf_dir), chunk_entities(spark, sf_dir))
    sized = chosen.join(table(spark, sf_dir, "orders"), F.col("chunk_id") == F.col("o_orderkey")).select("chunk_id", "place", F.floor(F.col("o_totalprice") / 1000).alias("tokens"), "o_orderpriority")
    return retrieval.within_budget(sized, 2000, ["place"])


@query("v16_token_budget", BUDGET + " SELECT chunk_id, place, tokens FROM bu WHERE upto <= 2000")
def v16(spark, sf_dir):
    return budgeted(spark, sf_dir).select("chunk_id", "place", "tokens")


@query("v17_context", BUDGET + " SELECT string_agg('[' || place || '] ' || chunk_id || ': ' || o_orderpriority, chr(10) ORDER BY place) AS context FROM bu WHERE upto <= 2000")
def v17(spark, sf_dir):
    line = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), F.col("chunk_id").cast("string"), F.lit(": "), "o_orderpriority")
    return retrieval.context_lines(budgeted(spark, sf_dir), line, "place")


COMMUNITIES = """co AS (SELECT c_nationkey::BIGINT AS community_id, (c_nationkey % 3)::INT AS level, count(*) AS size, string_agg(c_name, ' ' ORDER BY c_custkey) AS context, min(c_mktsegment) || ' ' || max(c_mktsegment) AS words FROM customer GROUP BY c_nationkey)"""


def communities(spark, sf_dir):
    named = F.array_sort(F.collect_list(F.struct("c_custkey", "c_name")))
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("community_id"), (F.col("c_nationkey") % 3).alias("level")).agg(
        F.count("*").alias("size"), F.array_join(F.transform(named, lambda s: s["c_name"]), " ").alias("context"), F.concat_ws(" ", F.min("c_mktsegment"), F.max("c_mktsegment")).alias("words")
    )


@query("v18_top_communities", f"WITH {COMMUNITIES} SELECT community_id, size FROM co WHERE level = 1 ORDER BY size DESC, community_id LIMIT 10")
def v18(spark, sf_dir):
    return retrieval.top_communities(communities(spark, sf_dir), 1).select("community_id", "size")


def _answers_sql(those: str = "") -> str:
    return f"""{COMMUNITIES}, an AS (SELECT community_id, CASE WHEN community_id % 5 = 0 THEN 'No relevant information here' ELSE substr(context, 1, ((community_id * 37) % 400 + 1)::INT) END AS answer FROM co{those}),
rl AS (SELECT *, CASE WHEN contains(lower(answer), 'no relevant information') THEN 0.0 WHEN length(answer) < 50 THEN 0.2 WHEN length(answer) < 150 THEN 0.5 WHEN length(answer) < 300 THEN 0.7 ELSE 0.9 END::DOUBLE AS relevance FROM an)"""


ANSWERS, ALL_ANSWERS = _answers_sql(" WHERE floor(length(context) * 0.25) <= 8000"), _answers_sql()


def partial_answers(those):
    answer = F.when(F.col("community_id") % 5 == 0, "No relevant information here").otherwise(F.substring("context", F.lit(1), (F.col("community_id") * 37 % 400 + 1).cast("int")))
    return retrieval.map_communities(those, answer)


@query("v19_global_map", f"WITH {ANSWERS} SELECT * FROM rl")
def v19(spark, sf_dir):
    return partial_answers(retrieval.fitting(communities(spark, sf_dir)))


@query("f12_reducible", f"WITH {ANSWERS} SELECT community_id FROM rl WHERE relevance > 0.1")
def f12(spark, sf_dir):
    return retrieval.reducible(partial_answers(retrieval.fitting(communities(spark, sf_dir)))).select("community_id")


@query("v20_global_reduce", f"WITH {ALL_ANSWERS} SELECT string_agg(answer, chr(10) || chr(10) ORDER BY relevance DESC, community_id) AS answer FROM rl WHERE relevance > 0.1")
def v20(spark, sf_dir):
    return retrieval.reduce_answers(partial_answers(communities(spark, sf_dir)))


@query("v11_community_by_keywords", f"""WITH {COMMUNITIES}, w AS (SELECT community_id, list_distinct(string_split_regex(lower(words), '\\s+')) AS w FROM co)
SELECT community_id, round(len(list_intersect(w, ['building', 'tools', 'cars']))::DOUBLE / len(list_distinct(list_concat(w, ['building', 'tools', 'cars']))), 6)::DOUBLE AS score FROM w WHERE len(list_intersect(w, ['building', 'tools', 'cars'])) > 0 ORDER BY score DESC, community_id LIMIT 3""")
def v11(spark, sf_dir):
    phrased = communities(spark, sf_dir).withColumn("phrases", F.array("words"))
    return lexical.community_by_keywords(phrased, "Building tools cars")


QUESTION = "is the thin ble of that and heating"
QW = "['is', 'the', 'thin', 'ble', 'of', 'that', 'and', 'heating']"
SHARE = f"(len(list_intersect({QW}, {DWORDS})) / 8.0)"
JUDGED = f"j AS (SELECT doc_id, CASE WHEN {SHARE} >= 0.6 THEN 2 WHEN {SHARE} >= 0.3 THEN 1 ELSE 0 END::INT AS relevance FROM documents)"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("f6_relevant", f"WITH {JUDGED} SELECT doc_id, relevance FROM j WHERE relevance >= 1")
def f6(spark, sf_dir):
    return lazy.relevant(docs(spark, sf_dir), lazy.relevance(QUESTION)).select("doc_id", "relevance")


@query("f7_by_relevance", f"WITH {JUDGED} SELECT relevance, count(*) AS n FROM j GROUP BY relevance")
def f7(spark, sf_dir):
    return lazy.by_relevance(docs(spark, sf_dir), lazy.relevance(QUESTION))


@query("w2_priority_pop", "SELECT doc_id AS id, n_chars AS priority FROM documents WHERE doc_id % 3 <> 0 ORDER BY priority DESC, id LIMIT 5")
def w2(spark, sf_dir):
    queue = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("n_chars").alias("priority"))
    return lazy.pop(queue, queue.where("id % 3 = 0").select("id"))


@query("f10_unvisited", "SELECT doc_id AS id FROM documents WHERE doc_id % 3 <> 0")
def f10(spark, sf_dir):
    ids = docs(spark, sf_dir).select(F.col("doc_id").alias("id"))
    return ids.join(ids.where("id % 3 = 0"), "id", "left_anti")


@query("v21_lazy_search")
def v21(spark, sf_dir):
    queue = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("n_chars").alias("priority"), "text")
    return lazy.search(queue, QUESTION, enough=40)


def many_questions(spark, sf_dir):
    """Every conversation's first question over all documents, with sources as communities: reported by their first document,
    with their ten first as members."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user' AND text IS NOT NULL")
    asked = turns.groupBy(F.col("conv_id").alias("question_id")).agg(F.min_by("text", "turn").alias("question"))
    d = docs(spark, sf_dir).where("doc_id IS NOT NULL AND text IS NOT NULL")
    chunks = d.select(F.col("doc_id").alias("id"), "text")
    nth = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    first = d.where("source IS NOT NULL").withColumn("nth", nth).where("nth <= 10")
    heads = first.where("nth = 1").select("source", F.col("doc_id").alias("community"), "text")
    members = heads.select("source", "community").join(first.select("source", F.col("doc_id").alias("chunk")), "source").select("community", "chunk")
    return questions.search_all(asked, chunks, heads.select(F.col("community").alias("id"), "text"), members, enough=6)


@query("v21_many_questions")
def v21m(spark, sf_dir):
    return many_questions(spark, sf_dir)[0]


@query("v21_question_states")
def v21s(spark, sf_dir):
    return many_questions(spark, sf_dir)[1]


@query("v23_lazy_gather")
def v23(spark, sf_dir):
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("source").alias("document_id"), "text")
    return lazy.gather(rows, QUESTION)


@query("v22_distinct_claims", f"""WITH c AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS claim, generate_subscripts(string_split(text, chr(10)), 1)::INT - 1 AS pos FROM documents)
SELECT doc_id, pos, claim FROM c QUALIFY row_number() OVER (PARTITION BY regexp_replace(trim(lower(claim)), '\\s+', ' ', 'g') ORDER BY doc_id, pos) = 1""")
def v22(spark, sf_dir):
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "claim"))
    return lazy.distinct_claims(lines, ["doc_id", "pos"])


@query("v24_deepening_sample", """WITH same AS (SELECT DISTINCT source FROM documents WHERE doc_id IN (3, 7)) SELECT doc_id AS id FROM documents LEFT JOIN (SELECT source, 1 AS s FROM same) USING (source) WHERE doc_id >= 20 ORDER BY coalesce(s, 0) DESC, md5(doc_id::VARCHAR), doc_id LIMIT 40""")
def v24(spark, sf_dir):
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("source").alias("document_id"))
    return lazy.deepen(rows, rows.where("id < 20").select("id"), rows.where("id IN (3, 7)").select("id"), 40).select("id")


@query("j19_same_document", "SELECT doc_id AS id FROM documents WHERE source IN (SELECT source FROM documents WHERE doc_id IN (3, 7)) AND doc_id NOT IN (3, 7)")
def j19(spark, sf_dir):
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "source")
    hits = rows.where("id IN (3, 7)")
    return rows.join(hits.select("source").distinct(), "source", "left_semi").join(hits.select("id"), "id", "left_anti").select("id")


CLAIMS = "cl AS (SELECT doc_id AS claim_id, trim(text) AS claim FROM documents), cw AS (SELECT claim_id, claim, list_distinct(string_split_regex(lower(trim(claim)), '\\s+')) AS w FROM cl)"


def claim_rows(spark, sf_dir):
    return docs(spark, sf_dir).select(F.col("doc_id").alias("claim_id"), F.trim("text").alias("claim"), F.col("source"))


@query("v25_similar_claims", f"WITH {CLAIMS} SELECT a.claim_id AS kept, b.claim_id AS dropped FROM cw a JOIN cw b ON a.claim_id < b.claim_id AND least(len(a.w), len(b.w)) >= 0.85 * greatest(len(a.w), len(b.w)) AND len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) >= 0.85")
def v25(spark, sf_dir):
    return lazy.similar_claims(claim_rows(spark, sf_dir))


@query("v25_first_claims")
def v25f(spark, sf_dir):
    return lazy.first_claims(claim_rows(spark, sf_dir))


@query("v25_merged_claims")
def v25m(spark, sf_dir):
    return lazy.merged_claims(claim_rows(spark, sf_dir))


NODE_UNITS = PAIRS + ", nu AS (SELECT phrase AS title, count(*) AS frequency, list_distinct(list(unit)) AS units FROM o GROUP BY phrase), sn AS (SELECT * FROM nu WHERE len(list_intersect(units, [1, 2, 5])) > 0)"


def subgraph(spark, sf_dir):
    units = cooccurrence.frequent(placed(spark, sf_dir)).groupBy(F.col("phrase").alias("title")).agg(F.count("*").alias("frequency"), F.collect_set("unit").alias("units"))
    return lazy.concept_subgraph(units, phrase_edges(spark, sf_dir), [1, 2, 5])


@query("v26_concept_subgraph", NODE_UNITS + " SELECT source, target, weight FROM ed WHERE source IN (SELECT title FROM sn) AND target IN (SELECT title FROM sn)")
def v26(spark, sf_dir):
    return subgraph(spark, sf_dir)[1].select("source", "target", "weight")


@query("v26_concept_nodes", NODE_UNITS + " SELECT title, frequency FROM sn")
def v26n(spark, sf_dir):
    return subgraph(spark, sf_dir)[0].select("title", "frequency")


SENT = f"""st AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1)::INT - 1 AS pos FROM documents), sc AS (SELECT doc_id, pos, text, round({SHARE}, 6)::DOUBLE AS score FROM st)"""


def scored_sentences(spark, sf_dir):
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return lines.withColumn("score", F.round(lexical.overlap(QUESTION, F.col("text")), 6))


@query("v27_context_fit", f"WITH {SENT}, t AS (SELECT *, sum(floor(length(text) * 0.25)::BIGINT) OVER (ORDER BY score DESC, doc_id, pos ROWS UNBOUNDED PRECEDING) AS upto FROM sc) SELECT doc_id, pos, score FROM t WHERE upto <= 4000")
def v27(spark, sf_dir):
    lines = scored_sentences(spark, sf_dir).withColumn("tokens", X.estimated_tokens(F.col("text")))
    fit = retrieval.within_budget(lines, 4000, ["-score", "doc_id", "pos"])
    return fit.select("doc_id", "pos", "score")


@query("v28_context_merge", f"WITH {SENT} SELECT text, max(score) AS score FROM sc GROUP BY text ORDER BY score DESC, text LIMIT 100")
def v28(spark, sf_dir):
    rows = scored_sentences(spark, sf_dir)
    merged = rows.where("doc_id % 2 = 0").unionByName(rows.where("doc_id % 2 = 1"))
    return fusion.stream_merge(merged, 100, "text")


@query("v29_minimal_context", f"WITH {SENT} SELECT doc_id, pos, score FROM sc ORDER BY score DESC, doc_id, pos LIMIT 20")
def v29(spark, sf_dir):
    return scored_sentences(spark, sf_dir).orderBy(F.desc("score"), "doc_id", "pos").limit(20).select("doc_id", "pos", "score")


@query("v30_qa_turns", """WITH g AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS qa FROM conversations)
SELECT conv_id, qa::INT AS qa, max(text) FILTER (WHERE role = 'user') AS question, coalesce(string_agg(text, chr(10) ORDER BY turn, text) FILTER (WHERE role <> 'user'), '') AS answers FROM g WHERE qa > 0 GROUP BY conv_id, qa""")
def v30(spark, sf_dir):
    return lazy.qa_turns(table(spark, sf_dir, "conversations"))


@query("v31_last_user_turns", "SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC))::INT AS nth FROM conversations WHERE role = 'user' QUALIFY nth <= 2")
def v31(spark, sf_dir):
    return lazy.last_user_turns(table(spark, sf_dir, "conversations"), 2).select("conv_id", "turn", "nth")


@query("v32_expansion", r"""WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user' AND text IS NOT NULL),
p AS (SELECT conv_id, turn, text AS subquery, -1 AS pos FROM u UNION ALL SELECT conv_id, turn, trim(unnest(string_split_regex(text, '[,.;?!]+|\band\b')), ' '), generate_subscripts(string_split_regex(text, '[,.;?!]+|\band\b'), 1) FROM u),
k AS (SELECT conv_id, turn, subquery, min(pos) AS pos FROM p WHERE pos = -1 OR len(list_distinct(list_filter(string_split_regex(lower(subquery), '\s+'), lambda w: w <> ''))) >= 2 GROUP BY ALL)
SELECT conv_id, turn, subquery FROM k QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) <= 5""")
def v32(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("role = 'user' AND text IS NOT NULL")
    return turns.select("conv_id", "turn", F.explode(questions.subqueries(F.col("text"))).alias("subquery"))


@query("w3_zero_runs", """WITH t AS (SELECT event_id, user_id, value > 50 AS hit FROM events), g AS (SELECT *, sum(hit::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM t)
SELECT event_id, (sum((NOT hit)::INT) OVER (PARTITION BY user_id, run ORDER BY event_id))::INT AS zeros FROM g""")
def w3(spark, sf_dir):
    tests = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("value") > 50).alias("hit"))
    return lazy.zero_runs(tests, "user_id", "event_id").select("event_id", "zeros")


MENTIONS = """mt AS (SELECT event_id AS pos, 'e' || event_id AS id, CASE user_id % 3 WHEN 0 THEN upper(event_type) WHEN 1 THEN event_type || '!' ELSE event_type END || ' ' || user_id % 40 AS name, event_type AS type,
  'd' || repeat('x', (event_id % 17)::INT) AS description, 'c' || event_id % 9 AS chunk, CASE WHEN event_id % 4 = 0 THEN (2000 + event_id % 20)::INT END AS year FROM events)"""


def mentions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    name = F.when(F.col("user_id") % 3 == 0, F.upper("event_type")).when(F.col("user_id") % 3 == 1, F.concat("event_type", F.lit("!"))).otherwise(F.col("event_type"))
    return e.select(
        F.col("event_id").alias("pos"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.concat(name, F.lit(" "), (F.col("user_id") % 40).cast("string")).alias("name"), F.col("event_type").alias("type"),
        F.concat(F.lit("d"), F.repeat(F.lit("x"), (F.col("event_id") % 17).cast("int"))).alias("description"), F.concat(F.lit("c"), (F.col("event_id") % 9).cast("string")).alias("chunk"),
        F.when(F.col("event_id") % 4 == 0, (2000 + F.col("event_id") % 20).cast("int")).alias("year"), F.lit(1.0).alias("confidence"),
    )


@query("a9_entity_merge", f"""WITH {MENTIONS}, k AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9_ \\-]', '', 'g') AS key FROM mt)
SELECT key, first(id ORDER BY pos) AS id, first(name ORDER BY pos) AS name, first(type ORDER BY pos) AS type, first(description ORDER BY length(description) DESC, pos) AS description,
 array_to_string(list_filter(list_sort(list_distinct(list(name))), lambda x: x <> first(name ORDER BY pos)), '|') AS aliases, array_to_string(list_sort(list_distinct(list(chunk))), '|') AS chunks,
 first(year ORDER BY pos) FILTER (WHERE year IS NOT NULL) AS year, CASE WHEN count(*) > 1 THEN least(1.0, count(*) * 0.2 + 0.5) ELSE 1.0 END::DOUBLE AS confidence FROM k GROUP BY key""")
def a9(spark, sf_dir):
    return merging.merge_entities(mentions(spark, sf_dir))


@query("a10_relation_merge", f"""WITH {MENTIONS} SELECT lower(type) || '|RELATED_TO|' || lower(chunk) AS key, first(description ORDER BY length(description) DESC, pos) AS description, first(name ORDER BY length(name) DESC, pos) AS evidence,
 array_to_string(list_sort(list_distinct(list(chunk))), '|') AS chunks, CASE WHEN count(*) > 1 THEN least(1.0, count(*) * 0.2 + 0.5) ELSE 1.0 END::DOUBLE AS confidence, CASE WHEN count(*) > 1 THEN least(1.0, count(*) * 0.15 + 0.5) ELSE 1.0 END::DOUBLE AS weight FROM mt GROUP BY 1""")
def a10(spark, sf_dir):
    found = mentions(spark, sf_dir).select("pos", F.col("type").alias("source"), F.lit("RELATED_TO").alias("type"), F.col("chunk").alias("target"), "description", F.col("name").alias("evidence"), "chunk", "confidence")
    return merging.merge_relations(found)


@query("a9_map_merge", "WITH m AS (SELECT user_id, event_type AS name, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type) SELECT user_id, name, value FROM m")
def a9m(spark, sf_dir):
    maps = table(spark, sf_dir, "events").select("user_id", "event_id", F.create_map("event_type", "value").alias("properties"))
    return merging.merge_maps(maps, "user_id", "properties", "event_id").select("user_id", F.explode("properties").alias("name", "value"))


@query("relation_seam", "WITH m AS (SELECT DISTINCT l_orderkey AS chunk, l_suppkey AS entity FROM lineitem) SELECT a.entity AS source, b.entity AS target, a.chunk FROM m a JOIN m b ON a.chunk = b.chunk AND a.entity < b.entity")
def relation_seam(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk"), F.col("l_suppkey").alias("entity"))
    return merging.extract_relations(found)


# snapshots: the old one lacks every 7th document and has other hashes for every 5th; the new one lacks every 11th
SNAPSHOTS = """od AS (SELECT doc_id AS document_id, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE '' END || substr(sha256(text), 1, 16) AS h, list_transform(range(0, (doc_id % 3 + 1)::INT), lambda i: 'u' || doc_id || '_' || i) AS u FROM documents WHERE doc_id % 7 <> 0),
nd AS (SELECT doc_id AS document_id, substr(sha256(text), 1, 16) AS h, list_transform(range(0, (doc_id % 4 + 1)::INT), lambda i: 'u' || doc_id || '_' || i) AS u FROM documents WHERE doc_id % 11 <> 0),
ch AS (SELECT coalesce(od.document_id, nd.document_id) AS document_id, CASE WHEN od.h IS NULL THEN 'ADDED' WHEN nd.h IS NULL THEN 'DELETED' WHEN od.h = nd.h THEN 'UNCHANGED' ELSE 'MODIFIED' END AS change_type, od.u AS ou, nd.u AS nu, nd.h AS nh FROM od FULL JOIN nd USING (document_id))"""


def snapshots(spark, sf_dir):
    d = docs(spark, sf_dir)
    unit = lambda n: F.transform(F.sequence(F.lit(0), (F.col("doc_id") % n).cast("int")), lambda i: F.concat(F.lit("u"), F.col("doc_id").cast("string"), F.lit("_"), i.cast("string")))
    hashed = X.content_hash(F.col("text"))
    old = d.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("document_id"), F.concat(F.when(F.col("doc_id") % 5 == 0, "x").otherwise(""), hashed).alias("content_hash"), unit(3).alias("units"))
    new = d.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("document_id"), hashed.alias("content_hash"), unit(4).alias("units"))
    return old, new


def changes(spark, sf_dir):
    return incremental.classify(*snapshots(spark, sf_dir))


@query("i1_changes", f"WITH {SNAPSHOTS} SELECT document_id, change_type FROM ch")
def i1(spark, sf_dir):
    return changes(spark, sf_dir).select("document_id", "change_type")


@query("j16_change_join", f"WITH {SNAPSHOTS} SELECT document_id, change_type FROM ch WHERE change_type <> 'DELETED'")
def j16(spark, sf_dir):
    return incremental.classify(*snapshots(spark, sf_dir), check_deleted=False).select("document_id", "change_type")


@query("i2_unit_changes", f"""WITH {SNAPSHOTS}, x AS (SELECT document_id, change_type, CASE change_type WHEN 'ADDED' THEN nu WHEN 'MODIFIED' THEN list_filter(nu, lambda u: NOT list_contains(ou, u)) ELSE [] END AS a, CASE change_type WHEN 'MODIFIED' THEN list_filter(ou, lambda u: NOT list_contains(nu, u)) WHEN 'DELETED' THEN ou ELSE [] END AS r FROM ch)
SELECT document_id, array_to_string(list_sort(a), ',') AS to_add, array_to_string(list_sort(r), ',') AS to_remove FROM x""")
def i2(spark, sf_dir):
    found = incremental.unit_changes(changes(spark, sf_dir))
    return found.select("document_id", F.array_join(F.array_sort("to_add"), ",").alias("to_add"), F.array_join(F.array_sort("to_remove"), ",").alias("to_remove"))


@query("i3_tracked_units", f"WITH {SNAPSHOTS} SELECT unnest(nu) AS unit, 'add' AS action FROM ch WHERE change_type IN ('ADDED', 'MODIFIED') UNION SELECT unnest(ou), 'remove' FROM ch WHERE change_type IN ('DELETED', 'MODIFIED')")
def i3(spark, sf_dir):
    return incremental.tracked_units(changes(spark, sf_dir))


@query("i4_applied", f"WITH {SNAPSHOTS} SELECT document_id, nh AS content_hash, len(nu)::INT AS n_units FROM ch WHERE change_type <> 'DELETED'")
def i4(spark, sf_dir):
    return incremental.applied(changes(spark, sf_dir)).select("document_id", "content_hash", F.size("units").alias("n_units"))


@query("i5_updated_units", f"""WITH {SNAPSHOTS} SELECT document_id, u AS unit FROM (SELECT document_id, unnest(ou) AS u FROM ch WHERE change_type = 'UNCHANGED' UNION ALL SELECT document_id, unnest(nu) FROM ch WHERE change_type IN ('ADDED', 'MODIFIED'))""")
def i5(spark, sf_dir):
    old, new = snapshots(spark, sf_dir)
    units = lambda d: d.select("document_id", F.explode("units").alias("unit"))
    return incremental.updated_units(units(old), changes(spark, sf_dir), units(new))


@query("i6_to_reindex", f"WITH {SNAPSHOTS} SELECT document_id FROM ch WHERE change_type IN ('ADDED', 'MODIFIED')")
def i6(spark, sf_dir):
    return incremental.to_reindex(changes(spark, sf_dir))


@query("a12_change_counts", f"WITH {SNAPSHOTS} SELECT change_type, count(*) AS n FROM ch GROUP BY change_type")
def a12(spark, sf_dir):
    return incremental.change_counts(changes(spark, sf_dir))


@query("a12_total_changes", f"WITH {SNAPSHOTS} SELECT count(*) FILTER (WHERE change_type <> 'UNCHANGED') AS n_changes FROM ch")
def a12t(spark, sf_dir):
    return incremental.total_changes(changes(spark, sf_dir))


@query("r8_file_changes", "SELECT url AS path, CASE WHEN page_id % 6 = 0 AND page_id % 5 <> 0 THEN 'ADDED' WHEN page_id % 5 = 0 AND page_id % 6 <> 0 THEN 'DELETED' WHEN page_id % 4 = 0 THEN 'MODIFIED' ELSE 'UNCHANGED' END AS change_type FROM (SELECT url, min(page_id) AS page_id FROM pages GROUP BY url) WHERE NOT (page_id % 5 = 0 AND page_id % 6 = 0)")
def r8(spark, sf_dir):
    files = table(spark, sf_dir, "pages").groupBy(F.col("url").alias("path")).agg(F.min("page_id").alias("page_id"))
    old = files.where("page_id % 6 <> 0").select("path", F.lit(1).alias("modified"))
    new = files.where("page_id % 5 <> 0").select("path", F.when(F.col("page_id") % 4 == 0, 2).otherwise(1).alias("modified"))
    return incremental.file_changes(old, new)


ROUTED = ["What is the main trend in graph retrieval?", "Survey of approaches", "How to implement attention?", "Compare BERT vs GPT", "difference between RAG and fine-tuning", "How many parameters does it have?", "Who first proposed it? the original paper", "benchmark ranking and leaderboard", "研究動向の概要", "手法の比較", "引用と先行研究", "ベンチマークの評価指標", "精度はいくつ", "tell me a story", "what is the accuracy of it", "95 accuracy", "where can I find it", "better or worse methods"]
_LOOK = [(k, p) for k, ps in routing.PATTERNS.items() for p in ps if "(?!" not in p]
_PHRASES = "[" + ", ".join("'" + q.replace("'", "''") + "'" for q in ROUTED) + "]"
_QUERIES_SQL = f"q AS (SELECT conv_id * 10000 + turn AS id, {_PHRASES}[(conv_id * 31 + turn) % {len(ROUTED)} + 1] || ' ' || text AS query FROM conversations WHERE text IS NOT NULL)"
_COUNTS = ", ".join(f"({' + '.join(f'regexp_matches(query, $r${p}$r$)::INT' for kk, p in _LOOK if kk == k)}{' + (regexp_matches(lower(query), $r$what\\s+is\\s+$r$) AND NOT regexp_matches(lower(query), $r$what\\s+is\\s+the\\s+(?:difference|accuracy)$r$))::INT' if k == 'exploration' else ''}) AS {k}" for k in routing.PATTERNS)
_KINDS = list(routing.PATTERNS)
ROUTE_SQL = f"""WITH {_QUERIES_SQL}, c AS (SELECT id, query, {_COUNTS} FROM q), g AS (SELECT *, greatest({', '.join(_KINDS)}) AS n FROM c),
ty AS (SELECT id, query, n, CASE WHEN n = 0 THEN 'unknown' {' '.join(f"WHEN {k} = n THEN '{k}'" for k in _KINDS)} END AS query_type, CASE WHEN n = 0 THEN 0.5 ELSE least(0.5 + 0.15 * n, 0.95) END::DOUBLE AS confidence FROM g),
mo AS (SELECT *, CASE query_type WHEN 'survey' THEN 'graphrag' WHEN 'comparison' THEN 'hybrid' WHEN 'benchmark' THEN 'hybrid' WHEN 'factoid' THEN 'vector' ELSE 'lazy' END AS mode FROM ty)"""


def routed(spark, sf_dir):
    """The turns of all conversations as a log of queries, each opened by one of the phrases above."""
    phrase = F.element_at(F.array(*map(F.lit, ROUTED)), ((F.col("conv_id") * 31 + F.col("turn")) % len(ROUTED) + 1).cast("int"))
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    return turns.select((F.col("conv_id") * 10000 + F.col("turn")).alias("id"), F.concat(phrase, F.lit(" "), "text").alias("query"))


@query("o1_classify", ROUTE_SQL + " SELECT id, query_type, n::INT AS n, round(confidence, 6)::DOUBLE AS confidence FROM ty")
def o1(spark, sf_dir):
    c = routing.classify(F.col("query"))
    return routed(spark, sf_dir).select("id", c["type"].alias("query_type"), c["n"].alias("n"), F.round(c["confidence"], 6).alias("confidence"))


@query("o2_mode", ROUTE_SQL + " SELECT id, mode, CASE WHEN mode IN ('graphrag', 'hybrid') THEN 'lazy' ELSE mode END AS minimal_mode FROM mo")
def o2(spark, sf_dir):
    kind = routing.classify(F.col("query"))["type"]
    return routed(spark, sf_dir).select("id", routing.mode_of(kind).alias("mode"), routing.mode_of(kind, F.lit(True)).alias("minimal_mode"))


@query("o3_fallback", ROUTE_SQL + """ SELECT id, lv.level, CASE WHEN lv.level = 0 AND mode IN ('lazy', 'graphrag', 'hybrid') THEN 'vector' WHEN lv.level = 1 AND mode IN ('graphrag', 'hybrid') THEN 'lazy' WHEN lv.level = 2 AND mode = 'graphrag' THEN 'lazy' ELSE mode END AS mode FROM mo, (SELECT unnest(range(0, 5))::INT AS level) lv""")
def o3(spark, sf_dir):
    levels = routed(spark, sf_dir).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return levels.select("id", "level", routing.fallback(routing.mode_of(routing.classify(F.col("query"))["type"]), F.col("level")).alias("mode"))


@query("o4_parameters", ROUTE_SQL + """ SELECT id, CASE mode WHEN 'vector' THEN CASE WHEN query_type = 'factoid' THEN 5 ELSE 10 END END::INT AS top_k, CASE mode WHEN 'lazy' THEN CASE WHEN query_type = 'exploration' THEN 5 ELSE 3 END END::INT AS max_iterations,
 CASE mode WHEN 'graphrag' THEN CASE WHEN query_type = 'survey' THEN 2 ELSE 1 END END::INT AS community_level, CASE mode WHEN 'hybrid' THEN CASE WHEN query_type = 'benchmark' THEN 'vector,lazy,graphrag' ELSE 'vector,lazy' END END AS engines FROM mo""")
def o4(spark, sf_dir):
    return routing.route(routed(spark, sf_dir), 3).select("id", "top_k", "max_iterations", "community_level", "engines")


@query("o5_preference", ROUTE_SQL + " SELECT id, 'hybrid' AS mode, 1.0::DOUBLE AS confidence FROM q")
def o5(spark, sf_dir):
    return routing.route(routed(spark, sf_dir), preference="hybrid").select("id", "mode", "confidence")


@query("o6_facade_mode", """SELECT conv_id, turn, CASE WHEN len(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) > 10 OR len(list_intersect(string_split_regex(lower(text), '\\s+'), ['why', 'how', 'explain', 'compare', 'difference', 'relationship'])) > 0 THEN 'lazy' ELSE 'vector' END AS mode FROM conversations""")
def o6(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", routing.facade_mode(F.col("text")).alias("mode"))


def engines(spark, sf_dir):
    def broken(_):
        raise ValueError("no index")

    def ranked(k):
        return lambda q: docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.round(lexical.overlap(q, F.col("text")), 6).alias("score")).where(F.col("id") % k == 0).orderBy(F.desc("score"), "id").limit(5)

    return {"lazy": broken, "hybrid": ranked(2), "vector": ranked(3)}


TOP5 = lambda k: f"(SELECT doc_id AS id, round({SHARE}, 6)::DOUBLE AS score FROM documents WHERE doc_id % {k} = 0 ORDER BY score DESC, id LIMIT 5)"


@query("o7_fallback_run", f"SELECT * FROM {TOP5(2)}")
def o7(spark, sf_dir):
    return routing.run_with_fallback(engines(spark, sf_dir), "lazy", QUESTION)[1]


@query("o8_together", f"SELECT *, 'hybrid' AS method FROM {TOP5(2)} UNION ALL SELECT *, 'vector' FROM {TOP5(3)}")
def o8(spark, sf_dir):
    both = {k: v for k, v in engines(spark, sf_dir).items() if k != "lazy"}
    return routing.run_together(both, QUESTION)


@query("o9_by_levels", f"SELECT *, 0 AS level FROM {TOP5(3)} UNION ALL SELECT *, 2 FROM {TOP5(2)}")
def o9(spark, sf_dir):
    e = engines(spark, sf_dir)
    return routing.run_by_levels({0: e["vector"], 2: e["hybrid"], 3: e["vector"]}, "standard", [0, 2, 3], QUESTION)


LEDGER = "lg AS (SELECT (user_id % 5)::INT AS level, event_type AS operation, floor(value)::BIGINT AS tokens, ts, event_id FROM events)"


def ledger(spark, sf_dir):
    return table(spark, sf_dir, "events").select((F.col("user_id") % 5).cast("int").alias("level"), F.col("event_type").alias("operation"), F.floor("value").alias("tokens"), "ts", "event_id")


@query("o10_budget_level", "SELECT conv_id, ['minimal', 'standard', 'premium', 'unlimited'][conv_id % 4 + 1] AS budget, (conv_id % 4 + 1)::INT AS level FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)")
def o10(spark, sf_dir):
    """Every conversation has a budget."""
    budget = F.element_at(F.array(*map(F.lit, routing.BUDGET_LEVELS)), (F.col("conv_id") % 4 + 1).cast("int"))
    asked = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL").select("conv_id").distinct().withColumn("budget", budget)
    return asked.withColumn("level", routing.level_of(F.col("budget")))


@query("f13_allowed_levels", f"WITH {LEDGER} SELECT level, count(*) AS n FROM lg WHERE level <= 2 AND level IN (0, 2, 3) GROUP BY level")
def f13(spark, sf_dir):
    return routing.allowed_levels(ledger(spark, sf_dir), "standard", [0, 2, 3]).groupBy("level").agg(F.count("*").alias("n"))


@query("a13_usage", f"WITH {LEDGER} SELECT level, operation, sum(tokens)::BIGINT AS tokens, count(*) AS n FROM lg GROUP BY CUBE (level, operation)")
def a13(spark, sf_dir):
    return metrics.usage(ledger(spark, sf_dir))


@query("a13_budget_state", f"WITH {LEDGER}, t AS (SELECT sum(tokens)::BIGINT AS total FROM lg) SELECT total, greatest(0, 600000 - total)::BIGINT AS remaining, round(total / 600000, 6)::DOUBLE AS ratio, total >= 480000 AS near, total >= 600000 AS over FROM t")
def a13b(spark, sf_dir):
    return metrics.budget_state(ledger(spark, sf_dir), 600000)


@query("a14_history", f"WITH {LEDGER} SELECT event_id FROM lg ORDER BY ts DESC, event_id DESC LIMIT 1000")
def a14(spark, sf_dir):
    return metrics.latest(ledger(spark, sf_dir), 1000, [F.desc("ts"), F.desc("event_id")]).select("event_id")


@query("a15_build_cost", "SELECT source, count(*) AS chunks, (floor(count(*) * 50000 / 1000) + floor(count(*) * 100000 / 1000))::BIGINT AS tokens FROM documents GROUP BY source")
def a15(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("chunks")).withColumn("tokens", metrics.build_cost(F.col("chunks"), "premium"))


@query("a16_histogram", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(n) AS n, min(value) AS least, max(value) AS most, round(avg(value), 6)::DOUBLE AS mean, max(value) FILTER (WHERE rn = n // 2) AS p50, CASE WHEN max(n) >= 20 THEN max(value) FILTER (WHERE rn = floor(n * 0.95)::BIGINT) ELSE max(value) END AS p95, CASE WHEN max(n) >= 100 THEN max(value) FILTER (WHERE rn = floor(n * 0.99)::BIGINT) ELSE max(value) END AS p99 FROM r GROUP BY event_type""")
def a16(spark, sf_dir):
    return metrics.histogram(table(spark, sf_dir, "events"), "event_type", "value")


@query("a17_counters", "SELECT event_type AS name, round(sum(value), 4)::DOUBLE AS total, arg_max(value, (ts, event_id)) AS last FROM events GROUP BY event_type")
def a17(spark, sf_dir):
    return metrics.counters(table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), "value", "ts", F.col("event_id").alias("id")))


@query("a18_hit_rate", "SELECT user_id, round(count(*) FILTER (WHERE value > 50)::DOUBLE / count(*), 6)::DOUBLE AS rate FROM events GROUP BY user_id")
def a18(spark, sf_dir):
    hits = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("value") > 50).alias("h"), F.count_if(F.col("value") <= 50).alias("m"))
    return hits.select("user_id", F.round(metrics.hit_rate(F.col("h"), F.col("m")), 6).alias("rate"))


@query("a19_errors", "SELECT event_type AS error, count(*) AS n FROM events WHERE value < 10 GROUP BY event_type")
def a19(spark, sf_dir):
    return metrics.error_counts(table(spark, sf_dir, "events").where("value < 10").select(F.col("event_type").alias("error")))


@query("a20_throughput", "SELECT event_type, round(CASE WHEN sum(value) > 0 THEN count(*) / sum(value) ELSE 0 END, 9)::DOUBLE AS rate FROM events GROUP BY event_type")
def a20(spark, sf_dir):
    sums = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    return sums.select("event_type", F.round(metrics.throughput(F.col("n"), F.col("s")), 9).alias("rate"))


@query("a11_batch_stats", "SELECT count(*) AS total, count(*) FILTER (WHERE value < 10) AS errors, round(count(*) FILTER (WHERE value >= 10)::DOUBLE / count(*), 6)::DOUBLE AS success_rate FROM events")
def a11(spark, sf_dir):
    return metrics.batch_stats(table(spark, sf_dir, "events").select((F.col("value") >= 10).alias("ok")))


@query("j1_metadata_join", "SELECT vec_id, label, substr(text, 1, 500) AS text FROM embeddings LEFT JOIN documents ON doc_id = vec_id")
def j1(spark, sf_dir):
    units = docs(spark, sf_dir).select(F.col("doc_id").alias("vec_id"), F.substring("text", 1, 500).alias("text"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label").join(units, "vec_id", "left")


@query("j2_features_join", f"WITH w AS (SELECT doc_id, len({DWORDS})::INT AS n_words FROM documents) SELECT doc_id, source, n_words FROM documents JOIN w USING (doc_id)")
def j2(spark, sf_dir):
    features = docs(spark, sf_dir).select("doc_id", F.size(X.word_set(F.col("text"))).alias("n_words"))
    return docs(spark, sf_dir).select("doc_id", "source").join(features, "doc_id")


@query("j10_co_citation_orders", "WITH p AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem) SELECT b.dst AS other, count(*) AS shared FROM p a JOIN p b ON a.src = b.src AND a.dst <> b.dst WHERE a.dst = 11 GROUP BY b.dst")
def j10(spark, sf_dir):
    from lumenfold.operators.citation import co_citation

    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    return co_citation(edges, 1, 11).select("other", "shared")


@query("j11_coupling_orders", "WITH p AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem) SELECT b.src AS other, count(*) AS shared FROM p a JOIN p b ON a.dst = b.dst AND a.src <> b.src WHERE a.src = 32 GROUP BY b.src")
def j11(spark, sf_dir):
    from lumenfold.operators.citation import coupling

    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    return coupling(edges, 1, 32).select("other", "shared")


@query("j17_union_group", f"SELECT id, count(*) AS n, max(score) AS score FROM (SELECT * FROM {TOP5(2)} UNION ALL SELECT * FROM {TOP5(3)}) GROUP BY id")
def j17(spark, sf_dir):
    both = {k: v for k, v in engines(spark, sf_dir).items() if k != "lazy"}
    return routing.run_together(both, QUESTION).groupBy("id").agg(F.count("*").alias("n"), F.max("score").alias("score"))


@query("j18_vector_by_query", "SELECT e.vec_id, round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 6)::DOUBLE AS dot FROM embeddings e, embeddings q WHERE q.vec_id = 1")
def j18(spark, sf_dir):
    from lumenfold.operators.vectors import dot, doubles

    e = table(spark, sf_dir, "embeddings")
    one = e.where("vec_id = 1").select(doubles("embedding").alias("q"))
    return e.crossJoin(F.broadcast(one)).select("vec_id", F.round(dot(doubles("embedding"), F.col("q")), 6).alias("dot"))  # one row
