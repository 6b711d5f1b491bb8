"""Parsers, the store and streams over the test tables."""

from __future__ import annotations

import io
import uuid
import zipfile

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenfold.functions import text as X
from lumenfold.operators import graph
from lumenfold.operators.chunking import section_chunks, token_chunks
from lumenfold.plans.catalog import query, table
from lumenfold.plans.graph_queries import FREQUENT, PARTS_SQL, parts
from lumenfold.plans.search_queries import DOCUMENTS, LISTS, lists
from lumenfold.plans.text_queries import _chunks_sql
from lumenfold.sources import files
from lumenfold.sources.buckets import BucketedIndex
from lumenfold.sources.build import build_index, builders
from lumenfold.sources.store import Store, export_documents, export_graph, graphml, read_graphml
from lumenfold.storage import materialise, scratch
from lumenfold.streaming import answers, updates


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def text_files(spark, sf_dir) -> str:
    """The texts as one .txt file for each source."""
    folder = scratch(spark)
    docs(spark, sf_dir).select("source", F.regexp_replace("text", r"\n", " ").alias("value")).repartition("source").write.partitionBy("source").text(folder)
    return folder


@query("s1_file_listing", "SELECT DISTINCT source, '.txt' AS file_type FROM documents")
def s1(spark, sf_dir):
    found = files.listing(spark, text_files(spark, sf_dir))
    return found.select(F.regexp_extract("path", "source=([^/]+)", 1).alias("source"), "file_type").distinct()


@query("s2_binary_load", "SELECT source, sum(strlen(regexp_replace(text, '\\n', ' ', 'g')) + 1)::BIGINT AS n_bytes FROM documents GROUP BY source")
def s2(spark, sf_dir):
    loaded = files.load(spark, text_files(spark, sf_dir), "*.txt")
    return loaded.groupBy(F.regexp_extract("path", "source=([^/]+)", 1).alias("source")).agg(F.sum(F.length("content")).cast("long").alias("n_bytes"))


NOTES = """SELECT doc_id, 'Paper ' || doc_id || chr(10) || 'dropped line' || chr(10) || '## Methods and data' || chr(10) || ' first words ' || chr(10) || chr(10) || 'Results' || chr(10) || lang || ' rows.' || chr(10) || source AS body FROM documents"""


def notes(spark, sf_dir, suffix: str = ".md"):
    body = F.concat(F.lit("Paper "), F.col("doc_id").cast("string"), F.lit("\ndropped line\n## Methods and data\n first words \n\nResults\n"), "lang", F.lit(" rows.\n"), "source")
    return docs(spark, sf_dir).select(F.concat(F.lit("/d/"), F.col("doc_id").cast("string"), F.lit(suffix)).alias("path"), body.alias("body"))


SECTIONS = """SELECT '/d/' || doc_id || '{0}' AS path, 'Paper ' || doc_id AS title, heading, level, section_type, content FROM (
  SELECT doc_id, 'Methods and data' AS heading, 2 AS level, 'methods' AS section_type, 'first words' || chr(10) AS content FROM documents UNION ALL
  SELECT doc_id, 'Results', 1, 'results', lang || ' rows.' || chr(10) || source || chr(10) FROM documents)"""


def sections(parsed):
    return parsed.select("path", "title", F.explode("sections").alias("s")).select("path", "title", "s.heading", "s.level", "s.section_type", "s.content")


@query("s5_text_structure", SECTIONS.format(".md"))
def s5(spark, sf_dir):
    return sections(files.parse_text(notes(spark, sf_dir)))


@query("s4_parse_dispatch", SECTIONS.format(".rst") + " UNION ALL SELECT '/d/' || doc_id || '.tex', 'T ' || doc_id, 'Method', 1, 'methods', 'We do .' FROM documents")
def s4(spark, sf_dir):
    rst = notes(spark, sf_dir, ".rst").select("path", F.encode("body", "UTF-8").alias("content"))
    key = F.col("doc_id").cast("string")
    tex = docs(spark, sf_dir).select(F.concat(F.lit("/d/"), key, F.lit(".tex")).alias("path"), F.encode(F.concat(F.lit("\\title{T "), key, F.lit("}\\section{Method} We do \\cite{a}.\\end{document}")), "UTF-8").alias("content"))
    return sections(files.parse(rst.unionByName(tex)))


@query("s7_html_title", """SELECT page_id, regexp_replace(replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '&quot;', '"'), '&amp;', '&'), '&middot;', '·'), '^\\s+|\\s+$', '', 'g') AS title FROM pages""")
def s7(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", files.html_title(F.col("html")).alias("title"))


@query("s7_html_text", r"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(html, '^.*?<body[^>]*>|</body>.*$', '', 'gs'), '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'gs') AS h FROM pages)
SELECT page_id, regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(h, '<[^>]*>', chr(10), 'gs'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', chr(160)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s*\n\s*', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM b""")
def s7t(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", files.html_text(F.col("html")).alias("text"))


@query("s7_html_documents")
def s7d(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("/p/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("body"))
    return files.parse_html(pages).select("path", "title", F.size("sections").alias("n_sections"))


@query("s8_json_documents", """SELECT '/d/' || doc_id || '.json' AS path, CASE WHEN doc_id % 2 = 0 THEN 'A ' || doc_id ELSE 'B ' || doc_id END AS title, 'Ann|' || source AS authors, CASE WHEN doc_id % 2 = 0 THEN '10.1/x' END AS doi, 2020 AS year, 'k|' || lang AS keywords FROM documents""")
def s8(spark, sf_dir):
    key = F.col("doc_id").cast("string")
    even = F.concat(F.lit('{"title": "A '), key, F.lit('", "doi": "10.1/x", '))
    body = F.concat(F.when(F.col("doc_id") % 2 == 0, even).otherwise(F.concat(F.lit('{"Title": "B '), key, F.lit('", '))), F.lit('"year": 2020, "authors": ["Ann", {"name": "'), "source", F.lit('"}], "keywords": ["k", "'), "lang", F.lit('"]}'))
    parsed = files.parse_json(docs(spark, sf_dir).select(F.concat(F.lit("/d/"), key, F.lit(".json")).alias("path"), body.alias("body")))
    return parsed.select("path", "title", F.array_join("authors", "|").alias("authors"), "doi", "year", F.array_join("keywords", "|").alias("keywords"))


@query("s9_latex_documents", "SELECT '/d/' || doc_id || '.tex' AS path, 'On ' || source AS title, 'Ann Lee|Bo' AS authors, 'Short ' || lang AS abstract, 2 AS n_sections FROM documents")
def s9(spark, sf_dir):
    body = F.concat(F.lit("\\title{On "), "source", F.lit("}\\author{Ann Lee \\and Bo}\\begin{abstract} Short "), "lang", F.lit("\\end{abstract}\\section{Introduction} a \\section{End} b\\end{document}"))
    parsed = files.parse_latex(docs(spark, sf_dir).select(F.concat(F.lit("/d/"), F.col("doc_id").cast("string"), F.lit(".tex")).alias("path"), body.alias("body")))
    return parsed.select("path", "title", F.array_join("authors", "|").alias("authors"), "abstract", F.size("sections").alias("n_sections"))


_DOCX = (
    '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>'
    '<w:p><w:pPr><w:pStyle w:val="Title"/></w:pPr><w:r><w:t>{0}</w:t></w:r></w:p><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Results</w:t></w:r></w:p>'
    "<w:p><w:r><w:t>{1}</w:t></w:r></w:p></w:body></w:document>"
)


@query("s10_office_documents", "SELECT '/n/' || n_nationkey || '.docx' AS path, n_name AS title, 'Results' AS heading, 2 AS level, 'results' AS section_type, 'region ' || n_regionkey || chr(10) AS content FROM nation")
def s10(spark, sf_dir):
    def pack(batches):
        for batch in batches:
            held = []
            for name, region in zip(batch["n_name"], batch["n_regionkey"], strict=True):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    z.writestr("word/document.xml", _DOCX.format(name, f"region {region}"))
                held.append(out.getvalue())
            yield batch.assign(content=held)[["path", "content"]]

    named = table(spark, sf_dir, "nation").withColumn("path", F.concat(F.lit("/n/"), F.col("n_nationkey").cast("string"), F.lit(".docx")))
    return sections(files.parse_office(named.mapInPandas(pack, "path string, content binary")))


@query("s11_layout_elements")
def s11(spark, sf_dir):
    kind = F.when(F.col("turn") == 0, "title").when(F.col("role") == "user", "heading").otherwise("text")
    elements = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("pos"), kind.alias("kind"), "text")
    return files.structured_elements(elements).select("path", "title", F.size("sections").alias("n_sections"))


@query("t2_section_chunks", "WITH c AS (" + _chunks_sql(300, 100) + ") SELECT doc_id || '_' || chunk_index AS id, doc_id AS document_id, chunk_index, 'body' AS section_type, n_tokens FROM c")
def t2_sections(spark, sf_dir):
    none = F.array().cast("array<struct<section_type:string,content:string>>")
    raw = docs(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.lit("").alias("abstract"), none.alias("sections"), F.col("text").alias("raw_text"))
    return section_chunks(raw).select(F.concat_ws("_", F.col("document_id").cast("string"), F.col("chunk_index").cast("string")).alias("id"), "document_id", "chunk_index", "section_type", "n_tokens")


def store_with_units(spark, sf_dir) -> Store:
    store = Store(spark, scratch(spark))
    units = token_chunks(docs(spark, sf_dir)).select(F.col("chunk_id").alias("id"), "doc_id", "n_tokens", F.col("chunk").alias("text"))
    store.write("text_units", units.where("doc_id % 2 = 0"))
    store.write("text_units", units.where("doc_id % 2 = 1"), append=True)
    return store


UNITS = "c AS (" + _chunks_sql(300, 100) + ")"


@query("s17_append", f"WITH {UNITS} SELECT chunk_id AS id, n_tokens FROM c")
def s17(spark, sf_dir):
    return store_with_units(spark, sf_dir).read("text_units", ["id", "n_tokens"])


@query("s18_pushed_scan", f"WITH {UNITS} SELECT chunk_id AS id FROM c WHERE n_tokens >= 300")
def s18(spark, sf_dir):
    return store_with_units(spark, sf_dir).read("text_units", ["id"], "n_tokens >= 300")


@query("s19_by_ids", f"WITH {UNITS} SELECT chunk_id AS id, n_tokens FROM c WHERE chunk_id IN ('3_0', '4_0', '5_1')")
def s19(spark, sf_dir):
    return store_with_units(spark, sf_dir).by_ids("text_units", ["3_0", "4_0", "5_1"]).select("id", "n_tokens")


@query("s20_without_vectors", "SELECT vec_id AS id, label FROM embeddings")
def s20(spark, sf_dir):
    store = Store(spark, scratch(spark))
    store.write("embeddings", table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label"))
    return store.embeddings(vectors=False)


@query("s21_store_stats", f"WITH {UNITS} SELECT 'text_units' AS name, count(*) AS n_rows FROM c")
def s21(spark, sf_dir):
    return store_with_units(spark, sf_dir).stats().select("name", "n_rows")


@query("s22_level_one_tables", f"WITH {PARTS_SQL} SELECT src AS source, dst AS target FROM e")
def s22(spark, sf_dir):
    store = Store(spark, scratch(spark))
    store.write("noun_phrase_edges", parts(spark, sf_dir).toDF("source", "target"))
    return store.read("noun_phrase_edges")


@query("s23_upper_levels", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def s23(spark, sf_dir):
    store = Store(spark, scratch(spark))
    store.write("entities", table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))
    return store.read("entities")


def indexed(spark, sf_dir, target: int = 3):
    store = Store(spark, scratch(spark))
    rows = docs(spark, sf_dir).where("doc_id IS NOT NULL").select(F.col("doc_id").alias("document_id"), "text", "lang", "source")

    def spread(e):
        e, names = graph.numbered(e, written=True)  # phrases are dealt out as numbers
        return graph.renamed(graph.label_propagation(e, 2).select(F.lit(1).alias("level"), "node", "community"), names)

    return store, build_index(store, rows, target, detect=spread)


_UNIT_PHRASES = FREQUENT.replace(DOCUMENTS, f"SELECT chunk_id AS doc_id, chunk AS text FROM ({_chunks_sql(300, 100)})").replace("doc_id // 3 AS doc_id", "split_part(doc_id, '_', 1)::BIGINT AS doc_id")


@query("s22_index_build", _UNIT_PHRASES + f""", n AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY pos, phrase) AS rn FROM o),
prs AS (SELECT DISTINCT least(x.phrase, y.phrase) AS a, greatest(x.phrase, y.phrase) AS b FROM n x JOIN n y ON x.unit = y.unit AND y.rn > x.rn AND y.rn <= x.rn + 5 WHERE x.phrase <> y.phrase), c AS ({_chunks_sql(300, 100)})
SELECT 'documents' AS name, count(*) AS n_rows FROM documents UNION ALL SELECT 'text_units', count(*) FROM c UNION ALL SELECT 'embeddings', count(*) FROM c UNION ALL SELECT 'nlp_features', count(*) FROM u
UNION ALL SELECT 'noun_phrase_nodes', count(DISTINCT phrase) FROM o UNION ALL SELECT 'noun_phrase_edges', count(*) FROM prs""")
def s22b(spark, sf_dir):
    """Rows of the tables of levels 0 and 1 built from the documents; communities (by label propagation here) have no SQL twin."""
    return indexed(spark, sf_dir, 1)[0].stats().where("name <> 'communities_l1'").select("name", "n_rows")


@query("s23_index_entities", f"""WITH c AS ({_chunks_sql(300, 100)}), t AS (SELECT chunk_id, term FROM c, (SELECT unnest([{", ".join("'" + t + "'" for t in X.ACADEMIC_TERMS)}]) AS term) WHERE contains(lower(chunk), lower(term)))
SELECT term AS name, count(*) AS n_units FROM t GROUP BY term""")
def s23b(spark, sf_dir):
    store = Store(spark, scratch(spark))
    rows = docs(spark, sf_dir).where("doc_id IS NOT NULL").select(F.col("doc_id").alias("document_id"), "text")
    made = builders(rows)
    store.build({0: made[0]}, 0)
    for name, table_ in made[2](store).items():
        store.write(name, table_)
    return store.read("entities", ["name", "n_units"])


@query("s24_graph_csv", f"WITH {PARTS_SQL} SELECT src, dst FROM e")
def s24(spark, sf_dir):
    folder = scratch(spark)
    e = parts(spark, sf_dir)
    export_graph(e, e.select(F.col("src").alias("node")).distinct(), folder)
    return spark.read.option("header", True).schema("src long, dst long").csv(f"{folder}/edges_csv")


@query("s24_graphml", f"WITH {PARTS_SQL} SELECT src::VARCHAR AS src, dst::VARCHAR AS dst FROM e")
def s24g(spark, sf_dir):
    path = scratch(spark)
    graphml(parts(spark, sf_dir)).write.text(path)
    return read_graphml(spark, path)


@query("s25_document_export", "SELECT doc_id, lang, source FROM documents")
def s25(spark, sf_dir):
    path = scratch(spark)
    export_documents(docs(spark, sf_dir).select("doc_id", "lang", "source"), path)
    return spark.read.option("header", True).schema("doc_id long, lang string, source string").csv(path)


@query("s26_delete", "SELECT vec_id AS id FROM embeddings WHERE vec_id % 4 <> 0")
def s26(spark, sf_dir):
    store = Store(spark, scratch(spark))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    store.write("embeddings", rows)
    store.delete("embeddings", rows.where("id % 4 = 0"))
    return store.read("embeddings", ["id"])


@query("s27_exhaustive_search", "SELECT e.vec_id, round(list_cosine_similarity(list_transform(e.embedding, lambda x: x::DOUBLE), list_transform(q.embedding, lambda x: x::DOUBLE)), 6)::DOUBLE AS score FROM embeddings e, embeddings q WHERE q.vec_id = 5 ORDER BY score DESC, e.vec_id LIMIT 50")
def s27(spark, sf_dir):
    from lumenfold.operators.vectors import cosine_top_k
    from lumenfold.plans.search_queries import query_vector

    return cosine_top_k(table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir, 5), 50)


@query("o11_level_gate", f"""WITH c AS ({_chunks_sql(300, 100)}), l AS (SELECT 0 AS level, 'text_units' AS name, count(*) AS n_rows FROM c UNION ALL SELECT 0, 'documents', count(*) FROM documents) SELECT level, name, n_rows FROM l""")
def o11(spark, sf_dir):
    """Level 0 from the documents; a second build finds it there and does nothing."""
    store, done = indexed(spark, sf_dir, 0)
    again = build_index(store, docs(spark, sf_dir).limit(0), 0)
    if done != [0] or again:
        raise AssertionError(f"built {done}, then {again}")
    return store.stats().where("name IN ('text_units', 'documents')").select(F.lit(0).alias("level"), "name", "n_rows")


@query("r7_incremental_stream", "SELECT doc_id AS document_id, substr(sha256(text || CASE WHEN doc_id % 3 = 0 THEN ' again' ELSE '' END), 1, 16) AS content_hash FROM documents")
def r7(spark, sf_dir):
    folder = scratch(spark)
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("document_id"), "text")
    store = Store(spark, f"{folder}/store")
    schema = "document_id long, text string"
    rows.write.parquet(f"{folder}/in")
    updates.follow(spark, f"{folder}/in", schema, store, f"{folder}/checkpoint").awaitTermination()
    rows.where("document_id % 3 = 0").withColumn("text", F.concat("text", F.lit(" again"))).write.mode("append").parquet(f"{folder}/in")
    updates.follow(spark, f"{folder}/in", schema, store, f"{folder}/checkpoint").awaitTermination()
    return store.read("state").select("document_id", "content_hash")


@query("r7_bucketed_stream", """WITH n AS (SELECT doc_id AS document_id, text || CASE WHEN doc_id % 3 = 0 THEN ' again' ELSE '' END AS text FROM documents WHERE doc_id IS NOT NULL)
SELECT document_id, substr(sha256(text), 1, 16) AS content_hash, length(text)::BIGINT AS n_chars FROM n""")
def r7b(spark, sf_dir):
    """Documents arrive in two rounds of files, the second changing a third of them; the state and the units' characters."""
    folder = scratch(spark)
    rows = docs(spark, sf_dir).where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").alias("document_id"), "text")
    index = BucketedIndex(spark, f"{folder}/index", 32, lambda d: d.select(F.col("document_id").cast("string").alias("id"), "document_id", "text"))
    rows.write.parquet(f"{folder}/in")
    updates.follow_buckets(spark, f"{folder}/in", "document_id long, text string", index, f"{folder}/checkpoint").awaitTermination()
    rows.where("document_id % 3 = 0").withColumn("text", F.concat("text", F.lit(" again"))).write.mode("append").parquet(f"{folder}/in")
    updates.follow_buckets(spark, f"{folder}/in", "document_id long, text string", index, f"{folder}/checkpoint").awaitTermination()
    units = index.read("units").groupBy("document_id").agg(F.sum(F.length("text")).alias("n_chars"))
    return index.read("state").join(units, "document_id").select("document_id", "content_hash", "n_chars")


@query("r2_stream_merge", LISTS + "SELECT id, max(score)::DOUBLE AS score FROM lists GROUP BY id ORDER BY score DESC, id LIMIT 10")
def r2(spark, sf_dir):
    from lumenfold.operators.fusion import stream_merge

    return stream_merge(lists(spark, sf_dir))


@query("r1_answer_stream")
def r1(spark, sf_dir):
    ranked = lists(spark, sf_dir).where("method = 'vector' AND rank <= 5").select("rank", "id")
    return updates.answer_stream(ranked, "As the sources say [1] it is so [2]")


@query("r5_word_stream", """SELECT conv_id, turn, unnest(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS word, generate_subscripts(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''), 1)::INT - 1 AS pos FROM conversations""")
def r5(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(X.tokens(F.col("text"))).alias("pos", "word"))


ENGINES, BEST = 5, 5
ANSWERS = f"""WITH a AS (SELECT user_id AS question, event_type AS engine, event_id AS id, value AS score, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1 AS done FROM events WHERE user_id IS NOT NULL),
f AS (SELECT question, engine, row_number() OVER (PARTITION BY question ORDER BY ts, engine) AS place FROM a WHERE done),
t AS (SELECT * FROM (SELECT question, id, score, row_number() OVER (PARTITION BY question ORDER BY score DESC, id) AS rank FROM a) WHERE rank <= {BEST}),
q AS (SELECT question, count(*) FILTER (WHERE done) AS m FROM a GROUP BY 1),
b AS (SELECT question, m, m + (m < {ENGINES})::INT AS base, (SELECT count(*) FROM t WHERE t.question = q.question) AS n FROM q),
p AS (SELECT question, 0 AS seq, 'start' AS kind, '' AS content, NULL AS id, NULL AS score FROM b
UNION ALL SELECT question, place, 'progress', engine || ' ' || place || '/{ENGINES}', NULL, NULL FROM f
UNION ALL SELECT question, base, 'error', 'timeout ' || m || '/{ENGINES}', NULL, NULL FROM b WHERE m < {ENGINES}
UNION ALL SELECT question, base + rank, 'result', rank::VARCHAR, id, score FROM t JOIN b USING (question)
UNION ALL SELECT question, base + n + 1, 'complete', n::VARCHAR, NULL, NULL FROM b
UNION ALL SELECT question, base + n + 1 + rank, 'text', id || '[' || rank || ']', NULL, NULL FROM t JOIN b USING (question)
UNION ALL SELECT question, base + 2 * n + 2, 'end', '', NULL, NULL FROM b) """


def arrivals(spark, sf_dir):
    """Events as what engines find: a user's question, answered by an engine a kind of event, done with its last one."""
    events = table(spark, sf_dir, "events").where("user_id IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp"))
    last = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))) == 1
    return events.select(F.col("user_id").alias("question"), F.col("event_type").alias("engine"), F.col("event_id").alias("id"), F.col("value").alias("score"), last.alias("done"), "ts")


def streamed_answers(spark, sf_dir):
    folder = scratch(spark)
    rows = materialise(arrivals(spark, sf_dir))
    cuts = rows.agg(F.percentile_approx("ts", [0.33, 0.66]).alias("at")).first()["at"]
    parts = [F.col("ts") < cuts[0], (F.col("ts") >= cuts[0]) & (F.col("ts") < cuts[1]), F.col("ts") >= cuts[1]]
    for part in parts:
        rows.where(part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    closing = rows.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("question"), F.lit("").alias("engine"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("score"), F.lit(False).alias("done"), (F.col("ts") + F.expr("INTERVAL 3000 days")).alias("ts"))
    closing.write.mode("append").parquet(f"{folder}/in")
    answers.follow_engines(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", ENGINES, BEST, "1000 days").awaitTermination()
    return spark.read.parquet(f"{folder}/out").where("question >= 0")


@query("r1_engine_answers", ANSWERS + "SELECT question, seq::INT AS seq, kind, content, id::BIGINT AS id, score::DOUBLE AS score FROM p")
def r1e(spark, sf_dir):
    """Three micro-batches and one that lets every question's time run out."""
    return streamed_answers(spark, sf_dir)


@query("r2_engine_answers_batch", ANSWERS + "SELECT question, seq::INT AS seq, kind, content, id::BIGINT AS id, score::DOUBLE AS score FROM p")
def r2b(spark, sf_dir):
    return answers.merged_answers(arrivals(spark, sf_dir), ENGINES, BEST)


@query("r5_collected_answers", ANSWERS + "SELECT question, coalesce(string_agg(content, ' ' ORDER BY seq) FILTER (WHERE kind = 'text'), '') AS answer, arg_max(kind, seq) AS status FROM p GROUP BY question")
def r5c(spark, sf_dir):
    return answers.collected(answers.merged_answers(arrivals(spark, sf_dir), ENGINES, BEST))


@query("r3_token_stream", r"""WITH RECURSIVE w AS (SELECT conv_id * 10000 + turn AS answer_id, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS t FROM conversations WHERE text IS NOT NULL),
r AS (SELECT answer_id, t, 0 AS i, '' AS held, 0 AS flush, NULL::VARCHAR AS chunk FROM w
UNION ALL SELECT answer_id, t, i + 1, CASE WHEN full_ THEN '' ELSE text END, flush + full_::INT, CASE WHEN full_ THEN text END FROM (SELECT *, held || t[i + 1] AS text, length(held || t[i + 1]) >= 10 OR i + 1 = len(t) AS full_ FROM r WHERE i < len(t)))
SELECT answer_id, (flush - 1)::INT AS flush, chunk FROM r WHERE chunk IS NOT NULL""")
def r3s(spark, sf_dir):
    """Tokens of all turns in three micro-batches, those of every third place coming last."""
    folder = scratch(spark)
    words = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select((F.col("conv_id") * 10000 + F.col("turn")).alias("answer_id"), X.tokens(F.col("text")).alias("t"))
    tokens = words.select("answer_id", F.size("t").alias("n"), F.posexplode("t").alias("pos", "token")).select("answer_id", "pos", "token", (F.col("pos") == F.col("n") - 1).alias("last"))
    for part in ("pos % 3 = 0 AND pos < 60", "pos % 3 = 1 AND pos < 60", "pos % 3 = 2 OR pos >= 60"):
        tokens.where(part).write.mode("append").parquet(f"{folder}/in")
    files = len(spark.read.parquet(f"{folder}/in").inputFiles())  # their names only; older ones are read first
    answers.follow_tokens(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", files_a_batch=-(-files // 3)).awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("r6_completion_order", "SELECT event_id, (row_number() OVER (PARTITION BY event_type ORDER BY event_id))::INT AS nth FROM events")
def r6(spark, sf_dir):
    return updates.first_answers(table(spark, sf_dir, "events"), "event_type", "event_id").select("event_id", "nth")


@query("r3_token_buffer")
def r3(spark, sf_dir):
    tokens = docs(spark, sf_dir).select(F.col("doc_id").alias("answer_id"), F.posexplode(X.tokens(F.col("text"))).alias("pos", "token"))
    return updates.buffered(tokens)


@query("r4_stream_citations", r"""SELECT conv_id, turn, mark FROM (SELECT conv_id, turn, unnest(list_distinct(list_transform(regexp_extract_all(text || ' [2] [' || turn || ']', '\[(\d{1,9})\]', 1), lambda x: x::INT))) AS mark FROM conversations) WHERE mark BETWEEN 1 AND 4""")
def r4(spark, sf_dir):
    answer = F.concat("text", F.lit(" [2] ["), F.col("turn").cast("string"), F.lit("]"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(X.citation_marks(answer, F.lit(4))).alias("mark"))


@query("windowed_usage", "SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, event_type, count(*) AS n, round(sum(value), 4)::DOUBLE AS total FROM events GROUP BY 1, 2")
def windowed(spark, sf_dir):
    return updates.windowed_usage(table(spark, sf_dir, "events"))


@query("windowed_usage_stream", "SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, event_type, count(*) AS n, round(sum(value), 4)::DOUBLE AS total FROM events GROUP BY 1, 2")
def windowed_stream(spark, sf_dir):
    folder = scratch(spark)
    events = table(spark, sf_dir, "events")
    events.orderBy("ts").coalesce(1).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
    name = f"w_{uuid.uuid4().hex}"
    updates.windowed_usage(stream).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)
