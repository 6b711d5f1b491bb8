"""Keywords, vector and keyword search, and fusion over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions.text import word_set
from lumenfold.operators import fusion, keywords, lexical, vectors
from lumenfold.plans.catalog import query, table

_STOPS = "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in keywords.STOP_WORDS) + ")"
DOCUMENTS = "SELECT * FROM documents"
PHRASES = rf"""WITH p AS (SELECT doc_id, list_transform(string_split_regex(lower(text), '[.!?,;:\n\t()\[\]{{}}"'']+'), lambda s: list_concat(regexp_extract_all(s, '[\p{{L}}\p{{N}}_\-]+'), [''])) AS parts FROM ({DOCUMENTS})),
w AS (SELECT doc_id, unnest(flatten(parts)) AS word, generate_subscripts(flatten(parts), 1) - 1 AS at_ FROM p),
e AS (SELECT *, word = '' OR word IN {_STOPS} OR regexp_matches(word, '^\d+$') AS ends FROM w),
r AS (SELECT *, sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY at_) AS run FROM e),
phrases AS (SELECT doc_id, run::INT AS pos, string_agg(word, ' ' ORDER BY at_) AS phrase, count(*)::INT AS n_words FROM r WHERE NOT ends
            GROUP BY doc_id, run HAVING count(*) <= 4 AND length(string_agg(word, ' ' ORDER BY at_)) >= 2)"""


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("t12_rake_candidates", PHRASES + "SELECT * FROM phrases")
def t12(spark, sf_dir):
    return keywords.candidates(documents(spark, sf_dir))


WORD_SCORES = PHRASES + """, words AS (SELECT doc_id, unnest(string_split(phrase, ' ')) AS word, n_words - 1 AS others FROM phrases),
scores AS (SELECT doc_id, word, count(*) AS freq, sum(others)::BIGINT AS degree, (sum(others) + count(*)) / count(*) AS score FROM words GROUP BY doc_id, word)"""


@query("t13_rake_words", WORD_SCORES + "SELECT doc_id, word, freq, degree, round(score, 6)::DOUBLE AS score FROM scores")
def t13(spark, sf_dir):
    return keywords.word_scores(keywords.candidates(documents(spark, sf_dir))).withColumn("score", F.round("score", 6))


@query("t14_rake_top", WORD_SCORES + """, d AS (SELECT DISTINCT doc_id, phrase FROM phrases), x AS (SELECT doc_id, phrase, unnest(string_split(phrase, ' ')) AS word FROM d),
s AS (SELECT x.doc_id, phrase, round(sum(score), 6)::DOUBLE AS score FROM x JOIN scores USING (doc_id, word) GROUP BY x.doc_id, phrase)
SELECT doc_id, phrase, score, (row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, phrase))::INT AS rank FROM s QUALIFY rank <= 10""")
def t14(spark, sf_dir):
    return keywords.rake(documents(spark, sf_dir))


@query("t15_tf_idf", rf"""WITH l AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 2 AND w NOT IN {_STOPS}) AS w FROM ({DOCUMENTS})),
g AS (SELECT doc_id, unnest(w) AS term FROM l UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM l
      UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM l),
tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY doc_id, term), n AS (SELECT count(*) AS total FROM ({DOCUMENTS})), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT doc_id, term, tf * (ln((1 + total) / (1 + df)) + 1) AS weight FROM tf JOIN df USING (term), n WHERE df <= 0.95 * total),
s AS (SELECT doc_id, term, round(weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)), 6)::DOUBLE AS score FROM w)
SELECT doc_id, term, score, (row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term))::INT AS rank FROM s WHERE score > 0 QUALIFY rank <= 10""")
def t15(spark, sf_dir):
    return keywords.tf_idf(documents(spark, sf_dir))


@query("t16_noun_phrases", PHRASES + "SELECT doc_id, phrase, min(pos) AS pos FROM phrases WHERE length(phrase) >= 3 GROUP BY doc_id, phrase")
def t16(spark, sf_dir):
    return keywords.phrases_of_units(documents(spark, sf_dir))


@query("t19_frequent_words", rf"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS word FROM ({DOCUMENTS})),
c AS (SELECT doc_id, word, count(*) AS n FROM w WHERE length(word) >= 3 AND word NOT IN {_STOPS} GROUP BY doc_id, word)
SELECT doc_id, word, n, (row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word))::INT AS rank FROM c QUALIFY rank <= 10""")
def t19(spark, sf_dir):
    return keywords.frequent_words(documents(spark, sf_dir))


def embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def query_vector(spark, sf_dir, vec_id: int = 0) -> list[float]:
    return list(embeddings(spark, sf_dir).where(F.col("vec_id") == vec_id).first()["embedding"])


E = "list_transform(e.embedding, lambda x: x::DOUBLE)"
Q = "list_transform(q.embedding, lambda x: x::DOUBLE)"
COSINES = f"c AS (SELECT e.vec_id, e.label, round(list_cosine_similarity({E}, {Q}), 6)::DOUBLE AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0)"


@query("v1_cosine_topk", f"WITH {COSINES} SELECT vec_id, score FROM c ORDER BY score DESC, vec_id LIMIT 10")
def v1(spark, sf_dir):
    return vectors.cosine_top_k(embeddings(spark, sf_dir), query_vector(spark, sf_dir))


@query("v2_cosine_threshold_first", f"WITH {COSINES} SELECT vec_id, score FROM c WHERE score >= 0.3 ORDER BY score DESC, vec_id LIMIT 50")
def v2(spark, sf_dir):
    return vectors.cosine_top_k(embeddings(spark, sf_dir), query_vector(spark, sf_dir), 50, 0.3, True)


@query("f3_threshold_after", f"WITH {COSINES}, k AS (SELECT vec_id, score FROM c ORDER BY score DESC, vec_id LIMIT 10) SELECT * FROM k WHERE score >= 0.35")
def f3(spark, sf_dir):
    return vectors.cosine_top_k(embeddings(spark, sf_dir), query_vector(spark, sf_dir), 10, 0.35)


@query("v3_l2_topk", f"SELECT e.vec_id, round(list_sum(list_transform(list_zip({E}, {Q}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6)::DOUBLE AS distance, round(1 - distance, 6)::DOUBLE AS similarity FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY distance, e.vec_id LIMIT 10")
def v3(spark, sf_dir):
    return vectors.l2_top_k(embeddings(spark, sf_dir), query_vector(spark, sf_dir))


@query("v4_batch_topk", f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity({E}, {Q}), 6)::DOUBLE AS score FROM embeddings e, embeddings q WHERE q.vec_id < 16)
SELECT query_id, vec_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s QUALIFY rank <= 10""")
def v4(spark, sf_dir):
    asked = embeddings(spark, sf_dir).where("vec_id < 16").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.batch_top_k(embeddings(spark, sf_dir), asked)


@query("f1_metadata_filter", f"WITH {COSINES} SELECT vec_id, score FROM c WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 10")
def f1(spark, sf_dir):
    tagged = embeddings(spark, sf_dir).withColumn("section_type", F.col("label").cast("string")).withColumn("metadata", F.create_map(F.lit("kind"), F.when(F.col("label") == 3, "x")))
    return vectors.cosine_top_k(vectors.metadata_filter(tagged, {"section_type": "3"}, {"kind": "x"}), query_vector(spark, sf_dir))


@query("f2_where", f"WITH {COSINES} SELECT vec_id, score FROM c WHERE label IN (1, 2) AND vec_id % 2 = 1 ORDER BY score DESC, vec_id LIMIT 10")
def f2(spark, sf_dir):
    return vectors.cosine_top_k(embeddings(spark, sf_dir).where("label IN (1, 2) AND vec_id % 2 = 1"), query_vector(spark, sf_dir))


ASKED = "the reason of that heating"
QWORDS = "['the', 'reason', 'of', 'that', 'heating']"
DWORDS = r"list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))"
OVERLAP = f"len(list_intersect({QWORDS}, {DWORDS}))::DOUBLE / 5"


@query("v5_keyword_overlap", f"SELECT doc_id, round({OVERLAP}, 6)::DOUBLE AS score FROM documents")
def v5(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(lexical.overlap(ASKED, F.col("text")), 6).alias("score"))


@query("v6_hybrid_expression", f"""WITH {COSINES} SELECT c.vec_id, round(0.5 * c.score + 0.5 * {OVERLAP}, 6)::DOUBLE AS score FROM c JOIN documents d ON d.doc_id = c.vec_id ORDER BY score DESC, c.vec_id LIMIT 10""")
def v6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), lexical.overlap(ASKED, F.col("text")).alias("w"))
    scored = embeddings(spark, sf_dir).select("vec_id", F.round(vectors.cosine(vectors.doubles("embedding"), vectors.literal(query_vector(spark, sf_dir))), 6).alias("v"))
    mixed = scored.join(docs, "vec_id").select("vec_id", F.round(0.5 * F.col("v") + 0.5 * F.col("w"), 6).alias("score"))
    return mixed.orderBy(F.desc("score"), "vec_id").limit(10)


BM25 = rf"""t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM documents),
tf AS (SELECT doc_id, len(w) AS n, term, len(list_filter(w, lambda x: x = term)) AS tf FROM t, unnest({QWORDS}) q(term)),
st AS (SELECT count(*) AS total, avg(len(w)) AS mean FROM t), df AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY term),
b AS (SELECT doc_id AS id, round(sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6)::DOUBLE AS score FROM tf JOIN df USING (term), st WHERE tf > 0 GROUP BY doc_id)"""


@query("v8_bm25", f"WITH {BM25} SELECT id AS doc_id, score FROM b ORDER BY score DESC, doc_id LIMIT 10")
def v8(spark, sf_dir):
    return lexical.bm25(table(spark, sf_dir, "documents"), ASKED)


@query("v7_hybrid_union", f"""WITH {COSINES}, {BM25}, v AS (SELECT vec_id AS id, score FROM c ORDER BY score DESC, vec_id LIMIT 20), k AS (SELECT id, score FROM b ORDER BY score DESC, id LIMIT 20)
SELECT coalesce(v.id, k.id) AS doc_id, round(0.5 * coalesce(v.score, 0) + 0.5 * coalesce(k.score, 0), 6)::DOUBLE AS score FROM v FULL JOIN k ON v.id = k.id ORDER BY score DESC, doc_id LIMIT 10""")
def v7(spark, sf_dir):
    near = vectors.cosine_top_k(embeddings(spark, sf_dir), query_vector(spark, sf_dir), 20).withColumnRenamed("vec_id", "doc_id")
    return vectors.hybrid(near, lexical.bm25(table(spark, sf_dir, "documents"), ASKED, 20))


@query("v9_multi_query", f"""WITH s AS (SELECT q.vec_id AS q, e.vec_id, round(list_cosine_similarity({E}, {Q}), 6)::DOUBLE AS score FROM embeddings e, embeddings q WHERE q.vec_id IN (0, 1, 2)),
r AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) <= 10)
SELECT vec_id, max(score) AS score FROM r GROUP BY vec_id ORDER BY score DESC, vec_id LIMIT 10""")
def v9(spark, sf_dir):
    asked = embeddings(spark, sf_dir).where("vec_id IN (0, 1, 2)").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.best_of(vectors.batch_top_k(embeddings(spark, sf_dir), asked))


@query("v10_index_stats", "SELECT count(*) AS n, count(DISTINCT label) AS n_labels, max(len(embedding))::INT AS dimensions FROM embeddings")
def v10(spark, sf_dir):
    return embeddings(spark, sf_dir).agg(F.count("*").alias("n"), F.count_distinct("label").alias("n_labels"), F.max(F.size("embedding")).alias("dimensions"))


@query("v12_community_by_vector", f"""WITH m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) r(i) GROUP BY label, i), q AS (SELECT i, embedding[i]::DOUBLE AS y FROM embeddings, range(1, 65) r(i) WHERE vec_id = 0)
SELECT label, round(sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 6)::DOUBLE AS score FROM m JOIN q USING (i) GROUP BY label ORDER BY score DESC, label LIMIT 3""")
def v12(spark, sf_dir):
    parts = embeddings(spark, sf_dir).select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centres = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding"))
    return vectors.cosine_top_k(centres, query_vector(spark, sf_dir), 3, key="label")


@query("f4_substring_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'an') OR contains(lower(p_type), 'an') ORDER BY p_partkey LIMIT 10")
def f4(spark, sf_dir):
    return lexical.substring_search(table(spark, sf_dir, "part"), "AN", ["p_name", "p_type"], 10, "p_partkey").select("p_partkey", "p_name")


@query("f5_pattern_search", "SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE contains(lower(s_name), '7') OR contains(lower(n_name), '7') OR contains(lower(n_name), 'ia')")
def f5(spark, sf_dir):
    named = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return named.where(lexical.any_contains(F.array("s_name", "n_name"), "7") | lexical.any_contains(F.array("n_name"), "IA")).select("s_suppkey")


# fusion: the vector list against documents of the same number, and the keyword list
LISTS = f"""WITH {COSINES}, {BM25}, v AS (SELECT 'vector' AS method, vec_id AS id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM c QUALIFY rank <= 40),
k AS (SELECT 'keyword' AS method, id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM b QUALIFY rank <= 40),
z AS (SELECT 'lazy' AS method, doc_id AS id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT doc_id, round({OVERLAP}, 6) AS score FROM documents) QUALIFY rank <= 40),
lists AS (SELECT * FROM v UNION ALL SELECT * FROM k UNION ALL SELECT * FROM z)"""


def lists(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    near = vectors.cosine_top_k(embeddings(spark, sf_dir), query_vector(spark, sf_dir), 40).select(F.lit("vector").alias("method"), F.col("vec_id").alias("id"), "score")
    worded = lexical.bm25(docs, ASKED, 40).select(F.lit("keyword").alias("method"), F.col("doc_id").alias("id"), "score")
    shared = docs.select(F.lit("lazy").alias("method"), F.col("doc_id").alias("id"), F.round(lexical.overlap(ASKED, F.col("text")), 6).alias("score")).orderBy(F.desc("score"), "id").limit(40)
    return lexical.ranked(near.unionByName(worded).unionByName(shared))


def _fused(score: str, sources: str = "count(*)") -> str:
    return f"{LISTS} SELECT id, round({score}, 6)::DOUBLE AS score, {sources} AS n_sources FROM lists GROUP BY id ORDER BY score DESC, id LIMIT 10"


@query("w1_ranks", f"{LISTS} SELECT method, id, score::DOUBLE AS score, rank::INT AS rank FROM lists")
def w1(spark, sf_dir):
    return lists(spark, sf_dir)


@query("u1_rrf", _fused("sum(1.0 / (60 + rank))"))
def u1(spark, sf_dir):
    return fusion.fuse(lists(spark, sf_dir))


@query("u1_rrf_search", _fused("sum(1.0 / (60 + rank))", "count(DISTINCT method)"))
def u1s(spark, sf_dir):
    return fusion.fuse(lists(spark, sf_dir), dialect="search")


@query("u2_weighted", _fused("sum(score * 0.5)"))
def u2(spark, sf_dir):
    return fusion.fuse(lists(spark, sf_dir), "weighted")


@query("u2_weighted_search", LISTS + """, tt AS (SELECT *, score / (CASE WHEN max(score) OVER (PARTITION BY method) = 0 THEN 1 ELSE max(score) OVER (PARTITION BY method) END) * (CASE method WHEN 'keyword' THEN 0.3 ELSE 0.5 END) AS s FROM lists)
SELECT id, round(sum(s), 6)::DOUBLE AS score, count(DISTINCT method) AS n_sources FROM tt GROUP BY id ORDER BY score DESC, id LIMIT 10""")
def u2s(spark, sf_dir):
    return fusion.fuse(lists(spark, sf_dir), "weighted", "search")


@query("u3_max", _fused("greatest(max(score), 0)"))
def u3(spark, sf_dir):
    return fusion.fuse(lists(spark, sf_dir), "max")


@query("u4_comb_sum", _fused("sum(score)"))
def u4(spark, sf_dir):
    return fusion.fuse(lists(spark, sf_dir), "comb_sum")


@query("u5_comb_mnz", _fused("sum(score) * count(*)"))
def u5(spark, sf_dir):
    return fusion.fuse(lists(spark, sf_dir), "comb_mnz")


KEYED = LISTS + ", keyed AS (SELECT l.*, md5(substr(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), 1, 200)) AS key FROM lists l JOIN documents d ON d.doc_id = l.id)"


def keyed(spark, sf_dir):
    from lumenfold.functions.text import content_key

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), content_key(F.col("text")).alias("key"))
    return lists(spark, sf_dir).join(docs, "id")


@query("u6_controller_rrf", KEYED + "SELECT key, round(sum(1.0 / (60 + rank)), 6)::DOUBLE AS score, min(rank)::INT AS best_rank, max(score)::DOUBLE AS best_score, string_agg(method, ',' ORDER BY method) AS engines FROM keyed GROUP BY key")
def u6(spark, sf_dir):
    return fusion.controller_rrf(keyed(spark, sf_dir))


@query("u7_controller_score", KEYED + "SELECT key, max(score)::DOUBLE AS score FROM keyed GROUP BY key")
def u7(spark, sf_dir):
    return fusion.controller_score(keyed(spark, sf_dir)).select("key", "score")


@query("u8_controller_weighted", KEYED + "SELECT key, round(sum(coalesce(nullif(score, 0), 1.0 / rank) * CASE method WHEN 'vector' THEN 2.0 ELSE 1.0 END), 6)::DOUBLE AS score FROM keyed GROUP BY key")
def u8(spark, sf_dir):
    return fusion.controller_weighted(keyed(spark, sf_dir), {"vector": 2.0})


@query("u9_interleave", KEYED + """, tt AS (SELECT *, CASE method WHEN 'vector' THEN 1 WHEN 'lazy' THEN 2 ELSE 3 END AS turn FROM keyed), o AS (SELECT * FROM tt QUALIFY row_number() OVER (PARTITION BY key ORDER BY rank, turn) = 1)
SELECT key, id, (row_number() OVER (ORDER BY rank, turn))::INT AS position FROM o QUALIFY position <= 100""")
def u9(spark, sf_dir):
    return fusion.interleave(keyed(spark, sf_dir), ["vector", "lazy", "keyword"]).select("key", "id", "position")


@query("u10_level_priority", LISTS + """, tt AS (SELECT *, CASE method WHEN 'vector' THEN 0 WHEN 'lazy' THEN 1 ELSE 2 END AS level FROM lists)
SELECT id, level::INT AS level, score::DOUBLE AS score FROM tt QUALIFY row_number() OVER (PARTITION BY id ORDER BY level DESC, score DESC, method) = 1""")
def u10(spark, sf_dir):
    level = F.when(F.col("method") == "vector", 0).when(F.col("method") == "lazy", 1).otherwise(2)
    return fusion.level_priority(lists(spark, sf_dir).withColumn("level", level), "id").select("id", "level", "score")


@query("u11_stream_merge", LISTS + "SELECT id, max(score)::DOUBLE AS score FROM lists GROUP BY id ORDER BY score DESC, id LIMIT 10")
def u11(spark, sf_dir):
    return fusion.stream_merge(lists(spark, sf_dir))


@query("a21_page", "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 100 OFFSET 150")
def a21(spark, sf_dir):
    return lexical.page(table(spark, sf_dir, "customer"), [F.desc("c_acctbal"), "c_custkey"], 500, 150).select("c_custkey", "c_name")


@query("f11_array_overlap", r"""SELECT doc_id FROM documents WHERE len(list_intersect(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ['idiot', 'avec', 'und'])) > 0""")
def f11(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.arrays_overlap(word_set(F.col("text")), F.array(F.lit("idiot"), F.lit("avec"), F.lit("und")))).select("doc_id")
