"""Text functions and chunking over the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import text as X
from lumenfold.operators import chunking
from lumenfold.plans.catalog import query, table

STRIP = lambda s: f"regexp_replace({s}, '^\\s+|\\s+$', '', 'g')"
WORDS = "list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> '')"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("t1_whitespace", f"""SELECT doc_id, md5(t) AS digest, length(t)::INT AS n FROM (SELECT doc_id,
    {STRIP("regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")} AS t FROM documents)""")
def t1(spark, sf_dir):
    clean = docs(spark, sf_dir).select("doc_id", X.normalise_whitespace(F.col("text")).alias("t"))
    return clean.select("doc_id", F.md5("t").alias("digest"), F.length("t").alias("n"))


def _chunks_sql(size: int, overlap: int) -> str:
    return f"""WITH w AS (SELECT doc_id, {WORDS} AS words FROM documents),
s AS (SELECT doc_id, words, unnest(list_filter(range(0, len(words), {size - overlap}), lambda k: k = 0 OR k + {overlap} < len(words))) AS start FROM w)
SELECT doc_id, doc_id || '_' || (start // {size - overlap}) AS chunk_id, (start // {size - overlap})::INT AS chunk_index,
       len(words[start + 1 : start + {size}])::INT AS n_tokens, start::INT AS start_token,
       array_to_string(words[start + 1 : start + {size}], ' ') AS chunk FROM s"""


@query("t2_token_chunks", _chunks_sql(300, 100))
def t2(spark, sf_dir):
    return chunking.token_chunks(docs(spark, sf_dir))


@query("t3_char_chunks", """WITH s AS (SELECT doc_id, text, unnest(CASE WHEN length(text) <= 1200 THEN [0] ELSE range(0, length(text), 1100) END) AS start FROM documents)
SELECT doc_id, (start // 1100)::INT AS chunk_index, start::INT AS start_char, substr(text, start + 1, 1200) AS chunk FROM s""")
def t3(spark, sf_dir):
    return chunking.char_chunks(docs(spark, sf_dir))


@query("t4_token_batches", _chunks_sql(500, 0))
def t4(spark, sf_dir):
    return chunking.token_chunks(docs(spark, sf_dir), 500, 0)


@query("t5_token_count", r"""SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]'))::INT AS n_tokens FROM documents""")
def t5(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.token_count(X.text("text")).alias("n_tokens"))


@query("t6_estimated_tokens", "SELECT doc_id, floor(length(text) * 0.25)::BIGINT AS n_tokens FROM documents")
def t6(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.estimated_tokens(F.col("text")).alias("n_tokens"))


@query("t7_estimated_chunks", """SELECT doc_id, CASE WHEN n_chars <= 1200 THEN 1 ELSE greatest(1, (n_chars - 100) // 1100 + 1) END::BIGINT AS n_chunks FROM documents""")
def t7(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.estimated_chunks(F.col("n_chars"), 1200, 100).alias("n_chunks"))


@query("t8_document_id", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'doi_10.1234_doc' || doc_id WHEN 1 THEN 'arxiv_2401.' || doc_id
    ELSE 'doc_' || substr(sha256(source || '_' || substr(text, 1, 40)), 1, 12) END AS document_id FROM documents""")
def t8(spark, sf_dir):
    key = F.col("doc_id").cast("string")
    doi = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("10.1234/doc"), key))
    arxiv = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("2401."), key))
    return docs(spark, sf_dir).select("doc_id", X.document_id(doi, arxiv, F.col("source"), F.substring("text", 1, 40)).alias("document_id"))


@query("t9_content_hash", "SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents")
def t9(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.content_hash(F.col("text")).alias("hash"))


@query("t10_document_hash", "SELECT doc_id, substr(sha256(coalesce(source, '') || chr(10) || coalesce(substr(text, 1, 200), '')), 1, 16) AS hash FROM documents")
def t10(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.document_hash(F.col("source"), F.substring("text", 1, 200)).alias("hash"))


SENTENCES = r"""SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g'),
    '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS parts, text FROM documents"""


@query("t11_sentences", f"""WITH s AS ({SENTENCES}), e AS (SELECT doc_id, CASE WHEN len(parts) > 0 THEN parts ELSE [text] END AS parts FROM s)
SELECT doc_id, unnest(parts) AS sentence, generate_subscripts(parts, 1)::INT - 1 AS pos FROM e""")
def t11(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence"))


@query("t17_academic_terms", f"""WITH t AS (SELECT unnest({list(X.ACADEMIC_TERMS)!r}) AS term),
d AS (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' A Transformer with self-attention' WHEN 1 THEN ' deep learning of a Knowledge Graph' ELSE '' END AS body FROM documents)
SELECT doc_id, term FROM d JOIN t ON contains(lower(body), term)""")
def t17(spark, sf_dir):
    tail = F.when(F.col("doc_id") % 4 == 0, " A Transformer with self-attention").when(F.col("doc_id") % 4 == 1, " deep learning of a Knowledge Graph").otherwise("")
    return docs(spark, sf_dir).select("doc_id", F.explode(X.academic_terms(F.concat("text", tail))).alias("term"))


@query("t18_method_names", r"""WITH d AS (SELECT doc_id, regexp_replace(text || ' GraphNet uses BERT-2 and LazyRank over CNN ' || upper(source), '[^\x00-\x7F]', '_', 'g') AS body FROM documents),
n AS (SELECT doc_id, unnest(list_distinct(list_concat(regexp_extract_all(body, '\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b', 1), regexp_extract_all(body, '\b([A-Z]{2,}(?:-[A-Z0-9]+)*)\b', 1)))) AS name FROM d)
SELECT doc_id, name FROM n""")
def t18(spark, sf_dir):
    body = F.concat(F.col("text"), F.lit(" GraphNet uses BERT-2 and LazyRank over CNN "), F.upper("source"))
    return docs(spark, sf_dir).select("doc_id", F.explode(X.method_names(body)).alias("name"))


@query("t20_title", r"""SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' -- ' || p_type || '!'), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS title FROM part""")
def t20(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.normalise_title(F.concat_ws("", "p_name", F.lit(" -- "), "p_type", F.lit("!"))).alias("title"))


REFERENCES_SQL = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'See 10.1234/doc' || (doc_id + 1) || '). for details' WHEN 1 THEN 'A. Author, "Title of ' || (doc_id + 3) || '", 2019.'
    WHEN 2 THEN 'Text of document ' || (doc_id + 5) || '. Some Journal (2001). arXiv:1234.56789v2' ELSE 'unmatched' END AS reference FROM documents"""


def references(spark, sf_dir):
    """A made-up reference line for each document."""
    key = lambda k: (F.col("doc_id") + k).cast("string")
    line = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("See 10.1234/doc"), key(1), F.lit("). for details")))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit('A. Author, "Title of '), key(3), F.lit('", 2019.')))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("Text of document "), key(5), F.lit(". Some Journal (2001). arXiv:1234.56789v2")))
        .otherwise("unmatched")
    )
    return docs(spark, sf_dir).select("doc_id", line.alias("reference"))


@query("t21_title_guess", rf"""SELECT doc_id, CASE WHEN regexp_extract(reference, '"([^"]+)"', 1) <> '' THEN regexp_extract(reference, '"([^"]+)"', 1)
    WHEN length(trim(regexp_extract(reference, '^([^.]*)\.', 1))) > 10 THEN trim(regexp_extract(reference, '^([^.]*)\.', 1)) END AS title FROM ({REFERENCES_SQL})""")
def t21(spark, sf_dir):
    return references(spark, sf_dir).select("doc_id", X.title_guess(F.col("reference")).alias("title"))


@query("t22_reference_doi", rf"""SELECT doc_id, nullif(regexp_replace(regexp_extract(reference, '(10\.\d{{4,}}/\S+)', 1), '[.,;:)]+$', ''), '') AS doi FROM ({REFERENCES_SQL})""")
def t22(spark, sf_dir):
    return references(spark, sf_dir).select("doc_id", X.reference_doi(F.col("reference")).alias("doi"))


@query("t23_external_key", f"SELECT doc_id, 'ext_' || substr(md5(reference), 1, 8) AS key FROM ({REFERENCES_SQL})")
def t23(spark, sf_dir):
    return references(spark, sf_dir).select("doc_id", X.external_key(F.col("reference")).alias("key"))


@query("t24_entity_name", r"""SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(lower('  ' || c_name || '  (' || c_mktsegment || ') '), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '[^\p{L}\p{N}_\s\-]', '', 'g') AS name FROM customer""")
def t24(spark, sf_dir):
    raw = F.concat(F.lit("  "), "c_name", F.lit("  ("), "c_mktsegment", F.lit(") "))
    return table(spark, sf_dir, "customer").select("c_custkey", X.normalise_entity(raw).alias("name"))


@query("t25_content_key", f"SELECT doc_id, md5(substr(lower({STRIP('text')}), 1, 200)) AS key FROM documents")
def t25(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.content_key(F.col("text")).alias("key"))


@query("t26_cache_key", """WITH k AS (SELECT doc_id, concat_ws(':', 'search', 'k=' || doc_id, 'lang=' || lang, CASE WHEN doc_id % 2 = 0 THEN 'text=' || substr(text, 1, 300) END) AS k FROM documents)
SELECT doc_id, CASE WHEN length(k) > 200 THEN 'search:' || substr(md5(k), 1, 16) ELSE k END AS key FROM k""")
def t26(spark, sf_dir):
    key = X.cache_key("search", k=F.col("doc_id"), lang=F.col("lang"), text=F.when(F.col("doc_id") % 2 == 0, F.substring("text", 1, 300)))
    return docs(spark, sf_dir).select("doc_id", key.alias("key"))


ANSWERS_SQL = "SELECT doc_id, 'As shown [' || (doc_id % 7) || '] and [2], again [2] and [' || (doc_id % 12) || ']' AS answer, (doc_id % 5 + 1)::INT AS sources FROM documents"


def answers(spark, sf_dir):
    line = F.concat(F.lit("As shown ["), (F.col("doc_id") % 7).cast("string"), F.lit("] and [2], again [2] and ["), (F.col("doc_id") % 12).cast("string"), F.lit("]"))
    return docs(spark, sf_dir).select("doc_id", line.alias("answer"), (F.col("doc_id") % 5 + 1).cast("int").alias("sources"))


@query("t27_citation_marks", rf"""WITH a AS ({ANSWERS_SQL}), m AS (SELECT doc_id, sources, unnest(list_distinct(list_transform(regexp_extract_all(answer, '\[(\d{{1,9}})\]', 1), lambda x: x::INT))) AS mark FROM a)
SELECT doc_id, mark FROM m WHERE mark BETWEEN 1 AND sources""")
def t27(spark, sf_dir):
    return answers(spark, sf_dir).select("doc_id", F.explode(X.citation_marks(F.col("answer"), F.col("sources"))).alias("mark"))


@query("t28_confidence", rf"""WITH a AS ({ANSWERS_SQL}), m AS (SELECT doc_id, sources, list_filter(list_distinct(list_transform(regexp_extract_all(answer, '\[(\d{{1,9}})\]', 1), lambda x: x::INT)), lambda x: x BETWEEN 1 AND sources) AS marks FROM a)
SELECT doc_id, CASE WHEN len(marks) = 0 THEN 0.0 ELSE round(least(1.0, list_sum(list_transform(marks, lambda x: 1.0 / x)) / len(marks) * (0.5 + 0.5 * least(len(marks)::DOUBLE / sources, 1.0))), 6) END::DOUBLE AS confidence FROM m""")
def t28(spark, sf_dir):
    scores = F.transform(X.citation_marks(F.col("answer"), F.col("sources")), lambda m: 1.0 / m)
    return answers(spark, sf_dir).select("doc_id", F.round(X.answer_confidence(scores, F.col("sources")), 6).alias("confidence"))


@query("t29_claim_lines", r"""WITH d AS (SELECT conv_id, turn, '- ' || replace(text, ' ', chr(10) || '* ') || chr(10) || 'no item' || chr(10) || '・abc' AS body FROM conversations),
c AS (SELECT conv_id, turn, list_filter(list_transform(list_filter(list_transform(string_split(body, chr(10)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: regexp_matches(s, '^(- |・|\* )')),
    lambda s: regexp_replace(regexp_replace(s, '^(- |・|\* )', ''), '^\s+|\s+$', '', 'g')), lambda s: length(s) >= 5)[1:5] AS claims FROM d)
SELECT conv_id, turn, unnest(claims) AS claim, generate_subscripts(claims, 1)::INT - 1 AS pos FROM c""")
def t29(spark, sf_dir):
    body = F.concat(F.lit("- "), F.replace("text", F.lit(" "), F.lit("\n* ")), F.lit("\nno item\n・abc"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(X.claim_lines(body, 5)).alias("pos", "claim"))


@query("t30_json_fields", """SELECT event_id, (json_extract(props, '$.k'))::INT AS k, event_type AS kind FROM events""")
def t30(spark, sf_dir):
    said = F.concat(F.lit("Here it is:\n```json\n"), F.concat(F.lit('{"kind": "'), "event_type", F.lit('", "props": '), "props", F.lit("}")), F.lit("\n```"))
    parsed = F.from_json(X.braced_json(said), "kind string, props struct<k:int>")
    return table(spark, sf_dir, "events").select("event_id", parsed["props"]["k"].alias("k"), parsed["kind"].alias("kind"))


@query("t31_braced_json", """SELECT event_id, props AS found FROM events""")
def t31(spark, sf_dir):
    said = F.concat(F.lit("Answer: "), "props", F.lit(" as asked {}"))
    return table(spark, sf_dir, "events").select("event_id", X.braced_json(said, greedy=False).alias("found"))


@query("t32_truncated", "SELECT doc_id, CASE WHEN length(text) > 1000 THEN substr(text, 1, 1000) || '...' ELSE text END AS shown FROM documents")
def t32(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.truncated(F.col("text")).alias("shown"))


@query("t33_hashed_embedding", """SELECT doc_id, i::INT AS pos, round(('0x' || substr(md5(text), 2 * (i % 16)::INT + 1, 2))::INT / 255.0 - 0.5, 9)::DOUBLE AS value FROM documents, range(0, 40) r(i)""")
def t33(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(X.hashed_embedding(F.col("text"), 40)).alias("pos", "value")).withColumn("value", F.round("value", 9))


@query("t34_support_confidence", """SELECT source, count(*) AS n, CASE WHEN count(*) > 1 THEN least(1.0, count(*) * 0.2 + 0.5) ELSE 1.0 END::DOUBLE AS entity_confidence,
    CASE WHEN count(*) > 1 THEN least(1.0, count(*) * 0.15 + 0.5) ELSE 1.0 END::DOUBLE AS relation_weight FROM documents GROUP BY source""")
def t34(spark, sf_dir):
    grouped = docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))
    return grouped.select("source", "n", X.support_confidence(F.col("n"), F.lit(1.0)).alias("entity_confidence"), X.support_confidence(F.col("n"), F.lit(1.0), 0.15).alias("relation_weight"))


SUFFIXES = list(X.FORMATS) + [".PDF", ".zip"]


@query("s3_file_format", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/markdown' END AS format FROM documents")
def s3(spark, sf_dir):
    suffix = F.when(F.col("doc_id") % 3 == 0, ".PDF").when(F.col("doc_id") % 3 == 1, ".md").otherwise(".zip")
    return docs(spark, sf_dir).select("doc_id", X.file_format(F.concat(F.lit("/data.d/paper"), F.col("doc_id").cast("string"), suffix)).alias("format"))


HEADINGS = ["1. Introduction", "2.1 Background and Related Work", "3.1.4 Proposed Methodology", "Experiments", "Discussion", "Conclusion and Summary", "References", "提案手法", "Appendix", "ABSTRACT"]
_SECTION_CASE = " ".join(f"WHEN regexp_matches(lower(h), '{'|'.join(w)}') THEN '{k}'" for k, w in X.SECTION_WORDS.items())


@query("s6_section_class", f"SELECT doc_id, CASE {_SECTION_CASE} ELSE 'other' END AS section_type FROM (SELECT doc_id, ({HEADINGS!r})[(doc_id % 10 + 1)::INT] AS h FROM documents)")
def s6(spark, sf_dir):
    heading = F.element_at(F.array(*map(F.lit, HEADINGS)), (F.col("doc_id") % 10 + 1).cast("int"))
    return docs(spark, sf_dir).select("doc_id", X.section_class(heading).alias("section_type"))


@query("s12_identifiers", r"""SELECT doc_id, nullif(regexp_extract(b, '(10\.\d{4,}/[^\s\]>"'']+)', 1), '') AS doi, nullif(regexp_extract(b, '(?i)arXiv:(\d{4}\.\d{4,5}(v\d+)?)', 1), '') AS arxiv FROM
    (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN ' <https://doi.org/10.5678/x' || doc_id || '>' WHEN 1 THEN ' ARXIV:2401.0' || (1000 + doc_id % 1000) || 'v3.' ELSE '' END AS b FROM documents)""")
def s12(spark, sf_dir):
    key = F.col("doc_id")
    tail = F.when(key % 3 == 0, F.concat(F.lit(" <https://doi.org/10.5678/x"), key.cast("string"), F.lit(">"))).when(key % 3 == 1, F.concat(F.lit(" ARXIV:2401.0"), (1000 + key % 1000).cast("string"), F.lit("v3."))).otherwise("")
    body = F.concat("text", tail)
    return docs(spark, sf_dir).select("doc_id", X.doi(body).alias("doi"), X.arxiv_id(body).alias("arxiv"))


@query("s13_reference_entry", rf"""SELECT doc_id, substr(reference, 1, 200) AS title, nullif(regexp_extract(reference, '((?:19|20)\d{{2}})', 1), '')::INT AS year,
    nullif(regexp_extract(reference, '(10\.\d{{4,}}/[^\s\]>"'']+)', 1), '') AS doi, nullif(regexp_extract(reference, '(?i)arXiv:(\d{{4}}\.\d{{4,5}}(v\d+)?)', 1), '') AS arxiv FROM ({REFERENCES_SQL}) WHERE length(reference) >= 20""")
def s13(spark, sf_dir):
    return references(spark, sf_dir).select("doc_id", X.reference_entry(F.col("reference")).alias("e")).where("e IS NOT NULL").select("doc_id", "e.*")


@query("s14_author_names", r"""WITH a AS (SELECT conv_id, turn, string_split_regex('Ann Lee*, ' || substr(text, 1, 60) || ' and Bo' || (turn % 3) || ', C. D. Ek†', ',\s*|\s+and\s+') AS names FROM conversations),
n AS (SELECT conv_id, turn, list_filter(list_transform(list_filter(list_transform(names, lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')),
  lambda s: len(list_filter(string_split_regex(s, '\s+'), lambda w: w <> '')) BETWEEN 1 AND 5 AND NOT regexp_matches(s, '\d')),
  lambda s: regexp_replace(regexp_replace(s, '[*†‡§∗]+', '', 'g'), '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS names FROM a)
SELECT conv_id, turn, array_to_string(CASE WHEN len(names) > 20 THEN [] ELSE names END, '|') AS authors FROM n""")
def s14(spark, sf_dir):
    line = F.concat(F.lit("Ann Lee*, "), F.substring("text", 1, 60), F.lit(" and Bo"), (F.col("turn") % 3).cast("string"), F.lit(", C. D. Ek†"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(X.author_names(line), "|").alias("authors"))


@query("s15_heading_level", rf"""SELECT doc_id, CASE WHEN regexp_matches(h, '^\d+\.\d+\.\d+') THEN 3 WHEN regexp_matches(h, '^\d+\.\d+') THEN 2 ELSE 1 END AS level FROM (SELECT doc_id, ({HEADINGS!r})[(doc_id % 10 + 1)::INT] AS h FROM documents)""")
def s15(spark, sf_dir):
    heading = F.element_at(F.array(*map(F.lit, HEADINGS)), (F.col("doc_id") % 10 + 1).cast("int"))
    return docs(spark, sf_dir).select("doc_id", X.heading_level(heading).alias("level"))


@query("s16_batch_stats", f"""WITH c AS ({_chunks_sql(300, 100)}), p AS (SELECT doc_id, count(*) AS n, sum(n_tokens)::BIGINT AS t FROM c GROUP BY doc_id)
SELECT count(*) AS files, count(*) FILTER (WHERE n > 0) AS succeeded, count(*) FILTER (WHERE n IS NULL) AS failed, round(count(*) FILTER (WHERE n > 0)::DOUBLE / count(*), 6) AS success_rate,
       coalesce(sum(n), 0)::BIGINT AS units, coalesce(sum(t), 0)::BIGINT AS tokens, round(sum(n) / count(*) FILTER (WHERE n > 0), 6)::DOUBLE AS units_per_file FROM documents LEFT JOIN p USING (doc_id)""")
def s16(spark, sf_dir):
    chunks = chunking.token_chunks(docs(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"))
    per = docs(spark, sf_dir).select("doc_id").join(chunks, "doc_id", "left")
    good = F.count_if(F.col("n") > 0)
    return per.agg(
        F.count("*").alias("files"), good.alias("succeeded"), F.count_if(F.col("n").isNull()).alias("failed"), F.round(good / F.count("*"), 6).alias("success_rate"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("units"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"), F.round(F.sum("n") / good, 6).alias("units_per_file"),
    )
