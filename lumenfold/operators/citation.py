"""Citation networks: resolving references, co-citation, coupling, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import external_key, normalise_title, reference_doi, title_guess
from lumenfold.operators.fuzzy import most_similar
from lumenfold.storage import materialise

SIMILAR = 0.85


def doi_index(docs: DataFrame) -> DataFrame:
    """(doi, match): the last document of each lower-case DOI."""
    return docs.where("doi IS NOT NULL AND doi <> ''").groupBy(F.lower("doi").alias("doi")).agg(F.max("doc_id").alias("match"))


def title_index(docs: DataFrame) -> DataFrame:
    """(title, match): the last document of each normalised title."""
    return docs.select("doc_id", normalise_title(F.col("title")).alias("title")).where("title <> ''").groupBy("title").agg(F.max("doc_id").alias("match"))


def fuzzy_matches(wanted: DataFrame, docs: DataFrame, least: float = SIMILAR, measure: str = "levenshtein") -> DataFrame:
    """(ref_id, match, similarity): the most similar title at or above `least`; ties to the smaller document."""
    left = wanted.select("ref_id", "doc_id", normalise_title(F.col("title")).alias("a")).where("a <> ''")
    right = docs.select(F.col("doc_id").alias("match"), normalise_title(F.col("title")).alias("b")).where("b <> ''")
    return most_similar(left, right, least, measure)


def _looked_up(rows: DataFrame, index: DataFrame, key: str, name: str) -> DataFrame:
    """`rows` with the match of `index` as `name`, other than the row's own document; rows without a key take no part in
    the join, where they would all meet."""
    hit = rows.where(F.coalesce(key, F.lit("")) != "").join(index.withColumnRenamed("match", name), key, "left")
    hit = hit.withColumn(name, F.when(F.col(name) != F.col("doc_id"), F.col(name)))
    return hit.unionByName(rows.where(F.coalesce(key, F.lit("")) == "").withColumn(name, F.lit(None).cast(index.schema["match"].dataType)))


def resolve(references: DataFrame, docs: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(ref_id, doc_id, reference, match, status, confidence): by DOI, else title, else similar title, else external; a
    document never resolves to itself. (J9)"""
    asked = references.select("ref_id", "doc_id", "reference", F.lower(reference_doi(F.col("reference"))).alias("doi"), title_guess(F.col("reference")).alias("guess"))
    asked = asked.withColumn("title", normalise_title(F.coalesce("guess", F.lit(""))))
    out = _looked_up(_looked_up(asked, doi_index(docs), "doi", "m_doi"), title_index(docs), "title", "m_title")
    if fuzzy:
        out = materialise(out)
        open_ = out.where("m_doi IS NULL AND m_title IS NULL").select("ref_id", "doc_id", F.col("guess").alias("title"))
        out = out.join(fuzzy_matches(open_, docs).select("ref_id", F.col("match").alias("m_fuzzy"), "similarity"), "ref_id", "left")
    else:
        out = out.withColumn("m_fuzzy", F.lit(None).cast("long")).withColumn("similarity", F.lit(None).cast("double"))
    status = F.when(F.col("m_doi").isNotNull(), "matched_doi").when(F.col("m_title").isNotNull(), "matched_title").when(F.col("m_fuzzy").isNotNull(), "matched_fuzzy").otherwise("unresolved")
    confidence = F.when(F.col("m_doi").isNotNull() | F.col("m_title").isNotNull(), 1.0).otherwise(F.coalesce("similarity", F.lit(0.0)))
    return out.select("ref_id", "doc_id", "reference", F.coalesce("m_doi", "m_title", "m_fuzzy").alias("match"), status.alias("status"), confidence.alias("confidence"))


def citation_edges(resolved: DataFrame) -> DataFrame:
    """(src, dst, is_internal, confidence, status): of parallel edges the last reference's. Unresolved references point to
    an external node named by their hash. (G1)"""
    target = F.coalesce(F.concat(F.lit("doc_"), F.col("match").cast("string")), external_key(F.col("reference")))
    rows = resolved.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("src"), target.alias("dst"), F.struct("ref_id", F.col("match").isNotNull().alias("is_internal"), "confidence", "status").alias("last"))
    return rows.groupBy("src", "dst").agg(F.max_by("last", "last.ref_id").alias("last")).select("src", "dst", "last.is_internal", "last.confidence", "last.status")


def co_citation(edges: DataFrame, least: int = 2, doc=None) -> DataFrame:
    """(doc, other, shared, score): documents cited together, score by the first one's citers.

    A citing node with d references makes d**2 / 2 pairs, in its own row and in one order only, since both ways share the
    same; `doc` anchors a join on one document instead.
    """
    edges = edges.select("src", "dst").distinct()
    cited = edges.groupBy("dst").agg(F.count("*").alias("n")).withColumnRenamed("dst", "doc")
    if doc is None:
        listed = edges.where("src IS NOT NULL").groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("all"))
        placed = listed.select("all", F.posexplode("all").alias("place", "doc"))
        pairs = placed.select("doc", F.explode(F.slice("all", F.col("place") + 2, F.size("all"))).alias("other"))
    else:
        mine = edges.where(F.col("dst") == doc)
        pairs = mine.select("src", F.col("dst").alias("doc")).join(edges.select("src", F.col("dst").alias("other")), "src").where("doc <> other")
    counted = pairs.groupBy("doc", "other").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    if doc is None:
        way = F.explode(F.array(F.struct("doc", "other"), F.struct(F.col("other").alias("doc"), F.col("doc").alias("other")))).alias("way")
        counted = counted.select(way, "shared").select("way.*", "shared")
    return counted.join(cited, "doc").select("doc", "other", "shared", F.round(F.col("shared") / F.col("n"), 6).alias("score"))


def coupling(edges: DataFrame, least: int = 2, doc=None, internal: DataFrame | None = None) -> DataFrame:
    """(doc, other, shared, score): documents that cite the same ones, the other among `internal`."""
    edges = edges.select("src", "dst").distinct()
    mine = edges if doc is None else edges.where(F.col("src") == doc)
    others = edges if internal is None else edges.join(internal.select(F.col("node").alias("src")), "src", "left_semi")
    refs = edges.groupBy("src").agg(F.count("*").alias("n")).withColumnRenamed("src", "doc")
    pairs = mine.select("dst", F.col("src").alias("doc")).join(others.select("dst", F.col("src").alias("other")), "dst").where("doc <> other")
    counted = pairs.groupBy("doc", "other").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    return counted.join(refs, "doc").select("doc", "other", "shared", F.round(F.col("shared") / F.col("n"), 6).alias("score"))


def related(edges: DataFrame, doc, least: int = 2, k: int = 10) -> DataFrame:
    """(relation, other, score): co-cited and coupled documents of one document."""
    both = co_citation(edges, least, doc).select(F.lit("co_citation").alias("relation"), "other", "score").unionByName(coupling(edges, least, doc).select(F.lit("coupling").alias("relation"), "other", "score"))
    return both.orderBy(F.desc("score"), "relation", "other").limit(k)


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, citations, refs)."""
    into = edges.groupBy("dst").agg(F.count("*").alias("citations"))
    out = edges.groupBy("src").agg(F.count("*").alias("refs"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return nodes.join(into, F.col("node") == F.col("dst"), "left").join(out, F.col("node") == F.col("src"), "left").select("node", zero("citations"), zero("refs"))


def top_by(metrics: DataFrame, column: str, k: int = 10, key: str = "node") -> DataFrame:
    """(A8)"""
    return metrics.orderBy(F.desc(column), key).limit(k)
