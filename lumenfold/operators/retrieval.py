"""Local search (entities, relations, chunks) and global search (communities)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.text import estimated_tokens
from lumenfold.operators.lexical import contains_all
from lumenfold.storage import materialise

NO_INFORMATION = "no relevant information"


def seeds(entities: DataFrame, query: str, k: int = 10) -> DataFrame:
    """(entity_id, hop, score) of the first k entities whose name or description holds the query."""
    hit = contains_all(F.col("name"), query) | contains_all(F.col("description"), query)
    return entities.where(hit).select("entity_id").orderBy("entity_id").limit(k).select("entity_id", F.lit(0).alias("hop"), F.lit(1.0).alias("score"))


def traverse(entities: DataFrame, relations: DataFrame, query: str, hops: int = 2, k: int = 10, follow: bool = True) -> DataFrame:
    """(entity_id, hop, score): breadth-first from the seeds over relations in both directions; the first visit counts, and
    scores 1 / (hop + 1). (V14, J12)"""
    seen = materialise(seeds(entities, query, k))
    front = seen.select("entity_id")
    if not follow:
        return seen
    both = relations.select(F.col("source_id").alias("at"), F.col("target_id").alias("entity_id")).unionByName(relations.select(F.col("target_id").alias("at"), F.col("source_id").alias("entity_id")))
    known = entities.select("entity_id")
    for hop in range(1, hops + 1):
        if front.isEmpty():
            break
        step = both.join(front.withColumnRenamed("entity_id", "at"), "at", "left_semi").select("entity_id").distinct()
        front = materialise(step.join(known, "entity_id", "left_semi").join(seen, "entity_id", "left_anti"))
        seen = seen.unionByName(front.select("entity_id", F.lit(hop).alias("hop"), F.lit(1.0 / (hop + 1)).alias("score")))
    return seen


def collect_chunks(matches: DataFrame, chunk_entities: DataFrame, each: int = 5, most: int = 20) -> DataFrame:
    """(chunk_id, place): at most `each` chunks of an entity in the order of matches, each chunk once, `most` in all."""
    per = Window.partitionBy("entity_id").orderBy("chunk_id")
    few = chunk_entities.join(matches.select("entity_id", "hop"), "entity_id").withColumn("nth", F.row_number().over(per)).where(F.col("nth") <= each)
    first = few.groupBy("chunk_id").agg(F.min(F.struct("hop", "entity_id", "nth")).alias("key")).orderBy("key", "chunk_id").limit(most)
    return first.select("chunk_id", F.row_number().over(Window.orderBy("key", "chunk_id")).alias("place"))  # at most `most` rows


def filled(chosen: DataFrame, extra: DataFrame, most: int = 20) -> DataFrame:
    """`chosen`, topped up with `extra` (chunk_id) that is not in it."""
    have = chosen.count()  # at most `most`
    if have >= most:
        return chosen
    more = extra.join(chosen, "chunk_id", "left_anti").orderBy("chunk_id").limit(most - have)
    return chosen.unionByName(more.select("chunk_id", (have + F.row_number().over(Window.orderBy("chunk_id"))).alias("place")))


def within_budget(rows: DataFrame, budget: int, order: list[str], tokens: str = "tokens") -> DataFrame:
    """Rows in order until the first one that overflows the budget. Names in `order` that begin with `-` descend; together
    they tell rows apart. (V16)

    A row with tokens takes one at least, so the first budget + 1 of those settle where the budget ends; everything before
    that row is taken, however much without tokens there is.
    """
    names, down = [c.lstrip("-") for c in order], [c.startswith("-") for c in order]
    ordered = [F.desc(c) if d else F.asc(c) for c, d in zip(names, down, strict=True)]
    counted = rows.where(F.col(tokens) > 0).orderBy(*ordered).limit(budget + 1)
    upto = counted.withColumn("_sum", F.sum(tokens).over(Window.orderBy(*ordered).rowsBetween(Window.unboundedPreceding, 0)))  # at most budget + 1 rows
    over = upto.where(F.col("_sum") > budget).orderBy(*ordered).limit(1).select(*[F.col(c).alias(f"_{c}") for c in names]).collect()
    if not over:
        return rows
    before = F.lit(False)
    for c, d in reversed(list(zip(names, down, strict=True))):
        edge = F.lit(over[0][f"_{c}"])
        before = (F.col(c) > edge if d else F.col(c) < edge) | ((F.col(c) == edge) & before)
    return rows.where(before)


def context_lines(rows: DataFrame, line: Column, order: str) -> DataFrame:
    """One row: the lines in order."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    return rows.agg(F.array_join(F.transform(listed, lambda s: s["l"]), "\n").alias("context"))


def top_communities(communities: DataFrame, level: int | None = None, k: int = 10) -> DataFrame:
    """(V18)"""
    found = communities if level is None else communities.where(F.col("level") == level)
    return found.orderBy(F.desc("size"), "community_id").limit(k)


def answer_relevance(answer: Column) -> Column:
    """By what the partial answer says and its length."""
    n = F.length(answer)
    return F.when(F.contains(F.lower(answer), F.lit(NO_INFORMATION)), 0.0).when(n < 50, 0.2).when(n < 150, 0.5).when(n < 300, 0.7).otherwise(0.9)


def map_communities(communities: DataFrame, answer: Column) -> DataFrame:
    """(community_id, answer, relevance): a partial answer of each community, however long its context. `answer` is the seam: any
    Column, such as a model's Arrow function. (V19)"""
    return communities.select("community_id", answer.alias("answer")).withColumn("relevance", answer_relevance(F.col("answer")))


def fitting(communities: DataFrame, limit: int = 8000) -> DataFrame:
    """Communities whose context has at most `limit` tokens, for a model that reads no more at once."""
    return communities.where(estimated_tokens(F.col("context")) <= limit)


def reducible(partial: DataFrame, least: float = 0.1) -> DataFrame:
    """(F12)"""
    return partial.where((F.col("relevance") > least) & ~F.contains(F.lower("answer"), F.lit(NO_INFORMATION)))


def reduce_answers(partial: DataFrame) -> DataFrame:
    """One row: the remaining answers, most relevant first; null where none remains."""
    listed = F.array_sort(F.collect_list(F.struct((-F.col("relevance")).alias("o"), "community_id", "answer")))
    joined = F.array_join(F.transform(listed, lambda s: s["answer"]), "\n\n")
    return reducible(partial).agg(F.when(F.count("*") > 0, joined).alias("answer"))
