"""Budgets, histograms, counters and other statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators.routing import BUDGET_LEVELS, INDEX_TOKENS


def usage(ledger: DataFrame) -> DataFrame:
    """(level, operation, tokens, n): by level and operation, by each alone, and in all."""
    return ledger.cube("level", "operation").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))


def budget_state(ledger: DataFrame, limit: int) -> DataFrame:
    """One row: total, remaining, ratio, near (80 % of the limit), over."""
    total = F.coalesce(F.sum("tokens"), F.lit(0))
    one = ledger.agg(total.alias("total"))
    return one.select("total", F.greatest(F.lit(0), limit - F.col("total")).alias("remaining"), F.round(F.col("total") / limit, 6).alias("ratio"), (F.col("total") >= int(0.8 * limit)).alias("near"), (F.col("total") >= limit).alias("over"))


def latest(rows: DataFrame, n: int, order: list) -> DataFrame:
    """The last n rows."""
    return rows.orderBy(*order).limit(n)


def build_cost(chunks: Column, budget: str) -> Column:
    """Tokens to build all levels a budget allows."""
    parts = [F.floor(chunks * F.lit(t) / 1000) for k, t in INDEX_TOKENS.items() if k <= BUDGET_LEVELS[budget]]
    return sum(parts[1:], parts[0]).cast("long")


def histogram(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, least, most, mean, p50, p95, p99): order statistics by position; p95 from 20 values, p99 from 100 on, the
    largest value below that. (A16)

    Positions come from counts per distinct value, so a hot group is combined before it is shuffled and then ranked as
    distinct values.
    """
    counts = rows.groupBy(by, value).agg(F.count("*").alias("c"))
    order = Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(Window.partitionBy(by)))
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col(value)))
    n = F.col("n")
    return placed.groupBy(by).agg(
        F.max("n").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.sum(F.col(value) * F.col("c")) / F.max("n"), 6).alias("mean"),
        at(F.floor(n / 2)).alias("p50"), F.when(F.max("n") >= 20, at(F.floor(n * 0.95))).otherwise(F.max(value)).alias("p95"), F.when(F.max("n") >= 100, at(F.floor(n * 0.99))).otherwise(F.max(value)).alias("p99"),
    )


def counters(events: DataFrame) -> DataFrame:
    """(name, total, last) by name alone."""
    return events.groupBy("name").agg(F.round(F.sum("value"), 4).alias("total"), F.max_by("value", F.struct("ts", "id")).alias("last"))


def hit_rate(hits: Column, misses: Column) -> Column:
    """(A18)"""
    return F.when(hits + misses == 0, 0.0).otherwise(hits / (hits + misses))


def error_counts(errors: DataFrame) -> DataFrame:
    """(A19)"""
    return errors.groupBy("error").agg(F.count("*").alias("n"))


def throughput(tokens: Column, seconds: Column) -> Column:
    """(A20)"""
    return F.when(seconds > 0, tokens / seconds).otherwise(0.0)


def batch_stats(results: DataFrame) -> DataFrame:
    """One row: total, errors, success rate (0 if empty). results: (ok)."""
    good = F.count_if(F.col("ok"))
    return results.agg(F.count("*").alias("total"), F.count_if(~F.col("ok")).alias("errors"), F.round(F.when(F.count("*") == 0, 0.0).otherwise(good / F.count("*")), 6).alias("success_rate"))
