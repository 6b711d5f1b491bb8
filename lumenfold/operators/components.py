"""Connected components of an undirected edge list, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.storage import materialise

MAX_ROUNDS = 60


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of `edges`; component is the smallest node of its component.

    Contraction: every node hooks on to its smallest neighbour if that is smaller, pointers are followed to their roots,
    and edges are renamed to roots and deduplicated, which at least halves the nodes that still have edges. The smallest
    node of a component is always a root, so it is the one that is left. Nothing but whether edges are left reaches the
    driver. Joins are plain equi-joins of written tables, which adaptive execution splits where a hub is hot, and minima
    are combined before the shuffle.
    """
    left = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    left = materialise(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    total = None
    for _ in range(MAX_ROUNDS):
        if total is not None and left.isEmpty():
            return total
        either = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("other")))
        parent = materialise(either.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("root")))
        while True:  # pointers only fall, so they end at roots; a turn follows four of them and sees whether a fifth is left
            at = parent
            for step in range(3):
                up = parent.select(F.col("node").alias("at"), F.col("root").alias("next"))
                at = at.join(up, F.col("root") == F.col("at")).select("node", F.col("next").alias("root"), *([(F.col("next") < F.col("root")).alias("moved")] if step == 2 else []))
            jumped = materialise(at)
            parent = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        to = lambda c: parent.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: B023, E731
        renamed = left.join(to("a"), "a").join(to("b"), "b").where("a_root <> b_root")
        left = materialise(renamed.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct())
        if total is None:
            total = parent.select("node", F.col("root").alias("component"))
        else:
            later = parent.select(F.col("node").alias("component"), F.col("root").alias("new"))
            total = materialise(total.join(later, "component", "left").select("node", F.coalesce("new", "component").alias("component")))
    raise RuntimeError(f"edges are left after {MAX_ROUNDS} rounds")
