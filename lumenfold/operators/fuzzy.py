"""Most similar titles: a similarity join on the rarest grams, in rounds of growing distance.

A title within d edits of another leaves at least one of any d + 1 disjoint substrings of it unchanged, at most d places
from where it stood. Which d + 1 substrings is free, so those are taken that the fewest held titles have: for every size of
GRAM_SIZES the cheapest d + 1 disjoint grams by their counts over all held titles (a small dynamic program for each title),
and the cheapest size. Grams that all titles share, such as a common beginning, are keys only where a title has nothing
rarer. A title has as many probes as d + 1, and a held title one index row for each of its places and sizes.

Where titles differ in a few characters only, such as a number behind a common beginning, the grams of a title that others lack do not
suffice for d + 1 probes, and each further one has most titles behind it. Titles within d edits also have a text in common that both
become by leaving out d characters at most. A title has few such texts (`variants`) as long as d and the title are small, whatever the
number of titles; they are looked up where the grams have more titles behind them.

Only the best match is asked for, so distances grow in rounds (1, 2, 5, ...). A reference leaves when its match is
better than anything farther away could be (given the lengths of held titles), or its own bound is reached; what most references find
is a title next to them, and the long probes of great distances are left to those that find none.

Sizes are guessed from written titles, which shrink well and are far below the grams and variants made of them, so tables that grow with
the titles are never broadcast.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.storage import materialise

GRAM_SIZES = (1, 2, 3, 5)
#: Single characters are looked up for shorter titles only; two fit wherever a longer title may differ. What is similar to a
#: shorter title has less than twice as many characters.
SHORT = 12
#: Variants are made for so many characters left out, of titles up to so long: 1,276 of them at most.
OUT, LONG = 2, 50


def edit_bound(n: Column, least: float, measure: str) -> Column:
    """The most edits between a title of n characters and one that is similar enough."""
    return F.floor(n * F.lit((1 - least) / least * (1 if measure == "levenshtein" else 2)) + 1e-9).cast("int")


def best_beyond(n: Column, d: Column, lengths: Column, measure: str, out: Column) -> Column:
    """No title of one of `lengths` that the pairs of a round lack is more similar to one of n characters than this.

    They lack titles more than d edits away; by `out` (looked up by variants) also those alone which leave more than d characters of the
    longer one without a partner. Characters in common are d + 1 fewer than the longer one's then; otherwise the others of both
    titles together are more than d."""

    def most(m: Column) -> Column:
        longer, shorter = F.greatest(n, m), F.least(n, m)
        if measure == "levenshtein":
            return 1 - F.greatest(d + 1, longer - shorter) / longer
        common = F.when(out, 2 * F.least(shorter, longer - d - 1)).otherwise(F.least(2 * shorter, n + m - d - 1))
        return common / (n + m)

    return F.array_max(F.transform(lengths, most))


def variants(text: Column, d: int) -> Column:
    """Hashes of what is left of a text without up to d (at most OUT) of its characters, each once."""
    n = F.length(text)
    without = lambda t, i: F.concat(F.substr(t, F.lit(1), i - 1), F.substr(t, i + 1))
    one = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: without(text, i)))
    left = [F.array(text), one]
    if d > 1:
        # the second place is before the first, so each pair is left out once
        left.append(F.when(n > 1, F.flatten(F.transform(F.sequence(F.lit(2), n), lambda j: F.transform(F.sequence(F.lit(1), j - 1), lambda i: without(without(text, j), i))))))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.transform(F.concat(*[F.coalesce(x, none) for x in left]), lambda t: F.xxhash64(t)))


def _places(text: Column, sizes: tuple[int, ...], short: int = SHORT) -> Column:
    """(q, at, gram) of all grams of a text, sizes and places ascending; single characters of texts below `short` only."""
    n = F.length(text)

    def of(q: int) -> Column:
        return F.transform(F.sequence(F.lit(0), n - q), lambda at: F.struct(F.lit(q).alias("q"), at.alias("at"), F.substr(text, at + 1, F.lit(q)).alias("gram")))

    none = F.array().cast("array<struct<q:int,at:int,gram:string>>")
    return F.flatten(F.array(*[F.when((n >= q) & ((n < short) | F.lit(q > 1)), of(q)).otherwise(none) for q in sizes]))


def cheapest(counts: np.ndarray, size: int, wanted: int) -> tuple[float, list[int]]:
    """The places of `wanted` disjoint grams of one size with the least sum of counts, by place."""
    n = len(counts) + size - 1
    cost = np.full((n + 1, wanted + 1), np.inf)
    cost[:, 0] = 0
    for i in range(1, n + 1):
        cost[i] = cost[i - 1]
        if i >= size:
            np.minimum(cost[i, 1:], cost[i - size, :-1] + counts[i - size], out=cost[i, 1:])
    total, places, i = float(cost[n, wanted]), [], n
    while wanted:
        if cost[i, wanted] == cost[i - 1, wanted]:
            i -= 1
        else:
            i, wanted = i - size, wanted - 1
            places.append(i)
    return total, places[::-1]


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _probes(counts: pd.Series, length: pd.Series, edits: pd.Series) -> pd.Series:
    """The size of the grams to look up, and their places; 0 where the variants of a title are fewer than the titles behind its grams."""
    out = []
    for found, n, d in zip(counts, length, edits, strict=True):
        best, at = None, 0
        for size in GRAM_SIZES:
            if n < size or (size == 1 and n >= SHORT):
                continue
            own, at = np.asarray(found[at : at + n - size + 1], float), at + n - size + 1
            if (d + 1) * size <= n:
                total, places = cheapest(own, size, d + 1)
                if best is None or total <= best[0]:
                    best = total, [size, *places]
        few = d <= OUT and n <= LONG and sum(comb(n, k) for k in range(d + 1)) < best[0]
        out.append([0] if few else best[1])
    return pd.Series(out)


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def candidate_pairs(open_: DataFrame, held: DataFrame) -> DataFrame:
    """(a_id, b_id): every pair of titles within the asked one's d edits, and few others.

    open_: (a_id, a, n, d, counts), the counts of a's grams among the held titles; held: (b_id, b)."""
    chosen = open_ if "chosen" in open_.columns else materialise(open_.select("a_id", "a", "n", "d", _probes("counts", "n", "d").alias("chosen")))
    size = F.get("chosen", F.lit(0))
    sizes = tuple(sorted(r["q"] for r in chosen.select(size.alias("q")).distinct().collect()))  # of GRAM_SIZES, and 0
    probes = chosen.where(size > 0).select("a_id", "a", "n", "d", size.alias("q"), F.explode(F.slice("chosen", 2, F.size("chosen"))).alias("place"))
    probes = probes.select("a_id", "n", "d", "q", "place", F.substr("a", F.col("place") + 1, F.col("q")).alias("gram"))
    grams = tuple(q for q in sizes if q)
    pairs = None
    if grams or not sizes:
        index = held.select("b_id", F.length("b").alias("m"), F.explode(_places(F.col("b"), grams or GRAM_SIZES, 2 * SHORT)).alias("g")).select("b_id", "m", "g.q", "g.at", "g.gram")
        near = (F.abs(F.col("at") - F.col("place")) <= F.col("d")) & (F.abs(F.col("m") - F.col("n")) <= F.col("d"))
        pairs = probes.join(index.hint("merge"), ["q", "gram"]).where(near).select("a_id", "b_id").distinct()
    if 0 in sizes:
        asked = chosen.where(size == 0)
        for d in sorted(r["d"] for r in asked.select("d").distinct().collect()):  # OUT at most
            left = asked.where(F.col("d") == d).select("a_id", "n", F.explode(variants(F.col("a"), d)).alias("key"))
            right = held.where(F.length("b") <= LONG + d).select("b_id", F.length("b").alias("m"), F.explode(variants(F.col("b"), d)).alias("key"))
            met = left.join(right.hint("merge"), "key").where(F.abs(F.col("m") - F.col("n")) <= d).select("a_id", "b_id").distinct()
            pairs = met if pairs is None else pairs.unionByName(met)
    return pairs


def most_similar(wanted: DataFrame, titles: DataFrame, least: float, measure: str = "levenshtein") -> DataFrame:
    """(ref_id, match, similarity) of the most similar title at or above `least`, ties to the smaller document; a reference
    never means its own document. wanted: (ref_id, doc_id, a), titles: (match, b), both normalised and not empty.

    `measure` is `levenshtein` (1 - edits / longer length) or `sequence` (difflib's ratio, in an Arrow function)."""
    titles = materialise(titles.distinct())
    # a title's two smallest documents are enough, since a reference leaves out one only
    nth = F.row_number().over(Window.partitionBy("b").orderBy("match"))
    few = titles.withColumn("nth", nth).where("nth <= 2").select("b", "match")
    held = materialise(titles.select("b").distinct().select(F.monotonically_increasing_id().alias("b_id"), "b"))
    asked = materialise(wanted.select("a").distinct().select(F.monotonically_increasing_id().alias("a_id"), "a", F.length("a").alias("n")))
    counts = held.select(F.explode(_places(F.col("b"), GRAM_SIZES, 2 * SHORT)).alias("g")).groupBy("g.q", "g.gram").agg(F.count("*").alias("count"))
    own = asked.select("a_id", "a", "n", F.explode(_places(F.col("a"), GRAM_SIZES)).alias("g")).select("a_id", "a", "n", "g.*")
    counted = own.join(counts.hint("merge"), ["q", "gram"], "left").groupBy("a_id", "a", "n").agg(F.array_sort(F.collect_list(F.struct("q", "at", F.coalesce("count", F.lit(0)).alias("count")))).alias("x"))
    counted = materialise(counted.select("a_id", "a", "n", edit_bound(F.col("n"), least, measure).alias("most"), F.transform("x", lambda x: x["count"]).alias("counts")))
    refs = wanted.join(counted.select("a", "a_id").hint("merge"), "a").select("ref_id", "doc_id", "a_id")
    lengths = held.agg(F.coalesce(F.collect_set(F.length("b")), F.array().cast("array<int>")).alias("lengths"))
    kept, reach = None, 1
    while True:
        open_ = counted.withColumn("d", F.least(F.lit(reach), F.col("most")))
        open_ = materialise(open_.select("a_id", "a", "n", "d", "most", _probes("counts", "n", "d").alias("chosen")).withColumn("out", F.get("chosen", F.lit(0)) == 0))
        pairs = candidate_pairs(open_, held).join(open_.select("a_id", "a", "d", "out").hint("merge"), "a_id").join(held.hint("merge"), "b_id")
        apart = F.levenshtein("a", "b", reach)
        within = (F.col("apart") >= 0) & (F.col("apart") <= F.col("d"))
        close = pairs.withColumn("apart", apart).where(within if measure == "levenshtein" else F.col("out") | within)
        similarity = 1 - F.col("apart") / F.greatest(F.length("a"), F.length("b")) if measure == "levenshtein" else _ratio("a", "b")
        good = close.withColumn("similarity", similarity).where(F.col("similarity") >= least)
        by_document = good.join(few.hint("merge"), "b").groupBy("a_id", "match").agg(F.max("similarity").alias("similarity"))
        place = F.row_number().over(Window.partitionBy("a_id").orderBy(F.desc("similarity"), "match"))
        two = by_document.withColumn("place", place).where("place <= 2")
        met = refs.join(two.hint("merge"), "a_id").where(F.col("doc_id") != F.col("match")).groupBy("ref_id").agg(F.min(F.struct("place", "match", "similarity")).alias("m"))
        done = (F.col("d") >= F.col("most")) | F.coalesce(F.col("m.similarity") > best_beyond(F.col("n"), F.col("d"), F.col("lengths"), measure, F.col("out")), F.lit(False))
        seen = refs.join(open_.select("a_id", "n", "d", "most", "out").hint("merge"), "a_id").join(met.hint("merge"), "ref_id", "left").crossJoin(F.broadcast(lengths))  # one row
        seen = materialise(seen.select("ref_id", "doc_id", "a_id", "m.match", "m.similarity", done.alias("done")))
        found = seen.where("done AND match IS NOT NULL").select("ref_id", "match", F.round("similarity", 6).alias("similarity"))
        kept = found if kept is None else kept.unionByName(found)
        refs = seen.where("NOT done").select("ref_id", "doc_id", "a_id")
        if refs.isEmpty():
            return kept
        counted = materialise(counted.join(refs.select("a_id").distinct().hint("merge"), "a_id", "left_semi"))
        reach = 2 if reach == 1 else 2 * reach + 1
