"""Quality by weak supervision: rules vote or abstain, and what their votes are worth is learned without labels.

A rule looks at one measure of a text and says good, bad or nothing. Whether a text is good is hidden; given that, votes
are taken as independent, and a rule that votes at all votes bad with one probability on bad texts and with another on good
ones (its accuracy on either kind). Expectation-maximisation estimates these and the share of good texts from how often
each pattern of votes occurs among all documents; a few imagined texts (PRIOR) keep a rule that never votes from deciding
anything. A text is kept where the posterior probability that it is good is at least one half, so one rule's failure is
outvoted where the rule often fails on texts that the others find good.

Measures, votes, patterns and posteriors are DataFrame expressions. Texts are read once and never shuffled; what reaches
the driver is the count of each pattern, at most 3 ** len(RULES) rows however many documents there are, over which the
estimates are computed.

Defined results: null and empty texts have no words, fail the base rule and are not kept; rows that repeat a doc_id and
rows with a null one are documents of their own; an empty table gives no rows; a rule without a measure (no words) abstains; a
posterior of exactly one half keeps; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.storage import materialise

WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
WINDOW = 3
LEAST_WORDS = 50
MOST_REPEATED = 50

#: (name, measure, votes good within, votes bad beyond). A measure is an SQL expression over the counts of `measures`. Within
#: and beyond are ranges (from, to) of the measure; between them the rule abstains. A null end is open.
RULES = (
    ("length", "n_words", (100, None), (None, 49)),
    ("symbols", "n_symbols / n_words", (None, 0.02), (0.1, None)),
    ("capitals", "n_upper / word_chars", (None, 0.2), (0.5, None)),
    ("exclamations", "n_exclamations / n_words", (None, 0.02), (0.2, None)),
    ("repeated_words", "n_repeat_words / n_words", (None, 0.1), (0.3, None)),
    ("distinct_words", "n_distinct / n_words", (0.3, None), (None, 0.1)),
    ("lone_marks", "n_marks / n_words", (None, 0.05), (0.2, None)),
    ("other_characters", "n_other / word_chars", (None, 0.1), (0.3, None)),
    ("word_length", "word_chars / n_words", (3.0, 12.0), (20.0, None)),
)
ROUNDS = 25
#: Imagined texts: of either kind, and of each vote of a rule on a kind that fits it or does not.
PRIOR_GOOD, PRIOR_BAD, PRIOR_FITS, PRIOR_FAILS = 8.0, 2.0, 2.0, 1.0
#: Where the estimates start.
START_GOOD, START_BAD_ON_GOOD, START_BAD_ON_BAD = 0.8, 0.01, 0.2


#: Places of words in a window's key; a text of more words has all its windows compared.
PLACE_BITS = 24


def window_keys(words: Column) -> Column:
    """Of the windows of WINDOW words, in ascending order: a hash without its low bits, and the window's place in those."""
    last = F.size(words) - WINDOW
    of = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)])
    key = lambda i: of(i).bitwiseAND(F.lit(-(1 << PLACE_BITS))).bitwiseOR(i.cast("long"))
    keys = F.sort_array(F.transform(F.sequence(F.lit(0), last), key))
    return F.when(last < 1, F.array().cast("array<long>")).when(last >= 1 << PLACE_BITS, F.sequence(F.lit(0), last).cast("array<long>")).otherwise(keys)


def repeated_words(words: Column, keys: Column) -> Column:
    """In how many places of the array `words` a word stands that is part of a window found twice or more.

    Windows whose hash has an equal neighbour in `keys` are candidates; those are sorted with their places, and equal
    neighbours are the repeated ones."""
    place = lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    same = lambda x, k: F.shiftright(x, PLACE_BITS).eqNullSafe(F.shiftright(F.get(keys, k), PLACE_BITS))
    candidates = F.transform(F.filter(keys, lambda x, k: same(x, k - 1) | same(x, k + 1)), place)
    candidates = F.when(F.size(words) - WINDOW >= 1 << PLACE_BITS, keys.cast("array<int>")).otherwise(candidates)
    window = lambda i: F.struct(F.concat_ws(" ", *[F.get(words, i + j) for j in range(WINDOW)]).alias("window"), i.alias("at"))

    def of_sorted(s: Column) -> Column:
        again = F.filter(s, lambda x, k: x["window"].eqNullSafe(F.get(s, k - 1)["window"]) | x["window"].eqNullSafe(F.get(s, k + 1)["window"]))
        places = F.flatten(F.transform(again, lambda x: F.array(*[x["at"] + i for i in range(WINDOW)])))
        return F.size(F.array_distinct(places))

    return _let(F.array_sort(F.transform(candidates, window)), of_sorted).cast("long")


def _let(value: Column, body) -> Column:
    """`body(value)` with the value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that rules look at, over whole texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    lines = F.filter(F.split(text, "\n"), lambda line: F.regexp_like(line, F.lit(WORD)))
    read = docs.select(
        "doc_id",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE)).alias("words"),
        _count(text, r"[#*$%&|<>]").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _count(text, r"\p{Lu}").alias("n_upper"),
        _count(text, r"[^\p{L}\x20\x09-\x0D]").alias("n_other"),
        _count(text, "!").alias("n_exclamations"),
        _count(text, r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}\p{N}]+(?![^\x20\x09-\x0D])").alias("n_marks"),
    )
    keyed = read.withColumn("keys", window_keys(F.col("words")))
    return keyed.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols", "n_dup_lines",
        repeated_words(F.col("words"), F.col("keys")).alias("n_repeat_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        "n_upper", "n_other", "n_exclamations", "n_marks",
    )


def _within(measure: str, low: float | None, high: float | None) -> str:
    return " AND ".join([f"{measure} {op} {end}" for op, end in ((">=", low), ("<=", high)) if end is not None])


def vote_sql(measure: str, good: tuple, bad: tuple) -> str:
    """1 good, -1 bad, 0 nothing; SQL for Spark and others alike."""
    if "/" in measure:
        over, under = measure.split(" / ")
        measure = f"(CAST({over} AS DOUBLE) / nullif({under}, 0))"
    return f"CASE WHEN {_within(measure, *bad)} THEN -1 WHEN {_within(measure, *good)} THEN 1 ELSE 0 END"


BASE_FAILED = f"(n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words)"


def learn(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[float], list[float]]:
    """Share of good texts and, by rule, the probability of a bad vote (of a vote at all) on good and on bad texts.

    `patterns`: votes and in how many documents they occur; of bounded number, since a rule has three votes."""
    size = len(patterns[0][0]) if patterns else 0
    share, on_good, on_bad = START_GOOD, [START_BAD_ON_GOOD] * size, [START_BAD_ON_BAD] * size
    for _ in range(rounds):
        weights = worth(share, on_good, on_bad)
        good, bad = PRIOR_GOOD, PRIOR_BAD
        voted = [[PRIOR_FAILS, PRIOR_FITS + PRIOR_FAILS, PRIOR_FITS, PRIOR_FITS + PRIOR_FAILS] for _ in range(size)]
        for votes, n in patterns:
            p = posterior(votes, weights)
            good += n * p
            bad += n * (1 - p)
            for j, v in enumerate(votes):
                if v:
                    voted[j][0] += n * p * (v < 0)
                    voted[j][1] += n * p
                    voted[j][2] += n * (1 - p) * (v < 0)
                    voted[j][3] += n * (1 - p)
        share = good / (good + bad)
        on_good, on_bad = [v[0] / v[1] for v in voted], [v[2] / v[3] for v in voted]
    return share, on_good, on_bad


def worth(share: float, on_good: list[float], on_bad: list[float]) -> tuple[float, list[tuple[float, float]]]:
    """Log odds of good: of the share, and of every rule's good and bad vote."""
    return math.log(share / (1 - share)), [(math.log((1 - g) / (1 - b)), math.log(g / b)) for g, b in zip(on_good, on_bad, strict=True)]


def posterior(votes: tuple[int, ...], weights: tuple[float, list[tuple[float, float]]]) -> float:
    odds = weights[0] + sum(w[v < 0] for v, w in zip(votes, weights[1], strict=True) if v)
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def judge(docs: DataFrame, rules=RULES, rounds: int = ROUNDS) -> DataFrame:
    """The measures of every document with `votes`, `quality` (the posterior), `base_failed` and `kept`."""
    measured = measures(docs)
    names = [name for name, *_ in rules]
    voted = materialise(measured.select("*", *[F.expr(vote_sql(*rule)).alias(f"vote_{name}") for name, *rule in rules]))
    votes = [f"vote_{n}" for n in names]
    counted = voted.groupBy(*votes).agg(F.count("*").alias("documents")).collect()  # at most 3 ** len(rules) rows
    patterns = sorted((tuple(r[v] for v in votes), r["documents"]) for r in counted)
    prior, weights = worth(*learn(patterns, rounds))
    odds = reduce(lambda total, x: total + F.when(F.col(x[0]) > 0, x[1][0]).when(F.col(x[0]) < 0, x[1][1]).otherwise(0.0), zip(votes, weights, strict=False), F.lit(prior))
    quality = 1 / (1 + F.exp(-odds))
    judged = voted.withColumn("quality", quality).withColumn("base_failed", F.expr(BASE_FAILED))
    return judged.select(*measured.columns, F.array(*votes).alias("votes"), "quality", "base_failed", (~F.col("base_failed") & (F.col("quality") >= 0.5)).alias("kept"))


def op12_quality(spark, sf_dir):
    judged = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 4).alias("quality"))


def _oracle() -> str:
    n = len(RULES)
    votes = ", ".join(f"{vote_sql(*rule)} AS v{j}" for j, (_, *rule) in enumerate(RULES))
    log_odds = "ln(s / (1 - s)) + " + " + ".join(f"CASE WHEN v{j} > 0 THEN ln((1 - g{j}) / (1 - b{j})) WHEN v{j} < 0 THEN ln(g{j} / b{j}) ELSE 0 END" for j in range(n))
    start = f"SELECT {START_GOOD}::DOUBLE AS s, " + ", ".join(f"{START_BAD_ON_GOOD}::DOUBLE AS g{j}, {START_BAD_ON_BAD}::DOUBLE AS b{j}" for j in range(n))
    both = PRIOR_FITS + PRIOR_FAILS
    rate = lambda j, w, base: f"(coalesce(sum({w}) FILTER (WHERE v{j} < 0), 0) + {base}) / (coalesce(sum({w}) FILTER (WHERE v{j} <> 0), 0) + {both})"
    update = f"SELECT (sum(n * p) + {PRIOR_GOOD}) / (sum(n) + {PRIOR_GOOD + PRIOR_BAD}) AS s, " + ", ".join(f"{rate(j, 'n * p', PRIOR_FAILS)} AS g{j}, {rate(j, 'n * (1 - p)', PRIOR_FITS)} AS b{j}" for j in range(n))
    rounds = ", ".join(f"e{r} AS MATERIALIZED (SELECT pt.*, 1 / (1 + exp(-({log_odds}))) AS p FROM pt, m{r}), m{r + 1} AS MATERIALIZED ({update} FROM e{r})" for r in range(ROUNDS))
    word = WORD.replace("'", "''")
    return rf"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT row, doc_id, text, regexp_extract_all(text, '{word}') AS words FROM t),
u AS MATERIALIZED (SELECT row, unnest(words) AS word, unnest(range(len(words))) AS place FROM w),
g AS (SELECT row, place, word || ' ' || lead(word) OVER x || ' ' || lead(word, 2) OVER x AS gram FROM u WINDOW x AS (PARTITION BY row ORDER BY place)),
a AS (SELECT row, place FROM (SELECT row, place, count(*) OVER (PARTITION BY row, gram) AS n FROM g WHERE gram IS NOT NULL) WHERE n > 1),
r AS (SELECT row, count(DISTINCT place + i) AS n_repeat_words FROM a, range({WINDOW}) x(i) GROUP BY row),
l AS (SELECT row, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM w),
c AS MATERIALIZED (SELECT w.row, doc_id, len(words)::BIGINT AS n_words, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(list_distinct(words))::BIGINT AS n_distinct,
  length(array_to_string(words, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  len(regexp_extract_all(text, '\p{{Lu}}'))::BIGINT AS n_upper, len(regexp_extract_all(text, '[^\p{{L}}\x20\x09-\x0D]'))::BIGINT AS n_other, len(regexp_extract_all(text, '!'))::BIGINT AS n_exclamations,
  len(list_filter(words, lambda x: NOT regexp_matches(x, '[\p{{L}}\p{{N}}]')))::BIGINT AS n_marks
  FROM w JOIN l USING (row) LEFT JOIN r USING (row)),
v AS MATERIALIZED (SELECT *, {votes} FROM c),
pt AS MATERIALIZED (SELECT {", ".join(f"v{j}" for j in range(n))}, count(*) AS n FROM v GROUP BY ALL),
m0 AS ({start}), {rounds},
q AS (SELECT v.*, 1 / (1 + exp(-({log_odds}))) AS quality, {BASE_FAILED} AS base_failed FROM v, m{ROUNDS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND quality >= 0.5 AS kept, round(quality, 4) AS quality FROM q
"""


ORACLE = _oracle()
