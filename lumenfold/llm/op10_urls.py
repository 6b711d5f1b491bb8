"""URL rules indexed by their rarest literal token.

A rule is either a pair of host and path prefix (`net/`, `example.net/en/`) or a pattern over `"." + host + path` in
which `*` stands for anything (the leading dot makes every label of the host begin with one). Both become a regular expression and a set of literal tokens: letter or digit runs that
stand in the rule between delimiters, so that any URL that fits the rule has them as whole tokens. The tokens'
frequencies are counted over all URLs; each rule is filed under its rarest one. A URL's own tokens then fetch the
few rules filed under them, and only those run their regular expression.

Up to INLINE_RULES rules the index is an array of buckets addressed by the token's hash, part of the expression: rows are
neither exploded nor shuffled to be judged. More rules are a table: URL tokens are joined with the rules filed under them (Spark
broadcasts the table where it is small and shuffles otherwise), and the rows that some rule fits get their best one back by
a second join. Both give the same rows; there is no limit to the number of rules.

Precedence: the longest pair that fits decides; where none fits, a fitting pattern blocks, otherwise the URL passes.
Defined results: a null url or one without `://` has empty host and path, which no rule fits (verdict allow); equal
urls give equal rows; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.storage import materialise

#: Host, path, verdict.
PAIRS = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Patterns that block: hosts named after what they push.
PATTERNS = (".cheap-", "-pills.", ".pills.", "/pills/", ".spam-", "-spam.", "/spam/", ".casino-", "-casino.", "/casino/", ".lottery-", "-lottery.", "-free-money.", "-payday-loans.", "/track/click/")
INLINE_RULES = 1_000
_DELIMITED = r"(?<![A-Za-z0-9*])[A-Za-z0-9]+(?![A-Za-z0-9*])"


def compile_rules(pairs=PAIRS, patterns=PATTERNS) -> list[dict]:
    rules = []
    for host, path, verdict in pairs:
        tokens = re.findall(_DELIMITED, f".{host}{path}" + "*" * (not path.endswith("/")))
        rules.append({"rule": f"{host}{path}", "verdict": verdict, "length": len(host) + len(path), "regex": rf"^[^/]*\.{re.escape(host)}{re.escape(path)}", "tokens": tokens})
    for pattern in patterns:
        tokens = re.findall(_DELIMITED, f"*{pattern}*")
        if not tokens:
            raise ValueError(f"pattern {pattern!r} holds no whole literal token to file it under")
        rules.append({"rule": None, "verdict": "block", "length": -1, "regex": re.escape(pattern).replace(r"\*", ".*"), "tokens": tokens})
    return rules


def split_url(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def tokens_of(place: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(place, F.lit("([A-Za-z0-9]+)"), F.lit(1)))


def token_counts(places: DataFrame, rules: list[dict]) -> dict[str, int]:
    """In how many URLs each of the rules' tokens occurs, over all URLs."""
    wanted = sorted({t for r in rules for t in r["tokens"]})
    if len(rules) <= INLINE_RULES:
        found = places.select(F.explode(F.array_intersect(tokens_of(F.col("place")), F.array(*map(F.lit, wanted)))).alias("token"))
    else:
        table = places.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
        found = places.select(F.explode(tokens_of(F.col("place"))).alias("token")).join(table, "token", "left_semi")
    return {r["token"]: r["count"] for r in found.groupBy("token").count().collect()}  # of the rules' tokens only


_KIND = "struct<token:string,rule:string,verdict:string,length:int,regex:string>"


def _judged_inline(placed: DataFrame, filed: list[tuple[str, dict]]) -> DataFrame:
    size = 1 << max(4, (2 * len(filed)).bit_length())
    buckets: list[list[tuple[str, dict]]] = [[] for _ in range(size)]
    for rarest, rule in filed:
        buckets[xxhash.xxh64_intdigest(rarest, 42) % size].append((rarest, rule))
    entry = lambda t, r: F.struct(F.lit(t).alias("token"), F.lit(r["rule"]).cast("string").alias("rule"), F.lit(r["verdict"]).alias("verdict"), F.lit(r["length"]).alias("length"), F.lit(r["regex"]).alias("regex"))
    index = F.array(*[F.array(*[entry(t, r) for t, r in b]).cast(f"array<{_KIND}>") for b in buckets])
    # size is a power of two, so the low bits of the signed hash are those of the unsigned one
    fetch = lambda t: F.filter(F.get(index, F.xxhash64(t).bitwiseAND(F.lit(size - 1)).cast("int")), lambda r: r["token"] == t)
    candidates = F.flatten(F.transform(tokens_of(F.col("place")), fetch))
    fitting = F.filter(candidates, lambda r: F.regexp_like(F.col("place"), r["regex"]))
    fits = F.transform(fitting, lambda r: F.struct(r["length"].alias("length"), r["rule"].alias("rule"), r["verdict"].alias("verdict")))
    return placed.withColumn("best", F.array_max(fits))


def _judged_by_table(placed: DataFrame, filed: list[tuple[str, dict]]) -> DataFrame:
    rows = [(token, r["rule"], r["verdict"], r["length"], r["regex"]) for token, r in filed]
    table = placed.sparkSession.createDataFrame(rows, "token string, rule string, verdict string, length int, regex string")
    placed = materialise(placed.withColumn("row", F.monotonically_increasing_id()))
    met = placed.select("row", "place", F.explode(tokens_of(F.col("place"))).alias("token")).join(table, "token").where("regexp_like(place, regex)")
    best = met.groupBy("row").agg(F.max(F.struct("length", "rule", "verdict")).alias("best"))
    return placed.join(best, "row", "left").drop("row")


def judge(pages: DataFrame, pairs=PAIRS, patterns=PATTERNS) -> DataFrame:
    """page_id, url, host, path, rule and verdict of every row."""
    rules = compile_rules(pairs, patterns)
    host, path = split_url(F.col("url"))
    placed = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("place", F.concat(F.lit("."), "host", "path"))
    counts = token_counts(placed, rules)
    filed = [(min(r["tokens"], key=lambda t: (counts.get(t, 0), t)), r) for r in rules]
    best = (_judged_inline if len(rules) <= INLINE_RULES else _judged_by_table)(placed, filed)
    return best.select("page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


def op10_url_rules(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("url")


_AS_SQL = " OR ".join(f"regexp_matches(place, '{re.escape(p).replace(chr(92) + '*', '.*').replace(chr(92) + '-', '-')}')" for p in PATTERNS)
ORACLE = rf"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
p AS (SELECT *, '.' || host || path AS place, '.' || host AS dotted FROM h),
v AS (SELECT *, CASE WHEN dotted LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
                     WHEN dotted LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
                     WHEN dotted LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
                     WHEN dotted LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN {_AS_SQL} THEN 'block' ELSE 'allow' END AS verdict FROM v
"""
