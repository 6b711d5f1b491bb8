"""Secrets in texts: three base patterns, and random-looking tokens found by a test battery.

Everything is a DataFrame expression: no Python runs on the executors.

Battery. A candidate is a run of 20 or more characters of an encoding's alphabet. Its encoding is inferred (hex,
base32 and base36 in either case, base62, base64; plain digits are left to other operators). Three tests ask whether
its symbols look drawn at random: chi-squared uniformity over the alphabet, the number of runs of digits, lower and
upper case letters against what the alphabet gives, and lag-one serial correlation. A candidate passes if no test
rejects at `ALPHA` / 3.

False discovery. To pass is not enough: short ordinary tokens pass too. What the same three statistics are in ordinary
tokens is measured, for each encoding, over all candidates of the corpus that the battery rejects (behind a few
pseudo-observations): the excess of chi-squared a symbol and its spread, the rate of class changes, the serial
correlation and its spread. The p-value of a candidate is the probability that an ordinary token of its length looks so
random: three times the least of the three tests' tails, and 1 for candidates that fail the battery. Length counts by
itself in each tail. Benjamini-Hochberg at level `FDR` runs over all candidates of the corpus within strata of encoding
and length. Its cut is taken from counts of p-values on a fixed logarithmic grid, a table of bounded size, rounded to
the strict side.

Positions are code points; they come from prefix sums in two levels, so that a text of n matches costs n * sqrt(n) at
most. Defined results: a null text counts as empty, an empty text has no spans; equal rows give equal results; empty
tables give empty results; `scan` and `find` return the input's columns in one struct, `row`, so no name clashes, and
`redact` returns them as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.storage import materialise

#: The patterns of the base kinds, and the least length of each.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"

ALPHA = 0.001
FDR = 0.01
#: The grid of p-values: steps of a tenth of a decade, down to 1e-40.
GRID_STEP, GRID_BINS = 0.1, 400
LENGTH_STEPS = (32, 48, 96)
#: Pseudo-observations of ordinary tokens: class changes and pairs; tokens, the probability that two letters of a
#: language are equal, and the spread of serial correlations.
PRIOR_CHANGES, PRIOR_PAIRS = 100, 1000
PRIOR_TOKENS, PRIOR_EQUAL, PRIOR_SERIAL = 20, 0.066, 0.25

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = {"hex": DIGITS + "abcdef", "base32": UPPER + "234567", "lower32": LOWER + "234567", "upper36": DIGITS + UPPER, "lower36": DIGITS + LOWER, "base62": DIGITS + UPPER + LOWER, "base64": DIGITS + UPPER + LOWER + "+/"}


def class_changes(alphabet: str) -> tuple[float, float]:
    """Of symbols drawn at random: the probability that the class changes from one to the next, and that it does so
    twice in a row."""
    sizes = [sum(c in some for c in alphabet) for some in (DIGITS, LOWER, UPPER)]
    shares = [n / len(alphabet) for n in (*sizes, len(alphabet) - sum(sizes))]
    return 1 - sum(p * p for p in shares), sum(p * (1 - p) ** 2 for p in shares)


def let(value: Column, body) -> Column:
    """`body` of `value`, which is computed once; named in a lambda function, an expression is computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefix(values: Column, combine, zero: int) -> Column:
    """For each of `values` (array<long>) the combination of those before it; `combine` is associative. Pieces of the
    square root of the length are scanned on their own, then shifted by what stands before them."""
    none = F.array().cast("array<long>")
    start = lambda at: F.struct(at.cast("long").alias("at"), none.alias("out"))
    step = lambda acc, v: F.struct(combine(acc["at"], v).cast("long").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def cut(v: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v).cast("double")))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda k: F.slice(v, k * width + 1, width))

    def scanned(pieces: Column) -> Column:
        totals = F.transform(pieces, lambda piece: F.aggregate(piece, F.lit(zero).cast("long"), lambda acc, v: combine(acc, v).cast("long")))
        before = F.aggregate(totals, start(F.lit(zero)), step, lambda acc: acc["out"])
        return F.flatten(F.zip_with(pieces, before, lambda piece, at: F.aggregate(piece, start(at), step, lambda acc: acc["out"])))

    return let(values, lambda v: F.when(F.size(v) > 0, let(cut(v), scanned)).otherwise(none))


def _placed(text: Column, pattern: str, keep: Column | None = None) -> Column:
    """array<struct<start,end,match>> of the leftmost non-overlapping matches that `keep` (an array of booleans) keeps."""
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def placed(found: Column) -> Column:
        steps = F.transform(found, lambda x: (F.length(x["piece"]) + F.length(x["match"])).cast("long"))
        parts = F.zip_with(found, prefix(steps, lambda a, b: a + b, 0), lambda x, at: F.struct((at + F.length(x["piece"])).cast("int").alias("start"), (at + F.length(x["piece"]) + F.length(x["match"])).cast("int").alias("end"), x["match"].alias("match"), x["keep"].alias("keep")))
        return F.transform(F.filter(parts, lambda x: x["keep"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["match"].alias("match")))

    def all_of(matches: Column) -> Column:
        kept = F.transform(matches, lambda _: F.lit(True)) if keep is None else keep
        return F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(matches)).alias("piece"), matches.alias("match"), kept.alias("keep"))

    return F.when(text.rlike(pattern), let(let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), all_of), placed)).otherwise(none)


def _as_kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution (Lin's approximation)."""
    a = F.abs(z)
    upper = 0.5 * F.exp(-0.717 * a - 0.416 * a * a)
    return F.when(z >= 0, upper).otherwise(1 - upper)


def _by_encoding(values: dict[str, float], encoding: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), encoding)


def _battery(tokens: Column) -> Column:
    """array<struct<start,end,encoding,stratum,passes,changes,pairs,excess,serial>> of candidate tokens."""
    s = lambda t: t["match"]
    encoding = lambda t: (
        F.when(s(t).rlike("^[0-9_-]+$"), None)
        .when(s(t).rlike("^([0-9a-f-]+|[0-9A-F-]+)$"), "hex")
        .when(s(t).rlike("^[A-Z2-7]+=*$"), "base32")
        .when(s(t).rlike("^[a-z2-7]+=*$"), "lower32")
        .when(s(t).rlike("^[A-Z0-9_-]+=*$"), "upper36")
        .when(s(t).rlike("^[a-z0-9_-]+=*$"), "lower36")
        .when(s(t).rlike("[+/]"), "base64")
        .otherwise("base62")
    )
    named = F.transform(tokens, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["match"].alias("match"), encoding(t).alias("encoding")))
    named = F.filter(named, lambda t: t["encoding"].isNotNull())
    alphabet = lambda t: _by_encoding(ALPHABETS, t["encoding"])
    body = lambda t: F.translate(F.when(t["encoding"] == "hex", F.lower(t["match"])).otherwise(t["match"]), "-_=", "")
    spelled = F.transform(named, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["encoding"].alias("encoding"), alphabet(t).alias("alphabet"), F.filter(F.split(body(t), ""), lambda c: c != "").alias("chars")))
    class_of = lambda c: F.when(c < "0", 3).when(c <= "9", 0).when(c <= "Z", 2).otherwise(1)
    coded = F.transform(
        spelled,
        lambda t: F.struct(
            t["start"].alias("start"), t["end"].alias("end"), t["encoding"].alias("encoding"), F.length(t["alphabet"]).cast("double").alias("a"),
            F.transform(t["chars"], lambda c: F.instr(t["alphabet"], c).cast("double")).alias("x"),
            F.transform(t["chars"], class_of).alias("cls"),
        ),
    )
    coded = F.filter(coded, lambda t: F.size(t["x"]) >= 8)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, v: acc + v)
    pairs = lambda xs, f: F.zip_with(F.slice(xs, F.lit(1), F.size(xs) - 1), F.slice(xs, F.lit(2), F.size(xs) - 1), f)
    counted = F.transform(
        coded,
        lambda t: F.struct(
            t["start"].alias("start"), t["end"].alias("end"), t["encoding"].alias("encoding"), t["a"].alias("a"), t["x"].alias("x"),
            F.size(t["x"]).cast("double").alias("n"),
            (total(t["x"]) / F.size(t["x"])).alias("mean"),
            total(F.transform(F.array_distinct(t["x"]), lambda v: F.pow(F.size(F.filter(t["x"], lambda y: y == v)).cast("double"), F.lit(2.0)))).alias("squares"),
            total(pairs(t["cls"], lambda v, w: (v != w).cast("double"))).alias("changes"),
        ),
    )
    moments = F.transform(
        counted,
        lambda t: F.struct(
            t["start"].alias("start"), t["end"].alias("end"), t["encoding"].alias("encoding"), t["n"].alias("n"), t["changes"].alias("changes"),
            (t["a"] * t["squares"] / t["n"] - t["n"]).alias("chi2"), (t["a"] - 1).alias("df"),
            total(F.transform(t["x"], lambda v: (v - t["mean"]) * (v - t["mean"]))).alias("var"),
            total(pairs(t["x"], lambda v, w: (v - t["mean"]) * (w - t["mean"]))).alias("cov"),
        ),
    )
    drawn = {k: class_changes(v) for k, v in ALPHABETS.items()}
    once = lambda t: _by_encoding({k: v[0] for k, v in drawn.items()}, t["encoding"])
    twice = lambda t: _by_encoding({k: v[1] for k, v in drawn.items()}, t["encoding"])
    k = lambda t: 2 / (9 * t["df"])
    chi_p = lambda t: _tail((F.pow(t["chi2"] / t["df"], F.lit(1 / 3)) - (1 - k(t))) / F.sqrt(k(t)))
    spread = lambda t: F.sqrt((t["n"] - 1) * once(t) * (1 - once(t)) + 2 * (t["n"] - 2) * (twice(t) - once(t) * once(t)))
    runs_p = lambda t: 2 * _tail(F.abs(t["changes"] - (t["n"] - 1) * once(t)) / spread(t))
    serial = lambda t: F.when(t["var"] <= 0, 1.0).otherwise(t["cov"] / t["var"])
    serial_p = lambda t: 2 * _tail(F.abs(serial(t) + 1 / t["n"]) * F.sqrt(t["n"]))
    length_class = lambda t: sum((F.when(t["n"] >= step, 1).otherwise(0) for step in LENGTH_STEPS), F.lit(0))
    return F.transform(
        moments,
        lambda t: F.struct(
            t["start"].alias("start"), t["end"].alias("end"), t["encoding"].alias("encoding"), F.concat_ws("/", t["encoding"], length_class(t).cast("string")).alias("stratum"),
            F.coalesce(F.least(chi_p(t), runs_p(t), serial_p(t)) >= ALPHA / 3, F.lit(False)).alias("passes"),
            t["changes"].alias("changes"), (t["n"] - 1).alias("pairs"), ((t["chi2"] - t["df"]) / t["n"]).alias("excess"), serial(t).alias("serial"),
        ),
    )


def scan(docs: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """(row, base, tokens) of every row: the columns `carried` (all, unless given), spans of the three patterns by start,
    then kind, and tested candidates."""
    text = F.coalesce(F.col("text"), F.lit(""))
    long_enough = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= ASSIGN_LEAST)
    kinds = [_placed(text, ASSIGN, long_enough), _placed(text, ACCESS), _placed(text, HEX)]
    tagged = [_as_kind(spans, k) for k, spans in enumerate(kinds)]
    return docs.select(F.struct(*(carried or docs.columns)).alias("row"), F.array_sort(F.concat(*tagged)).alias("base"), _battery(_placed(text, CANDIDATE)).alias("tokens"))


def _p_value(token: Column, ordinary: dict[str, dict[str, float]]) -> Column:
    """The probability that an ordinary token looks as random: three times the least of the tests' tails."""
    of = lambda name: _by_encoding({e: v[name] for e, v in ordinary.items()}, token["encoding"])
    n, df = token["pairs"] + 1, _by_encoding({k: len(v) - 1.0 for k, v in ALPHABETS.items()}, token["encoding"])
    share, rate = token["changes"] / token["pairs"], of("rate")
    left = F.when(share >= 1, 0.0).otherwise((1 - share) * F.log((1 - share) / (1 - rate)))
    divergence = F.when(share <= rate, 0.0).otherwise(share * F.log(share / rate) + left)
    runs = F.exp(-token["pairs"] * divergence)  # Chernoff's bound on so many changes
    uniform = _tail((of("excess") - token["excess"]) / F.sqrt(2 * (df / n + 2 * of("excess")) / n + of("excess_var")))
    serial = _tail((of("serial") - F.abs(token["serial"])) / F.sqrt(1 / n + of("serial_var")))
    return F.when(token["passes"], F.least(F.lit(1.0), 3 * F.least(runs, uniform, serial))).otherwise(1.0)


def _grid(p: Column) -> Column:
    """Bin of a p-value: larger means smaller p; a p lies at or below 10 ** (-GRID_STEP * bin)."""
    return F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) / GRID_STEP + 1e-9), F.lit(GRID_BINS)).cast("int")


def thresholds(scanned: DataFrame) -> tuple[dict[str, dict[str, float]], dict[str, int]]:
    """What ordinary tokens of each encoding are like, and the least grid bin accepted in each stratum.

    Both come from counts over all candidates: a row for each encoding, and strata x bins rows, reach the driver.
    """
    tokens = scanned.select(F.explode("tokens").alias("t")).select("t.*")
    sums = [F.sum(c).alias(c) for c in ("changes", "pairs", "excess", "serial")] + [F.sum(F.col(c) * F.col(c)).alias(f"{c}2") for c in ("excess", "serial")]
    seen = {r["encoding"]: r for r in tokens.where(~F.col("passes")).groupBy("encoding").agg(F.count("*").alias("n"), *sums).collect()}
    ordinary = {}
    for name, alphabet in ALPHABETS.items():
        get = lambda c, r=seen.get(name): float(r[c] or 0) if r else 0.0
        excess = max(len(alphabet) * PRIOR_EQUAL - 1, 0.5)
        n = get("n") + PRIOR_TOKENS
        rate = (get("changes") + PRIOR_CHANGES) / (get("pairs") + PRIOR_PAIRS)
        mean = (get("excess") + PRIOR_TOKENS * excess) / n
        square = (get("excess2") + PRIOR_TOKENS * 1.25 * excess * excess) / n
        serial = get("serial") / n
        serial_square = (get("serial2") + PRIOR_TOKENS * PRIOR_SERIAL**2) / n
        ordinary[name] = {"rate": min(max(rate, 0.02), 0.3), "excess": mean, "excess_var": max(square - mean * mean, 0.0), "serial": serial, "serial_var": max(serial_square - serial * serial, 0.0)}
    p = _p_value({k: F.col(k) for k in ("encoding", "changes", "pairs", "excess", "serial", "passes")}, ordinary)
    counts: dict[str, dict[int, int]] = {}
    for r in tokens.groupBy("stratum", _grid(p).alias("bin")).count().collect():
        counts.setdefault(r["stratum"], {})[r["bin"]] = r["count"]
    cut = {}
    for stratum, bins in counts.items():
        m, reached = sum(bins.values()), 0
        for b in sorted(bins, reverse=True):
            reached += bins[b]
            if 10 ** (-GRID_STEP * b) <= FDR * reached / m:
                cut[stratum] = b
    return ordinary, cut


def find(docs: DataFrame, scanned: DataFrame | None = None, cuts: tuple[dict, dict[str, int]] | None = None) -> DataFrame:
    """(row, base, extra) of every row: its columns, base spans, and random tokens that no base span overlaps."""
    scanned = scan(docs) if scanned is None else scanned
    ordinary, cut = cuts or thresholds(scanned)
    least = F.create_map(*[F.lit(x) for kv in cut.items() for x in kv]) if cut else F.create_map().cast("map<string,int>")
    accepted = F.filter("tokens", lambda t: _grid(_p_value(t, ordinary)) >= F.coalesce(F.try_element_at(least, t["stratum"]), F.lit(GRID_BINS + 1)))
    random = F.transform(accepted, lambda t: F.struct(t["start"].alias("start"), F.lit(len(KINDS) - 1).alias("kind"), t["end"].alias("end")))
    chosen = scanned.select("row", "base", random.alias("random")).withColumn("sorted", F.array_sort(F.concat("base", "random")))
    far = 1 << 40
    ends = F.transform("sorted", lambda x: F.when(x["kind"] < len(KINDS) - 1, x["end"]).otherwise(-1).cast("long"))
    starts = F.reverse(F.transform("sorted", lambda x: F.when(x["kind"] < len(KINDS) - 1, x["start"]).otherwise(F.lit(far)).cast("long")))
    ringed = F.arrays_zip(F.col("sorted").alias("x"), prefix(ends, F.greatest, -1).alias("ended"), F.reverse(prefix(starts, F.least, far)).alias("next"))
    alone = F.filter(ringed, lambda y: (y["x"]["kind"] == len(KINDS) - 1) & (y["ended"] <= y["x"]["start"]) & (y["next"] >= y["x"]["end"]))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    extra = F.when(F.size("random") == 0, none).when(F.size("base") == 0, F.col("random")).otherwise(F.transform(alone, lambda y: y["x"]))
    return chosen.select("row", "base", extra.alias("extra"))


def spans_text(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def cut_out(text: Column, spans: Column, mark: str) -> Column:
    """`text` with every one of `spans` (by start) replaced by `mark`; overlapping ones leave one mark. The text is taken in
    pieces of about the square root of its length, each with the spans that reach into it."""

    def renewed(x: Column, spans: Column, width: Column) -> Column:
        low, piece = x["low"], x["piece"]
        own = F.filter(spans, lambda span: (span["start"] < low + width) & (span["end"] > low))

        def step(acc: Column, span: Column) -> Column:
            fresh = (span["start"] >= acc["at"]) & (span["start"] >= low)
            said = F.when(fresh, F.concat(acc["out"], F.substring(piece, acc["at"] - low + 1, span["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], span["end"]).alias("at"), said.alias("out"))

        rest = lambda acc: F.when(acc["at"] < low + width, F.concat(acc["out"], F.substring(piece, acc["at"] - low + 1, width))).otherwise(acc["out"])
        return F.aggregate(own, F.struct(low.alias("at"), F.lit("").alias("out")), step, rest)

    def pieces(text: Column, length: Column, width: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((length - 1) / width).cast("int")), lambda k: F.struct((k * width).alias("low"), F.substring(text, k * width + 1, width).alias("piece")))

    width = lambda length: F.greatest(F.lit(256), F.ceil(F.sqrt(length.cast("double")))).cast("int")
    joined = lambda text, spans, length, w: F.array_join(F.transform(pieces(text, length, w), lambda x: renewed(x, spans, w)), "")
    return let(text, lambda t: let(spans, lambda s: let(F.length(t), lambda n: let(width(n), lambda w: joined(t, s, n, w)))))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every found span of `text` replaced by `mark` and `n_chars` renewed. The texts are scanned twice, for the
    corpus's cut and for the spans, so that no text passes through a shuffle."""
    cuts = thresholds(materialise(scan(docs, ["text"]).select("tokens")))
    found = find(docs, cuts=cuts).select("row", F.array_sort(F.concat("base", "extra")).alias("spans"))
    hit, text = F.size("spans") > 0, F.col("row")["text"]
    renewed = found.withColumn("text", F.when(hit, cut_out(text, F.col("spans"), mark)).otherwise(text))
    fresh = {"text": F.col("text"), "n_chars": F.when(hit, F.length("text").cast("long")).otherwise(F.col("row")["n_chars"]) if "n_chars" in docs.columns else None}
    return renewed.select(*[(fresh[c] if c in fresh else F.col("row")[c]).alias(c) for c in docs.columns])


def op3_secrets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs, scanned=materialise(scan(docs, ["doc_id"])))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    everything = F.array_sort(F.concat("base", "extra"))
    return found.select(
        "row.doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(everything).alias("spans"),
        F.size("extra").cast("long").alias("n_random"),
    )
