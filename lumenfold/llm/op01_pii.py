"""Personal data: base patterns, and terms that disclose the entities behind them.

The protected entities are the values that the base patterns find (addresses, numbers). What else gives an entity
away is measured on the corpus. With probabilities from document counts,

    PMI(t; e) = log(N * n(t, e) / (n(t) * n(e)))        IC(e) = log(N / n(e))

a term t that is seen near an entity e discloses it when PMI(t; e) >= DISCLOSURE * IC(e): knowing t then yields at
least that share of the information that e itself holds. Near means within WINDOW words of a mention. A pair counts
only if at least MIN_CONTEXTS different wordings show it, so copies of one text prove nothing. A term that discloses an
entity is marked wherever it stands, in documents that do not name the entity too, since there it discloses what base
patterns do not catch. `sanitise` replaces base spans by their kind, and disclosing terms by a class (a number, a name)
or, if they have none, removes them.

Passes over the texts: one finds entities and the terms near them; one counts n(t) over all documents, for terms that
a bitmap of bounded size admits; one marks the disclosing terms, if there are any, admitted by a bitmap and then joined
exactly. Pairs grow with mentions, not with their square. Counts are combined before they are shuffled, and hot pairs
meet only in equi-joins of written tables, which adaptive execution splits.

Defined results: null text counts as empty; a document's spans depend on its text alone, so rows of null or repeated
doc_id are rows like others, and equal rows give equal results; empty tables give empty results; extra columns are
ignored by `spans` and pass through `sanitise`, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.bitmaps import bitmap_of
from lumenfold.storage import materialise

#: The kinds in order and their patterns. A match never begins inside a run of digits, so the
#: look-behinds change nothing but the time that long runs take.
KINDS = ("email", "ip", "card", "phone")
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"\w+")

WINDOW = 8
DISCLOSURE = 0.8
MIN_CONTEXTS = 2
MIN_LETTERS = 3
#: Terms that a task counts before it hands its counts on.
HELD_TERMS = 200_000
#: Up to so many disclosing terms go to the tasks as they are (8 MB).
EXACT_TERMS = 1_000_000
#: Marked texts are broadcast to `sanitise` while they hold no more spans than this; beyond it texts are shuffled.
BROADCAST_SPANS = 200_000


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every base match, sorted."""
    spans = []
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        host = EMAIL_HOST.match(text, at + 1) if start < at else None
        if host:
            spans.append((start, 0, host.end()))
            done = host.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(int(p) <= 255 if len(p) < 20 else int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split(".")):
            spans.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                spans.append((m.start(), 3, m.end()))
    spans.sort()
    return spans


def _key(data: str) -> int:
    n = xxhash.xxh64_intdigest(data.encode())
    return n - (1 << 64) if n >> 63 else n


def entity(kind: int, value: str) -> int:
    plain = value.lower() if kind == 0 else value if kind == 1 else "".join(c for c in value if c in "0123456789")
    return _key(f"{KINDS[kind]}:{plain}")


def _words_around(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int, str]]]]:
    """For each span: its entity, a hash of its wording, and (start, end, term) of the terms near it."""
    for i, (start, kind, end) in enumerate(spans):
        after = []
        for m in WORD.finditer(text, end):
            after.append((m.start(), m.end()))
            if len(after) == WINDOW:
                break
        reach, before = 16 * WINDOW, []
        while True:  # words end at non-word characters, so the piece before is widened until it holds enough
            low = max(0, start - reach)
            before = [(m.start(), m.end()) for m in WORD.finditer(text, low, start)]
            before = before[1:] if low and before and before[0][0] == low else before
            if len(before) >= WINDOW or not low:
                break
            reach *= 4
        near = before[-WINDOW:] + after
        others = [s for s in spans[max(0, i - 64) : i + 64] if s[2] > (near[0][0] if near else start) and s[0] < (near[-1][1] if near else end)]
        terms = [(a, b, text[a:b].lower()) for a, b in near if b - a >= MIN_LETTERS and not any(a < s[2] and s[0] < b for s in others)]
        yield entity(kind, text[start:end]), _key(" ".join(t for _, _, t in terms)), terms


def text_key(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


FOUND = "doc_id {id}, text_key binary, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<start:int,kind:int,end:int>>, entities array<long>, near array<struct<e:long,t:long,w:long,start:int,end:int>>"


def scan(docs: DataFrame) -> DataFrame:
    """Base spans, entities, and terms near them, of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("text_key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "entities", "near")}
            for value in batch.column(1):
                text = value.as_py() or ""
                rows["text_key"].append(text_key(text))
                spans = base_spans(text)
                counts = Counter(k for _, k, _ in spans)
                for k, kind in enumerate(KINDS):
                    rows[f"n_{kind}"].append(counts[k])
                rows["base_sha256"].append(hashlib.sha256(spans_text(spans).encode()).hexdigest())
                rows["base"].append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
                near, seen = [], set()
                for e, w, terms in _words_around(text, spans):
                    seen.add(e)
                    near += [{"e": e, "t": _key(t), "w": w, "start": a, "end": b} for a, b, t in terms]
                rows["entities"].append(sorted(seen))
                rows["near"].append(near)
            types = {"base": pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])), "entities": pa.list_(pa.int64()), "near": pa.list_(pa.struct([("e", pa.int64()), ("t", pa.int64()), ("w", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])), "base_sha256": pa.string(), "text_key": pa.binary()}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, types.get(k, pa.int64())) for k, v in rows.items())], names=["doc_id", *rows])

    return docs.select("doc_id", "text").mapInArrow(run, FOUND.format(id=docs.schema["doc_id"].dataType.simpleString()))


def document_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(t, n_t): in how many documents each of `terms` occurs. Other terms that share a bit of the bitmap may be
    counted too."""
    held = docs.sparkSession.sparkContext.broadcast(bitmap_of(terms, "t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        counts: Counter[int] = Counter()

        def out() -> pa.RecordBatch:
            t = np.fromiter(counts.keys(), "<u8", len(counts)).view("<i8")
            return pa.RecordBatch.from_arrays([pa.array(t), pa.array(np.fromiter(counts.values(), np.int64, len(counts)))], names=["t", "n"])

        for batch in batches:
            for value in batch.column(0):
                words = {w for w in WORD.findall((value.as_py() or "").lower()) if len(w) >= MIN_LETTERS}
                if not words:
                    continue
                hashes = np.fromiter((digest(w.encode()) for w in words), np.uint64, len(words))
                counts.update(hashes[held.value.admits(hashes)].tolist())
                if len(counts) > HELD_TERMS:
                    yield out()
                    counts.clear()
        yield out()

    return docs.select("text").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n_t"))


def disclosures(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The scanned documents, and (e, t, n_et, n_e, n_t, pmi, ic) of every term that discloses an entity."""
    found = materialise(scan(docs))
    total = found.count()
    pair = F.explode(F.array_distinct(F.transform("near", lambda x: F.struct(x["e"].alias("e"), x["t"].alias("t"), x["w"].alias("w"))))).alias("p")
    # rows of one (e, t, w) are documents that show the pair in this wording
    wordings = found.select(pair).select("p.*").groupBy("e", "t", "w").agg(F.count("*").alias("n"))
    candidates = materialise(wordings.groupBy("e", "t").agg(F.sum("n").alias("n_et"), F.count("*").alias("wordings")).where(F.col("wordings") >= MIN_CONTEXTS))
    n_e = materialise(found.select(F.explode("entities").alias("e")).groupBy("e").agg(F.count("*").alias("n_e")))
    n_t = materialise(document_counts(docs, candidates.select("t").distinct()))
    scored = candidates.join(n_e, "e").join(n_t, "t").withColumn("n_et", F.least("n_et", "n_t", "n_e"))  # a document may show a pair in two wordings
    scored = scored.withColumn("pmi", F.log(F.lit(float(total)) * F.col("n_et") / (F.col("n_t") * F.col("n_e")))).withColumn("ic", F.log(F.lit(float(total)) / F.col("n_e")))
    return found, materialise(scored.where(F.col("pmi") >= DISCLOSURE * F.col("ic")).where("ic > 0").drop("wordings"))


class Exact:
    """Admits just the hashes it holds, 8 bytes each."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.sort(hashes.view("<u8"))

    def admits(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return self.sorted[at] == hashes


def marked(docs: DataFrame, disclosing: DataFrame) -> DataFrame:
    """(text_key, terms): where disclosing terms stand in each text that holds some, outside of base spans.

    Up to EXACT_TERMS terms go to the tasks as they are, and a text's row is complete there; more go as a bitmap, and the words
    that it admits are joined with the terms."""
    terms = materialise(disclosing.select("t").distinct())
    kind = "array<struct<start:int,end:int>>"
    count = terms.count()
    if not count:
        return docs.sparkSession.createDataFrame([], f"text_key binary, terms {kind}")
    exact = count <= EXACT_TERMS
    held = docs.sparkSession.sparkContext.broadcast(Exact(terms.toArrow().column("t").to_numpy()) if exact else bitmap_of(terms, "t"))
    place = pa.struct([("t", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            keys, found = [], []
            for value in batch.column(0):
                text = value.as_py() or ""
                words = [w for w in set(WORD.findall(text.lower())) if len(w) >= MIN_LETTERS]
                hashes = np.fromiter((digest(w.encode()) for w in words), np.uint64, len(words))
                admitted = held.value.admits(hashes) if words else np.zeros(0, bool)
                if admitted.any():
                    wanted = {w for w, hit in zip(words, admitted.tolist(), strict=True) if hit}
                    base, k, reach, own = base_spans(text), 0, 0, []
                    for m in WORD.finditer(text):
                        if m[0].lower() in wanted:
                            while k < len(base) and base[k][0] < m.end():
                                reach, k = max(reach, base[k][2]), k + 1
                            if reach <= m.start():
                                own.append({"t": _key(m[0].lower()), "start": m.start(), "end": m.end()})
                    if own:
                        keys.append(text_key(text))
                        found.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.list_(place))], names=["text_key", "places"])

    places = docs.select("text").mapInArrow(run, "text_key binary, places array<struct<t:bigint,start:int,end:int>>").dropDuplicates(["text_key"])
    if exact:
        return materialise(places.select("text_key", F.transform("places", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("terms")))
    each = materialise(places).select("text_key", F.explode("places").alias("p")).select("text_key", "p.*")
    return materialise(each.join(terms, "t").groupBy("text_key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("terms")))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, base counts and digest, `base`, and `terms`: array<struct<start,end>> of disclosing terms."""
    found, disclosing = disclosures(docs)
    none = F.array().cast("array<struct<start:int,end:int>>")
    return found.drop("near", "entities").join(marked(docs, disclosing), "text_key", "left").withColumn("terms", F.coalesce("terms", none)).drop("text_key")


def sanitise(docs: DataFrame) -> DataFrame:
    """`docs` with `text` sanitised: base spans become `[KIND]`, disclosing terms `[NUMBER]` or `[NAME]` or nothing."""
    places = marked(docs, disclosures(docs)[1])
    if (places.agg(F.sum(F.size("terms"))).first()[0] or 0) <= BROADCAST_SPANS:
        places = F.broadcast(places)
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_key"))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column(0).flatten()
            out = []
            for value, terms in zip(columns[place], batch.column(1), strict=True):
                text = value.as_py()
                if text is not None:
                    cuts = [(a, b, f"[{KINDS[k].upper()}]") for a, k, b in base_spans(text)]
                    for x in terms.as_py() or ():
                        word = text[x["start"] : x["end"]]
                        cuts.append((x["start"], x["end"], "[NUMBER]" if any(c.isdigit() for c in word) else "[NAME]" if word[:1].isupper() else ""))
                    parts, at = [], 0
                    for a, b, mark in sorted(cuts):
                        if a >= at:
                            parts += [text[at:a], mark]
                            at = b
                    text = "".join([*parts, text[at:]])
                out.append(text)
            columns[place] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=docs_names)

    docs_names = docs.columns
    return packed.join(places, "text_key", "left").select("row", "terms").mapInArrow(run, docs.schema)


def op1_pii(spark, sf_dir):
    found = spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kinds = F.array(*map(F.lit, KINDS), F.lit("term"))
    extra = F.transform("terms", lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), x["end"].alias("end")))
    everything = F.array_sort(F.concat("base", extra))
    text = F.array_join(F.transform(everything, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", text.alias("spans"), F.size("terms").cast("long").alias("n_term"))
