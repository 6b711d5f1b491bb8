"""Lazy search: evidence is gathered in rounds under a budget. What a model would judge comes in as seams: functions of
Columns, deterministic by default."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.text import sentences, text
from lumenfold.operators.lexical import overlap
from lumenfold.storage import dealt, materialise

HIGH, MEDIUM, LOW = 2, 1, 0
BATCH = 5
SAMPLE = 50


def relevance(query: str) -> Callable[[Column], Column]:
    """The default judge: the share of the query's words in the text. (seam)"""

    def judge(body: Column) -> Column:
        share = overlap(query, body)
        return F.when(share >= 0.6, HIGH).when(share >= 0.3, MEDIUM).otherwise(LOW)

    return judge


def relevant(rows: DataFrame, judge: Callable[[Column], Column], body: str = "text", least: int = MEDIUM) -> DataFrame:
    """Rows judged at least MEDIUM, with `relevance`."""
    return rows.withColumn("relevance", judge(F.col(body))).where(F.col("relevance") >= least)


def by_relevance(rows: DataFrame, judge: Callable[[Column], Column], body: str = "text") -> DataFrame:
    """(relevance, n)."""
    return rows.select(judge(F.col(body)).alias("relevance")).groupBy("relevance").agg(F.count("*").alias("n"))


def claims(rows: DataFrame, query: str, each: int = 3, key: str = "id", body: str = "text") -> DataFrame:
    """(key, pos, claim): sentences that share a word with the query, at most `each` a text. (seam)"""
    kept = F.slice(F.filter(sentences(text(body)), lambda s: overlap(query, s) > 0), 1, each)
    return rows.select(key, F.posexplode(kept).alias("pos", "claim"))


def normal_claim(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(c)), r"\s+", " ")


def distinct_claims(found: DataFrame, order: list, body: str = "claim") -> DataFrame:
    """The first of each claim, by its normalised text."""
    rank = F.row_number().over(Window.partitionBy(normal_claim(F.col(body))).orderBy(*order))
    return found.withColumn("_nth", rank).where("_nth = 1").drop("_nth")


def pop(queue: DataFrame, visited: DataFrame, n: int = BATCH, key: str = "id") -> DataFrame:
    """The n best of the queue that were not visited."""
    return queue.join(visited, key, "left_anti").orderBy(F.desc("priority"), key).limit(n)


def search(queue: DataFrame, query: str, judge: Callable[[Column], Column] | None = None, rounds: int = 5, calls: int = 20, enough: int = 3) -> DataFrame:
    """(id, round, claim) gathered from a queue (id, priority, text): pop, judge, extract, until there are claims enough, no
    calls or no candidates left. (V21)"""
    judge = judge or relevance(query)
    spark = queue.sparkSession
    queue = materialise(queue)
    visited = queue.select("id").limit(0)
    found = spark.createDataFrame([], "id long, round int, claim string")
    for k in range(1, rounds + 1):
        if (k - 1) * BATCH >= calls:
            break
        batch = materialise(pop(queue, visited))
        if batch.isEmpty():
            break
        visited = materialise(visited.unionByName(batch.select("id")))
        new = claims(relevant(batch, judge), query).select("id", F.lit(k).alias("round"), "claim")
        found = materialise(distinct_claims(found.unionByName(new), ["round", "id", "claim"]))
        if found.count() >= enough:
            break
    return found


def deterministic_sample(rows: DataFrame, n: int, key: str = "id") -> DataFrame:
    """Stands in for a random sample: the first n by a hash of the key."""
    return rows.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)


def deepen(rows: DataFrame, processed: DataFrame, hits: DataFrame, n: int, key: str = "id", document: str = "document_id") -> DataFrame:
    """The next n unprocessed rows: those of documents that had hits first, then by hash."""
    docs = rows.join(hits, key, "left_semi").select(document).distinct().withColumn("same", F.lit(1))
    left = rows.join(processed, key, "left_anti").join(docs, document, "left")
    return left.orderBy(F.coalesce("same", F.lit(0)).desc(), F.md5(F.col(key).cast("string")), key).limit(n).drop("same")


def gather(rows: DataFrame, query: str, threshold: float = 0.3, budget: int = 200, enough: int = 50, rounds: int = 5, sample: int = SAMPLE) -> DataFrame:
    """(id, round, sentence, score): sentences tested against the query in samples that deepen around hits, until the
    budget is spent or there is evidence enough. rows: (id, document_id, text). (V23)"""
    spark = rows.sparkSession
    rows = materialise(rows)
    processed, hits = rows.select("id").limit(0), rows.select("id").limit(0)
    found = spark.createDataFrame([], "id long, round int, sentence string, score double")
    spent = 0
    for k in range(1, rounds + 1):
        batch = materialise(deepen(rows, processed, hits, sample) if k > 1 else deterministic_sample(rows, sample))
        if batch.isEmpty():
            break
        processed = materialise(processed.unionByName(batch.select("id")))
        tested = batch.select("id", F.explode(sentences(text("text"))).alias("sentence")).withColumn("score", F.round(overlap(query, F.col("sentence")), 6))
        new = materialise(tested.orderBy(F.desc("score"), "id", "sentence").limit(budget - spent))
        spent += new.count()
        good = new.where(F.col("score") >= threshold)
        hits = hits.unionByName(good.select("id").distinct())
        found = materialise(found.unionByName(good.select("id", F.lit(k).alias("round"), "sentence", "score")))
        if spent >= budget or found.count() >= enough:
            break
    return found


def _worded(found: DataFrame, key: str, body: str) -> DataFrame:
    """(key, w): the distinct words of each claim, in order."""
    return found.select(key, F.array_sort(F.array_distinct(F.split(F.lower(F.trim(body)), r"\s+"))).alias("w"))


def _classes(found: DataFrame, key: str, body: str) -> tuple[DataFrame, DataFrame]:
    """(row, w), the words of one claim of all those with the same words, and (key, row) of all claims. A null claim has none.
    Word lists are dealt out once, by row, and stay there for what they are joined with."""
    lists = _worded(found, key, body).where("w IS NOT NULL").withColumn("row", F.monotonically_increasing_id())
    lists = dealt(lists.withColumn("words", F.sha2(F.array_join("w", " "), 256)), "row")
    names = materialise(lists.select(key, "row", "words"))
    firsts = names.groupBy("words").agg(F.min("row").alias("first"))
    member = materialise(names.join(firsts, "words").select(key, "row", "first"))
    some = member.where("row = first").select("row")
    return lists.select("row", "w").join(some.hint("shuffle_hash"), "row", "left_semi"), member.select(key, F.col("first").alias("row"))


def _size_classes(least: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first sizes of classes such that similar sets are in one class or in neighbouring ones, and for each class in how
    many parts words are dealt: one more than similar sets differ in, the smaller of them in the class."""
    starts = [1]
    while starts[-1] <= most:
        starts.append(max(starts[-1] + 1, math.floor(starts[-1] / least + 1e-9)))
    last = np.array(starts[1:]) - 1
    return np.array(starts[:-1]), np.floor((1 - least) / (1 + least) * (last + np.floor(last / least + 1e-9)) + 1e-6).astype(int) + 1


#: Parts with fewer words are weak; a class has one more part for so many that it needs.
WEAK, SPARE = 2, 6


def _parts(worded: DataFrame, least: float, key: str) -> DataFrame:
    """(key, n, t, u, v): for each claim a hash of the words in each of its parts, and two parity words of all of them.

    Words are dealt to more parts than similar sets can differ in, so some parts of two similar sets are the same. A claim has the
    parts of its own size class and of the one below, where smaller ones look for it. Parts of fewer than WEAK words, which
    unlike claims have in common, are left out where a claim has others enough: more than similar sets can differ in."""
    hashed = worded.where("w IS NOT NULL").select(key, F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    most = hashed.agg(F.max(F.size("h"))).first()[0] or 1
    starts, parts = _size_classes(least, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes, met, odd = [], [], [], []
            for i, value in enumerate(batch.column(1)):
                own = value.values.to_numpy().view("<u8")
                bits = np.bincount((own >> np.uint64(50)).astype(int) & 127, minlength=128) & 1
                parity = np.packbits(bits.astype(np.uint8)).view("<i8")
                mixed = (own ^ (own >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                at = int(np.searchsorted(starts, len(own), "right")) - 1
                for c in range(max(at - 1, 0), at + 1):
                    most = parts[c] + parts[c] // SPARE
                    sums = np.arange(most).astype("<u8") * np.uint64(0xD6E8FEB86659FD93) + np.uint64(c * 0x632BE59BD9B4E019 & (1 << 64) - 1)
                    part = ((own >> np.uint64(8)) % np.uint64(most)).astype(int)
                    np.add.at(sums, part, mixed)
                    strong = np.bincount(part, minlength=most) >= WEAK
                    if strong.sum() >= parts[c]:
                        sums = sums[strong]
                    met.append(sums.view("<i8"))
                    rows.append(np.full(len(sums), i))
                    sizes.append(np.full(len(sums), len(own), np.int32))
                    odd.append(np.tile(parity, (len(sums), 1)))
            if rows:
                both = np.concatenate(odd)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(rows))), *map(pa.array, (np.concatenate(sizes), np.concatenate(met), np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])))], names=[key, "n", "t", "u", "v"])

    return hashed.mapInArrow(run, f"{key} {worded.schema[key].dataType.simpleString()}, n int, t long, u long, v long")


def _similar_pairs(worded: DataFrame, least: float, key: str) -> DataFrame:
    """(kept, dropped): pairs of different word sets (key, w) as similar as `least`, the smaller key first.

    Pairs meet in a part that both have the same (`_parts`), where their sizes allow it and their parities differ in no more
    places than similar sets have different words; pairs of larger sets are told apart by longer parities first (`_parities`)."""
    held = materialise(_parts(worded, least, key))
    side = lambda name: held.select(F.col(key).alias(name), "t", *(F.col(c).alias(f"{c}_{name}") for c in ("n", "u", "v")))
    few, many = F.least("n_kept", "n_dropped"), F.greatest("n_kept", "n_dropped")
    apart = F.bit_count(F.col("u_kept").bitwiseXOR(F.col("u_dropped"))) + F.bit_count(F.col("v_kept").bitwiseXOR(F.col("v_dropped")))
    near = (few >= least * many) & (apart <= (1 - least) / (1 + least) * (few + many) + 1e-6)
    pairs = side("kept").join(side("dropped"), "t").where((F.col("kept") < F.col("dropped")) & near).select("kept", "dropped").distinct()
    longer = materialise(_parities(worded, key))
    of = lambda name: longer.select(F.col(key).alias(name), F.col("n").alias(f"n_{name}"), F.col("odd").alias(f"odd_{name}"))
    both = materialise(pairs).join(of("kept"), "kept").join(of("dropped"), "dropped")
    # of two lengths: left to `_verified`
    apart = F.aggregate(F.zip_with("odd_kept", "odd_dropped", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda x, y: x + F.coalesce(y, F.lit(0)))
    near = apart <= (1 - least) / (1 + least) * (F.col("n_kept") + F.col("n_dropped")) + 1e-6
    pairs = both.where(near | (F.size("odd_kept") != F.size("odd_dropped"))).select("kept", "dropped")
    return _verified(materialise(pairs), worded, least, key)


#: Sets from so many words on have parities of 2,048 bits, others of 512.
LARGE = 800


def _parities(worded: DataFrame, key: str) -> DataFrame:
    """(key, n, odd): for each bit whether an odd number of a claim's words fall on it. A word more or less turns one bit."""
    hashed = worded.where("w IS NOT NULL").select(key, F.transform("w", lambda w: F.xxhash64(w)).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [value.values.to_numpy().view("<u8") for value in batch.column(1)]
            odd = []
            for x in own:
                bits = 11 if len(x) >= LARGE else 9
                odd.append(np.packbits((np.bincount((x >> np.uint64(64 - bits)).astype(int), minlength=1 << bits) & 1).astype(np.uint8)).view("<i8"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in own], pa.int32()), pa.array(odd, pa.list_(pa.int64()))], names=[key, "n", "odd"])

    return hashed.mapInArrow(run, f"{key} {worded.schema[key].dataType.simpleString()}, n int, odd array<long>")


#: Word sets that come together to be compared, on either side.
CHUNK = 128


def _verified(pairs: DataFrame, worded: DataFrame, least: float, key: str) -> DataFrame:
    """Those of `pairs` (kept, dropped) whose word sets are as similar as `least`.

    Sets that meet one another mostly meet the same first one, too. By it they are put into chunks, and the pairs of two chunks
    are compared in one place, so a set goes there once however many pairs it has."""
    ends = F.explode(F.array(F.struct(F.col("kept").alias(key)), F.struct(F.col("dropped").alias(key)))).alias("end")
    nodes = pairs.select("kept", ends).groupBy(F.col(f"end.{key}").alias(key)).agg(F.min("kept").alias("root"))
    sizes = nodes.groupBy("root").agg(F.count("*").alias("size"))
    chunk = F.struct("root", F.pmod(F.xxhash64(key), F.ceil(F.col("size") / CHUNK)).alias("part"))
    placed = materialise(nodes.join(sizes, "root").select(key, chunk.alias("chunk")))
    for c in ("kept", "dropped"):
        pairs = pairs.join(placed.select(F.col(key).alias(c), F.col("chunk").alias(f"{c}_at")), c)
    cell = F.xxhash64(F.least("kept_at", "dropped_at"), F.greatest("kept_at", "dropped_at"))
    pairs = materialise(pairs.select("kept", "dropped", cell.alias("cell")))
    cells = pairs.select(F.col("cell").alias("at"), ends).select("at", f"end.{key}").distinct()
    there = worded.join(cells.hint("shuffle_hash"), key).select("at", key, "w")

    def run(words: pa.Table, asked: pa.Table) -> pa.Table:
        asked = asked.select(["kept", "dropped"])
        if not len(words) or not len(asked):
            return asked.slice(0, 0)
        lists = words["w"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        codes = lists.flatten().dictionary_encode().indices.to_numpy()
        at = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
        sets = {row: codes[at[i] : at[i + 1]] for i, row in enumerate(words[key].to_pylist())}
        near = []
        for a, b in zip(asked["kept"].to_pylist(), asked["dropped"].to_pylist(), strict=True):
            common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            near.append(common / (len(sets[a]) + len(sets[b]) - common) >= least)
        return asked.filter(pa.array(near))

    kind = worded.schema[key].dataType.simpleString()
    return there.groupBy("at").cogroup(pairs.groupBy("cell")).applyInArrow(run, f"kept {kind}, dropped {kind}")


def similar_claims(found: DataFrame, least: float = 0.85, key: str = "claim_id", body: str = "claim") -> DataFrame:
    """(kept, dropped): all pairs of claims whose words are similar, the earlier one first. Claims of the same words are one until their pairs
    are known, and others meet on a part of their words, so nothing is lost and no cross join is made. `first_claims` has a row a
    claim where pairs would be too many. (V25)"""
    worded, member = _classes(found, key, body)
    pairs = materialise(_similar_pairs(worded, least, "row"))
    same = member.select(F.col("row").alias("a")).distinct().withColumn("b", F.col("a"))
    # both ways, since which of two claims is the earlier one is theirs to say
    every = same.unionByName(pairs.toDF("a", "b")).unionByName(pairs.toDF("b", "a"))
    left, right = (member.select(F.col(key).alias(name), F.col("row").alias(at)) for name, at in (("kept", "a"), ("dropped", "b")))
    return every.join(left, "a").join(right, "b").where("kept < dropped").select("kept", "dropped")


def first_claims(found: DataFrame, least: float = 0.85) -> DataFrame:
    """(claim_id, kept, into): whether a claim stays when claims are gone through in order and each that is similar to one that
    stayed is dropped, and the earliest such one. found: (claim_id, claim); a null claim or id is passed over. (V25)

    Claims of the same words are one class under the earliest of them. Among classes the sequential result is found in
    rounds: a class stays once every earlier one that it is similar to is dropped, and is dropped once one of them stays.
    A round decides at least the first open class of every connected group, in practice nearly all."""
    worded, member = _classes(found.where("claim IS NOT NULL AND claim_id IS NOT NULL").dropDuplicates(["claim_id"]), "claim_id", "claim")
    firsts = materialise(member.groupBy("row").agg(F.min("claim_id").alias("first")))
    member = materialise(member.join(firsts, "row").select("claim_id", "first"))
    pairs = materialise(_similar_pairs(worded, least, "row"))
    for c in ("kept", "dropped"):
        pairs = pairs.join(firsts.select(F.col("row").alias(c), F.col("first").alias(f"{c}_first")), c)
    pairs = materialise(pairs.select(F.least("kept_first", "dropped_first").alias("kept"), F.greatest("kept_first", "dropped_first").alias("dropped")))
    classes = firsts.select(F.col("first").alias("claim_id"))
    open_ = materialise(classes.select("claim_id"))
    stays, left = open_.join(pairs.select(F.col("dropped").alias("claim_id")).distinct(), "claim_id", "left_anti"), pairs
    open_ = open_.join(pairs.select(F.col("dropped").alias("claim_id")).distinct(), "claim_id", "left_semi")
    decided = materialise(stays.select("claim_id", F.lit(True).alias("kept")))
    while not left.isEmpty():
        told = left.join(decided.select(F.col("claim_id").alias("kept"), F.col("kept").alias("stays")), "kept", "left")
        state = told.groupBy("dropped").agg(F.bool_or(F.coalesce("stays", F.lit(False))).alias("hit"), F.bool_and(F.coalesce(~F.col("stays"), F.lit(False))).alias("free"))
        new = state.where("hit OR free").select(F.col("dropped").alias("claim_id"), (~F.col("hit")).alias("kept"))
        decided = materialise(decided.unionByName(new))
        left = materialise(left.join(decided.select(F.col("claim_id").alias("dropped")), "dropped", "left_anti"))
    hit = pairs.join(decided.where("kept").select(F.col("claim_id").alias("kept")), "kept", "left_semi").groupBy("dropped").agg(F.min("kept").alias("into"))
    named = decided.join(hit, F.col("claim_id") == F.col("dropped"), "left").select(F.col("claim_id").alias("first"), "kept", F.when(~F.col("kept"), F.col("into")).alias("into"))
    all_ = member.join(named, "first")
    own = F.col("claim_id") == F.col("first")
    return all_.select("claim_id", (F.col("kept") & own).alias("kept"), F.when(own, F.col("into")).otherwise(F.coalesce("into", "first")).alias("into"))


def merged_claims(found: DataFrame, least: float = 0.85) -> DataFrame:
    """(claim, sources) of each claim that stays in order, with the sources of those that were dropped for it.
    found: (claim_id, claim, source). (V25)"""
    at = first_claims(found, least).select("claim_id", F.coalesce("into", "claim_id").alias("first"))
    named = found.select("claim_id", "source").join(at, "claim_id").groupBy("first").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    # the first of a claim and of those that were dropped for it is the claim itself
    texts = found.where("claim IS NOT NULL").select("claim_id", "claim").dropDuplicates(["claim_id"])
    return texts.join(named.withColumnRenamed("first", "claim_id"), "claim_id").select("claim", "sources")


def concept_subgraph(nodes: DataFrame, edges: DataFrame, chunks: list) -> tuple[DataFrame, DataFrame]:
    """Nodes (title, frequency, units) that stand in one of the chunks, and the edges among them."""
    some = nodes.where(F.arrays_overlap("units", F.array(*map(F.lit, chunks))))
    names = some.select("title")
    inner = edges.join(names.withColumnRenamed("title", "source"), "source", "left_semi").join(names.withColumnRenamed("title", "target"), "target", "left_semi")
    return some, inner


def zero_runs(tests: DataFrame, by: str = "session", order: str = "pos") -> DataFrame:
    """Consecutive misses so far: reset by a hit."""
    hits = F.sum(F.when(F.col("hit"), 1).otherwise(0)).over(Window.partitionBy(by).orderBy(order))
    grouped = tests.withColumn("_run", hits)
    misses = F.sum(F.when(F.col("hit"), 0).otherwise(1)).over(Window.partitionBy(by, "_run").orderBy(order))
    return grouped.withColumn("zeros", misses.cast("int")).drop("_run")


def qa_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, qa, question, answers): a user's turn opens, later turns attach, what comes before the first is dropped.
    (V30)"""
    opened = F.sum((F.col("role") == "user").cast("int")).over(Window.partitionBy("conv_id").orderBy("turn"))
    placed = turns.withColumn("qa", opened.cast("int")).where("qa > 0")
    answers = F.transform(F.array_sort(F.collect_list(F.when(F.col("role") != "user", F.struct("turn", "text")))), lambda s: s["text"])
    return placed.groupBy("conv_id", "qa").agg(F.max(F.when(F.col("role") == "user", F.col("text"))).alias("question"), F.array_join(answers, "\n").alias("answers"))


def last_user_turns(turns: DataFrame, n: int = 5) -> DataFrame:
    """(V31)"""
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.where("role = 'user'").withColumn("nth", nth).where(F.col("nth") <= n)


def expanded(query: str, more: list[str] | None, most: int = 5) -> list[str]:
    """The query's subqueries, or the query itself where there are none."""
    return [q for q in dict.fromkeys(more or []) if q.strip()][:most] or [query]
