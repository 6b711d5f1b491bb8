"""Keywords: candidate phrases between stop words, RAKE scores, TF-IDF, frequent words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.text import WORD, text

#: English stop words.
STOP_WORDS = """
a about above after again against all am an and any are aren't as at be because been before being below between both but
by can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't has
hasn't have haven't having he he'd he'll he's her here here's hers herself him himself his how how's i i'd i'll i'm i've if
in into is isn't it it's its itself let's me more most mustn't my myself no nor not of off on once only or other ought our
ours ourselves out over own same shan't she she'd she'll she's should shouldn't so some such than that that's the their
theirs them themselves then there there's these they they'd they'll they're they've this those through to too under until up
very was wasn't we we'd we'll we're we've were weren't what what's when when's where where's which while who who's whom why
why's with won't would wouldn't you you'd you'll you're you've your yours yourself yourselves
also however thus therefore hence moreover furthermore although though whereas nevertheless nonetheless
et al etc ie eg cf vs
""".split()

#: Characters that end a phrase.
BREAKS = r"""[.!?,;:\n\t()\[\]{}"']+"""
MAX_WORDS = 4
MIN_CHARS = 2


def stopped(word: Column) -> Column:
    return F.array_contains(F.array(*map(F.lit, STOP_WORDS)), word)


def candidates(docs: DataFrame, key: str = "doc_id", body: str = "text", drop_numbers: bool = True) -> DataFrame:
    """(key, pos, phrase, n_words): maximal runs of words that hold no stop word, number or break.

    A row's words are joined with a line end for each stop word or break and split again, so runs are found within the row
    and nothing is shuffled; pos counts the ends before a run.
    """
    pieces = F.split(F.lower(text(body)), BREAKS)
    marked = F.flatten(F.transform(pieces, lambda p: F.concat(F.regexp_extract_all(p, F.lit(r"([\p{L}\p{N}_\-]+)"), F.lit(1)), F.array(F.lit("")))))

    def coded(word: Column) -> Column:
        ends = (word == "") | word.isin(STOP_WORDS)
        return F.when(ends | word.rlike(r"^\d+$") if drop_numbers else ends, "\n").otherwise(word)

    runs = F.split(F.array_join(F.transform(marked, coded), " "), "\n")
    placed = docs.select(key, F.posexplode(F.transform(runs, lambda r: F.trim(r))).alias("pos", "phrase"))
    sized = placed.where(F.length("phrase") >= MIN_CHARS).withColumn("n_words", F.size(F.split("phrase", " ")))
    return sized.where(F.col("n_words") <= MAX_WORDS)


def word_scores(phrases: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, word, freq, degree, score): score is (degree + freq) / freq, degree the other words of its phrases."""
    words = phrases.select(key, F.explode(F.split("phrase", " ")).alias("word"), (F.col("n_words") - 1).alias("others"))
    return words.groupBy(key, "word").agg(F.count("*").alias("freq"), F.sum("others").alias("degree")).withColumn("score", (F.col("degree") + F.col("freq")) / F.col("freq"))


def rake(docs: DataFrame, k: int = 10, key: str = "doc_id", body: str = "text") -> DataFrame:
    """(key, rank, phrase, score) of the k best phrases of each document; ties in alphabetical order."""
    phrases = candidates(docs, key, body)
    scores = word_scores(phrases, key).select(key, "word", "score")
    distinct = phrases.select(key, "phrase").distinct().withColumn("word", F.explode(F.split("phrase", " ")))
    scored = distinct.join(scores, [key, "word"]).groupBy(key, "phrase").agg(F.round(F.sum("score"), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "phrase"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


#: Characters of the documents of a block, and of all documents for each bucket of terms, about.
BLOCK, BUCKET = 1 << 22, 1 << 24


def tf_idf(docs: DataFrame, k: int = 10, max_n: int = 3, max_df: float = 0.95, key: str = "doc_id", body: str = "text") -> DataFrame:
    """(key, term, score, rank): smooth idf, rows of unit length, 1- to max_n-grams without stop words.

    Documents are dealt out to blocks, as their words. A block tells each bucket of terms the 64-bit hashes of its own terms
    and in how many of its documents they are, and is told in how many they are of all; a bucket is chosen by another hash, so
    different terms are taken for one by both only. Terms themselves are never dealt out; a block makes them of its words."""
    words = F.filter(F.regexp_extract_all(F.lower(text(body)), F.lit(f"({WORD})"), F.lit(1)), lambda w: (F.length(w) >= 2) & ~w.isin(STOP_WORDS))
    total, chars = docs.agg(F.count("*"), F.coalesce(F.sum(F.length(body)), F.lit(0))).first()
    blocks, buckets = chars // BLOCK + 1, max(chars // BUCKET + 1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    listed = docs.select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"), key, F.array_join(words, " ").alias("w"))

    def told(block: pa.Table) -> pa.Table:
        _, at, hashes, ns = _in_buckets(_Terms(block[key], block["w"], max_n), buckets)
        ends = np.searchsorted(at, np.arange(buckets + 1))
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in (hashes.view("<i8"), ns.astype("<i4"))]
        own = block["block"][0].as_py() if len(block) else 0
        made = pa.table([pa.array(np.full(buckets, own, "<i4")), pa.array(np.arange(buckets, dtype="<i4")), *lists], names=["block", "bucket", "h", "n"])
        return made.filter(pa.array(ends[1:] > ends[:-1]))

    def counted(bucket: pa.Table) -> pa.Table:
        whole = bucket.combine_chunks()
        lists = whole["h"].chunk(0)
        _, same = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        df = np.bincount(same, whole["n"].chunk(0).flatten().to_numpy())[same].astype("<i4")
        ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
        return pa.table([whole["block"], whole["bucket"], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(df))], names=["block", "bucket", "df"])

    def best(block: pa.Table, counts: pa.Table) -> pa.Table:
        terms = _Terms(block[key], block["w"], max_n)
        df = np.zeros(0, "<i4")
        if len(counts):
            df = pa.concat_arrays([x.flatten() for x in counts.sort_by("bucket")["df"].chunks]).to_numpy()
        order, *_ = _in_buckets(terms, buckets)
        of_hash = np.empty(len(df), "<i8")
        of_hash[order] = df
        rows, ranks, scores = terms.best(of_hash[terms.same], total, max_df, k)
        return pa.table([terms.keys.take(pa.array(terms.doc[rows])), pa.array(terms.spelled(rows), pa.string()), pa.array(scores), pa.array(ranks.astype("<i4"))], names=[key, "term", "score", "rank"])

    hashes = listed.groupBy("block").applyInArrow(told, "block int, bucket int, h array<long>, n array<int>")
    counts = hashes.groupBy("bucket").applyInArrow(counted, "block int, bucket int, df array<int>")
    return listed.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(best, f"`{key}` {docs.schema[key].dataType.simpleString()}, term string, score double, rank int")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Terms:
    """The distinct terms of each document of a block, in arrays with a place for each: doc (of `keys`), tf, a word where the term
    stands (at), its number of words (n), its hash's place among the block's (same). Documents of one key are one."""

    def __init__(self, keys: pa.ChunkedArray, texts: pa.ChunkedArray, max_n: int):
        some = pc.not_equal(texts, "")
        coded = pc.dictionary_encode(keys.filter(some), null_encoding="encode").combine_chunks()
        lists = pc.split_pattern(texts.filter(some), " ").combine_chunks()
        if isinstance(coded, pa.ChunkedArray):  # of no rows, or of one chunk
            coded, lists = (x.chunk(0) if x.num_chunks else pa.array([], x.type) for x in (coded, lists))
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        words = lists.flatten().dictionary_encode()
        self.keys, self.words, self.word = coded.dictionary, words.dictionary, words.indices.to_numpy()
        spelled = self.words.to_numpy(zero_copy_only=False).astype(object)
        one = [hash_array(spelled, hash_key=salt, categorize=False)[self.word] for salt in ("0123456789123456", "6543219876543210")]
        starts, ns, hashes, seconds = [], [], [], []
        found = list(one)
        for n in range(1, max_n + 1):
            last = len(row) - n + 1
            if last <= 0:
                break
            if n > 1:
                found = [_mixed(x[:last] * np.uint64(0x9E3779B97F4A7C15) + y[n - 1 :]) for x, y in zip(found, one, strict=True)]
            whole = np.flatnonzero(row[:last] == row[n - 1 :])
            starts.append(whole)
            ns.append(np.full(len(whole), n, "<i4"))
            hashes.append(found[0][whole])
            seconds.append(found[1][whole])
        put = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        at, n, h, second = put(starts, "<i8"), put(ns, "<i4"), put(hashes, "<u8"), put(seconds, "<u8")
        doc = coded.indices.to_numpy()[row[at]]
        order = np.lexsort((h, doc))
        new = np.ones(len(order), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        first = np.flatnonzero(new)
        chosen = order[first]
        self.tf, self.doc, self.at, self.n = np.diff(np.append(first, len(order))), doc[chosen], at[chosen], n[chosen]
        self.hashes, where, self.same, self.count = np.unique(h[chosen], return_index=True, return_inverse=True, return_counts=True)
        self.second = second[chosen][where]

    def best(self, df: np.ndarray, total: int, max_df: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places of the k best terms of each document, their ranks and scores; ties in alphabetical order."""
        few = np.flatnonzero(df <= max_df * total)
        doc, weight = self.doc[few], self.tf[few] * (np.log((1 + total) / (1 + df[few])) + 1)
        norm = np.sqrt(np.bincount(doc, weight * weight, len(self.keys)))
        score = np.floor(weight / norm[doc] * 1e6 + 0.5) / 1e6
        order = np.lexsort((-score, doc))
        begins = np.searchsorted(doc[order], np.arange(len(self.keys) + 1))
        least = np.zeros(len(self.keys))
        some = begins[1:] > begins[:-1]
        least[some] = score[order][np.minimum(begins[:-1] + k, begins[1:])[some] - 1]
        near = np.flatnonzero((score >= least[doc]) & (score > 0))
        # a space comes before all that words are made of, so terms are in the order of their words
        place = np.empty(len(self.words), "<i8")
        place[pc.sort_indices(self.words).to_numpy()] = np.arange(len(self.words))
        rows = few[near]
        spelled = [np.where(self.n[rows] > j, place[self.word[np.minimum(self.at[rows] + j, len(self.word) - 1)]], -1) for j in range(self.n.max(initial=0))]
        order = np.lexsort((*spelled[::-1], -score[near], doc[near]))
        rank = np.arange(len(order)) - np.searchsorted(doc[near][order], doc[near][order]) + 1
        taken = order[rank <= k]
        return rows[taken], rank[rank <= k], score[near][taken]

    def spelled(self, rows: np.ndarray) -> list[str]:
        at, n = self.at[rows], self.n[rows]
        parts = [self.words.take(pa.array(self.word[np.minimum(at + j, len(self.word) - 1)])).to_pylist() for j in range(n.max(initial=0))]
        return [" ".join(p[i] for p in parts[:m]) for i, m in enumerate(n.tolist())]


def _in_buckets(terms: _Terms, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order of a block's hashes by bucket and, in that order, their buckets, they themselves and their documents."""
    bucket = terms.second % np.uint64(buckets)
    order = np.lexsort((terms.hashes, bucket))
    return order, bucket[order].astype("<i8"), terms.hashes[order], terms.count[order]


def phrases_of_units(units: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """(key, pos, phrase) of phrases of three characters or more, each once a unit, by first place: the stand-in for noun
    phrases of a tagger. (T16)"""
    return candidates(units, key, body).where(F.length("phrase") >= 3).groupBy(key, "phrase").agg(F.min("pos").alias("pos"))


def frequent_words(docs: DataFrame, k: int = 10, key: str = "doc_id", body: str = "text") -> DataFrame:
    """(key, rank, word, n): the most common words that are no stop words."""
    words = docs.select(key, F.explode(F.regexp_extract_all(F.lower(text(body)), F.lit(f"({WORD})"), F.lit(1))).alias("word"))
    counted = words.where((F.length("word") >= 3) & ~F.col("word").isin(STOP_WORDS)).groupBy(key, "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "word"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= k)
