"""Centroids, quality by weak supervision, ranked search."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from lumenfold.llm import op11_centroids, op12_quality, op13_ranked
from tests.llm.cases import KIND, LONG, awkward, nothing
from tests.twins import FOLDER, connection, rows_of, sql_rows


@pytest.mark.parametrize("module, name", [(op11_centroids, "op11_centroids"), (op12_quality, "op12_quality"), (op13_ranked, "op13_ranked")])
def test_twins(spark, module, name):
    df = getattr(module, name)(spark, FOLDER)
    names, expected = sql_rows(connection(), module.ORACLE)
    assert sorted(df.columns) == names
    assert rows_of(df) == expected


def plain_clusters(rows, k, rounds):
    """rows: (vec_id, integers)."""
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [r[1] for r in sorted(rows, key=key)[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    home = lambda x: min(range(len(centroids)), key=lambda c: (far(x, centroids[c]), c))
    for _ in range(rounds):
        groups = {}
        for _, x in rows:
            groups.setdefault(home(x), []).append(x)
        centroids = [[sum(v) // len(v) for v in zip(*groups[c], strict=True)] if c in groups else centroids[c] for c in range(len(centroids))]
    return [(i, home(x), far(x, centroids[home(x)])) for i, x in rows], centroids


EMBEDDINGS = "vec_id long, embedding array<double>, label int, cluster string, distance string, x string"


def test_centroids_of_awkward_vectors(spark):
    rng = random.Random(5)
    good = [(i, [rng.choice([-1.5, 0.25, 0.0, 3.0]) for _ in range(64)]) for i in range(60)]
    good += [(3, good[3][1]), (None, good[4][1]), (None, [0.001] * 64), (70, [1e5 * (-1) ** j for j in range(64)]), (71, [3e7] * 64)]
    bad = [(80, None), (81, []), (82, [1.0] * 63), (83, [1.0] * 63 + [None]), (84, [float("nan")] * 64), (85, [float("inf")] + [0.0] * 63)]
    table = spark.createDataFrame([(i, x, 1, "c", "d", "e") for i, x in good + bad], EMBEDDINGS)
    found, centroids = op11_centroids.cluster(table, k=5)
    expected, plain = plain_clusters([(i, [math.floor(64 * v) for v in x]) for i, x in good], 5, 3)
    assert centroids.tolist() == plain
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in found.collect()), key=repr) == sorted(expected, key=repr)
    assert {r["inertia"] for r in found.collect()} == {sum(e[2] for e in expected)}
    assert op11_centroids.cluster(table.limit(0))[0].collect() == []
    few = op11_centroids.cluster(spark.createDataFrame([(1, [0.5] * 64, 1, "c", "d", "e")] * 2, EMBEDDINGS))[0].collect()
    assert [(r["vec_id"], r["cluster"], r["distance"]) for r in few] == [(1, 0, 0)] * 2


def test_vectors_beyond_64_bits_saturate(spark):
    table = spark.createDataFrame([(1, [1e300] * 64, 1, "c", "d", "e"), (2, [-1e300] * 64, 1, "c", "d", "e"), (3, [0.0] * 64, 1, "c", "d", "e")], EMBEDDINGS)
    assert {r["vec_id"]: r["distance"] for r in op11_centroids.cluster(table, k=1)[0].collect()}[1] == 2**63 - 1


@pytest.mark.parametrize("size", [40, 1 << 12, 1 << 20, 1 << 25, 1 << 40, 1 << 62])
def test_nearest_is_exact_where_float32_is_not(size):
    """Centroids that differ by one unit, ties, and numbers that float32 rounds."""
    rng = np.random.default_rng(1)
    base = rng.integers(-size, size, 64)
    centroids = np.array([base + rng.integers(-1, 2, 64) for _ in range(12)] + [base, base])
    x = np.array([base + rng.integers(-2, 3, 64) for _ in range(200)] + [*centroids])
    plain = [min(range(len(centroids)), key=lambda c: (sum((int(a) - int(b)) ** 2 for a, b in zip(v, centroids[c], strict=True)), c)) for v in x]
    assert op11_centroids.nearest(x, centroids).tolist() == plain


def plain_repeats(words):
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return len({i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)})


def test_measures_against_plain_version(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "b", "c!", "###", "É", "d|d"]) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    texts += ["x\n \nx\n\ty\nx", "  lead and trail \x0b\f\r", "a b c", "one", "", " ", "p q r p q r", "p q r p q", "- -- a-b ...", "日本語 ÀB"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in op12_quality.measures(docs).collect():
        text = texts[r["doc_id"]]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text)), text
        assert (r["n_dup_lines"], r["n_repeat_words"], r["n_distinct"]) == (len(lines) - len(set(lines)), plain_repeats(words), len(set(words))), text
        assert (r["n_upper"], r["n_other"], r["n_exclamations"]) == (sum(c.isupper() for c in text), sum(not c.isalpha() for w in words for c in w), text.count("!")), text
        assert r["n_marks"] == sum(not any(c.isalnum() for c in w) for w in words), text


def test_quality_of_awkward_rows(spark):
    long = [(9, "no two lines are alike in here " * 20_000, "en", "s1", 1, "x", "y", "z")]
    docs = awkward(spark).unionByName(spark.createDataFrame(long, KIND))
    found = op12_quality.judge(docs).collect()
    assert len(found) == docs.count()
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[4]["n_words"] == 30_000
    assert by_id[4]["n_repeat_words"] == plain_by_hash(LONG.split())
    assert by_id[9]["n_repeat_words"] == by_id[9]["n_words"] == 140_000
    assert not any(r["kept"] for r in found if r["n_words"] < 50)
    assert op12_quality.judge(nothing(spark)).collect() == []


def plain_by_hash(words):
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    return len({i + j for places in seen.values() if len(places) > 1 for i in places for j in range(3)})


def test_accuracies_are_recovered():
    """Votes drawn from known accuracies; the fourth rule is a coin and must not decide."""
    rng = random.Random(8)
    on_good, on_bad = [0.02, 0.05, 0.03, 0.5, 0.02], [0.7, 0.6, 0.8, 0.5, 0.5]
    tally, truth = {}, {}
    for _ in range(20_000):
        bad = rng.random() < 0.2
        votes = tuple(0 if rng.random() < 0.2 else (-1 if rng.random() < (on_bad if bad else on_good)[j] else 1) for j in range(5))
        tally[votes] = tally.get(votes, 0) + 1
        truth.setdefault(votes, []).append(not bad)
    share, good, bad = op12_quality.learn(sorted(tally.items()), rounds=100)
    assert abs(share - 0.8) < 0.02
    assert np.allclose(good, on_good, atol=0.03) and np.allclose(bad, on_bad, atol=0.06)
    weights = op12_quality.worth(share, good, bad)
    right = sum((op12_quality.posterior(v, weights) >= 0.5) == t for v, ts in truth.items() for t in ts)
    assert right / 20_000 > 0.93
    scaled = op12_quality.learn(sorted((v, 1000 * n) for v, n in tally.items()), rounds=100)
    assert np.allclose(scaled[1], good, atol=0.01)  # alike at every size


def test_verdicts_against_labels(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = op12_quality.judge(docs).withColumnRenamed("quality", "posterior").join(labels, "doc_id").where("NOT base_failed").groupBy("quality", "kept").count().collect()
    tally = {(r["quality"], r["kept"]): r["count"] for r in found}
    assert tally.get((1, False), 0) <= 0.01 * tally[1, True]
    assert tally.get((0, True), 0) <= 0.05 * tally[0, False]


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_ranks(docs, items, k=10):
    read = [(i, plain_terms(t)) for i, t in docs]
    n_docs, all_terms = sum(bool(t) for _, t in read), sum(len(t) for _, t in read)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(plain_terms(text))
    out = []
    for item, terms in wanted.items():
        scores = []
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in held for _, held in read) + 1))) for t in terms}
        for i, held in read:
            m = 10 + (90 * len(held) * n_docs) // all_terms if all_terms else 0
            score = sum(w * ((10**9 * held.count(t)) // (1000 * held.count(t) + 8 * m)) for t, w in weights.items() if t in held)
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


def ranks(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


def test_ranks_against_plain_version(spark):
    rng = random.Random(4)
    words = ["The", "the", "ÉTÉ", "été", "x1", "b-c", "_", "日本", *[f"w{i}" for i in range(40)]]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i // 2 if i % 50 == 0 else i, " ".join(rng.choices(words, weights, k=rng.choice([1, 3, 20, 200])))) for i in range(400)]
    docs += [(None, docs[7][1]), (None, "w5 w6"), (901, ""), (902, None), (903, "!?"), docs[3], docs[3]]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 8, 30])))) for i in range(30)]
    items += [(3, "w39 w38"), (None, "w1"), (None, "w2 w2"), (50, ""), (51, None), (52, "unknown"), items[0]]
    wide = lambda rows, key: spark.createDataFrame([(i, t, "a", 1, 2, 3) for i, t in rows], f"{key} long, text string, term string, n long, score long, rank int")
    expected = sorted(plain_ranks(docs, items), key=repr)
    assert ranks(op13_ranked.ranked(wide(docs, "doc_id").repartition(3), wide(items, "item_id"))) == expected
    assert ranks(op13_ranked.ranked(wide(docs, "doc_id"), wide(items, "item_id"), block_pairs=40)) == expected
    assert op13_ranked.ranked(nothing(spark), wide(items, "item_id")).collect() == []
    assert op13_ranked.ranked(awkward(spark), wide([], "item_id")).collect() == []
    assert ranks(op13_ranked.ranked(awkward(spark), wide([(1, "w3x3 plain")], "item_id"))) == plain_ranks([(r["doc_id"], r["text"]) for r in awkward(spark).collect()], [(1, "w3x3 plain")])


def test_search_stops_early_and_loses_nothing():
    """Rare terms first: far fewer postings are added than there are, and the best rows are the same."""
    rng = np.random.default_rng(2)
    rows, vocabulary = 4000, 60
    held = rng.random((rows, vocabulary)) < (0.9 / (1 + np.arange(vocabulary)))[None, :]
    counts = np.where(held, rng.integers(1, 4, held.shape), 0)
    n = counts.sum(1) + rng.integers(1, 300, rows)
    facts = op13_ranked.Statistics(rows, int(n.sum()))
    doc, term = np.nonzero(counts)
    shard = op13_ranked.Shard(np.arange(rows), n, np.bincount(doc, minlength=rows), term.astype(np.int32), counts[doc, term], facts)
    weights = np.array([facts.weight(int(d)) for d in held.sum(0)])
    impacts = facts.impacts(np.repeat(n[:, None], vocabulary, 1), counts) * (counts > 0)
    fewer = 0
    for _ in range(40):
        terms = np.sort(rng.choice(vocabulary, rng.integers(1, 12), replace=False))
        own = np.zeros(vocabulary, np.int64)
        own[terms] = weights[terms]
        true = impacts @ own
        found, scores, added = shard.search(terms, own, 10, 1)
        best = op13_ranked._best(found, scores, 10)
        wanted = np.lexsort((np.arange(rows), -true))[:10]
        wanted = wanted[true[wanted] > 0]
        assert found[best].tolist() == wanted.tolist() and scores[best].tolist() == true[wanted].tolist()
        fewer += added < held[:, terms].sum()
    assert fewer >= 20
