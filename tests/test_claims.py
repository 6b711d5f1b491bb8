"""Claims deduplicated in order: the distributed rounds against going through them one by one."""

import random

from lumenfold.operators import lazy
from lumenfold.plans import registry
from tests.twins import FOLDER


def words_of(claim):
    return frozenset(claim.strip(" ").lower().split())


def similar(a, b, least=0.85):
    return len(a & b) >= least * len(a | b)


def in_order(rows, least=0.85):
    """{claim_id: (kept, into)}"""
    stayed, out = [], {}
    for i, claim in sorted(rows):
        own = words_of(claim)
        into = next((k for k, w in stayed if similar(w, own, least)), None)
        if into is None:
            stayed.append((i, own))
        out[i] = (into is None, into)
    return out


def found(df):
    return {r["claim_id"]: (r["kept"], r["into"]) for r in df.collect()}


def test_chains_of_similar_claims(spark):
    """Long chains in which every claim is similar to the next, so that what stays depends on the order."""
    rng, rows = random.Random(6), []
    for chain in range(6):
        words = [f"c{chain}w{k}" for k in range(20)]
        for _ in range(15):
            words = [*words]
            words[rng.randrange(20)] = f"c{chain}n{rng.randrange(1000)}"
            rows.append(" ".join(rng.sample(words, 20)))
        rows += [rows[-1], rows[-3].upper(), "  " + rows[-5]]
    rng.shuffle(rows)
    rows = [*enumerate(rows), (900, "one"), (901, "one two"), (902, "ONE")]
    df = spark.createDataFrame([(*r, "s") for r in rows] + [(None, "x", "s"), (950, None, "s")], "claim_id long, claim string, kept string")
    assert found(lazy.first_claims(df)) == in_order(rows)
    assert lazy.first_claims(df.limit(0)).collect() == []


def test_whole_texts_as_claims(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect() if r["text"] is not None]
    assert found(registry.QUERIES["v25_first_claims"](spark, FOLDER)) == in_order(rows)


def test_unlike_claims_do_not_meet(spark):
    """Claims of one small vocabulary share rare words all over; few of them share a whole part."""
    rng = random.Random(9)
    rows = [(k, " ".join(rng.sample([f"w{i}" for i in range(100)], rng.randint(30, 60)))) for k in range(300)]
    for k in range(0, 300, 10):
        words = rows[k][1].split()
        rows.append((300 + k, " ".join(words[: len(words) - rng.randint(0, 8)])))
    df = spark.createDataFrame(rows, "claim_id long, claim string")
    expected = {(a, b) for a, x in rows for b, y in rows if a < b and similar(words_of(x), words_of(y))}
    assert {(r["kept"], r["dropped"]) for r in lazy.similar_claims(df).collect()} == expected
    parts = lazy._parts(lazy._worded(df, "claim_id", "claim"), 0.85, "claim_id")
    met = parts.withColumnRenamed("claim_id", "a").join(parts.withColumnRenamed("claim_id", "b"), "t").where("a < b").select("a", "b").distinct()
    assert expected and met.count() < 2000  # of 54,285 pairs


def test_words_do_not_travel_with_pairs(spark):
    """Long claims of one vocabulary, some in copies, some nearly the same: pairs are told apart by parities and compared in chunks,
    and no pair has word lists of its own."""
    rng, rows = random.Random(4), []
    vocabulary = [f"w{i}" for i in range(1500)]
    for n in (10, 300, 700, 790, 810, 900):
        for _ in range(12):
            words = rng.sample(vocabulary, n)
            rows.append(" ".join(words))
            rows += [rows[-1].upper()] * rng.randrange(3)
            for _ in range(rng.randrange(4)):
                rows.append(" ".join(words[: n - rng.randrange(n // 5)] + rng.sample(vocabulary, n // 50)))
    rows = [(i // 2 if i < 10 else i, claim) for i, claim in enumerate(rows)]  # some ids are repeated
    df = spark.createDataFrame([*rows, (None, rows[0][1]), (5000, None)], "claim_id long, claim string")
    sets = [(i, words_of(claim)) for i, claim in rows]
    expected = sorted((a, b) for a, x in sets for b, y in sets if a < b and similar(x, y))
    pairs = lazy.similar_claims(df)
    assert "array_intersect" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert expected and sorted((r["kept"], r["dropped"]) for r in pairs.collect()) == expected
    small = df.where("claim_id >= 5 AND claim IS NOT NULL")
    assert found(lazy.first_claims(small)) == in_order([r for r in rows if r[0] >= 5])
