"""Lazy search for many questions against one question after the other in plain Python."""

import hashlib
import re
from collections import Counter

from lumenfold.operators import questions
from lumenfold.plans import answer_queries, registry
from tests.twins import FOLDER

SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


def words(t):
    return list(dict.fromkeys(w for w in SPACE.split(t.lower()) if w))


def share(q, t):
    asked = words(q)
    return len(set(asked) & set(words(t))) / len(asked) if asked else 0.0


def sentences(t):
    folded = SPACE.sub(" ", t).strip()
    return [s for s in (p.strip(" ") for p in re.split(r"(?<=[.!?])[ ]+(?=[A-Z])", folded)) if s] or [t]


def subqueries(q):
    clauses = [c.strip(" ") for c in re.split(r"[,.;?!]+|\band\b", q)]
    return list(dict.fromkeys([q, *(c for c in clauses if len(words(c)) >= 2)]))[:5]


def candidates(question, bodies, k):
    held = {i: set(words(t)) for i, t in bodies.items()}
    df = Counter(w for ws in held.values() for w in ws)
    best = {}
    for part in subqueries(question):
        rare = sorted((df[w], w.encode()) for w in words(part) if df[w])[:3]
        for i, ws in held.items():
            if any(w.decode() in ws for _, w in rare):
                best[i] = max(best.get(i, 0), round(share(part, bodies[i]), 6))
    return dict(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])


def search(question, chunks, communities, members, rounds, calls, enough, batch):
    bodies = {("chunk", i): t for i, t in chunks.items()} | {("community", i): t for i, t in communities.items()}
    queue = {("chunk", i): p for i, p in candidates(question, chunks, 20).items()} | {("community", i): p for i, p in candidates(question, communities, 3).items()}
    seen, spent, found, stopped = set(), 0, {}, None
    for k in range(1, rounds + 1):
        taken = sorted((key for key in queue if key not in seen), key=lambda x: (-queue[x], x))[: min(batch, calls - spent)]
        new = []
        for key in taken:
            part = share(question, bodies[key])
            if part >= 0.3:
                new += [(k, *key, pos, s) for pos, s in enumerate([s for s in sentences(bodies[key]) if share(question, s) > 0][:3])]
        for row in sorted(new, key=lambda r: r[:4]):
            found.setdefault(re.sub(r"[ \t\n\x0b\f\r]+", " ", row[4].lower().strip(" ")), row)
        spent += len(taken)
        stopped = "enough" if len(found) >= enough else "budget" if spent >= calls else "nothing" if not taken else "rounds" if k == rounds else None
        if stopped:
            break
        for kind, i in taken:
            if kind == "community" and share(question, bodies[kind, i]) >= 0.3:
                for c in members.get(i, ()):
                    queue["chunk", c] = max(queue.get(("chunk", c), 0), queue[kind, i])
        seen |= set(taken)
    return list(found.values()), (spent, len(found), stopped)


def plain(asked, chunks, communities, members, rounds=5, calls=20, enough=3, batch=5):
    claims, states = [], {}
    for q, question in asked.items():
        found, states[q] = search(question, chunks, communities, members, rounds, calls, enough, batch)
        claims += [(q, *row) for row in found]
    return sorted(claims), states


def answers(found, state):
    return sorted(tuple(r) for r in found.collect()), {r["question_id"]: (r["calls"], r["claims"], r["stopped"]) for r in state.collect()}


def test_every_way_to_stop(spark):
    chunks = {1: "Cats sleep. They purr.", 2: "Cats sleep.  Dogs bark. Birds sing.", 3: "cats run", 4: "Trains and ships", 5: "Rare stones of cats", 6: "Hidden in a community. Purple fish.", 7: ""}
    communities = {10: "purple fish and cats", 11: "ships"}
    members = {10: [6, 3], 11: [4]}
    asked = {1: "cats sleep", 2: "purple fish, and cats?", 3: "unknown", 4: "", 5: "ships run"}
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    inputs = [frame([*asked.items(), (1, "cats sleep"), (None, "x")], "question_id long, question string"), frame(list(chunks.items()), "id long, text string"), frame(list(communities.items()), "id long, text string"), frame([(c, m) for c, ms in members.items() for m in ms], "community long, chunk long")]
    limits = {"rounds": 4, "calls": 3, "enough": 5, "batch": 2}
    found = answers(*questions.search_all(*inputs, **limits))
    assert found == plain(asked, chunks, communities, members, **limits)
    assert {s[2] for s in found[1].values()} >= {"budget", "nothing"}


def test_questions_of_the_conversations(spark, monkeypatch):
    given = {}
    real = questions.search_all
    monkeypatch.setattr(answer_queries.questions, "search_all", lambda *a, **k: given.update(a=a, k=k) or real(*a, **k))
    found = answers(*answer_queries.many_questions(spark, FOLDER))
    asked, chunks, communities = ({r[0]: r[1] for r in df.collect()} for df in given["a"][:3])
    members = {}
    for r in given["a"][3].collect():
        members.setdefault(r["community"], []).append(r["chunk"])
    expected = plain(asked, chunks, communities, members, **given["k"])
    assert found[1] == expected[1]
    assert found[0] == expected[0]


def test_questions_look_into_few_texts(spark, monkeypatch):
    """In blocks of growing size, with equal shares and a repeated id, the k best are those of all texts; a question whose k best have
    all its words looks up nothing more, one that lacks a word its rarest word only."""
    monkeypatch.setattr(questions, "FIRST", 3)
    monkeypatch.setattr(questions, "GROWTH", 2)
    rare = {11: "ore", 29: "ore gem", 44: "gem ore the", 57: "ore the a"}
    bodies = {i: "the a of" if i % 3 else f"the of {rare.get(i, 'x')}" for i in range(60)} | rare
    asked = {1: "the of", 2: "ore gem the", 3: "the a of ore", 4: "nothing", 5: "gem"}
    texts = spark.createDataFrame([*bodies.items(), (None, "the ore"), (44, "gem")], "id long, text string")
    rows = questions.candidates(spark.createDataFrame(list(asked.items()), "question_id long, question string"), texts, 4).collect()
    for q, question in asked.items():
        assert {r["id"]: r["priority"] for r in rows if r["question_id"] == q} == candidates(question, bodies, 4)
    parts = spark.createDataFrame([(1, 1, 2, [7, 8]), (2, 2, 3, [9, 7, 8]), (3, 3, 3, [9, 7, 8])], "question_id long, part_id long, n int, wids array<long>")
    best = spark.createDataFrame([(1, 0, 1.0), (1, 1, 1.0), (2, 0, 1.0), (2, 1, round(2 / 3, 6)), (3, 0, 1.0)], "question_id long, id long, priority double")
    assert {r["part_id"]: r["probes"] for r in questions.probing(parts, best, 2).collect()} == {2: [9], 3: [9, 7, 8]}


def normal(claim):
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", claim.lower().strip(" "))


def part(q, t):
    """The share of a question's words, as runs of letters, digits and underscores."""
    of = lambda x: set(re.findall(r"\w+", x.lower()))
    return len(of(q) & of(t)) / len(of(q))


def test_search_of_one_question(spark):
    """v21: batches of five by priority; the first of equal claims."""
    docs = [(r["doc_id"], r["n_chars"], r["text"] or "") for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    queue, found = sorted(docs, key=lambda r: (-r[1], r[0])), {}
    for k in range(1, 5):
        new = []
        for i, _, t in queue[5 * (k - 1) : 5 * k]:
            if part(answer_queries.QUESTION, t) >= 0.3:
                new += [(k, i, s) for s in [s for s in sentences(t) if part(answer_queries.QUESTION, s) > 0][:3]]
        for row in sorted(new, key=lambda r: (r[0], r[1], r[2].encode())):
            found.setdefault(normal(row[2]), row)
        if len(found) >= 40:
            break
    got = registry.QUERIES["v21_lazy_search"](spark, FOLDER).collect()
    assert sorted((r["round"], r["id"], r["claim"]) for r in got) == sorted(found.values())


def test_gathering_for_one_question(spark):
    """v23: samples by hash, deepening in the sources of hits, a budget of tested sentences."""
    docs = {r["doc_id"]: (r["source"], r["text"] or "") for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    by_hash = lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i)
    done, hits, out, spent = set(), set(), [], 0
    for k in range(1, 6):
        near = {docs[i][0] for i in hits}
        batch = sorted((i for i in docs if i not in done), key=lambda i: (k > 1 and docs[i][0] not in near, by_hash(i)))[:50]
        if not batch:
            break
        done |= set(batch)
        tested = [(-round(part(answer_queries.QUESTION, s), 6), i, s.encode()) for i in batch for s in sentences(docs[i][1])]
        tested = sorted(tested)[: 200 - spent]
        spent += len(tested)
        good = [(i, k, s.decode(), -p) for p, i, s in tested if -p >= 0.3]
        hits |= {i for i, *_ in good}
        out += good
        if spent >= 200 or len(out) >= 50:
            break
    got = registry.QUERIES["v23_lazy_gather"](spark, FOLDER).collect()
    assert sorted((r["id"], r["round"], r["sentence"], r["score"]) for r in got) == sorted(out)
