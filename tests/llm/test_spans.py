"""Personal data, secrets and language."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import op01_pii, op02_language, op03_secrets
from lumenfold.llm.bitmaps import bitmap_of
from lumenfold.llm.sampling import hashed_sample
from tests.llm.cases import awkward, nothing
from tests.twins import FOLDER

PII = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def allowed(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "email":
        return True
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and op01_pii.luhn(digits)
    return 10 <= len(digits) <= 15


def plain_spans(text):
    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(PII) for m in re.finditer(p, text) if allowed(kind, m[0]))


def test_base_spans_against_plain_regex():
    rng = random.Random(5)
    texts = ["".join(rng.choice("a1.@_-+ 5(4") for _ in range(rng.randint(0, 120))) for _ in range(1500)]
    texts += ["a@b.c_d@e.f", "x 4539 1488 0343 6467 y", "1.2.3.4.5.6.7.8", "999.1.1.1", "+1 (555) 123-4567 x", "é@b.co"]
    for t in texts:
        assert op01_pii.base_spans(t) == plain_spans(t), t


def test_pii_query(spark):
    found = {r["doc_id"]: r for r in op01_pii.op1_pii(spark, FOLDER).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert found.keys() == texts.keys()
    for i, t in texts.items():
        spans = plain_spans(t)
        assert found[i]["base_sha256"] == hashlib.sha256(",".join(f"{PII[k][0]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
        assert found[i]["n_email"] == sum(k == 0 for _, k, _ in spans)


def plain_disclosing(rows):
    """(term, entity) pairs by plain counts of documents."""
    entities, pairs, wordings, spoken = collections.Counter(), collections.Counter(), collections.defaultdict(set), collections.Counter()
    for text in rows:
        spans = plain_spans(text)
        words = [(m.start(), m.end()) for m in re.finditer(r"\w+", text)]
        spoken.update({text[a:b].lower() for a, b in words})
        named, seen = set(), set()
        for a, k, b in spans:
            e = (k, text[a:b].lower() if k < 2 else re.sub("[^0-9]", "", text[a:b]))
            near = [w for w in words if w[1] <= a][-8:] + [w for w in words if w[0] >= b][:8]
            terms = [text[x:y].lower() for x, y in near if y - x >= 3 and not any(x < q and p < y for p, _, q in spans)]
            named.add(e)
            seen |= {(e, t, " ".join(terms)) for t in terms}
        entities.update(named)
        for e, t, w in seen:
            pairs[e, t] += 1
            wordings[e, t].add(w)
    n, out = len(rows), set()
    for (e, t), k in pairs.items():
        together = min(k, spoken[t], entities[e])
        ic = math.log(n / entities[e])
        if len(wordings[e, t]) >= 2 and ic > 0 and math.log(n * together / (spoken[t] * entities[e])) >= 0.8 * ic - 1e-12:
            out.add((t, e))
    return out


def test_disclosure_against_plain_counts(spark):
    rng = random.Random(6)
    people = [("Brandon Quimby", "bq@corp.com"), ("Zelda Orvik", "+49 30 1234567"), ("unit77 gateway", "10.20.30.40")]
    filler = [f"w{k}ord" for k in range(40)] + ["the", "and", "write", "about"]
    texts = []
    for _ in range(400):
        words = [rng.choice(filler) for _ in range(rng.randint(0, 30))]
        who = rng.choice(people)
        if rng.random() < 0.1:
            words.insert(rng.randint(0, len(words)), rng.choice(["{0} at {1} x", "{1} is of {0}", "{0} only", "mail {1} now {0}"]).format(*who))
        texts.append(" ".join(words))
    expected = plain_disclosing(texts)
    names = {t for t, _ in expected}
    assert {"quimby", "orvik", "gateway"} <= names and "the" not in names
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, found = op01_pii.disclosures(docs)
    assert {(r["t"], r["e"]) for r in found.collect()} == {(op01_pii._key(t), op01_pii._key(f"{PII[k][0]}:{v}")) for t, (k, v) in expected}
    for r in op01_pii.spans(docs).collect():  # every occurrence, also in texts that do not name the entity
        text = texts[r["doc_id"]]
        base = plain_spans(text)
        marks = [(m.start(), m.end()) for m in re.finditer(r"\w+", text) if m[0].lower() in names and not any(m.start() < q and p < m.end() for p, _, q in base)]
        assert [(x["start"], x["end"]) for x in r["terms"]] == marks


def test_disclosing_terms(spark, monkeypatch):
    rows = [(i, f"Please {'abcdefgh'[i]}{'abcdefgh'[i]}x write to Brandon Quimby at bq@corp.com about it", "b", "t") for i in range(6)]
    rows += [(100 + i, f"The other text please write about {'abcdefgh'[i % 8]}y today", "b", "t") for i in range(60)]
    rows += [(None, "Said Quimby", None, None), (None, "Said Quimby", None, None), (7, "Quimby here", "b", "t"), (7, None, "b", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string, terms string")
    cleaned = op01_pii.sanitise(docs).collect()
    assert len(cleaned) == len(rows) and cleaned[0].__fields__ == docs.columns
    first = {r["doc_id"]: r["text"] for r in cleaned}
    assert first[0].startswith("Please aax write") and "[EMAIL]" in first[0]
    assert "Quimby" not in first[0] and "Brandon" not in first[0]
    assert first[100] == rows[6][1]
    assert sorted((r["text"] or "-", r["base"] or "-") for r in cleaned if r["doc_id"] in (None, 7)) == [("-", "b"), ("Said [NAME]", "-"), ("Said [NAME]", "-"), ("[NAME] here", "b")]
    monkeypatch.setattr(op01_pii, "EXACT_TERMS", 0)
    assert sorted(map(str, op01_pii.sanitise(docs).collect())) == sorted(map(str, cleaned))
    monkeypatch.setattr(op01_pii, "BROADCAST_SPANS", -1)
    assert sorted(map(str, op01_pii.sanitise(docs).collect())) == sorted(map(str, cleaned))
    alone = spark.createDataFrame([(1, "Brandon Quimby at bq@corp.com")] * 3, "doc_id long, text string")  # one wording proves nothing
    assert [r["terms"] for r in op01_pii.spans(alone).collect()] == [[], [], []]


def test_pii_awkward(spark):
    found = op01_pii.spans(awkward(spark)).collect()
    assert len(found) == 8
    assert all(r["base"] == [] and r["terms"] == [] for r in found)
    assert op01_pii.spans(nothing(spark)).count() == 0
    assert op01_pii.sanitise(awkward(spark)).exceptAll(awkward(spark)).count() == 0
    assert op01_pii.sanitise(nothing(spark)).count() == 0


ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secret_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def test_secrets_query(spark):
    found = {r["doc_id"]: r for r in op03_secrets.op3_secrets(spark, FOLDER).collect()}
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        spans = secret_spans(r["text"])
        said = ",".join(f"{op03_secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert found[r["doc_id"]]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_secrets_against_plain_regex(spark):
    rng = random.Random(2)
    bits = ["token", "Secret", "api_key", "=", ":", " ", '"', "abcdef0123456789", "AKIA", "ABCDEFGHIJKLMNOP", "short", "é", "x" * 14]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in op03_secrets.scan(docs).collect():
        assert [(x["start"], x["kind"], x["end"]) for x in r["base"]] == secret_spans(r["row"]["text"]), r["row"]["text"]


def test_random_tokens(spark):
    random_ones = ["ghp_A8dk3Kd93kfLs0dkQ2mZx8Vb1Nq7Rt5Yp", "q7Zp3LkX9vTb2MnR8wYc5HdJ"]
    rows = [(1, f"x {random_ones[0]} /usr/local/lib/python/site-packages internationalizationstandards {random_ones[1]}"), (2, "SomeVeryLongCamelCaseIdentifierName another_snake_case_identifier_name 12345678901234567890123")]
    found = {r["row"]["doc_id"]: r for r in op03_secrets.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [found[1]["row"]["text"][x["start"] : x["end"]] for x in found[1]["extra"]] == random_ones
    assert found[2]["extra"] == []


def test_random_keys_of_every_alphabet(spark):
    """The battery passes random keys of each alphabet, short and long, and long ones are reported."""
    rng = random.Random(5)
    kinds = {"base32": op03_secrets.UPPER + "234567", "lower32": op03_secrets.LOWER + "234567", "upper36": op03_secrets.DIGITS + op03_secrets.UPPER, "lower36": op03_secrets.DIGITS + op03_secrets.LOWER, "base62": op03_secrets.DIGITS + op03_secrets.UPPER + op03_secrets.LOWER, "base64": op03_secrets.DIGITS + op03_secrets.UPPER + op03_secrets.LOWER + "+/"}
    rows = [(f"{kind} {n}", "".join(rng.choice(letters) for _ in range(n))) for kind, letters in kinds.items() for n in (20, 32, 64, 96, 128, 256) for _ in range(100)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    passed = {r["doc_id"]: r["rate"] for r in op03_secrets.scan(docs).selectExpr("row.doc_id", "double(exists(tokens, t -> t.passes)) AS v").groupBy("doc_id").agg({"v": "avg"}).withColumnRenamed("avg(v)", "rate").collect()}
    assert {k: v for k, v in passed.items() if v < 0.95} == {}
    plain = [("plain", f"internationalizationstandards another_snake_case_identifier_name some-page-of-2024-about-words SOME_CONSTANT_NAME_OF_A_LIBRARY {i}") for i in range(200)]
    found = op03_secrets.find(spark.createDataFrame([r for r in rows if len(r[1]) >= 64] + plain, "doc_id string, text string")).collect()
    missed = [r["row"]["doc_id"] for r in found if r["row"]["doc_id"] != "plain" and not r["extra"] and not r["base"]]
    assert len(missed) <= 0.02 * len(rows)
    assert not any(r["extra"] for r in found if r["row"]["doc_id"] == "plain")


def tail(z):
    upper = 0.5 * math.exp(-0.717 * abs(z) - 0.416 * z * z)
    return upper if z >= 0 else 1 - upper


def plain_battery(token):
    """Encoding, stratum, verdict and statistics of a token, or None."""
    if re.fullmatch("[0-9_-]+", token):
        return None
    names = [("hex", "[0-9a-f-]+|[0-9A-F-]+"), ("base32", "[A-Z2-7]+=*"), ("lower32", "[a-z2-7]+=*"), ("upper36", "[A-Z0-9_-]+=*"), ("lower36", "[a-z0-9_-]+=*"), ("base64", ".*[+/].*"), ("base62", ".*")]
    name = next(n for n, p in names if re.fullmatch(p, token))
    letters = op03_secrets.ALPHABETS[name]
    body = re.sub("[-_=]", "", token.lower() if name == "hex" else token)
    n, a = len(body), len(letters)
    if n < 8:
        return None
    x = [letters.index(c) + 1 for c in body]
    kind = ["d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "s" for c in body]
    changes = sum(p != q for p, q in zip(kind, kind[1:], strict=False))
    chi2 = a * sum(v * v for v in collections.Counter(x).values()) / n - n
    mean = sum(x) / n
    var, cov = sum((v - mean) ** 2 for v in x), sum((v - mean) * (w - mean) for v, w in zip(x, x[1:], strict=False))
    shares = [sum(c in some for c in letters) / a for some in (op03_secrets.DIGITS, op03_secrets.LOWER, op03_secrets.UPPER, "+/")]
    d = 1 - sum(p * p for p in shares)
    two = sum(p * (1 - p) ** 2 for p in shares)
    k = 2 / (9 * (a - 1))
    serial = cov / var if var else 1.0
    ps = [
        tail(((chi2 / (a - 1)) ** (1 / 3) - (1 - k)) / k**0.5),
        2 * tail(abs(changes - (n - 1) * d) / ((n - 1) * d * (1 - d) + 2 * (n - 2) * (two - d * d)) ** 0.5),
        2 * tail(abs(serial + 1 / n) * n**0.5),
    ]
    return {"name": name, "stratum": (name, sum(n >= s for s in (32, 48, 96))), "passes": min(ps) >= 0.001 / 3, "changes": changes, "n": n, "a": a, "excess": (chi2 - (a - 1)) / n, "serial": serial}


def plain_random_spans(texts):
    """Random tokens of every text by the battery and Benjamini-Hochberg, without regard to base spans."""
    found = [(i, m.start(), m.end(), plain_battery(m[0])) for i, t in enumerate(texts) for m in re.finditer("[A-Za-z0-9+/_-]{20,}={0,2}", t)]
    found = [x for x in found if x[3]]
    for x in found:
        b = x[3]
        same = [y[3] for y in found if y[3]["name"] == b["name"] and not y[3]["passes"]]
        prior = max(b["a"] * 0.066 - 1, 0.5)
        n = len(same) + 20
        rate = min(max((sum(y["changes"] for y in same) + 100) / (sum(y["n"] - 1 for y in same) + 1000), 0.02), 0.3)
        excess = (sum(y["excess"] for y in same) + 20 * prior) / n
        excess_var = (sum(y["excess"] ** 2 for y in same) + 25 * prior * prior) / n - excess**2
        serial = sum(y["serial"] for y in same) / n
        serial_var = (sum(y["serial"] ** 2 for y in same) + 20 * 0.0625) / n - serial**2
        share, pairs = b["changes"] / (b["n"] - 1), b["n"] - 1
        if share <= rate:
            runs = 1.0
        else:
            runs = math.exp(-pairs * (share * math.log(share / rate) + ((1 - share) * math.log((1 - share) / (1 - rate)) if share < 1 else 0)))
        uniform = tail((excess - b["excess"]) / (2 * ((b["a"] - 1) / b["n"] + 2 * excess) / b["n"] + excess_var) ** 0.5)
        correlation = tail((serial - abs(b["serial"])) / (1 / b["n"] + serial_var) ** 0.5)
        b["p"] = min(1.0, 3 * min(runs, uniform, correlation)) if b["passes"] else 1.0
    out = []
    for stratum in {x[3]["stratum"] for x in found}:
        own = sorted((x for x in found if x[3]["stratum"] == stratum), key=lambda x: x[3]["p"])
        bins = [math.floor(-math.log10(max(x[3]["p"], 1e-300)) / 0.1 + 1e-9) for x in own]
        last = max((k + 1 for k, b in enumerate(bins) if 10 ** (-0.1 * min(b, 400)) <= 0.01 * (k + 1) / len(own)), default=0)
        out += own[:last]
    return sorted((i, a, b) for i, a, b, _ in out)


def test_battery_and_control_against_plain_python(spark):
    rng = random.Random(17)
    syllables = "the an in er ion ed to ha re on at en nd st es or ti".split()
    texts = []
    for _ in range(400):
        parts = []
        for _ in range(rng.randint(0, 6)):
            kind = rng.random()
            if kind < 0.25:
                letters = rng.choice(list(op03_secrets.ALPHABETS.values()))
                parts.append("".join(rng.choice(letters) for _ in range(rng.randint(20, 110))))
            elif kind < 0.5:
                parts.append("".join(rng.choice(syllables) for _ in range(rng.randint(8, 20))))
            elif kind < 0.75:
                parts.append(rng.choice("_-/").join(rng.choice(syllables).capitalize() + rng.choice(["", "1", "2024"]) for _ in range(rng.randint(5, 14))))
            else:
                parts.append("é short words")
        texts.append(" ".join(parts))
    expected = [(i, a, b) for i, a, b in plain_random_spans(texts) if not any(s < b and a < e for s, _, e in secret_spans(texts[i]))]
    found = op03_secrets.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(expected) > 100
    assert sorted((r["row"]["doc_id"], x["start"], x["end"]) for r in found for x in r["extra"]) == expected


def test_many_secrets_in_one_text(spark):
    rng = random.Random(3)
    words = ["%032x" % rng.getrandbits(128) if k % 2 else "".join(rng.choice(op03_secrets.ALPHABETS["base62"]) for _ in range(40)) for k in range(6000)]
    text = " é".join(words)
    docs = spark.createDataFrame([(1, text), (2, "x" * 70_000), (3, "0" * 70_000)], "doc_id long, text string")
    found = {r["row"]["doc_id"]: r for r in op03_secrets.find(docs).collect()}
    assert [(x["start"], x["kind"], x["end"]) for x in found[1]["base"]] == secret_spans(text)
    assert all(text[x["start"] : x["end"]] in words for x in found[1]["extra"]) and len(found[1]["extra"]) > 2500
    gone = sorted((x["start"], x["end"]) for x in [*found[1]["base"], *found[1]["extra"]])
    expected, at = "", 0
    for a, b in gone:
        expected, at = (expected + text[at:a] + "[SECRET]", b) if a >= at else (expected, max(at, b))
    out = {r["doc_id"]: r["text"] for r in op03_secrets.redact(docs).collect()}
    assert out == {1: expected + text[at:], 2: "x" * 70_000, 3: "[SECRET]"}


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "é token = 'abcdef0123456789' z", 29, "k"), (2, None, None, "k"), (3, "clean", 5, "k")], "doc_id long, text string, n_chars long, base string")
    assert sorted((r["row"]["base"], len(r["base"])) for r in op03_secrets.find(docs).collect()) == [("k", 0), ("k", 0), ("k", 2)]
    out = {r["doc_id"]: r for r in op03_secrets.redact(docs).collect()}
    assert out[1]["text"] == "é [SECRET]' z" and out[1]["n_chars"] == 13
    assert out[2]["text"] is None and out[3]["text"] == "clean" and out[1]["base"] == "k"


def test_secrets_awkward(spark):
    docs = awkward(spark)
    assert op03_secrets.redact(docs).exceptAll(docs).count() == 0
    assert op03_secrets.redact(nothing(spark)).columns == docs.columns
    assert op03_secrets.redact(nothing(spark)).count() == 0


def test_gradients():
    """Backpropagation through time agrees with finite differences."""
    rng = np.random.default_rng(3)
    net = op02_language.fresh(["a", "b"], rng, 3)
    data, alive, _ = op02_language.windows([b"hello", b"wor"], 6)
    table, inner = net.table[0].astype(np.float64), net.inner[0].astype(np.float64)
    weight = rng.normal(size=(6, 2, 3))

    def loss(t, i):
        states = np.zeros((6, 2, 3))
        h = np.zeros((2, 3))
        for k in range(6):
            g, s = t[data[k]], h @ i
            z, r = 1 / (1 + np.exp(-(g[:, :3] + s[:, :3]))), 1 / (1 + np.exp(-(g[:, 3:6] + s[:, 3:6])))
            c = np.tanh(g[:, 6:] + r * s[:, 6:])
            h = (h + z * (c - h)) * alive[k][:, None]
            states[k] = h
        return float((states * weight).sum())

    states, saved = op02_language.direction(net.table[0], net.inner[0], data, alive)
    d_table, d_inner = op02_language.back(net.inner[0], data, alive, saved, weight.astype(np.float32))
    for name, base, grad in (("t", table, d_table), ("i", inner, d_inner)):
        for at in [(0, 1), (2, 4), (1, 8)] if name == "i" else [(ord("h"), 0), (ord("l"), 5), (ord("o"), 7)]:
            up, down = base.copy(), base.copy()
            up[at] += 1e-4
            down[at] -= 1e-4
            slope = (loss(up, inner) - loss(down, inner) if name == "t" else loss(table, up) - loss(table, down)) / 2e-4
            assert slope == pytest.approx(float(grad[at]), abs=2e-3)


def test_fast_reading_is_the_same():
    net = op02_language.fresh(["a", "b", "c"], np.random.default_rng(0), 5)
    data, alive, _ = op02_language.windows([b"hello world" * 20, b"xyz"])
    ahead, _ = op02_language.direction(net.table[0], net.inner[0], data, alive)
    behind, _ = op02_language.direction(net.table[1], net.inner[1], *op02_language.backwards(data, alive))
    logits = ahead @ net.out[0] + behind[::-1] @ net.out[1] + net.bias
    p = np.exp(logits - logits.max(-1, keepdims=True))
    p /= p.sum(-1, keepdims=True)
    assert np.abs((p - op02_language.labels(net, data, alive).transpose(0, 2, 1)) * alive[:, :, None]).max() < 1e-5


def test_language_held_out(spark):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in op02_language.op2_language(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert len(held) > 200
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) > 0.97


def test_language_awkward(spark):
    docs = awkward(spark)
    net = op02_language.train([("en", b"the words of it"), ("fr", "été à la".encode())], 4, 2)
    found = op02_language.label_documents(docs, net).collect()
    assert len(found) == 8
    assert {r["lang_pred"] for r in found if r["doc_id"] in (2, 3, 5)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in found)
    assert {r["lang_pred"] for r in op02_language.label_documents(docs, op02_language.train([])).collect()} == {"und"}
    assert op02_language.sample(nothing(spark)) == []
    assert op02_language.label_documents(nothing(spark), net).count() == 0


def test_sample_and_bitmap(spark):
    rows = spark.range(10_000)
    some = {r["id"] for r in hashed_sample(rows, 100, "id").collect()}
    expected = {r["id"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(100).collect()}
    assert some == expected
    keys = spark.range(1000).select(F.xxhash64("id").alias("k"))
    bitmap = bitmap_of(keys, "k")
    assert bitmap.admits(np.array([r["k"] for r in keys.collect()], np.int64)).all()
    assert bitmap.admits(np.arange(100_000, dtype=np.int64) * 7919).mean() < 0.1
    assert not bitmap_of(keys.limit(0), "k").admits(np.arange(10, dtype=np.int64)).any()
