"""Language of a text: a bidirectional gated recurrent network over its bytes.

The network reads bytes in both directions, labels every position, and a document's probabilities are the mean over
its positions. It is trained here, in numpy, by backpropagation through time, on every byte of a bounded sample of
labelled rows (SAMPLE_ROWS rows in the order of a hash). Prediction reads every byte of every text, in windows of WINDOW
bytes that are run side by side.

Defined results: `und` with score 0 for a text that is null or has no letter; a null lang is not learned from; a null
doc_id counts as not held out and is not learned from; equal rows give equal results; with nothing to learn from,
every text is `und`; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.sampling import hashed_sample

HIDDEN = 12
WINDOW = 128
SAMPLE_ROWS = 256
EPOCHS = 6
BATCH = 64
RATE = 0.01
#: Windows run side by side.
SIDE = 2048
SEED = 7


@dataclass
class Network:
    """For each direction: `table` (256 x 3H, a byte's part of the gates), `inner` (H x 3H) and `out` (H x K). Columns are
    update gate, reset gate, candidate."""

    langs: list[str]
    table: list[np.ndarray]
    inner: list[np.ndarray]
    out: list[np.ndarray]
    bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [*self.table, *self.inner, *self.out, self.bias]


def fresh(langs: list[str], rng: np.random.Generator, hidden: int = HIDDEN) -> Network:
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    return Network(langs, [draw(256, 3 * hidden, scale=0.3) for _ in "fb"], [draw(hidden, 3 * hidden, scale=hidden**-0.5) for _ in "fb"], [draw(hidden, len(langs), scale=0.3) for _ in "fb"], np.zeros(len(langs), np.float32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def direction(table: np.ndarray, inner: np.ndarray, data: np.ndarray, alive: np.ndarray):
    """States after each step, (steps, windows, H), and what the way back needs; data and alive are (steps, windows)."""
    hidden = inner.shape[0]
    h = np.zeros((data.shape[1], hidden), np.float32)
    states, saved = np.empty((*data.shape, hidden), np.float32), []
    for t in range(len(data)):
        gates = table[data[t]]
        from_state = h @ inner
        zr = gates[:, : 2 * hidden]
        zr += from_state[:, : 2 * hidden]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        z, r = zr[:, :hidden], zr[:, hidden:]
        c = np.tanh(gates[:, 2 * hidden :] + r * from_state[:, 2 * hidden :])
        saved.append((h, z.copy(), r.copy(), c, from_state[:, 2 * hidden :]))
        h = (h + z * (c - h)) * alive[t][:, None]
        states[t] = h
    return states, saved


def back(inner: np.ndarray, data: np.ndarray, alive: np.ndarray, saved: list, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of `table` and `inner` through time."""
    hidden = inner.shape[0]
    d_table, d_inner = np.zeros((256, 3 * hidden), np.float32), np.zeros_like(inner)
    dh = np.zeros_like(d_states[0])
    for t in range(len(data) - 1, -1, -1):
        h, z, r, c, s = saved[t]
        d = (dh + d_states[t]) * alive[t][:, None]
        dc = d * z * (1 - c * c)
        dz = d * (c - h) * z * (1 - z)
        dr = dc * s * r * (1 - r)
        d_gates = np.concatenate([dz, dr, dc], 1)
        d_from = np.concatenate([dz, dr, dc * r], 1)
        d_inner += h.T @ d_from
        dh = d * (1 - z) + d_from @ inner.T
        np.add.at(d_table, data[t], d_gates)
    return d_table, d_inner


def backwards(data: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same windows from their last byte to their first; dead steps come first and keep the state at zero."""
    return data[::-1], alive[::-1]


def _read(table: np.ndarray, inner: np.ndarray, out: np.ndarray, data: np.ndarray, alive: np.ndarray | None, logits: np.ndarray, turned: bool) -> None:
    """Add one direction's part to `logits` (steps, K, windows). The same arithmetic as `direction`, laid out gate by gate
    so that every operation runs over contiguous memory."""
    hidden, n = inner.shape[0], data.shape[1]
    table, inner, out = (np.ascontiguousarray(x.T) for x in (table, inner, out))
    table[: 2 * hidden] *= 0.5
    inner[: 2 * hidden] *= 0.5
    h, gates, state = np.zeros((hidden, n), np.float32), np.empty((3 * hidden, n), np.float32), np.empty((3 * hidden, n), np.float32)
    zr, c, s = gates[: 2 * hidden], gates[2 * hidden :], state[2 * hidden :]
    steps = range(len(data) - 1, -1, -1) if turned else range(len(data))
    for t in steps:
        np.take(table, data[t], axis=1, out=gates, mode="clip")
        np.matmul(inner, h, out=state)
        zr += state[: 2 * hidden]
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5
        s *= zr[hidden:]
        c += s
        np.tanh(c, out=c)
        c -= h
        c *= zr[:hidden]
        h += c
        if alive is not None:
            h *= alive[t]
        logits[t] += out @ h


def labels(net: Network, data: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Probabilities at every position: (steps, K, windows)."""
    logits = np.empty((data.shape[0], len(net.langs), data.shape[1]), np.float32)
    logits[:] = net.bias[None, :, None]
    _read(net.table[0], net.inner[0], net.out[0], data, None, logits, False)  # dead steps come last here
    _read(net.table[1], net.inner[1], net.out[1], data, alive, logits, True)
    logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(1, keepdims=True)
    return logits


def windows(texts: list[bytes], width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(steps, windows) bytes, which of them are there, and the text each window is of."""
    sizes = np.array([len(t) for t in texts], np.int64)
    count = (sizes + width - 1) // width
    data = np.zeros((int(count.sum()), width), np.uint8)
    at = np.concatenate([[0], np.cumsum(count)]) * width
    flat = data.reshape(-1)
    for i, t in enumerate(texts):
        flat[at[i] : at[i] + len(t)] = np.frombuffer(t, np.uint8)
    owner = np.repeat(np.arange(len(texts)), count)
    first = np.repeat(at[:-1] // width, count)
    there = (np.arange(len(owner)) - first) * width
    alive = (there[:, None] + np.arange(width)[None, :]) < sizes[owner][:, None]
    return np.ascontiguousarray(data.T), np.ascontiguousarray(alive.T).astype(np.float32), owner


def train(samples: list[tuple[str, bytes]], hidden: int = HIDDEN, epochs: int = EPOCHS) -> Network | None:
    """Adam on the cross-entropy of every position; the classes weigh alike."""
    langs = sorted({lang for lang, _ in samples})
    if not langs:
        return None
    rng = np.random.default_rng(SEED)
    net = fresh(langs, rng, hidden)
    data, alive, owner = windows([t for _, t in samples])
    target = np.array([langs.index(lang) for lang, _ in samples])[owner]
    share = np.bincount(target, minlength=len(langs))
    weight = (len(target) / (len(langs) * np.maximum(share, 1))).astype(np.float32)
    mean, var, steps = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()], 0
    n = len(target)
    total = epochs * ((n + BATCH - 1) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(n)
        for k in range(0, n, BATCH):
            some = order[k : k + BATCH]
            x, live, y = data[:, some], alive[:, some], target[some]
            rx, rlive = backwards(x, live)
            ahead, kept_a = direction(net.table[0], net.inner[0], x, live)
            behind, kept_b = direction(net.table[1], net.inner[1], rx, rlive)
            behind = behind[::-1]
            p = ahead @ net.out[0] + behind @ net.out[1] + net.bias
            p = np.exp(p - p.max(-1, keepdims=True))
            p /= p.sum(-1, keepdims=True)
            p[:, np.arange(len(y)), y] -= 1
            p *= (live * weight[y])[:, :, None] / max(1.0, float(live.sum()))
            d_a, d_b = p @ net.out[0].T, p @ net.out[1].T
            ga, gb = back(net.inner[0], x, live, kept_a, d_a), back(net.inner[1], rx, rlive, kept_b, d_b[::-1])
            grads = [ga[0], gb[0], ga[1], gb[1], np.einsum("tnh,tnk->hk", ahead, p), np.einsum("tnh,tnk->hk", behind, p), p.sum((0, 1))]
            norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
            steps += 1
            rate = RATE * (1 - steps / (total + 1))
            for part, g, m, v in zip(net.parts(), grads, mean, var, strict=True):
                g = g * min(1.0, 1.0 / max(norm, 1e-9))
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                part -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
    return net


def predict(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities of each text: (texts, K). Texts are cut into windows, which run SIDE at a time."""
    pooled, sizes = np.zeros((len(texts), len(net.langs))), np.array([max(1, len(t)) for t in texts])
    held: list[tuple[int, bytes]] = []
    room = SIDE * WINDOW

    def flush() -> None:
        data, alive, owner = windows([t for _, t in held])
        p = np.einsum("tkn,tn->nk", labels(net, data, alive), alive)
        np.add.at(pooled, np.array([i for i, _ in held])[owner], p)
        held.clear()

    used = 0
    for i, text in enumerate(texts):
        for k in range(0, len(text), room):
            piece = text[k : k + room]
            if held and used + len(piece) > room:
                flush()
                used = 0
            held.append((i, piece))
            used += max(len(piece), WINDOW)
    if held:
        flush()
    return pooled / sizes[:, None]


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4


def sample(docs: DataFrame) -> list[tuple[str, bytes]]:
    """At most SAMPLE_ROWS rows reach the driver, with their whole texts."""
    rows = docs.where((remainder(F.col("doc_id")) != 2) & F.col("lang").isNotNull())
    total = rows.count()
    whole = rows.where(F.length("text") > 0).select("doc_id", "lang", F.xxhash64("text").alias("hash"), F.col("text").cast("binary").alias("text"))
    return [(r["lang"], bytes(r["text"])) for r in hashed_sample(whole, SAMPLE_ROWS, "doc_id", "lang", "hash", total=total).collect()]


def label_documents(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(net)  # some kilobytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            known = [i for i, t in enumerate(texts) if net and t and any(map(str.isalpha, t))]
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            if known:
                p = predict(net, [texts[i].encode() for i in known])
                for i, row in zip(known, p, strict=True):
                    best = int(row.argmax())
                    names[i], scores[i] = net.langs[best], min(1.0, float(row[best]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def op2_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = label_documents(docs, train(sample(docs)))
    return found.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
