"""Quality of documents by attention-based multiple-instance learning.

A document is a bag of passages and only the bag has a label (Ilse, Tomczak and
Welling, "Attention-based Deep Multiple Instance Learning"). Every passage is encoded,
gated attention weighs the encodings, and a logistic layer scores the weighted sum:

    h = tanh(x E + e),  a = softmax((tanh(h V) * sigmoid(h U)) w),  score = sigmoid(a h c + d)

Features of a passage are shares of its bytes and simple word statistics of its text;
ids, sources, languages and labels are not among them. The model is trained on a
bounded sample of the labelled rows and sent to the tasks (some 50 kB); every text is
then scored whole, where it lies, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from groundswell.llm.common import binary, digest_words, documents, per_batch

PASSAGE_WORDS = 64
TRAIN_ROWS = 6_000  # labelled documents in the sample, lowest hashes of their ids
TRAIN_BYTES = 200_000  # documents longer than this are scored, but not in the sample
HIDDEN, ATTENTION = 32, 16
EPOCHS, BATCH, RATE, DECAY = 25, 64, 4e-3, 1e-4
FEATURES = 95 + 12


def passages(raw: bytes | None) -> np.ndarray:
    """One row of features per passage; a text without words is one empty passage."""
    words = raw.split() if raw else []
    if not words:
        return np.zeros((1, FEATURES), np.float32)
    count = -(-len(words) // PASSAGE_WORDS)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    own = np.arange(len(words)) // PASSAGE_WORDS
    joined = np.frombuffer(b"".join(words), np.uint8)
    # 0 for bytes above ASCII, 1-94 for the printable ones; control bytes count as 0.
    kind = np.where((joined > 32) & (joined < 127), joined - 32, 0).astype(np.int64)
    at = np.repeat(own, lengths)
    shares = np.bincount(at * 95 + kind, minlength=count * 95).reshape(count, 95).astype(np.float64)
    size = np.maximum(shares.sum(axis=1), 1.0)
    shares /= size[:, None]
    n = np.bincount(own, minlength=count).astype(np.float64)

    hashes = digest_words(words)
    again = np.zeros(len(words))
    again[1:] = hashes[1:] == hashes[:-1]
    order = np.lexsort((hashes, own))
    distinct = np.ones(len(words))
    distinct[order[1:]] = (hashes[order[1:]] != hashes[order[:-1]]) | (own[order[1:]] != own[order[:-1]])
    per = lambda values: np.bincount(own, values, minlength=count) / n
    mean = per(lengths)
    upper, digit = shares[:, 33:59].sum(axis=1), shares[:, 16:26].sum(axis=1)
    letter = upper + shares[:, 65:91].sum(axis=1) + shares[:, 0]
    lines = (raw.count(b"\n") + 1) / len(words)
    statistics = [
        mean / 8,
        np.sqrt(np.maximum(per(lengths**2) - mean**2, 0)) / 8,
        per(again),
        per(distinct),
        per(lengths <= 3),
        per(lengths == 1),
        np.log1p(n) / 4,
        np.full(count, np.log1p(lines)),
        np.full(count, np.log1p(len(words)) / 8),
        upper,
        digit,
        1 - letter - digit,
    ]
    return np.column_stack([np.sqrt(shares), *statistics]).astype(np.float32)


@dataclass
class Model:
    """Weights; ``center`` and ``scale`` standardize the features."""

    center: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def score(self, bag: np.ndarray) -> float:
        w = self.weights
        x = (bag - self.center) / self.scale
        h = np.tanh(x @ w["E"] + w["e"])
        gate = np.tanh(h @ w["V"]) / (1 + np.exp(-(h @ w["U"])))
        logit = gate @ w["w"]
        a = np.exp(logit - logit.max())
        z = (a / a.sum()) @ h
        return float(1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"][0], -50, 50))))


def _constant(share: float) -> Model:
    """What is known from labels of one kind, or from none (0.5)."""
    shapes = {"E": (FEATURES, 1), "e": (1,), "V": (1, 1), "U": (1, 1), "w": (1,), "c": (1,)}
    weights = {k: np.zeros(s) for k, s in shapes.items()}
    share = min(max(share, 0.01), 0.99)
    weights["d"] = np.array([np.log(share / (1 - share))])
    return Model(np.zeros(FEATURES), np.ones(FEATURES), weights)


def fit(bags: list[np.ndarray], labels: np.ndarray) -> Model:
    """Train by Adam on mini-batches of bags; the same bags give the same model."""
    if not len(labels) or labels.min() == labels.max():
        return _constant(labels.mean() if len(labels) else 0.5)
    every = np.concatenate(bags)
    center, scale = every.mean(axis=0), every.std(axis=0) + 0.02
    rng = np.random.default_rng(11)
    shapes = {
        "E": (FEATURES, HIDDEN),
        "e": (HIDDEN,),
        "V": (HIDDEN, ATTENTION),
        "U": (HIDDEN, ATTENTION),
        "w": (ATTENTION,),
        "c": (HIDDEN,),
        "d": (1,),
    }
    w = {
        k: rng.normal(0, 1 / np.sqrt(s[0]), s) if k.isupper() or k in "wc" else np.zeros(s)
        for k, s in shapes.items()
    }
    m, v = ({k: np.zeros(s) for k, s in shapes.items()} for _ in range(2))
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(bags), BATCH):
            chosen = order[at : at + BATCH]
            sizes = np.array([len(bags[i]) for i in chosen])
            x = (np.concatenate([bags[i] for i in chosen]) - center) / scale
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            grad = _gradient(w, x, sizes, starts, labels[chosen])
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k in w:
                g = grad[k] + (DECAY * w[k] if k.isupper() else 0)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(center, scale, w)


def _gradient(w, x, sizes, starts, labels) -> dict[str, np.ndarray]:
    """Of the mean cross entropy over bags; bags are runs of rows of ``x``."""
    bag = np.repeat(np.arange(len(sizes)), sizes)
    h = np.tanh(x @ w["E"] + w["e"])
    tv, su = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    logit = (tv * su) @ w["w"]
    a = np.exp(logit - np.maximum.reduceat(logit, starts)[bag])
    a /= np.add.reduceat(a, starts)[bag]
    z = np.add.reduceat(a[:, None] * h, starts)
    p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -50, 50)))
    dy = (p - labels) / len(labels)
    dz = dy[:, None] * w["c"]
    da = (dz[bag] * h).sum(axis=1)
    dlogit = a * (da - np.add.reduceat(a * da, starts)[bag])
    dg = dlogit[:, None] * w["w"]
    dv, du = dg * su * (1 - tv * tv), dg * tv * su * (1 - su)
    dh = a[:, None] * dz[bag] + dv @ w["V"].T + du @ w["U"].T
    dx = dh * (1 - h * h)
    return {
        "E": x.T @ dx,
        "e": dx.sum(axis=0),
        "V": h.T @ dv,
        "U": h.T @ du,
        "w": (tv * su).T @ dlogit,
        "c": z.T @ dy,
        "d": np.array([dy.sum()]),
    }


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _bags(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = [passages(raw).tobytes() for raw in binary(batch, "text")]
    return pa.record_batch([batch.column(0), pa.array(found, pa.binary())], names=["label", "bag"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The model from at most ``rows`` labelled documents that are not held out.

    Of a doc_id with several labels the smallest counts. At most
    ``rows * TRAIN_BYTES`` bytes of text take part, whatever the tables' sizes.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
        .where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    sample = (
        documents(docs)
        .where(F.octet_length(F.coalesce("text", F.lit(""))) <= TRAIN_BYTES)
        .join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "label", "text")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "text")
        .limit(rows)
        .select("label", "text")
    )
    found = sample.mapInArrow(per_batch(_bags), "label int, bag binary").collect()
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES) for r in found]
    return fit(bags, np.array([r["label"] for r in found], np.float64))


def _score(model: Model):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = [model.score(passages(raw)) for raw in binary(batch, "text")]
        return pa.record_batch([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return per_batch(run)


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs`` (doc_id, text, ...).

    A null, empty or blank text is one empty passage and gets the score learned for
    it. Without labels of both kinds every score is the share of 1 among the labels,
    or 0.5 when there is none. A null doc_id is not held out.
    """
    model = train(docs, labels, rows)
    scored = documents(docs).mapInArrow(_score(model), "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def keep_quality(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores ``least`` or more, with the same columns."""
    model = train(docs, labels)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        good = [model.score(passages(raw)) >= least for raw in binary(batch, "text")]
        return batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(per_batch(run), docs.schema)
