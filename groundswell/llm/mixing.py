"""Mixing domains to target weights with soft membership.

1. A classifier learned from labelled rows of the table gives every document a
   posterior over the domains, from its text alone.
2. Rates r >= 0 (expected copies) are fitted so that the expected tokens of each domain,
   sum of tokens * posterior * rate, match the targets: least squares by projected
   gradient from r = 1, with documents weighed by their tokens. A step subtracts the
   document's posterior times one number per domain, so a document's rate follows from
   its posterior and the short list of steps. Each step is one aggregate over the
   compact table of posteriors; nothing but a number per domain reaches the driver.
   A domain that (nearly) no document belongs to has no target, and the others share
   its weight. A fit that does not settle is logged with what it is off.
3. To apply the rates, a document is repeated by the whole part of its rate and once
   more with the probability of the rest, drawn from a hash of its id and text.

Domains of the ``documents`` table are its languages: the texts of its sources do not
differ, so no classifier can tell them apart.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from groundswell.llm.common import binary, checkpointed, documents, per_batch

TARGETS = {"en": 0.5, "de": 0.18, "fr": 0.18, "es": 0.14}
TRAIN_ROWS = 2_000  # labelled documents learned from, lowest hashes of their ids
TRAIN_BYTES = 100_000  # documents longer than this are mixed, but not learned from
DIMENSION = 1_024
EPOCHS, RATE, DECAY = 150, 0.5, 1e-5
STEPS, CLOSE = 40, 1e-4  # of the fit: at most, and the share of tokens it may be off
PRESENT = 1e-3  # a domain with a smaller share of tokens, by documents likely its own, has no target

_log = logging.getLogger(__name__)


def trigrams(raw: bytes | None) -> np.ndarray:
    """Hashed byte trigrams of a lower-cased text, square roots scaled to length 1."""
    found = np.zeros(DIMENSION, np.float32)
    a = np.frombuffer((raw or b"").lower(), np.uint8).astype(np.uint32)
    if len(a) >= 3:
        codes = (a[:-2] << np.uint32(16) | a[1:-1] << np.uint32(8) | a[2:]) * np.uint32(2654435761)
        found = np.sqrt(np.bincount(codes >> np.uint32(22), minlength=DIMENSION)).astype(np.float32)
        found /= np.sqrt((found * found).sum())
    return found


def posterior(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Softmax of a linear layer; the last row of ``weights`` is the bias."""
    logit = x @ weights[:-1] + weights[-1]
    p = np.exp(logit - logit.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fit_classifier(x: np.ndarray, y: np.ndarray, domains: int) -> np.ndarray:
    """Multinomial logistic regression by Adam; without rows all domains are equally likely."""
    w = np.zeros((DIMENSION + 1, domains))
    if not len(y):
        return w
    x = np.column_stack([x, np.ones(len(x), np.float32)])
    hot = np.eye(domains)[y]
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, EPOCHS + 1):
        grad = x.T @ (posterior(x[:, :-1], w) - hot) / len(y) + DECAY * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def rates(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates after the given projected gradient steps, from the rows' posteriors."""
    r = np.ones(len(p))
    for step in steps:
        r = np.maximum(0.0, r - p @ step)
    return r


def copies(p: np.ndarray, steps: list[np.ndarray], factor: float, at_least: float) -> np.ndarray:
    """The rates times a common factor, and ``at_least`` for every row."""
    return np.maximum(at_least, rates(p, steps) * factor)


def _features(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = [trigrams(raw).tobytes() for raw in binary(batch, "text")]
    return pa.record_batch([batch.column(0), pa.array(found, pa.binary())], names=["domain", "x"])


def train(docs: DataFrame, domains: list[str], column: str, rows: int = TRAIN_ROWS) -> np.ndarray:
    """The classifier, from at most ``rows`` rows whose ``column`` names a domain."""
    labelled = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").alias("text"),
        F.col(f"`{column}`").cast("string").alias("domain"),
    ).where(
        F.col("domain").isin(domains)
        & F.col("text").isNotNull()
        & (F.octet_length("text") <= TRAIN_BYTES)
    )
    chosen = labelled.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = (
        labelled.join(F.broadcast(chosen), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "domain", "text")
        .limit(rows)
        .select("domain", "text")
    )
    found = sample.mapInArrow(per_batch(_features), "domain string, x binary").collect()
    x = np.array([np.frombuffer(r["x"], np.float32) for r in found]).reshape(-1, DIMENSION)
    return fit_classifier(x, np.array([domains.index(r["domain"]) for r in found], int), len(domains))


def _memberships(weights: np.ndarray):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raws = binary(batch, "text")
        p = posterior(np.array([trigrams(raw) for raw in raws]), weights)
        tokens = [len(raw.split()) if raw else 0 for raw in raws]
        ends = pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32))
        lists = pa.ListArray.from_arrays(ends, pa.array(p.ravel()))
        return pa.record_batch(
            [batch.column(0), pa.array(tokens, pa.int64()), lists], names=["doc_id", "n_tokens", "p"]
        )

    return per_batch(run)


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, posteriors) of a batch of memberships."""
    n = batch.num_rows
    return batch.column(1).to_numpy().astype(np.float64), batch.column(2).flatten().to_numpy().reshape(n, -1)


def _expected(steps: list[np.ndarray], factor: float, at_least: float):
    """Per task and domain: expected tokens under the rates, and tokens of documents likely its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, own = None, None
        for batch in batches:
            if batch.num_rows:
                tokens, p = _rows(batch)
                part = (tokens * copies(p, steps, factor, at_least)) @ p
                likely = tokens @ (p >= 0.5)
                total, own = (part, likely) if total is None else (total + part, own + likely)
        if total is not None:
            yield pa.record_batch(
                [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total), pa.array(own)],
                names=["k", "tokens", "own"],
            )

    return run


def _sums(
    members: DataFrame, steps: list[np.ndarray], domains: int, factor: float = 1.0, at_least: float = 0.0
) -> tuple[np.ndarray, np.ndarray]:
    found = (
        members.mapInArrow(_expected(steps, factor, at_least), "k int, tokens double, own double")
        .groupBy("k")
        .agg(F.sum("tokens").alias("tokens"), F.sum("own").alias("own"))
        .collect()
    )
    total, own = np.zeros(domains), np.zeros(domains)
    for row in found:
        total[row["k"]], own[row["k"]] = row["tokens"], row["own"]
    return total, own


def fit_rates(members: DataFrame, targets: list[float], at_least: float = 0.0) -> tuple[list[np.ndarray], float, float]:
    """The steps of the fit, the common factor of the rates, and the share of tokens that is off.

    The factor lifts the domain whose rate is lowest to ``at_least``: the inverse of the
    smallest target is the most it can be. A step of this size never overshoots, as the
    memberships scaled by the shares have no eigenvalue over 1.
    """
    now, own = _sums(members, [], len(targets))
    whole = now.sum()
    steps: list[np.ndarray] = []
    present = own > PRESENT * whole
    if not present.any():
        return steps, max(1.0, at_least), 0.0
    share = now / whole
    weights = np.where(present, targets, 0.0)
    weights *= share[present].sum() / weights.sum()
    scale = np.maximum(share, PRESENT)
    off = lambda now, whole: np.where(present, now / whole - weights, 0.0)
    gap = off(now, whole)
    while len(steps) < STEPS and np.abs(gap).max() > CLOSE:
        steps.append(gap / scale)
        now, _ = _sums(members, steps, len(targets))
        gap = off(now, whole)
    residual, factor = np.abs(gap).max(), 1.0
    if residual > CLOSE:
        _log.warning("the rates did not settle in %d steps: %.4f of the tokens off", STEPS, residual)
    if at_least:
        factor = max(1.0, at_least * (share[present] / weights[present]).max())
        now, _ = _sums(members, steps, len(targets), factor, at_least)
        residual = np.abs(off(now, now.sum())).max()
        if residual > 0.01:
            _log.warning("with every document kept, %.4f of the tokens are off the targets", residual)
    return steps, factor, float(residual)


class Mix:
    """A fitted mix: the classifier, the steps of the fit, and the common factor of all rates.

    ``at_least`` raises all rates by one factor until the lowest domain has that number, and
    single documents still below it too; with 1 every document stays and others are
    repeated instead. ``residual`` is the share of tokens that the result is off.
    """

    def __init__(self, docs: DataFrame, targets: dict[str, float], column: str, at_least: float):
        self.domains = list(targets)
        self.weights = train(docs, self.domains, column)
        schema = "doc_id long, n_tokens long, p array<double>"
        self.members = checkpointed(documents(docs).mapInArrow(_memberships(self.weights), schema))
        self.at_least = at_least
        self.steps, self.factor, self.residual = fit_rates(self.members, list(targets.values()), at_least)

    def report(self) -> DataFrame:
        domains, steps, factor, at_least = self.domains, self.steps, self.factor, self.at_least

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            _, p = _rows(batch)
            best = p.argmax(axis=1)
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array([domains[k] for k in best.tolist()], pa.string()),
                pa.array(p[np.arange(len(p)), best]),
                pa.array(copies(p, steps, factor, at_least)),
            ]
            return pa.record_batch(columns, names=["doc_id", "n_tokens", "domain", "posterior", "rate"])

        return self.members.mapInArrow(
            per_batch(run),
            "doc_id long, n_tokens long, domain string, posterior double, rate double",
        )

    def apply(self, docs: DataFrame) -> DataFrame:
        weights, steps, factor, at_least = self.weights, self.steps, self.factor, self.at_least

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            raws = binary(batch, "text")
            ids = batch.column(batch.schema.names.index("doc_id")).to_pylist()
            p = posterior(np.array([trigrams(raw) for raw in raws]), weights)
            draw = [
                xxhash.xxh3_64_intdigest(b"%s %s" % (str(key).encode(), raw or b"")) / 2**64
                for key, raw in zip(ids, raws)
            ]
            rate = copies(p, steps, factor, at_least)
            times = np.floor(rate + 1e-9 + np.array(draw) * (1 - 2e-9)).astype(int)
            return batch.take(pa.array(np.repeat(np.arange(len(times)), times)))

        return docs.mapInArrow(per_batch(run), docs.schema)


def mixing_rates(
    docs: DataFrame,
    targets: dict[str, float] = TARGETS,
    column: str = "lang",
    at_least: float = 0.0,
) -> DataFrame:
    """(doc_id, n_tokens, domain, posterior, rate) per row of ``docs`` (doc_id, text, ``column``, ...).

    ``domain`` is the likeliest one and ``posterior`` its probability. Tokens are words,
    runs without ASCII white space. Null and empty texts have no tokens and the posterior
    of the bias; rows whose ``column`` is null or names no target are only not learned
    from. A domain that no text belongs to has no target. Repeated rows count
    each for itself. An empty table gives an empty result.
    """
    return Mix(docs, targets, column, at_least).report()


def mix_documents(
    docs: DataFrame,
    targets: dict[str, float] = TARGETS,
    column: str = "lang",
    at_least: float = 1.0,
) -> DataFrame:
    """``docs`` with the same columns, each row as often as its rate says."""
    return Mix(docs, targets, column, at_least).apply(docs)
