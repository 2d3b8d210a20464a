"""Repeated lines across documents, found with two Bloom filters.

1. Every task hashes its lines into a once-seen and a twice-seen filter of
   ``FILTER_WORDS`` 64-bit words; a bit set again carries over into the second filter.
2. The tasks' non-zero words are merged by word, in as many tasks as Spark has
   partitions, by the same rule. Only words of the twice-seen filter go on.
3. That filter (at most ``FILTER_WORDS`` rows of 12 bytes, whatever the data) is
   broadcast to a second pass; a line whose bits are not all set is in one document.
4. Only the suspected lines shuffle: an exact count by the line's key decides, and the
   largest doc_id holding the key keeps it.

A full filter only lets more lines through to step 4; results do not change. Give
more words to a corpus of billions of lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from groundswell.llm.common import binary, documents, per_batch

FILTER_WORDS = 1 << 20  # 8 MB for each filter; a power of two
SHARD_WORDS = 1 << 12  # words merged together
MIN_LENGTH = 20  # code points of a key
MIN_DOCUMENTS = 3


def key_of(line: bytes) -> bytes:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return line.strip().lower()


def long_enough(key: bytes) -> bool:
    if len(key) < MIN_LENGTH:
        return False
    return len(key) >= 4 * MIN_LENGTH or len(key.decode("utf-8", "replace")) >= MIN_LENGTH


def keys_of(raw: bytes | None) -> list[bytes]:
    """The distinct keys of a text that are long enough, in order of appearance."""
    found = dict.fromkeys(map(key_of, raw.split(b"\n"))) if raw else {}
    return [key for key in found if long_enough(key)]


def place(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Each hash's word in the filter and its three bits there."""
    word = (hashes >> np.uint64(18)) % np.uint64(words)
    mask = np.zeros(len(hashes), np.uint64)
    for shift in (0, 6, 12):
        mask |= np.uint64(1) << (hashes >> np.uint64(shift) & np.uint64(63))
    return word.astype(np.int64), mask


def absorb(once: np.ndarray, twice: np.ndarray, at: np.ndarray, o: np.ndarray, t: np.ndarray):
    """Merge words (at, o, t) into the filters; a place may come many times."""
    np.bitwise_or.at(twice, at, t)
    order = np.argsort(at, kind="stable")
    at, o = at[order], o[order]
    while len(at):
        first = np.ones(len(at), bool)
        first[1:] = at[1:] != at[:-1]
        w = at[first]
        twice[w] |= once[w] & o[first]
        once[w] |= o[first]
        at, o = at[~first], o[~first]


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def _build(words: int):
    """The non-zero words of both filters over all lines of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(words, np.uint64), np.zeros(words, np.uint64)
        for batch in batches:
            keys = [key for raw in binary(batch, "text") for key in keys_of(raw)]
            distinct, count = np.unique(_hashes(keys), return_counts=True)
            at, mask = place(distinct, words)
            absorb(once, twice, at, mask, np.where(count > 1, mask, np.uint64(0)))
        (at,) = np.nonzero(once)
        yield pa.record_batch(
            [
                pa.array((at // SHARD_WORDS).astype(np.int32)),
                pa.array((at % SHARD_WORDS).astype(np.int32)),
                pa.array(once[at].view(np.int64)),
                pa.array(twice[at].view(np.int64)),
            ],
            names=["shard", "word", "once", "twice"],
        )

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The twice-seen words of the shards that came to this task."""
    shards: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        shard, word, once, twice = (batch.column(i).to_numpy() for i in range(4))
        for s in np.unique(shard):
            if s not in shards:
                shards[s] = np.zeros(SHARD_WORDS, np.uint64), np.zeros(SHARD_WORDS, np.uint64)
            own = shard == s
            absorb(*shards[s], word[own], once[own].view(np.uint64), twice[own].view(np.uint64))
    for s, (_, twice) in shards.items():
        (at,) = np.nonzero(twice)
        yield pa.record_batch(
            [
                pa.array((int(s) * SHARD_WORDS + at).astype(np.int64)),
                pa.array(twice[at].view(np.int64)),
            ],
            names=["word", "twice"],
        )


def _lines(words: int):
    """(doc_id, key, word, mask) of every distinct long key of each document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, keys = [], []
        for key, raw in zip(batch.column(0).to_pylist(), binary(batch, "text")):
            found = keys_of(raw)
            keys += found
            ids += [key] * len(found)
        at, mask = place(_hashes(keys), words)
        columns = [
            pa.array(ids, pa.int64()),
            pa.array(keys, pa.binary()),
            pa.array(at),
            pa.array(mask.view(np.int64)),
        ]
        return pa.record_batch(columns, names=["doc_id", "key", "word", "mask"])

    return per_batch(run)


def _rewrite(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Drop the lines whose key is listed; (rest, text, n_lines, n_dropped, sha)."""
    names = batch.schema.names
    texts, counts, dropped, shas = [], [], [], []
    for raw, keys in zip(binary(batch, "text"), batch.column(names.index("keys")).to_pylist()):
        lines = (raw or b"").split(b"\n")
        kept = lines
        if keys:
            keys = set(keys)
            kept = [line for line in lines if key_of(line) not in keys]
        out = b"\n".join(kept)
        texts.append(None if raw is None else out)
        counts.append(len(lines))
        dropped.append(len(lines) - len(kept))
        shas.append(hashlib.sha256(out).hexdigest())
    columns = [
        batch.column(names.index("rest")),
        pa.array(texts, pa.binary()).cast(pa.string()),
        pa.array(counts, pa.int64()),
        pa.array(dropped, pa.int64()),
        pa.array(shas, pa.string()),
    ]
    return pa.record_batch(columns, names=["rest", "text", "n_lines", "n_dropped", "sha"])


def repeated_lines(docs: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """(key, last): the keys held by enough documents, and the largest doc_id among them."""
    docs = documents(docs).where("doc_id is not null and text is not null")
    suspects = _suspects(docs, words)
    return (
        suspects.groupBy("key")
        .agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("last"))
        .where(F.col("n") >= MIN_DOCUMENTS)
        .drop("n")
    )


def _suspects(docs: DataFrame, words: int) -> DataFrame:
    built = docs.select("text").mapInArrow(
        _build(words), "shard int, word int, once long, twice long"
    )
    twice = built.repartition("shard").mapInArrow(_merge, "word long, twice long")
    lines = docs.mapInArrow(_lines(words), "doc_id long, key binary, word long, mask long")
    return (
        lines.join(F.broadcast(twice), "word")
        .where(F.col("twice").bitwiseAND(F.col("mask")) == F.col("mask"))
        .select("doc_id", "key")
    )


def _named(column: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + column.replace("`", "``") + "`").alias(column)


def _marked(docs: DataFrame, words: int) -> DataFrame:
    """(rest, text, n_lines, n_dropped, sha): ``rest`` holds every column but the text."""
    plain = documents(docs).where("doc_id is not null and text is not null")
    drops = (
        _suspects(plain, words)
        .join(repeated_lines(plain, words), "key")
        .where("doc_id <> last")
        .groupBy("doc_id")
        .agg(F.collect_set("key").alias("keys"))
    )
    packed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").alias("text"),
        F.struct(*[_named(c) for c in docs.columns if c != "text"]).alias("rest"),
    )
    joined = packed.join(drops, "doc_id", "left").select("rest", "text", "keys")
    schema = T.StructType().add(joined.schema["rest"])
    for name, kind in (("text", "string"), ("n_lines", "long"), ("n_dropped", "long"), ("sha", "string")):
        schema.add(name, kind)
    return joined.mapInArrow(per_batch(_rewrite), schema)


def line_report(docs: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of ``docs`` (doc_id, text, ...).

    A null or empty text is one empty line. A row without doc_id is in no document and
    loses nothing. Rows that repeat a doc_id are one document: a line in two of them is
    in one document, and both lose or keep it.
    """
    return _marked(docs, words).select(
        F.col("rest.doc_id").cast("long").alias("doc_id"),
        "n_lines",
        "n_dropped",
        F.col("sha").alias("kept_sha256"),
    )


def drop_repeated_lines(docs: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """``docs`` with the same columns and rows, without the repeated lines.

    ``n_chars`` follows the text where there is such a column.
    """
    marked = _marked(docs, words)
    columns = []
    for name in docs.columns:
        if name == "text":
            columns.append(F.col("text"))
        elif name == "n_chars":
            length = F.char_length("text").cast(docs.schema[name].dataType)
            columns.append(F.coalesce(length, F.col("rest.n_chars")).alias(name))
        else:
            columns.append(F.col("rest").getField(name).alias(name))
    return marked.select(*columns)
