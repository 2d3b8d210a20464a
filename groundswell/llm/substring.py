"""Duplicate word spans across documents, by anchored lookups of windows.

This replaces a relative Lempel-Ziv parse. The reference of a document is every document
with a smaller id, and the words covered are those of the parse: all that lie in a run
of ``WINDOW`` words or more that the reference holds. The factors are not: each points to
the first place of its own stretch, so one long copy can come out as several, and they
can overlap.

1. Every window of ``WINDOW`` words owns one anchor: the smallest of the hashes of its
   runs of ``GRAM`` words (winnowing, Schleimer et al.). Equal windows own equal
   anchors, and a text has about one anchor in five words. Anchors found in one document
   only are dropped: a count per anchor, combined before the shuffle.
2. Consecutive windows of one anchor are a stretch. The stretches are the reference
   blocks: Spark deals them by hash, and each block is an index from a stretch to its
   first place (smallest doc_id, then position). Every stretch is looked up in the block
   it can be in; a stretch found in a smaller document is copied whole.
3. Where stretches of one anchor differ, a factor begins or ends inside them. There, and
   only there, single windows of the stretches' first places are looked up in the same way.
4. Places next to each other that point to one document and distance become one factor.

Counts and lookups are aggregates and joins; a passage in a third of all documents is
combined before the shuffle, and its lookups are split by adaptive execution.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from groundswell.llm.common import (
    Prefixes,
    Words,
    binary,
    checkpointed,
    documents,
    mix,
    per_batch,
    release,
)

WINDOW = 13
GRAM = 5
SLICE = 1 << 20  # bytes of text worked on at a time, or one text


def _smallest(grams: np.ndarray) -> np.ndarray:
    """The smallest of each ``WINDOW - GRAM + 1`` neighbours, by doubling: of 2, of 4, of 8, of 9."""
    pairs = np.minimum(grams[:-1], grams[1:])
    fours = np.minimum(pairs[:-2], pairs[2:])
    eights = np.minimum(fours[:-4], fours[4:])
    return np.minimum(eights[:-1], grams[WINDOW - GRAM :])


class _Windows:
    """All windows of many texts with their anchors, and the stretches of equal ones.

    The texts' words are one sequence, since a run's hash does not depend on its place; the
    windows that cross the border of two texts are left out.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        words = Words(data, ends)
        self.begin = words.text  # the first word of each text
        self.text = Prefixes(words.hashes)
        count = np.maximum(np.diff(self.begin) - (WINDOW - 1), 0)
        rows = np.repeat(np.arange(len(count)), count)
        #: Of each window: its text and its first word.
        self.at = np.arange(len(rows)) + (self.begin[:-1] - np.cumsum(count) + count)[rows]
        grams = self.text.every(GRAM)
        own = _smallest(grams)[self.at] if len(rows) else np.empty(0, np.uint64)
        new = np.ones(len(rows), bool)
        new[1:] = (own[1:] != own[:-1]) | (rows[1:] != rows[:-1])
        first = np.flatnonzero(new)
        #: Of each stretch: its text, first word, number of windows and anchor.
        self.row, self.first = rows[first], self.at[first]
        self.count = np.diff(np.append(first, len(rows)))
        self.anchor = own[first]

    def start(self, at: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Places in the texts of the words ``at``."""
        return at - self.begin[row]


def _sliced(batch: pa.RecordBatch) -> Iterator[tuple[int, _Windows]]:
    """The windows of a batch's texts, a slice of some ``SLICE`` bytes at a time, with its first row."""
    texts = batch.column(batch.schema.names.index("text")).cast(pa.large_binary()).fill_null(b"")
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    begin = 0
    while begin < len(texts):
        stop = max(begin + 1, int(np.searchsorted(ends, ends[begin] + SLICE)))
        stop = min(stop, len(texts))
        yield begin, _Windows(data[ends[begin] : ends[stop]], ends[begin : stop + 1] - ends[begin])
        begin = stop


def _anchors(batch: pa.RecordBatch) -> pa.RecordBatch:
    values, counts = [np.empty(0, np.uint64)], [np.zeros(1, np.int64)]
    for _, found in _sliced(batch):
        order = np.lexsort((found.anchor, found.row))
        anchor, row = found.anchor[order], found.row[order]
        new = np.ones(len(row), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
        values.append(anchor[new])
        counts.append(np.bincount(row[new], minlength=len(found.begin) - 1))
    ends = pa.array(np.cumsum(np.concatenate(counts)).astype(np.int32))
    lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(values).view(np.int64)))
    return pa.record_batch([batch.column(0), lists], names=["doc_id", "anchors"])


def _tagged(anchor: np.ndarray, row: np.ndarray) -> np.ndarray:
    """One number for an anchor of a row. Two that meet by chance only cause a lookup in vain."""
    return anchor + mix(row.astype(np.uint64) + np.uint64(1))


def _listed(batch: pa.RecordBatch, name: str) -> Iterator[tuple[np.ndarray, _Windows, np.ndarray]]:
    """(ids, windows, which stretches have listed anchors) of the documents that have a list."""
    lists = batch.column(batch.schema.names.index(name))
    batch = batch.filter(pc.greater(pc.fill_null(pc.list_value_length(lists), 0), 0))
    lists = batch.column(batch.schema.names.index(name))
    ids = batch.column(0).to_numpy()
    rows = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    listed = _tagged(lists.flatten().to_numpy().view(np.uint64), rows)
    ends = np.searchsorted(rows, np.arange(len(lists) + 1))
    for begin, found in _sliced(batch):
        stop = begin + len(found.begin) - 1
        wanted = listed[ends[begin] : ends[stop]]
        keep = np.isin(_tagged(found.anchor, found.row + begin), wanted)
        yield ids[begin:stop], found, keep


def _rows(found: list[tuple[np.ndarray, ...]], names: list[str], kinds: list) -> pa.RecordBatch:
    """The rows of all slices, a column per name."""
    columns = zip(*found) if found else [[np.empty(0, np.int64)]] * len(names)
    arrays = [pa.array(np.concatenate(c), kind) for c, kind in zip(columns, kinds)]
    return pa.record_batch(arrays, names=names)


def _stretches(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The stretches of each document's remaining anchors."""
    rows = []
    for ids, found, keep in _listed(batch, "shared"):
        row, first, count = found.row[keep], found.first[keep], found.count[keep]
        hashes = found.text.runs(first, count + WINDOW - 1).view(np.int64)
        rows.append((ids[row], found.start(first, row), count, found.anchor[keep].view(np.int64), hashes))
    names = ["doc_id", "start", "windows", "anchor", "stretch"]
    return _rows(rows, names, [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()])


def _windows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The single windows of each document's anchors with differing stretches."""
    rows = []
    for ids, found, keep in _listed(batch, "open"):
        row = np.repeat(found.row[keep], found.count[keep])
        at = found.at[np.repeat(keep, found.count)]
        hashes = found.text.runs(at, np.int64(WINDOW)).view(np.int64)
        rows.append((ids[row], found.start(at, row), hashes))
    return _rows(rows, ["doc_id", "start", "window"], [pa.int64(), pa.int32(), pa.int64()])


def parse(places: list) -> list[tuple[int, int, int, int]]:
    """Factors (start, length, ref_doc, ref_start) from copied stretches, neighbours merged.

    A stretch is (first window, number of windows, document, first window there).
    """
    factors: list[tuple[int, int, int, int]] = []
    for start, windows, doc, place in sorted(places):
        length = windows + WINDOW - 1
        if factors:
            begin, so_far, ref, at = factors[-1]
            if doc == ref and start - begin == place - at and start <= begin + so_far - WINDOW + 1:
                factors[-1] = (begin, max(so_far, start - begin + length), ref, at)
                continue
        factors.append((start, length, doc, place))
    return factors


def _parse(batch: pa.RecordBatch) -> pa.RecordBatch:
    names = ["start", "length", "ref_doc_id", "ref_start"]
    found = [
        [dict(zip(names, f)) for f in parse([tuple(p.values()) for p in places])]
        for places in batch.column(1).to_pylist()
    ]
    kind = pa.list_(
        pa.struct([(n, pa.int64() if n == "ref_doc_id" else pa.int32()) for n in names])
    )
    return pa.record_batch([batch.column(0), pa.array(found, kind)], names=["doc_id", "factors"])


def _first_places(rows: DataFrame, key: str, *others: str) -> DataFrame:
    """(key, doc, place, last, others) of the smallest (doc_id, start) with each key."""
    place = F.struct(F.col("doc_id").alias("doc"), F.col("start").alias("place"), *others)
    found = rows.groupBy(key).agg(F.min(place).alias("ref"), F.max("doc_id").alias("last"))
    # Always true; it keeps all uses of the aggregate alike, so that it is shuffled once.
    return found.select(key, "ref.*", "last").where("doc <= last")


def duplicate_factors(docs: DataFrame) -> DataFrame:
    """(doc_id, factors) of the documents that hold words copied from smaller ids.

    ``factors`` is an array of (start, length, ref_doc_id, ref_start), counted in words
    from 0, in order; they may overlap at their boundaries. Null, empty and short texts
    and a null doc_id have none. Rows that repeat a doc_id are one document and do not
    make each other's words duplicates; they should hold the same text.
    """
    docs = documents(docs)
    owned = docs.where("doc_id is not null and text is not null").mapInArrow(
        per_batch(_anchors), "doc_id long, anchors array<long>"
    )
    owned = owned.select("doc_id", F.explode("anchors").alias("anchor"))
    shared = owned.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    suspects = (
        owned.join(shared.select("anchor"), "anchor")
        .groupBy("doc_id")
        .agg(F.collect_set("anchor").alias("shared"))
    )
    suspects = checkpointed(suspects)
    release(docs.sparkSession)

    # All joins of the texts are left joins on doc_id, so Spark shuffles the texts once
    # and reads that exchange again.
    found = docs.join(suspects, "doc_id", "left").mapInArrow(
        per_batch(_stretches),
        "doc_id long, start int, windows int, anchor long, stretch long",
    )
    first = _first_places(found, "stretch", "anchor")
    copied = (
        found.join(first.where("doc < last").select("stretch", "doc", "place"), "stretch")
        .where("doc < doc_id")
        .select("doc_id", "start", "windows", "doc", "place")
    )
    differing = first.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    opened = (
        first.join(differing.select("anchor"), "anchor")
        .groupBy(F.col("doc").alias("doc_id"))
        .agg(F.collect_set("anchor").alias("open"))
    )
    windows = docs.join(opened, "doc_id", "left").mapInArrow(
        per_batch(_windows), "doc_id long, start int, window long"
    )
    earlier = _first_places(windows, "window").where("doc < last").drop("last")
    single = (
        windows.join(earlier, "window")
        .where("doc < doc_id")
        .select("doc_id", "start", F.lit(1).alias("windows"), "doc", "place")
    )
    places = (
        copied.unionByName(single)
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("start", "windows", "doc", "place")).alias("places"))
    )
    return places.mapInArrow(
        per_batch(_parse),
        "doc_id long, factors array<struct<start:int,length:int,ref_doc_id:long,ref_start:int>>",
    )


def _cut(batch: pa.RecordBatch) -> pa.RecordBatch:
    counts, removed, shas = [], [], []
    factors = batch.column(batch.schema.names.index("factors")).to_pylist()
    for raw, spans in zip(binary(batch, "text"), factors):
        words = raw.split() if raw else []
        kept = words
        if spans:
            gone = np.zeros(len(words), bool)
            for span in spans:
                gone[span["start"] : span["start"] + span["length"]] = True
            kept = [word for word, drop in zip(words, gone.tolist()) if not drop]
        counts.append(len(words))
        removed.append(len(words) - len(kept))
        shas.append(hashlib.sha256(b" ".join(kept)).hexdigest())
    columns = [
        batch.column(0),
        pa.array(counts, pa.int64()),
        pa.array(removed, pa.int64()),
        pa.array(shas, pa.string()),
    ]
    return pa.record_batch(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def substring_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row for each row of ``docs``."""
    factors = duplicate_factors(docs)
    return (
        documents(docs)
        .join(factors, "doc_id", "left")
        .mapInArrow(
            per_batch(_cut), "doc_id long, n_words long, n_removed long, kept_sha256 string"
        )
    )
