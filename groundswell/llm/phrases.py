"""Phrases whose words stand together more often than their counts suggest.

Word ids of bounded shards of the text are indexed by a depth-limited Burrows-Wheeler
transform: rows are the places of the shard, sorted by the words that follow (or, in the
mirrored index, precede), and every phrase is an interval of rows. A phrase grows to the
right in the mirrored index and to the left in the forward one; either way the symbols of
its interval, grouped, give each longer phrase's count, its interval, and the shorter
phrases that it extends on both sides. Counts of a phrase are summed over the shards, level by
level: only phrases that reach the least count over all shards go back to the shards that
hold them and are extended there, since no longer phrase can be more frequent.

Words and phrases are known by a number: shard and first row where the phrase stands
first. Shards hold at most about ``SHARD_WORDS`` words, so nothing that a task keeps
grows with the corpus, and nothing is broadcast.
"""

from __future__ import annotations

import itertools
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from groundswell.llm.common import (
    binary,
    checkpointed,
    delete_folder,
    give_back,
    shared_folder,
    written,
)

SHARD_WORDS = 1 << 21
BLOCK = 4 << 20  # bytes of one text whose words are held as objects at a time
UNKNOWN = "und"
ROW_BITS, SERIAL_BITS = 28, 13  # of a phrase's number: row in the shard; shard of the task
SCALE = 1_000_000

# What ends a piece, and blanks.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_PLAIN = bytes.maketrans(ENDS + b"\t", b";" * len(ENDS) + b" ")


def words_of(raw: bytes) -> Iterator[list[bytes]]:
    """Lower-cased words of a text, ``;`` at the end of each piece, in bounded blocks."""
    plain = raw.lower().translate(_PLAIN)
    at = 0
    while at < len(plain):
        end = plain.find(b";", at + BLOCK)
        end = len(plain) if end < 0 else end
        yield plain[at:end].replace(b";", b" ; ").split()
        at = end


class _Shard:
    """Word ids of texts, 0 at the end of each piece, and the words by language."""

    def __init__(self):
        count = itertools.count(1)
        self.ids = defaultdict(lambda: defaultdict(count.__next__, {b";": 0}))
        self.parts = [np.zeros(1, np.int32)]
        self.size = 0

    def add(self, lang: str, words: list[bytes]) -> None:
        ids = self.ids[lang]
        self.parts.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
        self.parts.append(np.zeros(1, np.int32))
        self.size += len(words)

    def row(self, shard: int) -> pa.RecordBatch:
        places = np.concatenate(self.parts)
        if len(places) >> ROW_BITS:
            raise ValueError("a piece is too long for one shard")
        langs, words, ids, codes = list(self.ids), [], [], []
        for code, found in enumerate(self.ids.values()):
            del found[b";"]
            words += found.keys()
            ids += found.values()
            codes.append(np.full(len(found), code))
        order = np.argsort(ids)
        counts = np.bincount(places, minlength=len(ids) + 1)[1:]
        columns = [
            pa.array([shard], pa.int64()),
            pa.array([_squeeze(places)], pa.binary()),
            pa.array([_squeeze(counts)], pa.binary()),
            pa.array([zstandard.compress(b" ".join(words[i] for i in order), 3)], pa.binary()),
            pa.array([_squeeze(np.concatenate(codes)[order])], pa.binary()),
            pa.array([langs], pa.list_(pa.string())),
        ]
        return pa.record_batch(columns, names=["shard", "places", "counts", "words", "codes", "langs"])


SHARDS = "shard long, places binary, counts binary, words binary, codes binary, langs array<string>"


def _squeeze(values: np.ndarray) -> bytes:
    """32-bit numbers, their bytes side by side by weight, compressed."""
    return zstandard.compress(values.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, serial, shard = TaskContext.get().partitionId(), 0, _Shard()

    def finished() -> pa.RecordBatch:
        if serial >> SERIAL_BITS:
            raise ValueError("too many shards in a task: use smaller partitions")
        return shard.row(task << SERIAL_BITS | serial)

    for batch in batches:
        for raw, lang in zip(binary(batch, "text"), batch.column(1).to_pylist()):
            for words in words_of(raw or b""):
                shard.add(lang, words)
                if shard.size >= SHARD_WORDS:
                    yield finished()
                    serial, shard = serial + 1, _Shard()
    if shard.size:
        yield finished()
    del shard
    give_back()


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, place, size) per word of each shard; ``place`` numbers its first row."""
    for batch in batches:
        for row in range(batch.num_rows):
            shard, counts, words, codes, langs = (batch.column(c)[row].as_py() for c in range(5))
            counts = _unsqueeze(counts)
            if not len(counts):
                continue
            columns = [
                pa.array(langs, pa.string()).take(pa.array(_unsqueeze(codes))),
                pa.array(zstandard.decompress(words).split(b" "), pa.binary()).cast(pa.string()),
                pa.array(_before(counts) + (shard << ROW_BITS), pa.int64()),
                pa.array(counts, pa.int64()),
            ]
            yield pa.record_batch(columns, names=["lang", "word", "place", "size"])
    give_back()


def _before(counts: np.ndarray) -> np.ndarray:
    """First row of each word: the rows of smaller ids come before."""
    return np.cumsum(counts) - counts


class Index:
    """Rows of a shard by the ``depth`` words from their place on, forward or mirrored.

    Ends of pieces (id 0) come last, so that rows of words are numbered from 0 on.
    ``symbols`` holds, row by row, the word before (in a mirrored index, behind) the place.
    """

    def __init__(self, places: np.ndarray, depth: int, mirrored: bool = False):
        if mirrored:
            places = places[::-1]
        ended = int(places.max()) + 1
        places = np.where(places == 0, np.int32(ended), places)
        keys = [places]
        for step in range(1, depth):  # beyond the end of a piece nothing counts
            later = np.full(len(places), ended, np.int32)
            later[:-step] = places[step:]
            later[keys[-1] == ended] = ended
            keys.append(later)
        if depth == 2:
            keys = [places * np.int64(ended + 1) + keys[1]]
        order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
        new = np.zeros(len(order) + 1, bool)
        new[0] = new[-1] = True
        for key in keys:
            key = key[order]
            new[1:-1] |= key[1:] != key[:-1]
        self.edges = np.flatnonzero(new)  # of the intervals of phrases of ``depth`` words
        self.ended = ended
        self.symbols = np.roll(places, 1)[order]
        self.counts = np.bincount(places, minlength=ended + 1)

    def sizes(self, begins: np.ndarray) -> np.ndarray:
        """Occurrences of the phrases of ``depth`` words whose intervals begin at ``begins``."""
        return self.edges[np.searchsorted(self.edges, begins) + 1] - begins

    def steps(self) -> np.ndarray:
        """For each row, the row of its place moved one back over its symbol."""
        to = np.empty(len(self.symbols), np.int32)
        to[np.argsort(self.symbols, kind="stable")] = np.arange(len(to), dtype=np.int32)
        return to

    def extend(self, begins: np.ndarray, sizes: np.ndarray):
        """(parent, symbol, smaller, size, row) of each extension by a word of the intervals.

        ``smaller``: how many of the parent's rows have a smaller symbol, which is where
        the extension begins within its parent in the other index; ``row``: its first row here.
        """
        before = np.cumsum(sizes) - sizes
        parents = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        rows = np.repeat((begins - before).astype(np.int32), sizes)
        rows += np.arange(len(rows), dtype=np.int32)
        key = parents * np.int64(self.ended + 1) + self.symbols[rows]
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, int)
        size = np.diff(np.append(first, len(key)))
        parent, symbol = np.divmod(key[first], self.ended + 1)
        row = rows[order[first]]
        word = symbol != self.ended
        return tuple(x[word] for x in (parent, symbol, first - before[parent], size, row))


def _known(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values lie in one of the sorted intervals, and the number of that interval."""
    at = np.searchsorted(begins, values, "right") - 1
    inside = (at >= 0) & (values < ends[at])
    return inside, at


def _grow(words: int, placed: bool, shards: pa.Table, kept: pa.Table) -> pa.Table:
    """Phrases of ``words`` words in one shard, from those of one word less that were kept.

    ``prefix`` and ``suffix`` number the phrases without the last and the first word;
    ``place`` is left out unless ``placed``.
    """
    found = {n: np.empty(0, np.int64) for n in ("prefix", "suffix", "place", "size")}
    if shards.num_rows and kept.num_rows:
        shard = shards.column("shard")[0].as_py()
        begins, numbers = (kept.column(n).to_numpy() for n in ("begin", "number"))
        order = np.argsort(begins)
        begins, numbers = begins[order], numbers[order]
        # a word's interval is the same in both indexes: it grows to the right in the mirrored
        # one; longer phrases grow to the left
        index = Index(_unsqueeze(shards.column("places")[0].as_py()), words - 1, words == 2)
        sizes = index.sizes(begins)
        parent, symbol, smaller, size, row = index.extend(begins, sizes)
        if words == 2:
            begin = begins[parent] + smaller
            other = _before(index.counts)[symbol]  # where the added word's interval begins
        else:
            begin = other = index.steps()[row]  # within the interval without the last word
        good, at = _known(other, begins, begins + sizes)
        ends = numbers[parent], numbers[at]
        prefix, suffix = ends if words == 2 else ends[::-1]
        found = {"prefix": prefix, "suffix": suffix, "place": begin + (np.int64(shard) << ROW_BITS)}
        found = {name: values[good] for name, values in {**found, "size": size}.items()}
    if not placed:
        del found["place"]
    return pa.table({name: pa.array(values, pa.int64()) for name, values in found.items()})


def _frequent(level: DataFrame, key: list[str], least: int) -> DataFrame:
    """Rows of a level whose phrase has ``least`` occurrences over all shards, with its number.

    The key stays only where the phrase stands first; the other rows go back to their shards.
    """
    every = W.partitionBy(*key)
    kept = (
        level.withColumn("total", F.sum("size").over(every))
        .withColumn("number", F.min("place").over(every))
        .where(F.col("total") >= least)
    )
    first = F.col("place") == F.col("number")
    return kept.select(
        "place", "number", *(F.when(first, F.col(c)).alias(c) for c in ("total", *key))
    )


def frequent_phrases(
    docs: DataFrame, folder: str, longest: int = 3, least: int = 10
) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to ``longest`` words with at least ``least`` occurrences, and words per language.

    First: (number, words, lang, phrase, total, prefix, suffix, lefts, rights): ``number``
    differs among phrases of as many words (null for the longest), ``prefix`` and ``suffix``
    are the numbers of the phrases without the last and the first word (null for words),
    ``lefts`` and ``rights`` the totals of the first 1, 2, ... and of the last 1, 2, ...
    words. Second: (lang, n) with all word occurrences. Both read tables written to ``folder``, which has to be shared and new.
    """
    texts = docs.select(
        F.col("text").alias("text"), F.coalesce(F.col("lang"), F.lit(UNKNOWN)).alias("lang")
    )
    shards = written(texts.mapInArrow(_index, SHARDS), f"{folder}/shards")
    words = shards.select("shard", "counts", "words", "codes", "langs").mapInArrow(
        _words, "lang string, word string, place long, size long"
    )
    totals = written(words.groupBy("lang").agg(F.sum("size").alias("n")), f"{folder}/totals")
    kept = written(_frequent(words, ["lang", "word"], least), f"{folder}/words")
    found = kept.where("place = number").select(
        "number",
        F.lit(1).alias("words"),
        "lang",
        F.col("word").alias("phrase"),
        "total",
        F.lit(None).cast("long").alias("prefix"),
        F.lit(None).cast("long").alias("suffix"),
        F.array().cast("array<long>").alias("lefts"),
        F.array().cast("array<long>").alias("rights"),
        F.col("word").alias("last"),
    )
    every = found
    for size in range(2, longest + 1):
        back = kept.select(
            F.shiftright("place", ROW_BITS).alias("shard"),
            F.col("place").bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("begin"),
            "number",
        )
        last = size == longest
        schema = "prefix long, suffix long, " + ("" if last else "place long, ") + "size long"
        level = (
            shards.select("shard", "places")
            .groupBy("shard")
            .cogroup(back.groupBy("shard"))
            .applyInArrow(partial(_grow, size, not last), schema)
        )
        if not last:
            kept = written(_frequent(level, ["prefix", "suffix"], least), f"{folder}/kept{size}")
            new = kept.where("place = number")
        else:  # nothing goes back to the shards or refers to these: a sum is enough
            sums = level.groupBy("prefix", "suffix").agg(F.sum("size").alias("total"))
            new = sums.where(F.col("total") >= least).withColumn("number", F.lit(None).cast("long"))
        head = found.select(
            F.col("number").alias("prefix"),
            "lang",
            F.col("phrase").alias("head"),
            F.array_append("lefts", F.col("total")).alias("lefts"),
        )
        tail = found.select(
            F.col("number").alias("suffix"),
            "last",
            F.array_append("rights", F.col("total")).alias("rights"),
        )
        found = new.join(head, "prefix").join(tail, "suffix")
        found = found.withColumn("phrase", F.concat_ws(" ", "head", "last"))
        found = found.withColumn("words", F.lit(size)).select(*every.columns)
        found = written(found, f"{folder}/phrases{size}")
        every = every.union(found)
    return every.drop("last"), totals


#: Of all cuts the worst; the cut after k words has the totals of the first k and of the others.
WORST_CUT = f"""
array_min(transform(lefts, (l, k) -> named_struct(
    'score', cast(a AS decimal(38,0)) * a * {SCALE} div (cast(l AS decimal(38,0)) * rights[size(rights) - 1 - k]),
    'k', k, 'l', l, 'r', rights[size(rights) - 1 - k])))
"""


def collocations(
    docs: DataFrame, longest: int = 3, least: int = 10, covered: int = 50, top: int = 2000
) -> DataFrame:
    """The best phrases of 2 to ``longest`` words of each language.

    ``docs``: (text, lang, ...). A text is lower-cased (A-Z), cut into pieces at
    ``ENDS`` and into words at ``BLANKS``; a phrase lies within a piece, a null language is
    ``und``. A phrase with ``a`` >= ``least`` occurrences scores floor(SCALE * a^2 / (l * r)),
    l and r the occurrences of the two parts of its worst cut (of equal ones, the first).
    Left out: phrases within a longer one that has ``covered`` percent of their occurrences.
    Returns (lang, rank, phrase, a, l, r, n, score), the first ``top`` of each language by
    score, occurrences, phrase; n: the language's word occurrences. Null, empty and blank
    texts have no words; repeated rows count each; without phrases the result is empty.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/phrases-{uuid.uuid4().hex}"
    found, totals = frequent_phrases(docs, folder, longest, least)
    # a phrase of more words yet is as frequent at most, and contains one of one word more
    longer = found.where("words > 2").withColumn("words", F.col("words") - 1)
    inside = (
        longer.select("words", F.col("prefix").alias("number"), "total")
        .union(longer.select("words", F.col("suffix").alias("number"), "total"))
        .groupBy("words", "number")
        .agg(F.max("total").alias("longer"))
    )
    scored = (
        found.where("words >= 2")
        .withColumn("a", F.col("total"))
        .withColumn("cut", F.expr(WORST_CUT))
        .join(inside, ["words", "number"], "left")
        .where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    )
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    best = ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
    best = checkpointed(best)
    delete_folder(spark, folder)
    return best
