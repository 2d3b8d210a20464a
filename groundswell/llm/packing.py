"""Best-fit packing of documents into token sequences, by hierarchical residuals.

1. Where the documents lie, they are tokenized, cut into pieces of at most ``LENGTH``
   tokens and packed best-fit, longest piece first. Bins with at most ``SLACK`` tokens
   of room are finished.
2. The underfull bins are the items of the next round: dealt anew over fewer tasks,
   and packed best-fit again, bins into bins. Rounds go on while they reduce the number
   of underfull bins by a hundredth. A task of a round gets about ``ROUND_ITEMS`` bins,
   so no round passes through one task unless so few are left.
3. A piece's sequence and place follow from the chain of bins it went through.

Only bins (id and size) move between tasks; token ids never do.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from groundswell.llm.common import Recent, binary, checkpointed, documents, give_back, slices

LENGTH = 2048
SLACK = 1
ROUND_ITEMS = 20_000
STORED = 500_000  # words in each of the two generations whose ids a worker holds, some 70 MB each
SLICE = 4 << 20  # bytes of text whose words are held as objects at a time
CHUNK = 100  # new words tokenized in one call
END = (0).to_bytes(4, "little")
_SPECIAL = b"<|"  # begins the special tokens, whose case matters
_SIGNS = bytes(c for c in range(128) if c != ord("'") and not chr(c).isalnum())
_SHIFT = 33  # a bin's id: round and task above, number in the task below


def _chunks(words: list[bytes]) -> list[list[bytes]]:
    return [words[at : at + CHUNK] for at in range(0, len(words), CHUNK)]


class WordTokens:
    """Token ids of texts, by the ids of their words.

    The tokenizer lower-cases, drops white space and never joins tokens across it, or
    across the border of a letter and an ASCII sign other than the apostrophe. So a
    text's ids are its words' ids one after the other, a word's are those of its base
    and of the signs at its end, and each is tokenized once. Words are tokenized many
    at a time: those of letters with a space between them, all others with a special token.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = "<|endoftext|>"
        self.mark_id = self.tokenizer.token_to_id(self.mark)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[at for token, at in vocabulary.items() if token.endswith("</w>")]] = True
        self.recent = Recent(STORED)

    @staticmethod
    def words(raw: bytes | None) -> list[bytes]:
        if not raw:
            return []
        if _SPECIAL in raw:
            return raw.split()
        if b"\xcc" in raw or b"\xcd" in raw:  # a mark may join a capital before it is lower-cased
            return [word.lower() if word.isascii() else word for word in raw.split()]
        return raw.lower().split()

    def learn(self, words: set[bytes]) -> None:
        missing = self.recent.missing(words)
        known, before = self.recent.now, self.recent.before
        new, joined = set(), []
        for word in missing:
            last = word[-1]
            # Most words end in a letter and need no closer look.
            if 97 <= last <= 122 or last > 127 or _SPECIAL in word:
                new.add(word)
                continue
            base = word.rstrip(_SIGNS)
            if len(base) == len(word) or not base[-1:].isalpha():
                new.add(word)
                continue
            end = word[len(base) :]
            joined.append((word, base, end))
            for part in (base, end):
                if part not in known:
                    value = before.get(part)
                    if value is None:
                        new.add(part)
                    else:
                        known[part] = value
        letters, plain = [], []
        for word in new:
            (letters if word.decode().isalpha() else plain).append(word)
        plain += self._spaced(letters)
        groups = _chunks([w for w in plain if _SPECIAL not in w])
        groups += [[w] for w in plain if _SPECIAL in w]
        for some, ids in self._encoded(groups, self.mark):
            raw = ids.tobytes()
            if len(some) == 1:
                known[some[0]] = raw
                continue
            ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids)).tolist()
            for word, begin, end in zip(some, [-1, *ends], ends, strict=False):
                known[word] = raw[4 * begin + 4 : 4 * end]
        for word, base, end in joined:
            known[word] = known[base] + known[end]

    def _encoded(self, groups: list[list[bytes]], between: str) -> Iterator[tuple[list[bytes], np.ndarray]]:
        texts = [between.join(w.decode() for w in some) for some in groups]
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return ((some, np.array(f.ids, "<u4")) for some, f in zip(groups, found))

    def _spaced(self, words: list[bytes]) -> list[bytes]:
        """Learn words of letters with a space between them; the words left to be told apart.

        Such a word is one unit of the tokenizer, whose last token is marked as an end. Each
        word has at least one, so a group with as many ends as words has one in each.
        """
        left = []
        for some, ids in self._encoded(_chunks(words), " "):
            ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(ends) != len(some):  # lower-casing may take a letter apart
                left += some
                continue
            raw = ids.tobytes()
            for word, begin, end in zip(some, [0, *ends], ends, strict=False):
                self.recent.now[word] = raw[4 * begin : 4 * end]
        return left

    def encode(self, words: list[bytes]) -> bytes:
        """Little-endian 32-bit ids; all words must have been learned with the last call."""
        return b"".join(map(self.recent.now.__getitem__, words))

    def encode_all(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, the end token after each; where each ends).

        Arrow numbers the words, so that each distinct one is looked up once.
        """
        numbered = pa.array(list(chain.from_iterable(texts)), pa.binary()).dictionary_encode()
        words = numbered.dictionary.to_pylist()
        self.learn(set(words))
        parts = [*map(self.recent.now.__getitem__, words), END]
        ids = np.frombuffer(b"".join(parts), "<u4")
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        last = np.cumsum([len(some) for some in texts])  # the end token's place among the words
        numbers = np.insert(numbered.indices.to_numpy(), last, len(words))
        count = sizes[numbers]
        ends = np.cumsum(count)
        total = int(ends[-1])
        kind = np.int32 if max(total, len(ids)) < 1 << 31 else np.int64
        shift = ((np.cumsum(sizes) - sizes)[numbers] - (ends - count)).astype(kind)
        at = np.arange(total, dtype=kind)
        at += np.repeat(shift, count)
        return ids[at], ends[last + np.arange(len(texts))]


_OF_WORKER: dict[tuple, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """The process's tokenizer of a vocabulary file, with the words its earlier tasks learned.

    Python workers live on between tasks; loading the file and learning the common words
    anew in each would take a sixth of a task's time.
    """
    found = os.stat(path)
    key = (path, found.st_mtime_ns, found.st_size)
    if key not in _OF_WORKER:
        _OF_WORKER.clear()
        _OF_WORKER[key] = WordTokens(path)
    return _OF_WORKER[key]


def best_fit(lengths: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin of each item, its offset there, sizes of the bins).

    ``open_at[r]`` holds the bins with r tokens of room and the bits of ``rooms`` say
    which r have any, so the tightest room for an item is one bit operation away.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    sizes: list[int] = []
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for item in order.tolist():
        length = int(lengths[item])
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            chosen = open_at[room].pop()
            if not open_at[room]:
                rooms &= ~(1 << room)
            left = room - length
        else:
            chosen, left = len(sizes), capacity - length
            sizes.append(0)
        bins[item], offsets[item] = chosen, sizes[chosen]
        sizes[chosen] += length
        if left:
            open_at[left].append(chosen)
            rooms |= 1 << left
    return bins, offsets, np.array(sizes, np.int64)


def _local(path: str):
    """Pieces of a task's documents, packed: one row per piece, with its bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_tokens(path)
        keys_of, pieces, starts, lengths, crcs = [], *(array("q") for _ in range(4))
        for batch in batches:
            raws, keys = binary(batch, "text"), batch.column(0).to_pylist()
            for rows in slices(raws, SLICE):
                texts = [known.words(raws[row]) for row in rows]
                ids, ends = known.encode_all(texts)
                begin = 0
                for row, end in zip(rows, ends.tolist()):
                    for piece, at in enumerate(range(begin, end, LENGTH)):
                        part = ids[at : min(at + LENGTH, end)]
                        keys_of.append(keys[row])
                        pieces.append(piece)
                        starts.append(at - begin)
                        lengths.append(len(part))
                        crcs.append(zlib.crc32(part))
                    begin = end
        own = TaskContext.get().partitionId() << _SHIFT
        bins, offsets, sizes = best_fit(np.array(lengths, np.int64))
        yield pa.record_batch(
            [
                pa.array(keys_of, pa.int64()),
                pa.array(np.array(pieces, np.int32)),
                pa.array(np.array(starts, np.int64)),
                pa.array(np.array(lengths, np.int64)),
                pa.array(np.array(crcs, np.int64)),
                pa.array(own + bins, pa.int64()),
                pa.array(offsets, pa.int64()),
                pa.array(sizes[bins] if len(bins) else bins, pa.int64()),
            ],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "place", "size"],
        )
        del keys_of, pieces, starts, lengths, crcs
        give_back()

    return run


def _again(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pack one group's underfull bins into each other; the new bin takes its first one's id."""
    pdf = pdf.sort_values(["size", "bin"], ascending=[False, True], ignore_index=True)
    bins, places, sizes = best_fit(pdf["size"].to_numpy())
    first = np.full(len(sizes), -1, np.int64)
    np.maximum.at(first, bins, np.where(places == 0, pdf["bin"].to_numpy(), -1))
    return pd.DataFrame(
        {"bin": pdf["bin"], "parent": first[bins], "shift": places, "total": sizes[bins]}
    )


def pack(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    A null, empty or blank text is the end token alone. Repeated rows are packed each
    for itself.
    """
    pieces = documents(docs).mapInArrow(
        _local(path),
        "doc_id long, piece int, start long, length long, ids_crc32 long, "
        "bin long, place long, size long",
    )
    pieces = checkpointed(pieces)
    underfull = pieces.where(F.col("size") < LENGTH - SLACK).groupBy("bin").agg(F.max("size").alias("size"))
    moves: DataFrame | None = None  # (bin, parent, shift): where each first-round bin lies now
    items = checkpointed(underfull)
    count = items.count()
    seed = 0
    while count > 1:
        tasks = -(-count // ROUND_ITEMS)
        group = F.pmod(F.xxhash64("bin", F.lit(seed)), F.lit(tasks))
        packed = checkpointed(
            items.withColumn("group", group)
            .groupBy("group")
            .applyInPandas(_again, "bin long, parent long, shift long, total long")
        )
        step = packed.where("bin <> parent").select("bin", "parent", "shift")
        if moves is None:
            moves = step
        else:
            later = step.select(
                F.col("bin").alias("parent"), F.col("parent").alias("p2"), F.col("shift").alias("s2")
            )
            moved = moves.join(later, "parent", "left").select(
                "bin",
                F.coalesce("p2", "parent").alias("parent"),
                (F.col("shift") + F.coalesce("s2", F.lit(0))).alias("shift"),
            )
            moves = checkpointed(moved.union(step))
        items = packed.where(
            (F.col("bin") == F.col("parent")) & (F.col("total") < LENGTH - SLACK)
        ).select("bin", F.col("total").alias("size"))
        before, count = count, items.count()
        if tasks == 1 or count > 0.99 * before:
            break
        seed += 1
    if moves is not None:
        pieces = pieces.join(moves, "bin", "left")
        sequence = F.coalesce("parent", "bin")
        offset = F.col("place") + F.coalesce("shift", F.lit(0))
    else:
        sequence, offset = F.col("bin"), F.col("place")
    return pieces.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        sequence.alias("sequence_id"),
        offset.alias("offset"),
    )
