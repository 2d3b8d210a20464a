"""Reading, column selection and word hashing shared by the operators."""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from groundswell.session import checkpointed, ensure_checkpoint_dir

__all__ = [
    "Prefixes",
    "Recent",
    "Words",
    "binary",
    "checkpointed",
    "delete_folder",
    "digest_words",
    "documents",
    "fold",
    "give_back",
    "is_written",
    "mix",
    "per_batch",
    "release",
    "shared_folder",
    "shingles",
    "slices",
    "table",
    "written",
]

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_MUL = np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(docs: DataFrame) -> DataFrame:
    """Only the id and the text: other columns, whatever their names, stay out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))


def binary(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return batch.column(batch.schema.names.index(name)).cast(pa.binary()).to_pylist()


SLICE_BYTES = 8 << 20


def slices(raws: list[bytes | None], most: int = SLICE_BYTES) -> Iterator[range]:
    """Row ranges of a batch that hold about ``most`` bytes of text each.

    The words of a text take some ten times its bytes as Python objects, so they are
    made for a slice at a time.
    """
    begin, size = 0, 0
    for row, raw in enumerate(raws):
        size += len(raw or b"")
        if size >= most:
            yield range(begin, row + 1)
            begin, size = row + 1, 0
    if begin < len(raws):
        yield range(begin, len(raws))


class Recent:
    """Values of the keys met lately, in bounded memory.

    A full generation becomes the one before, and the one before that is forgotten;
    keys that come again move on, so common keys are computed once.
    """

    def __init__(self, size: int):
        self.size = size
        self.now: dict = {}
        self.before: dict = {}

    def missing(self, keys: set) -> list:
        """The keys without a value. All others, and what is stored next, are in ``now``."""
        if len(self.now) > self.size:
            self.now, self.before = {}, self.now
        new = []
        for key in keys.difference(self.now):
            value = self.before.get(key)
            if value is None:
                new.append(key)
            else:
                self.now[key] = value
        return new


def per_batch(fn):
    """An Arrow function over an iterator of batches, from one over a single batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)
        give_back()

    return run


def give_back() -> None:
    """Return a finished task's free memory to the system.

    Python workers live on between tasks; without this an idle one keeps the pages of
    its largest task, which count against the executor.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library; it has ways of its own
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> _HALF)) * _MUL
    x = (x ^ (x >> _HALF)) * _MUL
    return x ^ (x >> _HALF)


def digest_words(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, words), dtype=np.uint64, count=len(words))


_SPACE = np.isin(np.arange(256), [*range(9, 14), 32])
_BLOCK = 8  # bytes hashed in one step
_LONG = 64  # bytes from which a word is hashed on its own
_KEPT = np.array([(1 << 8 * n) - 1 for n in range(_BLOCK + 1)], np.uint64)


class Words:
    """Where the words of many texts lie, and a 64-bit hash of each.

    ``data`` holds the bytes of the texts one after the other, ``ends`` where each text begins,
    and where the last one ends. A word is a run without ASCII white space, as ``bytes.split``
    finds them, and belongs to one text. All words are hashed at once, ``_BLOCK`` bytes in a
    step, so that a word costs no Python object.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        inside = ~_SPACE[data]
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        borders = ends[(ends > 0) & (ends < len(data))]
        begins[borders] = inside[borders]
        stops[borders - 1] = inside[borders - 1]
        self.first = np.flatnonzero(begins)
        self.length = np.flatnonzero(stops) + 1 - self.first
        #: The first word of each text, and the number of all words.
        self.text = np.searchsorted(self.first, ends)
        self.hashes = self._hashed(data)

    def _hashed(self, data: np.ndarray) -> np.ndarray:
        padded = np.concatenate([data, np.zeros(_BLOCK, np.uint8)])
        blocks = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
        found = mix(blocks[self.first] & _KEPT[np.minimum(self.length, _BLOCK)])
        found += mix(self.length.astype(np.uint64) * _ODD)
        for done in range(_BLOCK, _LONG, _BLOCK):
            more = np.flatnonzero(self.length > done)
            if not len(more):
                break
            left = np.minimum(self.length[more] - done, _BLOCK)
            found[more] = mix(found[more] + (blocks[self.first[more] + done] & _KEPT[left]))
        for word in np.flatnonzero(self.length > _LONG).tolist():
            begin = self.first[word]
            found[word] = xxhash.xxh3_64_intdigest(data[begin : begin + self.length[word]])
        return found


class Prefixes:
    """Hashes of any run of words of one text, each from two prefix sums.

    A run's hash is the sum of word hash * ODD^position, shifted to its own start and
    mixed with its length; arithmetic is modulo 2^64, where an odd number has an inverse.
    """

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        steps = np.full(max(n, 1), _ODD)
        steps[0] = 1
        powers = np.multiply.accumulate(steps)
        steps[1:] = _INVERSE
        self.back = np.multiply.accumulate(steps)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * powers[:n], out=self.sums[1:])

    def runs(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Of the runs of ``length`` (above 0) words at ``start``."""
        value = (self.sums[start + length] - self.sums[start]) * self.back[start]
        return mix(value + length.astype(np.uint64))

    def every(self, length: int) -> np.ndarray:
        """Of all runs of ``length`` words, in order."""
        count = len(self.sums) - length
        if count < 1:
            return np.empty(0, np.uint64)
        value = (self.sums[length:] - self.sums[:count]) * self.back[:count]
        return mix(value + np.uint64(length))


def fold(hashes: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit hash per run of ``size`` consecutive words."""
    return Prefixes(hashes).every(size)


def shingles(raw: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a UTF-8 text.

    Words are runs without ASCII white space, A-Z lower-cased. A text with fewer
    words than ``size`` is one shingle; one without words has none.
    """
    words = raw.lower().split() if raw else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = digest_words(words)
    return np.unique(fold(hashes, min(size, len(hashes))))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now.

    Call it after a checkpoint. Spark deletes them when the driver's garbage collector
    finds their owners gone, which on an idle driver heap can take the whole job. An
    owner goes only after what refers to it, hence the rounds.
    """
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as a compressed table and go on from there."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def _in_file_system(spark: SparkSession, path: str):
    """A path and the file system it lies in."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(context._jsc.hadoopConfiguration()), target


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a table at ``path`` was written to its end."""
    system, target = _in_file_system(spark, f"{path}/_SUCCESS")
    return system.exists(target)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of tables that are no longer read."""
    system, target = _in_file_system(spark, path)
    system.delete(target, True)
