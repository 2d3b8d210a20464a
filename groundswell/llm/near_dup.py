"""MinHash near-duplicates of documents, with compressed (HyperMinHash) registers.

1. Each text becomes its set of 64-bit shingle hashes. A set's hashes are dealt over
   ``BANDS * ROWS`` buckets; a bucket keeps its smallest value as a leading-zero count
   plus ``MANTISSA`` bits (Yu and Weber, "HyperMinHash"). An empty bucket takes the
   register of the first filled bucket in an order of its own, so short texts match
   with the same probability as long ones.
2. Texts with equal sets form one class; only its smallest id goes on.
3. Bands of the registers are keys. Each member of a key is compared to the key's
   smallest id (a star, so a key of n members makes n pairs, not n * n).
4. Keys whose members are then in one component need nothing more. In the others all
   pairs across components are compared, in blocks, so no link is lost to the star.
5. A comparison estimates Jaccard from the registers, corrected for registers that
   agree by chance, and confirms survivors on the full sets.

With 24 bands of 4 registers a pair at a threshold of 0.85 shares a key with
probability 1 - 2e-8, one at 0.8 with 1 - 3e-6.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from groundswell.llm.common import binary, checkpointed, documents, mix, per_batch, shingles
from groundswell.llm.components import connected_components

BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
MANTISSA = 10  # bits kept after the leading one; with 6 bits of zero count: 16 bits
WORDS = 5  # words in a shingle
PERCENT = 85  # unless told otherwise, a link needs 100 * intersection >= PERCENT * union
DEVIATIONS = 6.0  # an estimate this many standard deviations too low ends a comparison
BLOCK_SHINGLES = 1_000_000  # shingles of one side of a block of comparisons (8 MB)

_FILL = np.argsort(np.random.default_rng(7).random((REGISTERS, REGISTERS)), axis=1)


def compress(values: np.ndarray) -> np.ndarray:
    """Leading zeros of 64-bit values and the bits after the leading one, in 16 bits."""
    _, exponent = np.frexp(np.maximum(values, np.uint64(1)).astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 53).astype(np.uint64)
    shifted = (values << zeros) << np.uint64(1)
    tail = shifted >> np.uint64(64 - MANTISSA)
    return (zeros << np.uint64(MANTISSA) | tail).astype(np.uint16)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The compressed registers of a non-empty set."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
    values = mix(hashes)
    smallest = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(smallest, bucket, values)
    filled = np.zeros(REGISTERS, bool)
    filled[bucket] = True
    packed = compress(smallest)
    if not filled.all():
        donor = _FILL[np.arange(REGISTERS), filled[_FILL].argmax(axis=1)]
        packed = np.where(filled, packed, packed[donor])
    return packed


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that registers of disjoint sets of n and m elements agree.

    Sums, over leading-zero counts, the chance that both minima fall in one cell.
    """
    a, b = np.maximum(n / REGISTERS, 1.0)[..., None], np.maximum(m / REGISTERS, 1.0)[..., None]
    zeros = np.arange(40)
    low, cell = 2.0 ** -(zeros + 1.0), 2.0 ** -(zeros + 1.0 + MANTISSA)
    middle = 1.5 * low
    density = a * b * np.exp((a + b - 2) * np.log1p(-middle))
    return np.minimum((density * cell * cell * 2**MANTISSA).sum(axis=-1), 0.5)


def plausible(same: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether ``same`` agreeing registers leave the threshold possible."""
    need = percent / 100
    by_chance = chance(n, m)
    jaccard = (same / REGISTERS - by_chance) / (1 - by_chance)
    support = np.minimum(np.minimum(n, m), REGISTERS)
    return jaccard >= need - DEVIATIONS * np.sqrt(need * (1 - need) / support)


def sized(n: np.ndarray, m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether sets of n and m elements can overlap enough."""
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """The exact test on two sorted sets of distinct hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
    out = [[], [], [], []]
    for key, raw in zip(batch.column(0).to_pylist(), binary(batch, "text")):
        found = shingles(raw, WORDS)
        out[0].append(key)
        out[1].append(len(found))
        out[2].append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
        out[3].append(registers(found).tobytes() if len(found) else None)
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    names = ["doc_id", "n_shingles", "fp", "sketch"]
    return pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], names=names)


def _sets(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = [shingles(raw, WORDS) for raw in binary(batch, "text")]
    columns = [
        batch.column(0),
        pa.array([registers(x).tobytes() for x in found], pa.binary()),
        pa.array([x.tobytes() for x in found], pa.binary()),
    ]
    return pa.record_batch(columns, names=["rep", "sketch", "items"])


def _confirm(percent: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        get = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        sketch = [np.frombuffer(b"".join(get[s]), np.uint16).reshape(-1, REGISTERS) for s in ("sa", "sb")]
        n, m = (np.array([len(x) // 8 for x in get[s]]) for s in ("xa", "xb"))
        same = (sketch[0] == sketch[1]).sum(axis=1)
        likely = sized(n, m, percent) & plausible(same, n, m, percent)
        keep = [
            i
            for i in np.flatnonzero(likely)
            if linked(np.frombuffer(get["xa"][i], np.uint64), np.frombuffer(get["xb"][i], np.uint64), percent)
        ]
        return pa.record_batch(
            [pa.array([get[c][i] for i in keep], pa.int64()) for c in ("a", "b")], names=["a", "b"]
        )

    return per_batch(run)


def _across(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links that join different components inside one pair of blocks of one key."""
        pdf = pdf.sort_values(["side", "rep"], ignore_index=True)
        sketch = np.frombuffer(b"".join(pdf["sketch"]), np.uint16).reshape(-1, REGISTERS)
        items = [np.frombuffer(x, np.uint64) for x in pdf["items"]]
        n = np.array([len(x) for x in items])
        side, rep = pdf["side"].to_numpy(), pdf["rep"].to_numpy()
        root = pdf["component"].to_numpy().copy()
        one_block = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        found = []
        for i in range(1, len(rep)):
            near = np.arange(i)[(root[:i] != root[i]) & (one_block | (side[:i] != side[i]))]
            near = near[sized(n[near], n[i], percent)]
            if not len(near):
                continue
            same = (sketch[near] == sketch[i]).sum(axis=1)
            for k in near[plausible(same, n[near], np.full(len(near), n[i]), percent)]:
                if root[k] != root[i] and linked(items[k], items[i], percent):
                    found.append((int(rep[k]), int(rep[i])))
                    root[root == root[k]] = root[i]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of ``docs`` (doc_id, text, ...).

    Documents are linked when their shingle sets share ``percent`` of their union; a component is what
    links reach and is named by its smallest id, the one that is kept. Null, empty and
    blank texts have no shingles, link with nothing and are kept. Rows that repeat a
    doc_id count as one document when texts agree; each input row gives one output
    row. A row without doc_id names no component: it shows that of the documents with its
    words (null if there are none) and is kept.
    """
    docs = documents(docs)
    schema = "doc_id long, n_shingles long, fp binary, sketch binary"
    sketched = checkpointed(docs.mapInArrow(per_batch(_sketch), schema))
    classes = sketched.where("fp is not null and doc_id is not null").groupBy("fp").agg(
        F.min("doc_id").alias("rep"), F.min("sketch").alias("sketch")
    )
    classes = checkpointed(classes)

    width = 2 * ROWS
    bands = F.array(
        *[
            F.xxhash64(F.lit(b), F.substring("sketch", 1 + b * width, width))
            for b in range(BANDS)
        ]
    )
    rows = classes.select("rep", F.explode(bands).alias("key"))
    keys = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"),
        F.min("rep").alias("hub"),
        F.sum(F.xxhash64("rep").bitwiseAND(F.lit((1 << 40) - 1))).alias("who"),
    )
    # Keys with the same members need one look: one key per (size, hub, members' sum).
    keys = keys.where("size > 1").groupBy("size", "hub", "who").agg(F.min("key").alias("key"))
    members = checkpointed(rows.join(keys.drop("who"), "key"))

    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.join(wanted, "doc_id").dropDuplicates(["doc_id"])
    sets = checkpointed(
        texts.mapInArrow(per_batch(_sets), "rep long, sketch binary, items binary")
    )

    def side(name: str) -> DataFrame:
        return sets.select(
            F.col("rep").alias(name),
            F.col("sketch").alias(f"s{name}"),
            F.col("items").alias(f"x{name}"),
        )

    star = members.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    pairs = star.distinct().join(side("b"), "b").join(side("a"), "a")
    links = checkpointed(pairs.mapInArrow(_confirm(percent), "a long, b long"))
    first = connected_components(links)

    # Keys of three or more whose members are not yet in one component.
    placed = members.where("size > 2").join(
        first.withColumnRenamed("node", "rep"), "rep", "left"
    )
    placed = placed.withColumn("component", F.coalesce("component", "rep"))
    weighed = placed.join(sets.select("rep", (F.length("items") / 8).alias("n")), "rep")
    open_keys = (
        weighed.groupBy("key")
        .agg(
            F.min("component").alias("low"),
            F.max("component").alias("high"),
            F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"),
        )
        .where("low <> high")
        .select("key", "blocks")
    )
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    blocked = (
        placed.join(open_keys, "key")
        .withColumn("side", own)
        .withColumn("other", F.explode(others))
        .select(
            "key",
            "rep",
            "component",
            "side",
            F.least("side", "other").alias("i"),
            F.greatest("side", "other").alias("j"),
        )
        .join(sets, "rep")
    )
    more = blocked.groupBy("key", "i", "j").applyInPandas(_across(percent), "a long, b long")
    more = checkpointed(more.distinct())
    # The first components stand for their links: only they and the new links remain.
    tree = first.where("node <> component").select(
        F.col("component").alias("a"), F.col("node").alias("b")
    )
    joined = connected_components(tree.union(more))

    named = classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select(
        "fp", F.coalesce("component", "rep").alias("component")
    )
    result = sketched.drop("sketch").join(named, "fp", "left")
    component = F.coalesce("component", "doc_id")
    return result.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents that ``near_duplicates`` does not keep.

    Rows that repeat a kept doc_id stay: they are one document, not a copy of another.
    """
    name = "_gone"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    gone = near_duplicates(docs, percent).where(~F.col("kept")).select(F.col("doc_id").alias(name))
    match = F.col("doc_id").cast("long") == F.col(name)
    return docs.join(gone.distinct(), match, "left_anti")
