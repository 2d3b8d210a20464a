"""Near-duplicate embeddings by random-hyperplane sign hashing.

1. Equal vectors of one label become one class; its smallest id stands for it.
2. Each of ``TABLES`` tables keys a vector by the signs of ``BITS`` random projections.
   A pair at the threshold shares a bit with probability 1 - angle / pi = 0.88, and
   misses all tables with probability (1 - 0.88 ** BITS) ** TABLES = 2e-5. For more
   vectors per label take more bits, and more tables to keep that product.
3. Vectors that share a key are compared by exact cosine. A key with more than
   ``BLOCK`` vectors is split into blocks and each pair of blocks compared in a task of
   its own. A pair counts in the first table that both vectors share.
4. A comparison hands on, for each vector, how many vectors it links with and one link
   to its component there, never the pairs. Components are then joined in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from groundswell.llm.common import checkpointed, per_batch
from groundswell.llm.components import connected_components
from groundswell.llm.vectors import matrices, unit

THRESHOLD = 0.93
TABLES, BITS = 24, 8
BLOCK = 1024
SEED = 5


def signs(vectors: np.ndarray) -> np.ndarray:
    """The key (one byte) of each vector in each table."""
    planes = np.random.default_rng([SEED, vectors.shape[1]]).standard_normal(
        (vectors.shape[1], TABLES * BITS)
    )
    return np.packbits(vectors @ planes > 0, axis=1)


def _prepare(kind: type):
    """(vec_id, label, vector, codes); rows that can link with nothing have no vector.

    A vector is its components as ``kind``, as the column holds them: no digit is lost.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors: list[bytes | None] = [None] * batch.num_rows
        codes: list[bytes | None] = [None] * batch.num_rows
        for rows, matrix in matrices(batch.column(2)).values():
            for row, v, c in zip(rows.tolist(), matrix.astype(kind), signs(unit(matrix))):
                vectors[row], codes[row] = v.tobytes(), c.tobytes()
        columns = [
            batch.column(0),
            batch.column(1),
            pa.array(vectors, pa.binary()),
            pa.array(codes, pa.binary()),
        ]
        return pa.record_batch(columns, names=["vec_id", "label", "vector", "codes"])

    return per_batch(run)


def _roots(near: np.ndarray) -> np.ndarray:
    """The smallest position reachable from each, from a symmetric adjacency matrix."""
    label = np.arange(len(near))
    while True:
        reached = np.where(near, label[None, :], len(near)).min(axis=1)
        best = np.minimum(label, reached)
        best = best[best]
        if (best == label).all():
            return label
        label = best


def _compare(part: dict[str, np.ndarray], units: np.ndarray, codes: np.ndarray):
    """(rep, count, root) of the vectors of one pair of blocks that link."""
    side, weight, rep = part["side"], part["weight"], part["rep"]
    table, same_block = int(part["tab"][0]), part["i"][0] == part["j"][0]
    near = units @ units.T >= THRESHOLD
    if not same_block:
        near &= side[:, None] != side[None, :]
    np.fill_diagonal(near, False)
    a, b = np.nonzero(near)
    first = (codes[a] == codes[b]).argmax(axis=1) == table
    counted = np.bincount(a[first], weight[b[first]], minlength=len(rep)).astype(np.int64)
    (linked,) = np.nonzero(near.any(axis=1))
    order = np.argsort(rep, kind="stable")
    back = np.empty(len(rep), np.int64)
    back[order] = np.arange(len(rep))
    root = rep[order][_roots(near[np.ix_(order, order)])[back]]
    return rep[linked], counted[linked], root[linked]


NAMES = ["key", "rep", "weight", "tab", "side", "i", "j"]


def _groups(kind: type):
    """Compare each run of rows with one key; a run can go over several batches."""

    def done(rows: pa.Table) -> pa.RecordBatch | None:
        rows = rows.combine_chunks()
        get = {n: rows.column(n).to_numpy() for n in NAMES}
        cuts = np.flatnonzero(get["key"][1:] != get["key"][:-1]) + 1
        vectors, codes = (rows.column(n).to_pylist() for n in ("vector", "codes"))
        out = []
        for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(vectors)]):
            if end - begin < 2:
                continue
            part = {n: v[begin:end] for n, v in get.items()}
            v = np.frombuffer(b"".join(vectors[begin:end]), kind).reshape(end - begin, -1)
            c = np.frombuffer(b"".join(codes[begin:end]), np.uint8).reshape(end - begin, -1)
            out.append(_compare(part, unit(v.astype(np.float64)), c))
        if not out:
            return None
        columns = [pa.array(np.concatenate([o[k] for o in out]), pa.int64()) for k in range(3)]
        return pa.record_batch(columns, names=["rep", "n", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            rows = new if rest is None else pa.concat_tables([rest, new])
            keys = rows.column("key").to_numpy()
            before = np.flatnonzero(keys != keys[-1])
            full = int(before[-1]) + 1 if len(before) else 0
            if full and (found := done(rows.slice(0, full))) is not None:
                yield found
            rest = rows.slice(full)
        if rest is not None and (found := done(rest)) is not None:
            yield found

    return run


def near_duplicate_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of ``vectors`` (vec_id, embedding, label, ...).

    Only vectors of equal, non-null labels and equal dimension are compared. A vector
    that is null, empty, zero or holds a null or non-finite component, and one without
    label or id, links with nothing and is kept. Each row is a vector of its own: rows
    that repeat a vec_id link with each other.
    """
    vectors = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding"
    )
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = np.float32 if element == "float" else np.float64
    prepared = checkpointed(
        vectors.mapInArrow(
            _prepare(kind), "vec_id long, label string, vector binary, codes binary"
        )
    )
    usable = prepared.where("vector is not null and label is not null and vec_id is not null")
    classes = checkpointed(
        usable.groupBy("label", "vector", "codes").agg(
            F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight")
        )
    )
    tables = F.transform(
        F.sequence(F.lit(0), F.lit(TABLES - 1)),
        lambda t: F.struct(
            t.alias("tab"), F.substring(F.col("codes"), t + 1, F.lit(1)).alias("code")
        ),
    )
    keyed = classes.select("*", F.explode(tables).alias("t")).select(
        F.xxhash64("label", F.length("vector"), "t.tab", "t.code").alias("bucket"),
        F.col("t.tab").alias("tab"),
        "rep",
        "weight",
        "vector",
        "codes",
    )
    sizes = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sized = keyed.join(
        sizes.select("bucket", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "bucket"
    )
    split = sized.withColumn(
        "side", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")).cast("int")
    ).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("side", "other"), F.greatest("side", "other")
    rows = split.select(
        F.xxhash64("bucket", low, high).alias("key"),
        "rep",
        "weight",
        "tab",
        "side",
        low.alias("i"),
        high.alias("j"),
        "vector",
        "codes",
    )
    found = checkpointed(
        rows.repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(_groups(kind), "rep long, n long, root long")
    )
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    links = found.where("rep <> root").select(F.col("root").alias("a"), F.col("rep").alias("b"))
    joined = connected_components(links.distinct())
    named = (
        classes.join(counts, "rep", "left")
        .join(joined.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "label",
            "vector",
            (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    linkable = F.col("vec_id").isNotNull()
    result = prepared.select(
        "vec_id", F.when(linkable, F.col("label")).alias("label"), F.when(linkable, F.col("vector")).alias("vector")
    ).join(named, ["label", "vector"], "left")
    component = F.coalesce("component_id", "vec_id")
    return result.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("vec_id").isNull() | (component == F.col("vec_id"))).alias("kept"),
    )
