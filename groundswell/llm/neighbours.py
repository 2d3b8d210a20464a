"""Approximate nearest neighbours by randomly rotated one-bit codes.

Every vector is centred, rotated and kept as one sign bit per dimension with three
correction numbers (Gao and Long, "RaBitQ"): its distance to the centre, the inner
product of its direction with its code, and its inner product with the centre. From
these a query's inner product with the vector is estimated with an error bound.

The index table is dealt into blocks of about ``INDEX_BLOCK`` rows, the stated queries
into blocks of ``QUERY_BLOCK``, and each pair of blocks is searched in one task: the
best ``PROBE * k`` estimates of a query are computed exactly, and every other vector
whose upper bound reaches the k-th of them is reranked too. ``WIDTH`` standard
deviations of the estimate bound the error. Only k rows per query and block go on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from groundswell.llm.common import checkpointed, per_batch
from groundswell.llm.vectors import matrices

INDEX_BLOCK, QUERY_BLOCK = 8_192, 2_048
CHUNK = 128  # queries scored at a time in a task
PROBE = 3
WIDTH = 2.5
SEED = 9


def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(matrix: np.ndarray, center: np.ndarray):
    """(bits, distance to the centre, direction times code) of the rows of a matrix."""
    dim = matrix.shape[1]
    turned = (matrix - center) @ rotation(dim)
    distance = np.sqrt((turned * turned).sum(axis=1))
    direction = turned / np.where(distance > 0, distance, 1)[:, None]
    agreement = np.abs(direction).sum(axis=1) / np.sqrt(dim)
    return np.packbits(turned > 0, axis=1), distance, np.where(distance > 0, agreement, 1.0)


def _usable(batch: pa.RecordBatch) -> pa.RecordBatch:
    ids, dims, raws = [], [], []
    keys = batch.column(0).to_pylist()
    for dim, (rows, matrix) in matrices(batch.column(1)).items():
        for row, vector in zip(rows.tolist(), matrix):
            if keys[row] is not None:
                ids.append(keys[row])
                dims.append(dim)
                raws.append(vector.tobytes())
    columns = [pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(raws, pa.binary())]
    return pa.record_batch(columns, names=["vec_id", "dim", "raw"])


def _totals(batches):
    """Sum and number of a task's vectors, by dimension."""
    sums: dict[int, list] = {}
    for batch in batches:
        dims = batch.column(1).to_numpy()
        raws = batch.column(2).to_pylist()
        for dim in np.unique(dims).tolist():
            own = b"".join(raws[i] for i in np.flatnonzero(dims == dim))
            matrix = np.frombuffer(own, np.float64).reshape(-1, dim)
            total = sums.setdefault(dim, [np.zeros(dim), 0])
            with np.errstate(over="ignore"):
                total[0] = total[0] + matrix.sum(axis=0)
            total[1] += len(matrix)
    for dim, (total, n) in sums.items():
        yield pa.record_batch(
            [pa.array([dim], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([n], pa.int64())],
            names=["dim", "total", "n"],
        )


def _encode(centers: dict[int, np.ndarray]):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        dims = batch.column(1).to_numpy()
        raws = batch.column(2).to_pylist()
        bits: list[bytes] = [b""] * batch.num_rows
        distance, agreement = np.zeros(batch.num_rows), np.ones(batch.num_rows)
        for dim in np.unique(dims).tolist():
            (rows,) = np.nonzero(dims == dim)
            matrix = np.frombuffer(b"".join(raws[i] for i in rows), np.float64).reshape(-1, dim)
            packed, distance[rows], agreement[rows] = encode(matrix, centers[dim])
            for row, code in zip(rows.tolist(), packed):
                bits[row] = code.tobytes()
        columns = [*batch.columns, pa.array(bits, pa.binary()), pa.array(distance), pa.array(agreement)]
        return pa.record_batch(columns, names=[*batch.schema.names, "code", "distance", "agreement"])

    return per_batch(run)


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, of equal ones the smaller ids first."""
    return np.lexsort((ids, -scores))[:k]


def _search(centers: dict[int, np.ndarray], k: int):
    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if not len(index) or not len(queries):
            return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])
        dim = int(index["dim"].iloc[0])
        root = np.sqrt(dim)
        index = index.sort_values("vec_id", ignore_index=True)
        ids = index["vec_id"].to_numpy()
        vectors = np.frombuffer(b"".join(index["raw"]), np.float64).reshape(-1, dim)
        packed = np.frombuffer(b"".join(index["code"]), np.uint8).reshape(len(ids), -1)
        code = np.unpackbits(packed, axis=1, count=dim).astype(np.float32) * 2 - 1
        distance, agreement = index["distance"].to_numpy(), index["agreement"].to_numpy()
        factor = (distance / (agreement * root)).astype(np.float32)
        spread = np.sqrt(np.maximum(1 - agreement**2, 0)) / agreement
        spread = (distance * spread * WIDTH / np.sqrt(max(dim - 1, 1))).astype(np.float32)
        who = queries["vec_id"].to_numpy()
        asked = np.frombuffer(b"".join(queries["raw"]), np.float64).reshape(-1, dim)
        base = asked @ centers[dim]
        turned = (asked @ rotation(dim)).astype(np.float32)
        size = np.sqrt((asked * asked).sum(axis=1))
        probe = min(PROBE * k + 1, len(ids))
        for at in range(0, len(who), CHUNK):
            part = slice(at, at + CHUNK)
            estimate = turned[part] @ code.T * factor + base[part, None].astype(np.float32)
            best = np.argpartition(-estimate, probe - 1, axis=1)[:, :probe]
            bound = estimate + size[part, None].astype(np.float32) * spread
            for row, query in enumerate(range(at, min(at + CHUNK, len(who)))):
                exact = (vectors[best[row]] * asked[query]).sum(axis=1)
                exact = exact[ids[best[row]] != who[query]]
                least = np.partition(exact, -k)[-k] if len(exact) > k else -np.inf
                (near,) = np.nonzero(bound[row] >= least - 1e-5 * (1 + abs(least)) if np.isfinite(least) else bound[row] > -np.inf)
                near = np.union1d(near, best[row])
                near = near[ids[near] != who[query]]
                scores = (vectors[near] * asked[query]).sum(axis=1)
                chosen = top(scores, ids[near], k)
                out += zip([int(who[query])] * len(chosen), ids[near][chosen].tolist(), scores[chosen].tolist())
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product per query.

    Queries are the rows of ``vectors`` (vec_id, embedding, ...) whose id is divisible
    by ``every``; candidates are all rows with another id and the same dimension. Scores
    are computed in double precision on the vectors as given. Vectors that are null,
    empty, zero or hold a null or non-finite component, and rows without id, take no
    part. Of equal scores the smaller id is nearer; rows that repeat a vec_id are one
    candidate. An empty table gives an empty result.
    """
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    usable = checkpointed(
        plain.mapInArrow(per_batch(_usable), "vec_id long, dim int, raw binary").dropDuplicates(["vec_id"])
    )
    totals = usable.mapInArrow(_totals, "dim int, total array<double>, n long")
    summed = (
        totals.select("dim", "n", F.posexplode("total").alias("pos", "part"))
        .groupBy("dim", "pos")
        .agg(F.sum("part").alias("total"), F.sum("n").alias("n"))
        .orderBy("dim", "pos")
        .collect()  # one number for each dimension of a vector
    )
    numbers = {row["dim"]: row["n"] for row in summed}
    centers = {
        dim: np.nan_to_num([row["total"] / n for row in summed if row["dim"] == dim])
        for dim, n in numbers.items()
    }
    index = checkpointed(
        usable.mapInArrow(
            _encode(centers),
            "vec_id long, dim int, raw binary, code binary, distance double, agreement double",
        )
    )
    rows = sum(numbers.values())
    queries = index.where(F.col("vec_id") % every == 0).select("vec_id", "dim", "raw")
    asked = queries.count()
    blocks, sets = max(1, -(-rows // INDEX_BLOCK)), max(1, -(-asked // QUERY_BLOCK))

    def own(parts: int):
        return F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")

    def spread(parts: int):
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    left = index.withColumn("ib", own(blocks)).withColumn("qb", spread(sets))
    right = queries.withColumn("qb", own(sets)).withColumn("ib", spread(blocks))
    found = (
        left.groupBy("dim", "ib", "qb")
        .cogroup(right.groupBy("dim", "ib", "qb"))
        .applyInPandas(_search(centers, k), "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
