"""Exact top-k inner-product search by columnar branch-and-bound (operator 3).

Candidates lie in blocks in vertical layout (dimension by dimension).  For a query, partial inner products are accumulated over
one block of dimensions at a time; what the remaining dimensions can add is at most the product of the remaining norms
(Cauchy-Schwarz), so candidates whose upper bound is below the k-th best lower bound are dropped and the survivors compacted
before the next block of dimensions.  Results are exact.

Queries are packed in blocks too; query blocks are copied once to each of ``groups`` candidate groups and equi-joined on the
group, so neither side is broadcast or collected.  A task keeps each query's k-th best score so far (for ``KEPT`` query blocks) and
carries it from block to block, so later blocks are cut down from the first dimensions on and give only rows that may still
count.  One window keeps the best k.

Edge cases: vectors that are null or hold null or non-finite components take no part, nor does a null id; rows that repeat
another's id and vector count once; rows that share an id but not the vector are candidates each, never of one another, and
queries each (ranked apart, told apart by the further column query_key, a hash of the vector); vectors are compared with those of the
same length only; ties go to the smaller id, then to the smaller key; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

#: Dimensions are accumulated in blocks of these sizes, the last one repeated.
DIMS = (16, 16, 32)
#: Query blocks whose bounds a task keeps.
KEPT = 4096


def _packed(vectors: DataFrame, size: int) -> DataFrame:
    """Blocks of at most ``size`` vectors (id, key, x) of one dimension, as bytes: ids, keys, and components in vertical layout."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        held: dict[int, tuple[list, list, list]] = {}

        def block(dim: int) -> pa.RecordBatch:
            nonlocal n
            ids, keys, xs = held.pop(dim)
            made = np.array(xs, np.int64).reshape(len(ids), dim).T
            n += 1
            raw = [np.array(ids, np.int64).tobytes(), np.array(keys, np.int64).tobytes(), np.ascontiguousarray(made).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([part << 32 | n]), *(pa.array([x], pa.binary()) for x in raw)], ["dim", "block", "ids", "keys", "xs"])

        for batch in batches:
            for i, key, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, keys, xs = held.setdefault(len(x), ([], [], []))
                ids.append(i)
                keys.append(key)
                xs.append(x)
                if len(ids) >= size:
                    yield block(len(x))
        for dim in sorted(held):
            yield block(dim)

    return vectors.select("id", "key", "x").mapInArrow(run, "dim int, block long, ids binary, keys binary, xs binary")


def best(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates (columns of c) of each query (column of q), without those below the query's floor: numbers of queries
    and of candidates, scores.  Floors rise to the k-th best score seen."""
    dim = len(c)
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(dim, 1)
    kind = np.float64 if top < 2**52 else np.int64  # products of floats are exact up to there, and fast
    qf, cf = q.astype(kind), c.astype(kind)
    edges = [0]
    while edges[-1] < dim:
        edges.append(min(dim, edges[-1] + DIMS[min(len(edges) - 1, len(DIMS) - 1)]))
    mass = lambda x: np.array([np.sqrt((x[e:].astype(np.float64) ** 2).sum(0)) for e in edges[1:]])
    q_mass, c_mass = mass(q), mass(c)
    first = qf[: edges[1]].T @ cf[: edges[1]] if dim else np.zeros((q.shape[1], c.shape[1]))
    out: list[tuple] = []
    for j in range(q.shape[1]):
        alive = np.flatnonzero(c_ids != q_ids[j])
        acc = first[j, alive]
        least = -np.inf if floor is None else float(floor[j])
        for b in range(len(edges) - 1):
            if b:
                acc = acc + qf[edges[b] : edges[b + 1], j] @ cf[edges[b] : edges[b + 1], alive]
            if len(alive) > k or least > -np.inf:
                room = q_mass[b, j] * c_mass[b, alive] * (1 + 1e-9) + 0.5 * (b + 2 < len(edges))
                low = acc - room
                if len(alive) > k:
                    least = max(least, np.partition(low, len(low) - k)[len(low) - k])
                keep = acc + room >= least * (1 - 1e-9 * np.sign(least)) if abs(least) >= 2**52 else acc + room >= least
                alive, acc = alive[keep], acc[keep]
        order = np.lexsort((c_ids[alive], -acc))[:k]
        if floor is not None and len(order) == k:
            floor[j] = max(floor[j], float(acc[order[-1]]))
        out += [(j, alive[o], int(acc[o])) for o in order]
    made = np.array(out, np.int64).reshape(-1, 3)
    return made[:, 0], made[:, 1], made[:, 2]


def quantised(x: Column, scale: float = 256.0) -> Column:
    return F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(scale)).cast("long"))


def search(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: float = 256.0, groups: int | None = None, block: int = 4096, query_block: int = 128) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products of quantised vectors; and query_key.

    groups: 64 or, if there are more, the session's shuffle partitions."""
    spark = vectors.sparkSession
    ship(spark)
    groups = groups or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    x = F.col(vector_col)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == F.lit(float("inf"))))
    good = vectors.where(F.col(id_col).isNotNull() & x.isNotNull()).where(~bad)
    rows = good.select(F.col(id_col).cast("long").alias("id"), quantised(x, scale).alias("x"), is_query.alias("q")).withColumn("key", F.xxhash64("x")).dropDuplicates(["id", "key", "x"])
    candidates = _packed(rows, block).withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups)))
    queries = _packed(rows.where("q"), query_block)
    queries = queries.select("dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("keys").alias("q_keys"), F.col("xs").alias("q_xs"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"))
    pairs = candidates.join(queries, ["dim", "g"]).select("dim", "ids", "xs", "q_block", "q_ids", "q_keys", "q_xs", "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for dim, ids, xs, q_block, q_ids, q_keys, q_xs, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                of = lambda i, v: (np.frombuffer(v, np.int64).reshape(dim, -1) if dim else np.zeros((0, len(i)), np.int64))  # noqa: B023, E731
                c_ids, own, c_keys, own_keys = (np.frombuffer(v, np.int64) for v in (ids, q_ids, keys, q_keys))
                floor = floors.pop((dim, q_block), None)
                floor = np.full(len(own), -np.inf) if floor is None else floor
                who, which, score = best(of(own, q_xs), own, of(c_ids, xs), c_ids, k, floor)
                floors[dim, q_block] = floor
                if len(floors) > KEPT:
                    floors.pop(next(iter(floors)))
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (own[who], own_keys[who], c_ids[which], c_keys[which], score)], ["query_id", "query_key", "vec_id", "vec_key", "score"])

    found = pairs.mapInArrow(run, "query_id long, query_key long, vec_id long, vec_key long, score long")
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), F.asc("vec_id"), F.asc("vec_key"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_key")
