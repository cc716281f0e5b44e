"""Exact nearest neighbours by a block matrix join of quantised vectors.

Queries and candidates are packed in blocks. For each pair of blocks, a task multiplies int8 matrices: each vector is a scale times
integers from -127 to 127, plus a remainder whose length is known. The product gives the distance between the quantised vectors,
and by the triangle inequality the true one is within both remainders' lengths of it. What rounding may add is part of the bounds:
the square is a difference of large numbers where vectors are near one another, so its error is counted in units of their squared
lengths. Candidates whose lower bound is above the k-th smallest upper bound can't be among the k nearest; the others' distances
are computed again from the original vectors, and a heap keeps the k nearest of each query. The heaps of a query's tasks are
merged in the end. So nothing is lost: recall is 1.

The number of tiles is the product of the numbers of blocks; a task holds one block of either side at a time. Both sides are
shuffled by the part of the candidates, whose number grows with the table: neither is broadcast.

Defined results: vectors that are null, of length 0 or with null or non-finite components, or all of whose components are zero, take
no part, nor do those of another length than the query's; a query has as many neighbours as there are candidates, if fewer than
k. A row's own id is no candidate, so rows of one id aren't neighbours of one another; an id's rows give a result for each. Ties
go to the smaller id. An empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm.common import materialize, table

QUERY_BLOCK = 256
CANDIDATE_BLOCK = 4096
K = 10
#: Parts to which candidate blocks are dealt, each of which gets every query block: so many at least, and one for so many vectors.
SPREAD = 64
PART_ROWS = 1_000_000
#: Of double precision: what a computed square may be off, as a share of the sum of both squared lengths, and a computed length as a share of itself.
EPS = 2.0**-52


def usable(v: Column) -> Column:
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)


def packed(vectors: DataFrame, block: int) -> DataFrame:
    """(dims, ids, data): as many vectors of one length as a block holds, ids as int64 and components as float64 in their order.

    Blocks are made within a partition, so no shuffle is needed and each block has a bounded size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def full(dims: int) -> pa.RecordBatch:
            rows = held.pop(dims)
            ids = np.array([i for i, _ in rows], np.int64)
            data = np.stack([v for _, v in rows])
            return pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())], ["dims", "ids", "data"])

        for batch in batches:
            lists = batch.column(1)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            for i, end, dims in zip(batch.column(0).to_pylist(), ends, lists.value_lengths().to_pylist()):
                held.setdefault(dims, []).append((i, flat[end - dims : end]))
                if len(held[dims]) == block:
                    yield full(dims)
        for dims in list(held):
            yield full(dims)

    return vectors.mapInArrow(run, "dims int, ids binary, data binary")


def quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 matrix, scales, lengths of the remainders)."""
    scale = np.abs(v).max(axis=1) / 127
    scale[scale == 0] = 1.0  # the largest component is too small to be divided: all of the vector is its remainder
    q = np.rint(v / scale[:, None]).clip(-127, 127).astype(np.int8)
    return q, scale, np.sqrt(((v - q * scale[:, None]) ** 2).sum(axis=1))


def bounds(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances between the vectors of two quantised blocks."""
    (a, a_scale, a_rest), (b, b_scale, b_rest) = a, b
    # Sums of products of int8 values are exact in float32 up to 2**24, so long vectors are multiplied in parts.
    product = np.zeros((len(a), len(b)))
    for j in range(0, a.shape[1], 1024):
        product += a[:, j : j + 1024].astype(np.float32) @ b[:, j : j + 1024].astype(np.float32).T
    square = lambda m, s: (m.astype(np.float64) ** 2).sum(axis=1) * s**2
    lengths = square(a, a_scale)[:, None] + square(b, b_scale)[None, :]
    about = lengths - 2 * a_scale[:, None] * b_scale[None, :] * product
    off = 16 * EPS * lengths
    slack = 16 * EPS * (len(a[0]) + 1) * np.sqrt(lengths)  # of the remainders, and of the distances that are compared in the end
    margin = (a_rest[:, None] + b_rest[None, :]) * (1 + 1e-9) + slack
    low = np.sqrt(np.maximum(0, about - off)) * (1 - 1e-9) - margin
    high = np.sqrt(np.maximum(0, about + off)) * (1 + 1e-9) + margin
    return np.where(np.isnan(low), 0.0, low), np.where(np.isnan(high), np.inf, high)  # squares beyond the range of a double tell nothing


def distances(query: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, summed in the order of the components."""
    total = np.zeros(len(others))
    for j in range(len(query)):
        total += (query[j] - others[:, j]) ** 2
    return np.sqrt(total)


def nearest(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """Of each query, in order, the k nearest candidates of one tile."""
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        low, high = bounds(quantised(q), quantised(c))
        other = q_ids[:, None] != c_ids[None, :]
        upper = np.where(other, high, np.inf)
        limit = np.partition(upper, k - 1, axis=1)[:, k - 1] if upper.shape[1] > k else np.full(len(q), np.inf)
        may = other & (low <= limit[:, None])
    for i in range(len(q)):
        at = np.flatnonzero(may[i])
        with np.errstate(over="ignore"):
            yield int(i), heapq.nsmallest(k, zip(distances(q[i], c[at]).tolist(), c_ids[at].tolist()))


def k_nearest(vectors: DataFrame, queries: Column, *, k: int = K, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK, spread: int | None = None) -> DataFrame:
    """vectors: (vec_id, embedding). (query_id, rank, vec_id, score) of the k nearest rows of each row for which queries holds."""
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    asked = materialize(packed(good.where(queries), query_block), "queries").select("dims", F.monotonically_increasing_id().alias("q_block"), F.col("ids").alias("q_ids"), F.col("data").alias("q"))
    spread = spread or max(SPREAD, -(-vectors.count() // PART_ROWS))
    held = packed(good, candidate_block).select("dims", F.col("ids").alias("c_ids"), F.col("data").alias("c"))

    def run(tiles: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tiles:
            for dims, block, q_ids, q, c_ids, c in zip(*(x.to_pylist() for x in batch.columns)):
                ids = np.frombuffer(q_ids, np.int64)
                sides = np.frombuffer(q).reshape(-1, dims), np.frombuffer(c_ids, np.int64), np.frombuffer(c).reshape(-1, dims)
                rows = [(block, i, int(ids[i]), other, score) for i, found in nearest(ids, *sides, k) for score, other in found]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64()))], ["q_block", "i", "query_id", "vec_id", "score"])

    # A tile is a row of two blocks: a join by the vectors' length alone, whose number of rows is that of the blocks, not of the vectors.
    tiles = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))).join(held.withColumn("part", F.pmod(F.xxhash64("c_ids"), F.lit(spread)).cast("int")).hint("shuffle_merge"), ["dims", "part"])
    merged = tiles.select("dims", "q_block", "q_ids", "q", "c_ids", "c").mapInArrow(run, "q_block long, i int, query_id long, vec_id long, score double")
    order = Window.partitionBy("q_block", "i", "query_id").orderBy("score", "vec_id")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k_nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM d
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
