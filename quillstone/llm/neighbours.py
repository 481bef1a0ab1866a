"""Nearest neighbours by a block matrix join over int8 tiles.

Queries and candidates are dealt into blocks of a fixed size; every pair of a
query block and a candidate block is one task's work. Vectors are quantised
to int8, each with its own scale. A tile of int8 products gives every inner
product with a bound on its error, for with q = s a + e and c = t b + f

    |q.c - s t a.b| <= |e|.|c| + |q|.|f| + |e|.|f|

Pairs whose upper bound is below the k-th best lower bound seen so far cannot
be among the k nearest; only the others are computed again in double
precision. Each query's best k of a block sit in a heap, and the heaps of all
blocks are merged by rank. Nothing is approximate in the result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm import _shared

NEAREST = 20
BLOCK_ROWS = 8192  # candidates of a block
BLOCK_QUERIES = 1024
TILE_ROWS = 512
QUERY_EVERY = 20


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 components (held as floats in which sums of their products are exact), scales, and norms of what is lost."""
    scale = np.maximum(np.abs(x).max(1) / 127, np.finfo(float).tiny)
    whole = np.rint(x / scale[:, None])
    lost = np.sqrt(((x - whole * scale[:, None]) ** 2).sum(1))
    wide = 127 * 127 * x.shape[1] >= 1 << 24  # float32 has whole numbers up to here
    return whole if wide else whole.astype(np.float32), scale, lost


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in double precision, summed from the first component to the last."""
    total = np.zeros(len(q))
    for d in range(q.shape[1]):
        total += q[:, d] * c[:, d]
    return total


def nearest_of_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, tile_rows: int = TILE_ROWS) -> Iterator[tuple[int, int, float]]:
    """The k nearest of these candidates for each query: (query_id, vec_id, score)."""
    heaps: list[list[tuple[float, int]]] = [[] for _ in query_ids]
    floor = np.full(len(query_ids), -np.inf)  # a lower bound of the k-th best so far
    qa, qs, qe = quantise(queries)
    qn = np.sqrt((queries**2).sum(1))
    for at in range(0, len(ids), tile_rows):
        own, x = ids[at : at + tile_rows], vectors[at : at + tile_rows]
        ca, cs, ce = quantise(x)
        cn = np.sqrt((x**2).sum(1))
        near = (qa @ ca.T).astype(np.float64) * qs[:, None] * cs[None, :]
        bound = (qe[:, None] * cn + qn[:, None] * ce + qe[:, None] * ce) * (1 + 1e-9) + 1e-300
        bound += 1e-12 * qn[:, None] * cn
        itself = query_ids[:, None] == own[None, :]
        low = np.where(itself, -np.inf, near - bound)
        if len(own) > k:
            floor = np.maximum(floor, np.partition(low, len(own) - k, axis=1)[:, len(own) - k])
        i, j = np.nonzero(~(near + bound < floor[:, None]) & ~itself)  # what overflowed survives
        if not len(i):
            continue
        scores = exact(queries[i], x[j])
        for a, vec, score in zip(i.tolist(), own[j].tolist(), scores.tolist(), strict=True):
            heap = heaps[a]
            entry = (score, -vec)
            if len(heap) < k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
        for a in np.unique(i).tolist():
            if len(heaps[a]) == k:
                floor[a] = max(floor[a], heaps[a][0][0])
    for query, heap in zip(query_ids.tolist(), heaps, strict=True):
        for score, vec in heap:
            yield query, -vec, score


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part: not null, not zero, all components finite."""
    wide = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    return wide.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    ).withColumn("length", F.size("v"))


def search(vectors: DataFrame, every: int = QUERY_EVERY, k: int = NEAREST, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query, ties to the smaller vec_id.

    Queries are the rows whose key is divisible by `every`; candidates are
    all rows but the query's own key. Rows that repeat a key with another
    vector are candidates in their own right. Fewer than k candidates are
    all returned. Vectors that are null, zero or hold null or non-finite
    components take no part; vectors of another length have no inner product
    with a query and aren't its candidates. Extra columns don't pass; an empty
    table gives an empty result.
    """
    rows = _shared.settle(usable(vectors, key, column), "vectors")
    counts = rows.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).first()
    tiles = max(1, -(-counts["n"] // block_rows))
    query_blocks = max(1, -(-counts["q"] // block_queries))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    hashed = F.xxhash64("vec_id")
    queries = rows.where(F.col("vec_id") % every == 0).select("vec_id", "v", "length", F.pmod(hashed, F.lit(query_blocks)).cast("int").alias("qb"), spread(tiles).alias("cb"))
    candidates = rows.select("vec_id", "v", "length", F.pmod(hashed, F.lit(tiles)).cast("int").alias("cb"), spread(query_blocks).alias("qb"))

    def tile(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            left, right = left.sort_values("vec_id"), right.sort_values("vec_id")
            found = list(nearest_of_block(left["vec_id"].to_numpy(), np.stack(left["v"]), right["vec_id"].to_numpy(), np.stack(right["v"]), k))
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    best = queries.groupBy("length", "qb", "cb").cogroup(candidates.groupBy("length", "qb", "cb")).applyInPandas(tile, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return search(_shared.table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
