"""An approximate index for dense search: inverted lists around trained centroids.

Centroids are trained on a bounded sample. Every vector goes to the list of
its nearest centroid, as a code: what is left of its unit vector, in int8 with
one scale. A query looks into the lists of its nearest centroids, found by an
equality join; codes give scores that choose candidates, whose own vectors are
compared at last. Long lists are dealt to parts and many queries to blocks, so
that a list that holds a third of all vectors is searched by many tasks, and a
task's memory depends neither on the number of vectors nor on that of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import vectors as V

SAMPLE = 50_000  # vectors that centroids are trained on, at most
LISTS = 32
PROBES = 20
PART_ROWS = 20_000  # codes that one task looks at
QUERY_ROWS = 5_000  # queries of one block, about; each block meets all codes of the lists it looks into
CELLS = 2_000_000  # scores made at once
SLICE_ROWS = 500  # queries that lists are chosen for at once
AGAIN = 8  # candidates compared by their own vectors, as a multiple of what is wanted


def usable(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, v): unit vectors as doubles. Null and zero vectors and those with null or non-finite entries have no direction and drop out."""
    wide = vectors.select(key, F.col(column).cast("array<double>").alias("v"))
    sound = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return wide.where(F.coalesce(sound, F.lit(False))).select(key, V.unit(F.col("v")).alias("v"))


def train(units: DataFrame, lists: int = LISTS, sample: int = SAMPLE, seed: int = 1) -> np.ndarray:
    """Centroids of at most `lists` lists, from the `sample` vectors that hash lowest. Takes unit vectors v of one length."""
    drawn = units.select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(sample).select(array_to_vector("v").alias("features")).persist()
    try:
        n = drawn.count()
        if not n:
            return np.zeros((0, 0))
        model = KMeans(k=max(2, min(lists, n)), seed=seed, maxIter=15, initMode="k-means||").fit(drawn)
        return np.array([c.tolist() if hasattr(c, "tolist") else list(c) for c in model.clusterCenters()])
    finally:
        drawn.unpersist()


def _rows(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def build(units: DataFrame, centroids: np.ndarray, key: str = "vec_id") -> DataFrame:
    """(list, key, scale, code binary): the index of every vector."""
    kind = units.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _rows(batch.column("v"), centroids.shape[1])
            own = np.argmin((centroids**2).sum(1)[None, :] - 2 * v @ centroids.T, axis=1)
            left = v - centroids[own]
            scale = np.maximum(np.abs(left).max(1) / 127, 1e-300)
            code = np.rint(left / scale[:, None]).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), batch.column(key), pa.array(scale), pa.array([c.tobytes() for c in code], pa.binary())], ["list", key, "scale", "code"])

    return units.select(key, "v").mapInArrow(run, f"list int, {key} {kind}, scale double, code binary")


def best_codes(v: np.ndarray, center: np.ndarray, codes: np.ndarray, scale: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the `most` codes of a list that are nearest to each query, a few queries at a time."""
    places, scores = np.empty((len(v), most), np.int64), np.empty((len(v), most))
    step = max(1, CELLS // len(codes))
    for at in range(0, len(v), step):
        own = v[at : at + step]
        near = (own @ center)[:, None] + (own.astype(np.float32) @ codes.T) * scale[None, :]
        best = np.argpartition(-near, most - 1, axis=1)[:, :most]
        places[at : at + step], scores[at : at + step] = best, np.take_along_axis(near, best, 1)
    return places, scores


def search(queries: DataFrame, index: DataFrame, units: DataFrame, centroids: np.ndarray, k: int = 20, probes: int = PROBES, key: str = "vec_id", query: str = "query_id") -> DataFrame:
    """(query, rank, key, score): about the k nearest by cosine of each query (query, v of unit length), nearest first, ties to the smaller key.

    Recall grows with `probes`; scores are exact. `index` and `units` are
    read once each besides a count by list, `queries` twice besides a count,
    so store them. The index is sent once a block of QUERY_ROWS queries.
    """
    if not len(centroids):
        return queries.select(query).limit(0).join(units.select(key).limit(0), F.lit(True)).select(query, F.lit(0).alias("rank"), key, F.lit(0.0).alias("score"))
    length = centroids.shape[1]
    kind, asked_kind = units.schema[key].dataType.simpleString(), queries.schema[query].dataType.simpleString()
    sizes = index.groupBy("list").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))  # a row for each list
    dealt = index.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64(key), F.col("parts")).cast("int")).drop("parts")
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def nearest_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
            v = _rows(batch.column("v"), length)
            order = np.argsort((centroids**2).sum(1)[None, :] - 2 * v @ centroids.T, axis=1, kind="stable")[:, :probes]
            at = np.repeat(np.arange(len(v)), order.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(order.ravel(), pa.int32()), batch.column("q").take(pa.array(at)), batch.column("v").take(pa.array(at))], ["list", "q", "v"])

    probing = queries.select(F.col(query).alias("q"), "v").mapInArrow(nearest_lists, f"list int, q {asked_kind}, v array<double>")
    probing = probing.join(F.broadcast(sizes), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    probing = probing.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int"))

    def scan(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({"q": [], key: [], "near": []})
        v, center = np.stack(asked["v"]), centroids[asked["list"].iloc[0]]
        codes = np.frombuffer(b"".join(held["code"]), np.int8).reshape(-1, length).astype(np.float32)
        most = min(AGAIN * k, len(held))
        best, near = best_codes(v, center, codes, held["scale"].to_numpy(), most)
        return pd.DataFrame({"q": np.repeat(asked["q"].to_numpy(), most), key: held[key].to_numpy()[best.ravel()], "near": near.ravel()})

    found = probing.groupBy("list", "part", "block").cogroup(dealt.groupBy("list", "part", "block")).applyInPandas(scan, f"q {asked_kind}, {key} {kind}, near double")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("near"), key))
    chosen = found.withColumn("_n", place).where(F.col("_n") <= AGAIN * k).select("q", key)
    scored = chosen.join(units.select(key, F.col("v").alias("_own")), key).join(queries.select(F.col(query).alias("q"), F.col("v").alias("_asked")), "q")
    scored = scored.select(F.col("q").alias(query), key, V.cosine_of_units(F.col("_asked"), F.col("_own")).alias("score"))
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select(query, "rank", key, "score")
