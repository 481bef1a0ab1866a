"""Token ids in fixed-stride shards, in a keyed random training order.

Sequences are numbered, and a Feistel network keyed by a seed permutes the
numbers; values past the last sequence are permuted again until they fall
inside (cycle walking). So every sequence gets its own slot without a table of
the permutation, and the slot says where it goes: a shard holds a range of
slots, each at a fixed stride, so a reader finds slot s by arithmetic and
resumes anywhere. A task writes a range of shards in order, so that files are
read sequentially. Shards are rows of a Parquet table, which any store that
Spark writes to can hold.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import _shared, packing

TOKENS = 512  # of a sequence, at most
SHARD_SLOTS = 1024
TASK_SHARDS = 16  # shards that one task writes, in order
SEED = 20240229
_ROUNDS = 6
_HEAD = np.dtype([("doc_id", "<i8"), ("piece", "<i4"), ("length", "<i4")])


def stride(tokens: int) -> int:
    """Bytes of a slot: document, piece and length, then ids of two bytes, padded with zeros."""
    return _HEAD.itemsize + 2 * tokens


def _round(half: np.ndarray, key: int) -> np.ndarray:
    x = (half + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permute(index: np.ndarray, total: int, seed: int = SEED) -> np.ndarray:
    """The slots of these sequences out of `total`: a bijection of 0 ... total - 1."""
    bits = max(1, -(-max(1, total - 1).bit_length() // 2))
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    keys = [zlib.crc32(f"{seed}/{r}".encode()) for r in range(_ROUNDS)]
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> shift, x & mask
        for key in keys:
            left, right = right, left ^ (_round(right, key) & mask)
        x = (left << shift) | right
        out[todo] = x
        todo = todo[x >= total]
    return out.astype(np.int64)


def sequences(documents: DataFrame, path: str | None = None, tokens: int = TOKENS) -> DataFrame:
    """doc_id, piece, length, ids_crc32 and ids (two bytes each) of every sequence."""
    wide = packing.pieces(documents, path, tokens, with_ids=True, id_bytes=2)
    return wide.select(F.col("doc_id").cast("long").alias("doc_id"), "piece", F.col("length").cast("int").alias("length"), "ids_crc32", "ids")


def materialise(documents: DataFrame, path: str | None = None, tokens: int = TOKENS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """Shards (shard, first_slot, slots, index, payload) of all documents' sequences, settled in the shared folder.

    The index holds (doc_id, piece, length, ids_crc32) of each slot, so that
    what is where can be read without the payload.

    A document is its ids and the end id, cut as for packing. Null and empty
    texts are the end id alone, a null doc_id is written as -1, repeated rows
    are sequences of their own, other columns don't pass, and an empty table
    gives no shards.
    """
    numbered, total = _shared.number_rows(sequences(documents, path, tokens), "sequences", "index")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = permute(batch.column("index").to_numpy(), total, seed)
            yield pa.RecordBatch.from_arrays([pa.array(slot // shard_slots), pa.array(slot), *(batch.column(c) for c in kept)], ["shard", "slot", *kept])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("shard", "slot", *kept)), strict=True))
        width = stride(tokens)
        for shard, group in groupby(rows, key=lambda r: r[0]):
            own = list(group)  # shard_slots at most
            _, slot, doc_id, piece, length, crc, ids = zip(*own, strict=True)
            heads = np.zeros(len(own), _HEAD)
            heads["doc_id"], heads["piece"], heads["length"] = [-1 if x is None else x for x in doc_id], piece, length
            head = heads.tobytes()
            size = _HEAD.itemsize
            payload = b"".join(x for i, own_ids in enumerate(ids) for x in (head[i * size : (i + 1) * size], own_ids, bytes(width - size - len(own_ids))))
            listed = pa.StructArray.from_arrays([pa.array(doc_id, pa.int64()), pa.array(piece, pa.int32()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())], list(kept[:4]))
            index = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), listed)
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([slot[0]]), pa.array([len(own)], pa.int32()), index, pa.array([payload], pa.binary())], ["shard", "first_slot", "slots", "index", "payload"])

    kept = ("doc_id", "piece", "length", "ids_crc32", "ids")
    placed = numbered.mapInArrow(place, "shard bigint, slot bigint, doc_id bigint, piece int, length int, ids_crc32 bigint, ids binary")
    # Slots are dealt by range: a task's shards follow each other, and how much a task gets doesn't depend on the data.
    parts = max(1, -(-total // (shard_slots * TASK_SHARDS)))
    dealt = placed.repartitionById(parts, F.floor(F.col("shard") / TASK_SHARDS).cast("int")).sortWithinPartitions("slot")
    return _shared.settle(dealt.mapInArrow(fill, "shard bigint, first_slot bigint, slots int, index array<struct<doc_id:bigint,piece:int,length:int,ids_crc32:bigint>>, payload binary"), "shards")


def index_of(shards: DataFrame, tokens: int = TOKENS) -> DataFrame:
    """slot, shard, byte_offset, doc_id, piece, length, ids_crc32 of every sequence, without reading payloads."""
    rows = shards.select("shard", "first_slot", F.posexplode("index").alias("at", "x"))
    return rows.select((F.col("first_slot") + F.col("at")).alias("slot"), "shard", (F.col("at").cast("long") * stride(tokens)).alias("byte_offset"), "x.*")


def read(shards: DataFrame, tokens: int = TOKENS, from_slot: int = 0, shard_slots: int = SHARD_SLOTS, with_ids: bool = False) -> DataFrame:
    """The sequences from a slot on, in any order of shards: what a resumed run still has to see. A null doc_id is stored, and read, as -1."""
    width = stride(tokens)
    names = ["slot", "shard", "byte_offset", "doc_id", "piece", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, slots, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "first_slot", "slots", "payload")), strict=True):
                heads = np.ndarray(slots, _HEAD, data, 0, width)
                slot = np.arange(first, first + slots)
                wanted = np.flatnonzero(slot >= from_slot)
                begin = (wanted * width + _HEAD.itemsize).tolist()
                ids = [data[a : a + 2 * n] for a, n in zip(begin, heads["length"][wanted].tolist(), strict=True)]
                crc = [zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x in ids]
                columns = [pa.array(slot[wanted]), pa.array(np.full(len(wanted), shard)), pa.array((slot[wanted] - first) * width), *(pa.array(heads[c][wanted].copy()) for c in ("doc_id", "piece", "length")), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.binary())] if with_ids else []), names)

    still = shards.where(F.col("shard") >= from_slot // shard_slots)
    return still.mapInArrow(run, "slot bigint, shard bigint, byte_offset bigint, doc_id bigint, piece int, length int, ids_crc32 bigint" + ", ids binary" * with_ids)


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(materialise(_shared.table(spark, sf_dir, "documents")))
