"""Byte-level BPE encoding and decoding of whole texts."""

from __future__ import annotations

import base64
import heapq
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import _shared, pretokens

RANKS = "byte_bpe_multi_50k.tiktoken"
_NEVER = 1 << 60
assert array("I").itemsize == 4 and sys.byteorder == "little"


class Cache(dict):
    """Ids of pre-tokens as little-endian unsigned 32-bit integers.

    Holds at most `most` entries: a full generation is set aside and those of
    its entries that are asked for again move to the next one.
    """

    def __init__(self, encode, most: int = 250_000, longest: int = 200):
        super().__init__()
        self._encode, self._most, self._longest, self._old = encode, most, longest, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self._old.get(piece)
        if ids is None:
            ids = array("I", self._encode(piece)).tobytes()
        if len(piece) <= self._longest:
            if len(self) >= self._most:
                self._old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


def merge(ranks: dict[bytes, int], piece: bytes) -> list[int]:
    """Ids of one pre-token: itself if it has a rank, else what merging leaves."""
    whole = ranks.get(piece)
    return [whole] if whole is not None else [ranks[piece[a:b]] for a, b in pairwise(cuts(ranks, piece))]


def cuts(ranks: dict, piece: bytes | str) -> list[int]:
    """Where the parts of a pre-token begin and end: the pair with the lowest rank is merged, the leftmost first, until none can be."""
    if len(piece) > 128:
        return _cuts_long(ranks, piece)
    places = list(range(len(piece) + 1))
    get = ranks.get
    pairs = [get(piece[i : i + 2], _NEVER) for i in range(len(piece) - 1)]
    while pairs:
        lowest = min(pairs)
        if lowest == _NEVER:
            break
        i = pairs.index(lowest)
        del places[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = get(piece[places[i] : places[i + 2]], _NEVER)
        if i:
            pairs[i - 1] = get(piece[places[i - 1] : places[i + 1]], _NEVER)
    return places


def _cuts_long(ranks: dict, piece: bytes | str) -> list[int]:
    """The same for long pieces, by a heap over linked parts: n log n steps."""
    n = len(piece)
    end = list(range(1, n + 1))
    left = list(range(-1, n - 1))
    alive = bytearray(b"\x01" * n)
    heap = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (rank := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, j, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, j, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != j or end[j] != stop:
            continue
        alive[j] = 0
        end[i] = stop
        if stop < n:
            left[stop] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    return [*(i for i in range(n) if alive[i]), n]


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def rank_cache(path: str) -> Cache:
    ranks = load_ranks(path)
    return Cache(lambda piece: merge(ranks, piece.encode("utf-8", "surrogatepass")))


_SLOTS = (1 << 20) - 1
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # masks of 0 to 8 bytes


def _same_pieces(joined: str, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pre-token the number of its content, and for each number a pre-token that has it.

    The first sixteen bytes and the length are hashed for all pre-tokens at
    once. Contents are equal if these are; every pre-token is compared with
    the one that stands for its hash. Those that are longer, or differ twice
    from the one that shares their hash, get numbers of their own.
    """
    data = joined.encode("utf-8", "surrogatepass")
    stops = np.append(places[1:], len(joined))
    if len(data) == len(joined):
        begins, ends = places, stops
    else:
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        width = np.ones(len(points) + 1, np.int64)
        width[:-1] += (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        at = np.cumsum(width) - width
        begins, ends = at[places], at[stops]
    length = ends - begins
    padded = data + bytes(16)
    eight = np.ndarray(len(data) + 9, "<u8", padded, 0, (1,))
    low = eight[begins] & _LOW_BYTES[np.minimum(length, 8)]
    high = eight[begins + 8] & _LOW_BYTES[np.clip(length - 8, 0, 8)]
    mixed = (low ^ (low >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + (high ^ (high >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F) + length.astype(np.uint64)
    mixed ^= mixed >> np.uint64(32)
    # One pre-token of each hash stands for it: the last that is written to its slot.
    number = np.empty(len(places), np.int32)
    shown, rest, seen = [], np.flatnonzero(length <= 16).astype(np.int32), 0
    for turn in range(2):
        slot = (mixed[rest] >> np.uint64(20 * turn)).astype(np.int32) & _SLOTS
        table = np.empty(_SLOTS + 1, np.int32)
        table[slot] = rest
        stands = table[slot]
        same = (low[stands] == low[rest]) & (high[stands] == high[rest]) & (length[stands] == length[rest])
        own = rest[stands == rest]
        number[own] = np.arange(seen, seen + len(own), dtype=np.int32)
        number[rest[same]] = number[stands[same]]
        shown.append(own)
        seen += len(own)
        rest = rest[~same]
    apart = np.concatenate([rest, np.flatnonzero(length > 16)])
    number[apart] = np.arange(seen, seen + len(apart), dtype=np.int32)
    return number, np.concatenate([*shown, apart])


def encode_pieces(joined: str, places: np.ndarray, cache: Cache) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pre-tokens that start at `places` of a text, and how many come before each and in all. Each different pre-token is looked up once."""
    if not len(places):
        return np.zeros(0, "<u4"), np.zeros(1, np.int64)
    number, shown = _same_pieces(joined, places)
    stops = np.append(places[1:], len(joined))
    ids = [cache[joined[a:b]] for a, b in zip(places[shown].tolist(), stops[shown].tolist(), strict=True)]
    known = np.frombuffer(b"".join(ids), "<u4")
    size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    begin = np.cumsum(size) - size
    sizes = size[number]
    before = np.append(0, np.cumsum(sizes))
    at = np.repeat(begin[number] - before[:-1], sizes) + np.arange(before[-1])
    return known[at], before


def encode_flat(texts: list[str], cache: Cache) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts, how many come before each text and in all, where pre-tokens start, and the first one's number for each text."""
    joined, places, first = pretokens.boundaries(texts)
    flat, before = encode_pieces(joined, places, cache)
    return flat, before[first], places, first


def encode_texts(texts: list[str], cache: Cache) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Ids of each text as bytes; where pre-tokens start, and the first one's number for each text."""
    flat, before, places, first = encode_flat(texts, cache)
    data = flat.tobytes()
    return [data[4 * a : 4 * b] for a, b in pairwise(before.tolist())], places, first


def encode(documents: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text by the ranks at `path`, each pre-token separately, without special tokens.

    Returns key, n_tokens long, ids binary (little-endian unsigned 32-bit)
    and piece_starts binary (the same format: the character at which each
    pre-token starts). A null text counts as empty; an empty text has no
    ids. Other columns don't pass. Rows are kept as they are, repeats
    included; one text is held in memory at a time beside the batch.
    """
    path = path or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = rank_cache(path)
        for batch in batches:
            for part, texts in _shared.slices(batch, "t"):
                ids, places, first = encode_texts(texts, cache)
                begin = np.cumsum([0, *map(len, texts)])
                numbers = first.tolist()
                starts = [(places[a:b] - at).astype("<u4").tobytes() for a, b, at in zip(numbers, numbers[1:], begin.tolist(), strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(starts, pa.binary())], ["k", "n_tokens", "ids", "piece_starts"])

    kind = documents.schema[key].dataType.simpleString()
    out = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, n_tokens bigint, ids binary, piece_starts binary")
    return out.withColumnRenamed("k", key)


def decode(encoded: DataFrame, path: str | None = None, key: str = "doc_id") -> DataFrame:
    """The bytes that ids stand for. Takes key, n_tokens and ids as encode() returns them; adds decoded binary."""
    path = path or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(path)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        look = tokens.__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [b"".join(map(look, np.frombuffer(x, "<u4").tolist())) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("k", "n_tokens", "ids")), pa.array(texts, pa.binary())], ["k", "n_tokens", "ids", "decoded"])

    kind = encoded.schema[key].dataType.simpleString()
    out = encoded.select(F.col(key).alias("k"), "n_tokens", "ids").mapInArrow(run, f"k {kind}, n_tokens bigint, ids binary, decoded binary")
    return out.withColumnRenamed("k", key)


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    documents = _shared.table(spark, sf_dir, "documents")
    return decode(encode(documents)).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
