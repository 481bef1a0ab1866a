"""The index of near_duplicates() for texts of five-word similarity 0.8 or more.

Two texts are near duplicates if the Jaccard similarity of their sets of
five-word shingles is 0.8 or more. Of the 64 bits of a SimHash, 9.7 differ on
average at that similarity, too many for segments that differ by one bit at
most. So the fingerprint is wider here: 48 min-hashes take the place of the
bits, 0.8 of which agree. The index is that of op10: the fingerprint is cut
into eight segments of six; a pair at exactly 0.8 has a segment that differs
in one symbol at most with a probability of 0.9998, more similar pairs with a
higher one. Each segment is indexed with every symbol in turn as a wildcard.

Pairs are tested where they meet, inside the equality join, by a bound that
is exact: each text has a set of 1024 bits, one for each residue of its
shingles' hashes, and can't share more shingles than bits, plus shingles that
share a bit. Only pairs that may be similar enough leave the join, and each is
verified on the whole sets.

Of small buckets all pairs are tested. Members of a larger bucket are first
verified against its hubs; after that, only pairs whose ends aren't linked
through others yet are tested. So no pair of a bucket is left out, and a large
group of near copies, which the hubs link, makes no pairs of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm import _shared, graph

SHINGLE_WORDS = 5
LEAST = (4, 5)  # similarity 4 / 5, kept as whole numbers so that the check is exact
SEGMENTS, SYMBOLS = 8, 6
SKETCH_WORDS = 16  # of 64 bits
BUCKET_MOST = 8
HUBS = 2
_CHUNK = 1 << 12
_DRAW = np.random.default_rng(5)
_FLIP, _TIMES, _MIX = (_DRAW.integers(0, 1 << 64, (SEGMENTS * SYMBOLS, 1), np.uint64, endpoint=False) | np.uint64(low) for low in (0, 1, 1))
_PLACE = _DRAW.integers(0, 1 << 64, (SEGMENTS, SYMBOLS), np.uint64, endpoint=False)
_BITS = [f"bits{i}" for i in range(SKETCH_WORDS)]


def shingles(text: str) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of five words, or of all words if there are fewer; without words one of its own."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    k = min(SHINGLE_WORDS, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    stops = np.cumsum(lengths + 1) - 1
    starts = stops - lengths
    digest = xxhash.xxh64_intdigest
    if not words:
        return np.array([digest(b"")], np.uint64)
    spans = zip(starts[: len(words) - k + 1].tolist(), stops[k - 1 :].tolist(), strict=True)
    return np.unique(np.array([digest(joined[a:b]) for a, b in spans], np.uint64))


def symbols(hashes: np.ndarray) -> np.ndarray:
    """The wide fingerprint: min-hashes, in segments."""
    least = np.full(SEGMENTS * SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        least = np.minimum(least, ((hashes[at : at + _CHUNK] ^ _FLIP) * _TIMES).min(1))
    return least.reshape(SEGMENTS, SYMBOLS)


def variants(fingerprint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of each segment with each of its symbols as a wildcard, and of each whole segment, as signed 64-bit integers.

    The last six bits of a key are the place of its wildcard among all symbols.
    """
    mixed = (fingerprint ^ (fingerprint >> np.uint64(31))) * _MIX.reshape(SEGMENTS, SYMBOLS)
    mixed ^= mixed >> np.uint64(29)
    whole = mixed.sum(1, dtype=np.uint64)
    rest = whole[:, None] - mixed + _PLACE
    rest = (rest ^ (rest >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    keys = (rest & ~np.uint64(63)).ravel() | np.arange(SEGMENTS * SYMBOLS, dtype=np.uint64)
    return keys.view(np.int64), whole.view(np.int64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """A bit for each residue that the hashes have."""
    bits = np.zeros(64 * SKETCH_WORDS, bool)
    bits[hashes % np.uint64(64 * SKETCH_WORDS)] = True
    return np.packbits(bits).view(np.int64)


def prints(rows: DataFrame) -> DataFrame:
    """n, keys of variants and of whole segments, the number of shingles, how many of them share another's bit, and the bits of each text."""
    names = ["n", "keys", "whole", "size", "over", *_BITS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _shared.slices(batch, "text"):
                own = [shingles(t) for t in texts]
                bits = np.stack([sketch(x) for x in own])
                size = np.array([len(x) for x in own])
                over = size - np.bitwise_count(bits.view(np.uint64)).sum(1)
                made = [variants(symbols(x)) for x in own]
                keys, whole = (pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([m[i] for m in made])), n).cast(pa.list_(pa.int64())) for i, n in ((0, SEGMENTS * SYMBOLS), (1, SEGMENTS)))
                yield pa.RecordBatch.from_arrays([part.column("n"), keys, whole, pa.array(size, pa.int32()), pa.array(over, pa.int32()), *(pa.array(bits[:, i].copy()) for i in range(SKETCH_WORDS))], names)

    return rows.select("n", "text").mapInArrow(run, "n bigint, keys array<bigint>, whole array<bigint>, size int, over int, " + ", ".join(f"{b} bigint" for b in _BITS))


def sets(rows: DataFrame) -> DataFrame:
    """n and the shingles of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _shared.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("n"), pa.array([shingles(t).view(np.int64) for t in texts], pa.list_(pa.int64()))], ["n", "own"])

    return rows.select("n", "text").mapInArrow(run, "n bigint, own array<bigint>")


def _similar(common: Column, both: Column) -> Column:
    """common / (both - common) >= p / q"""
    p, q = LEAST
    return (p + q) * common >= p * both


def _met(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Pairs (a, b) of rows that share a key, fulfil `on` (where `other` and a name is a column of the right) and may be near duplicates.

    Sketches that leave no room for the similarity prove that it isn't there.
    Equal segments share the variants of all their symbols: they meet under
    the first of them.
    """
    place = F.col("key").bitwiseAND(F.lit(63))
    first = (place % SYMBOLS == 0) | (F.get("whole", F.floor(place / SYMBOLS).cast("int")) != F.get("other_whole", F.floor(place / SYMBOLS).cast("int")))
    right = right.toDF(*(f"other_{c}" for c in right.columns))
    most = reduce(add, (F.bit_count(F.col(x).bitwiseAND(F.col(f"other_{x}"))) for x in _BITS)) + F.least("over", "other_over")
    met = left.join(right, F.expr(f"key = other_key AND {on}") & first & _similar(most, F.col("size") + F.col("other_size")))
    return met.select(F.least("n", "other_n").alias("a"), F.greatest("n", "other_n").alias("b"))


def _verified(pairs: DataFrame, rows: DataFrame, label: str) -> DataFrame:
    """Those pairs (a, b) of rows that are similar enough."""
    pairs = _shared.settle(pairs.distinct(), f"{label}-pairs")
    ends = pairs.select(F.col("a").alias("n")).unionByName(pairs.select(F.col("b").alias("n"))).distinct()
    known = _shared.settle(sets(rows.join(ends, "n", "left_semi")), f"{label}-sets")
    a, b = known.select(F.col("n").alias("a"), F.col("own").alias("x")), known.select(F.col("n").alias("b"), F.col("own").alias("y"))
    similar = _similar(F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y"))
    return _shared.settle(pairs.join(a, "a").join(b, "b").where(similar).select("a", "b"), f"{label}-links")


def links(rows: DataFrame, most: int = BUCKET_MOST, hubs: int = HUBS) -> DataFrame:
    """Edges (a, b) whose closure links all near duplicates that share a variant. Takes n, which is unique, and text."""
    own = _shared.settle(prints(rows), "prints")
    keyed = own.select("n", F.explode("keys").alias("key"))
    first = (F.min(F.struct(F.xxhash64("n", F.lit(i)).alias("h"), "n"))["n"].alias(f"hub{i}") for i in range(hubs))
    buckets = _shared.settle(keyed.groupBy("key").agg(F.count("*").alias("members"), *first).where("members > 1"), "buckets")
    # Buckets grow with the corpus: at no size are they broadcast.
    members = _shared.settle(keyed.join(buckets.hint("merge"), "key"), "members")
    stars = members.where(F.col("members") > most).select("n", F.explode(F.array_distinct(F.array(*(f"hub{i}" for i in range(hubs))))).alias("hub")).where("n <> hub")
    thin = own.drop("keys")
    few = _shared.settle(members.where(F.col("members") <= most).select("key", "n").join(thin.hint("merge"), "n"), "few")
    small = _met(few, few, "n < other_n")
    found = _verified(small.unionByName(stars.select(F.least("n", "hub").alias("a"), F.greatest("n", "hub").alias("b"))), rows, "near")
    crowd = _shared.settle(members.where(F.col("members") > most).select("key", "n"), "crowd")
    if crowd.isEmpty():
        return found
    label = _shared.settle(graph.components(found), "linked")
    named = _shared.settle(crowd.join(label, crowd["n"] == label["node"], "left").select("key", "n", F.coalesce("component", "n").alias("component")), "named")
    main = named.groupBy("key", "component").count().groupBy("key").agg(F.max(F.struct("count", "component"))["component"].alias("main"), F.count("*").alias("parts")).where("parts > 1")
    open_ = _shared.settle(named.join(main, "key").join(thin.hint("merge"), "n"), "open")
    return found.unionByName(_verified(_met(open_.where("component <> main"), open_, "component <> other_component"), rows, "rest"))
