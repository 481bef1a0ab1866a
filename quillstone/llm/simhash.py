"""Near-duplicate detection by SimHash with deletion-variant signatures.

A fingerprint is cut into fewer segments than an exact match would need: with
two segments, fingerprints at most two bits apart have a segment that differs
by at most one bit. Each segment is therefore indexed once for every position
as a variant in which that bit is a wildcard; segments that differ by one bit
or none share a variant. Fingerprints are made distinct first. Small buckets
of equal variants are joined and their pairs verified. A bucket of more than
`most` fingerprints yields no pairs: its members are indexed under all values
one bit away, and those that share such a value, which are at most two bits
apart, become a star. Both ways are exact; the second is linear in the number
of members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm import _shared, graph, near_texts

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 2
BUCKET_MOST = 8
_SEGMENT = 32
_CHUNK = 1 << 16


def fingerprint(text: str, words_in_shingle: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64 bits, each set if it is in over half of the shingles' hashes; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    k = min(words_in_shingle, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    stops = np.cumsum(lengths + 1) - 1
    starts = stops - lengths
    n = len(words) - k + 1
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        to = min(n, at + _CHUNK)
        spans = zip(starts[at:to].tolist(), stops[at + k - 1 : to + k - 1].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(documents: DataFrame, words_in_shingle: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id and fingerprint (a long that holds the 64 bits). A null text has no words; its fingerprint is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _shared.slices(batch, "text"):
                bits = np.array([fingerprint(t, words_in_shingle, seed) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(bits)], ["doc_id", "fp"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


def _mask(low: int, bits: int) -> int:
    """A literal of `bits` ones from bit `low`, as a signed 64-bit integer."""
    value = ((1 << bits) - 1) << low
    return value - (1 << 64) if value >> 63 else value


def _variants(fp: Column) -> Column:
    """The keys of both segments with each of their bits as a wildcard: place 0..63 and the bits that are left.

    Keys are 64-bit hashes of the two. Should two share a key, their buckets
    merge, and verification parts them again.
    """
    out = []
    for bit in range(64):
        segment = _mask(bit // _SEGMENT * _SEGMENT, _SEGMENT)
        rest = fp.bitwiseAND(F.lit(segment)).bitwiseAND(F.bitwise_not(F.lit(_mask(bit, 1))))
        out.append(F.xxhash64(F.lit(bit).cast("byte"), rest))
    return F.explode(F.array(*out))


def _near(x: Column, y: Column) -> Column:
    return F.bit_count(x.bitwiseXOR(y)) <= MAX_BITS


def links(nodes: DataFrame, most: int = BUCKET_MOST) -> DataFrame:
    """Edges (a, b) whose closure links all fingerprints at most two bits apart. Takes distinct fingerprints: fp."""
    # Files of nodes are few and small: each fingerprint makes 64 rows, so they are dealt out first.
    nodes = nodes.repartition("fp")
    variants = nodes.select("fp", _variants(F.col("fp")).alias("key"))
    buckets = _shared.settle(variants.groupBy("key").count().where("count > 1"), "buckets")
    # Buckets grow with the corpus: at no size are they broadcast.
    members = _shared.settle(variants.join(buckets.hint("merge"), "key"), "members")
    few = members.where(F.col("count") <= most)
    left, right = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    pairs = left.join(right, (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & _near(F.col("a"), F.col("b"))).select("a", "b")
    crowd = members.where(F.col("count") > most).select("fp").distinct()
    return pairs.unionByName(_stars(crowd)).distinct()


def _stars(crowd: DataFrame) -> DataFrame:
    """Link fingerprints that share a neighbour.

    Each is indexed under itself and the 64 values one bit away. Two share
    such a value exactly if they are at most two bits apart, so all under one
    value are linked by a star to the smallest: no pairs are made.
    """
    around = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_mask(bit, 1))) for bit in range(64)))
    rows = crowd.select("fp", F.explode(around).alias("value"))
    least = _shared.settle(rows.groupBy("value").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("value", "b"), "least")
    return rows.join(least, "value").where("fp <> b").select(F.col("fp").alias("a"), "b")


def near_duplicates(documents: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits) and component_id.

    Fingerprints link at two or fewer differing bits; component_id is the
    smallest doc_id that can be reached. Null and empty texts have the
    fingerprint zero and are linked like any other. Repeated rows repeat in
    the result, other columns don't pass, an empty table gives an empty
    result. Documents without a doc_id have no component of their own: a
    null doc_id takes that of its fingerprint, null if it is alone.
    """
    fps = _shared.settle(fingerprints(documents, **options), "fingerprints")
    nodes = _shared.settle(fps.groupBy("fp").agg(F.min("doc_id").alias("doc")), "nodes")
    found = graph.components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    grouped = _shared.settle(nodes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "grouped")
    least = _shared.settle(grouped.groupBy("component").agg(F.min("doc").alias("component_id")), "components")
    labels = _shared.settle(grouped.join(least, "component").select("fp", "component_id"), "labels")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return fps.join(labels, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, **options) -> DataFrame:
    """One row of each group of near duplicates, with all its columns: that with the smallest doc_id.

    Near duplicates have a five-word similarity of 0.8 or more; the index is
    that of near_texts, and every link is verified. Groups are closed: near
    duplicates of near duplicates belong to them. Rows are told apart by their
    place, so a repeated doc_id is as good as any, and columns may have any
    name. A null doc_id is larger than any other, a null text counts as empty,
    texts without words are near duplicates of each other, and an empty table
    gives an empty result.
    """
    rows, _ = _shared.number_rows(documents.select(F.struct("*").alias("row")), "documents", "row_n")
    texts = rows.select(F.col("row_n").alias("n"), F.col("row.text").alias("text"))
    label = _shared.settle(graph.components(near_texts.links(texts, **options)), "components")
    order = F.struct(F.col("row.doc_id").isNull().alias("no_id"), F.col("row.doc_id"), F.md5(_shared.text_or_empty("row.text")).alias("digest"), F.col("row_n").alias("n"))
    ranked = _shared.settle(rows.select(F.col("row_n").alias("node"), order.alias("place")).join(label, "node"), "ranked")
    least = ranked.groupBy("component").agg(F.min("place")["n"].alias("node"))
    gone = ranked.select("node").join(least, "node", "left_anti")
    return rows.join(gone.withColumnRenamed("node", "row_n"), "row_n", "left_anti").select("row.*")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(_shared.table(spark, sf_dir, "documents"))
