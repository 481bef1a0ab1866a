"""Cross-tokenizer alignment by byte-owner arrays.

Both tokenizers cover the same bytes. Each token's number is repeated over
its bytes, once for either tokenizer; where an owner changes a new pair of
owners begins, and these pairs are the overlaps. Where both change at once
the text is cut into groups. Owners are made for whole slices of documents.

How many documents hold a pair of ids linked is counted over the corpus.
Documents are aligned in slices of a bounded number of characters; a slice's
distinct pairs are what leaves it, get their corpus-wide counts by an equality
join, and come back to the slice's documents, which are grouped by slice.
Nothing is broadcast but by Spark itself, and no row holds more than a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import _shared, bpe, packing, pieces

VOCABULARY = packing.VOCABULARY
_A = 32  # a pair is the id of A above so many bits, and that of B below


@lru_cache(maxsize=2)
def _bytes_of_a(path: str) -> list[bytes]:
    from tokenizers import Tokenizer

    back = {char: byte for byte, char in packing.byte_alphabet().items()}
    vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values()) + 1)
    for entry, i in vocabulary.items():
        out[i] = bytes(back[c] for c in entry) if all(c in back for c in entry) else entry.encode()
    return out


def _lengths(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, tokens), np.int64, len(tokens))


class Aligner:
    """Aligns slices of texts. `space` goes before each text for A; B's model adds its own."""

    def __init__(self, path_a: str, path_b: str):
        self.cache_a = packing.library_cache(path_a)
        self.model_b = pieces.load_model(path_b)
        self.cache_b = pieces.part_cache(self.model_b)
        self.bytes_a, self.bytes_b = _bytes_of_a(path_a), self.model_b.raw
        self.length_a, self.length_b = _lengths(self.bytes_a), _lengths(self.bytes_b)
        names_a, names_b = [str(i) for i in range(len(self.bytes_a))], [str(i) for i in range(len(self.bytes_b))]
        # A token inside its side of a group, the last of A's side, the last of a group.
        self.names = [x + end for names in (names_a, names_b) for end in ",|;" for x in names]
        self.base = {"a": 0, "b": 3 * len(names_a)}

    def _agree(self, texts: list[str], flat: np.ndarray, before: np.ndarray, tokens: list[bytes]) -> np.ndarray:
        """For each text, whether the tokens' bytes are a space and the text."""
        ids, cut = flat.tolist(), before.tolist()
        look = tokens.__getitem__
        if b"".join(map(look, ids)) == "".join(f" {t}" for t in texts).encode("utf-8", "surrogatepass"):
            sizes = _lengths(tokens)[flat]
            ends = np.append(0, np.cumsum(sizes))[before]
            wanted = np.fromiter((len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts), np.int64, len(texts))
            return np.diff(ends) == wanted
        return np.fromiter((b"".join(map(look, ids[a:b])) == b" " + t.encode("utf-8", "surrogatepass") for t, a, b in zip(texts, cut, cut[1:], strict=False)), bool, len(texts))

    def align(self, texts: list[str]) -> dict[str, np.ndarray | list]:
        """By text: n_a, n_b, n_groups, n_links, groups; of all texts in order: link_a and link_b, ids of linked tokens, cut by n_links."""
        used = [t for t in texts if t]
        a, before_a, _, _ = bpe.encode_flat([" " + t for t in used], self.cache_a)
        b, before_b, _, _ = self.model_b.encode_flat(used, self.cache_b)
        a = a.astype(np.int64)
        good = self._agree(used, a, before_a, self.bytes_a) & self._agree(used, b, before_b, self.bytes_b)
        if not good.all():
            a, before_a = _only(a, before_a, good)
            b, before_b = _only(b, before_b, good)
        size_a, size_b = self.length_a[a], self.length_b[b]
        owner_a = np.repeat(np.arange(len(a), dtype=np.int32), size_a)
        owner_b = np.repeat(np.arange(len(b), dtype=np.int32), size_b)
        change_a, change_b = np.ones(len(owner_a), bool), np.ones(len(owner_b), bool)
        change_a[1:], change_b[1:] = owner_a[1:] != owner_a[:-1], owner_b[1:] != owner_b[:-1]
        at = np.flatnonzero(change_a | change_b)
        link_a, link_b = owner_a[at], owner_b[at]
        cuts = np.flatnonzero(change_a & change_b)
        open_a, open_b = owner_a[cuts].astype(np.int64), owner_b[cuts].astype(np.int64)  # first tokens of groups
        text_begin = np.append(0, np.cumsum(size_a))[before_a]
        links, groups = np.searchsorted(at, text_begin), np.searchsorted(cuts, text_begin)
        # Tokens in the order in which groups name them: A's side of a group, then B's.
        many_a, many_b = np.diff(np.append(open_a, len(a))), np.diff(np.append(open_b, len(b)))
        begin = open_a + open_b
        place_a = np.arange(len(a)) + np.repeat(open_b, many_a)
        place_b = np.arange(len(b)) + np.repeat(open_a + many_a, many_b)
        named = np.empty(len(a) + len(b), np.int64)
        named[place_a], named[place_b] = a, self.base["b"] + b
        named[begin + many_a - 1] += len(self.bytes_a)
        named[begin + many_a + many_b - 1] += 2 * len(self.bytes_b)
        words, look = named.tolist(), self.names.__getitem__
        limits = (before_a + before_b).tolist()
        texts_of = ["".join(map(look, words[i:j]))[:-1] for i, j in zip(limits, limits[1:], strict=False)]

        def spread(values, zero):
            found = iter(values)
            return [next(found) if t else zero for t in texts]

        return {
            "n_a": spread(np.diff(before_a).tolist(), 0),
            "n_b": spread(np.diff(before_b).tolist(), 0),
            "n_groups": spread(np.diff(groups).tolist(), 0),
            "n_links": spread(np.diff(links).tolist(), 0),
            "groups": spread(texts_of, ""),
            "link_a": a[link_a],
            "link_b": b[link_b],
        }


def _only(flat: np.ndarray, before: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the texts that are good; the others have none."""
    sizes = np.diff(before)
    return flat[np.repeat(good, sizes)], np.append(0, np.cumsum(np.where(good, sizes, 0)))


def _distinct(pairs: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of each text in ascending order, how often each occurs there, and how many each text has before it and in all."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((pairs, text))
    pairs, text = pairs[order], text[order]
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[1:] != pairs[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return pairs[at], np.diff(np.append(at, len(pairs))), np.searchsorted(text[at], np.arange(len(sizes) + 1))


def align(documents: DataFrame, path_a: str | None = None, path_b: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Align two tokenizers on every whole text: A on a space and the text, B on the text, whose model adds the space.

    Returns key, slice long (documents aligned together share it), n_a, n_b,
    n_groups, n_links long, groups string (`a1,a2|b1;a3|b2,b3`), pairs
    array<long> (distinct linked ids, A's above 32 bits) and times array<int>
    (links of each). Null and empty texts have no tokens, nor have texts that
    either tokenizer doesn't give back byte by byte. Special tokens' strings
    are plain text. Very long texts are aligned whole, one at a time. Rows
    are kept as they are, repeats and null keys included; other columns don't
    pass. An empty table gives no rows.
    """
    path_a, path_b = path_a or public_tokenizers.path(VOCABULARY), path_b or public_tokenizers.path(pieces.MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part, texts in _shared.slices(batch, "t"):
                found = aligner.align(texts)
                sizes = np.array(found["n_links"], np.int64)
                pairs, times, before = _distinct((found["link_a"] << _A) + found["link_b"], sizes)
                offsets = pa.array(before, pa.int32())
                longs = [pa.array(x, pa.int64()) for x in ([number] * len(texts), found["n_a"], found["n_b"], found["n_groups"], found["n_links"])]
                lists = [pa.ListArray.from_arrays(offsets, pa.array(pairs, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column("k"), *longs, pa.array(found["groups"], pa.string()), *lists], ["k", "slice", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])
                number += 1

    kind = documents.schema[key].dataType.simpleString()
    schema = f"k {kind}, slice bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs array<bigint>, times array<int>"
    return documents.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, schema).withColumnRenamed("k", key)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, documents, best: how many rows of align() hold each pair, and whether no pair of its A id has more (ties included)."""
    return _ranked(_pairs_of_slices(aligned))


def _pairs_of_slices(aligned: DataFrame) -> DataFrame:
    return aligned.select("slice", F.explode("pairs").alias("pair")).groupBy("slice", "pair").agg(F.count("*").alias("held"))


def _ranked(pairs: DataFrame) -> DataFrame:
    counts = pairs.groupBy("pair").agg(F.sum("held").alias("documents")).withColumn("a", F.shiftright("pair", _A))
    most = counts.groupBy("a").agg(F.max("documents").alias("most"))
    return counts.join(most, "a").select("pair", "documents", (F.col("documents") == F.col("most")).alias("best"))


def score(aligned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add n_best, links whose pair has its A id's highest count, and count_sum, the counts of all links. Takes a settled result of align(), which is read twice."""
    pairs = _shared.settle(_pairs_of_slices(aligned), "align-pairs")
    counted = pairs.join(_ranked(pairs), "pair").select("slice", "pair", "documents", "best")
    names = [c for c in aligned.columns if c not in ("slice", "pairs", "times")]
    left = aligned.select("slice", *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), "pairs", "times")
    kinds = ", ".join(f"c{i} {aligned.schema[c].dataType.simpleString()}" for i, c in enumerate(names))

    def add(documents: pa.Table, counts: pa.Table) -> pa.Table:
        known = counts.column("pair").to_numpy()
        order = np.argsort(known)
        known, held, best = known[order], counts.column("documents").to_numpy()[order], counts.column("best").to_numpy()[order]
        kept = documents.select([f"c{i}" for i in range(len(names))])
        pair_lists, time_lists = documents.column("pairs").combine_chunks(), documents.column("times").combine_chunks()
        lists = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (pair_lists, time_lists)] if documents.num_rows else []
        sums = np.zeros((2, documents.num_rows), np.int64)
        if documents.num_rows and len(known):
            sizes = np.asarray(lists[0].value_lengths())
            at = np.searchsorted(known, lists[0].flatten().to_numpy())
            times = lists[1].flatten().to_numpy().astype(np.int64)
            before = np.append(0, np.cumsum(sizes))
            for i, weight in enumerate((times * best[at], times * held[at])):
                sums[i] = np.diff(np.append(0, np.cumsum(weight))[before])
        return kept.append_column("n_best", pa.array(sums[0], pa.int64())).append_column("count_sum", pa.array(sums[1], pa.int64()))

    out = left.groupBy("slice").cogroup(counted.groupBy("slice")).applyInArrow(add, f"{kinds}, n_best bigint, count_sum bigint")
    return out.toDF(*names, "n_best", "count_sum")


def op11_cross_tokenizer(spark, sf_dir: str) -> DataFrame:
    aligned = align(_shared.table(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    settled = _shared.settle(aligned.select("doc_id", "slice", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times"), "aligned")
    return score(settled).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
