"""Substring deduplication with suffix automata of reference shards.

A window is `window` consecutive words of one document. Every word that lies
in a window whose words also occur in a document with a smaller doc_id goes.

Whole corpora don't fit an automaton, nor may one that grows with the data be
broadcast, so references are narrowed down and dealt out first:

1. Each window picks an anchor, the smallest hash of the word runs inside it.
   Equal windows pick equal anchors, so a window can only recur where its
   anchor recurs in another document. Windows that share an anchor's
   occurrence form one short segment.
2. Segments under recurring anchors are reduced to distinct ones with their
   smallest doc_id and dealt out by anchor. Those of an anchor that occurs
   very often are cut into windows instead, and each window's smallest doc_id
   says what recurs: as exact, and no task gets more than `crowd` segments of
   one anchor.
3. Each partition cuts its segments into reference shards of bounded size and
   streams a shard's documents in order of doc_id: matching statistics
   against the suffix automaton of all earlier documents give the spans that
   recur, then what is new extends the automaton.
4. The spans of all documents with a segment follow from those of its first.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, compress, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import _shared

WINDOW = 13
RUN_WORDS = 5
CROWD = 1024  # occurrences of an anchor, beyond which single windows are dealt out
SHARD_SEGMENTS = 4000


class SuffixAutomaton:
    """All substrings of the sequences added so far."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, sequence: list) -> None:
        last = 0
        for item in sequence:
            last = self._extend(last, item)

    def _extend(self, last: int, item) -> int:
        following, link, length = self.next, self.link, self.length
        if item in following[last]:
            target = following[last][item]
            return target if length[last] + 1 == length[target] else self._clone(last, item, target)
        new = len(length)
        following.append({})
        link.append(0)
        length.append(length[last] + 1)
        state = last
        while state >= 0 and item not in following[state]:
            following[state][item] = new
            state = link[state]
        if state >= 0:
            target = following[state][item]
            link[new] = target if length[state] + 1 == length[target] else self._clone(state, item, target)
        return new

    def _clone(self, state: int, item, target: int) -> int:
        following, link, length = self.next, self.link, self.length
        clone = len(length)
        following.append(dict(following[target]))
        link.append(link[target])
        length.append(length[state] + 1)
        link[target] = clone
        while state >= 0 and following[state].get(item) == target:
            following[state][item] = clone
            state = link[state]
        return clone

    def matches(self, sequence: list) -> list[int]:
        """Matching statistics: for each place, the length of the longest known substring that ends there."""
        following, link, length = self.next, self.link, self.length
        state = known = 0
        out = []
        for item in sequence:
            while state and item not in following[state]:
                state = link[state]
                known = length[state]
            if item in following[state]:
                state = following[state][item]
                known += 1
            out.append(known)
        return out


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


class Windows:
    """The windows of some texts and their anchors, as arrays over all texts' words."""

    def __init__(self, texts: list[str], hashes: _WordHashes, window: int):
        split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        self.words = list(chain.from_iterable(split))
        counts = np.fromiter(map(len, split), np.int64, len(split))
        self.ends = np.cumsum(counts)
        self.begins = self.ends - counts
        n = len(self.words)
        places = max(0, n - window + 1)
        owner = np.repeat(np.arange(len(split)), counts)
        self.owner = owner[:places]
        self.valid = np.arange(places) + window <= self.ends[self.owner]
        word = np.fromiter(map(hashes.__getitem__, self.words), np.uint64, n)
        run = min(RUN_WORDS, window)
        mixed = np.zeros(max(0, n - run + 1), np.uint64)
        for t in range(run):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + word[t : t + len(mixed)]
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        best = mixed[:places].copy()
        at = np.zeros(places, np.int64)
        for t in range(1, window - run + 1):
            other = mixed[t : t + places]
            better = other < best
            best[better] = other[better]
            at[better] = t
        self.anchor = best.view(np.int64)
        self.at = at + np.arange(places)

    def segment_starts(self, chosen: np.ndarray) -> np.ndarray:
        """Of the chosen windows, those that start a segment: another anchor's occurrence, or another text."""
        fresh = chosen.copy()
        same = chosen[1:] & chosen[:-1] & (self.at[1:] == self.at[:-1]) & (self.owner[1:] == self.owner[:-1])
        fresh[1:] &= ~same
        return fresh


def anchors(documents: DataFrame, window: int) -> DataFrame:
    """(anchor, doc_id) for each occurrence of an anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            for part, texts in _shared.slices(batch, "text"):
                w = Windows(texts, hashes, window)
                first = np.flatnonzero(w.segment_starts(w.valid))
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(w.anchor[first]), pa.array(ids[w.owner[first]])], ["anchor", "doc_id"])

    return documents.mapInArrow(run, "anchor bigint, doc_id bigint")


def _segments(documents: DataFrame, window: int) -> DataFrame:
    """Segments under the anchors in `anchors`, and whether theirs is in `crowded`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            for part, texts in _shared.slices(batch, "text"):
                w = Windows(texts, hashes, window)
                wanted, crowded = (part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("anchors", "crowded"))
                chosen = w.valid & np.isin(w.anchor, wanted)
                fresh = w.segment_starts(chosen)
                first = np.flatnonzero(fresh)
                if not len(first):
                    continue
                # Windows of a segment: the chosen ones up to the next that starts another.
                order = np.cumsum(fresh) - 1
                count = np.bincount(order[chosen], minlength=len(first))
                words = w.words
                content = [b" ".join(words[a : a + c + window - 1]) for a, c in zip(first.tolist(), count.tolist(), strict=True)]
                digest = np.fromiter((xxhash.xxh64_intdigest(x, 1) for x in content), np.uint64, len(content)).view(np.int64)
                key, owner = w.anchor[first], w.owner[first]
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                columns = [pa.array(key), pa.array(digest), pa.array(content, pa.binary()), pa.array(ids[owner]), part.column("text_key").take(pa.array(owner)), pa.array((first - w.begins[owner]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(np.isin(key, crowded))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "digest", "content", "doc_id", "text_key", "start", "windows", "crowded"])

    return documents.select("doc_id", "text_key", "text", "anchors", "crowded").mapInArrow(run, "key bigint, digest bigint, content binary, doc_id bigint, text_key bigint, start int, windows int, crowded boolean")


def match_shard(segments: list[tuple], window: int) -> list[int]:
    """For segments (first doc_id, words) in order of doc_id: a bit for each window that an earlier document has."""
    known = SuffixAutomaton()
    out = []
    for _, own in groupby(segments, key=lambda s: s[0]):
        new = []
        for _, words in own:
            mask = sum(1 << i for i, n in enumerate(known.matches(words)[window - 1 :]) if n >= window)
            out.append(mask)
            if mask.bit_count() < len(words) - window + 1:
                new.append(words)
        for words in new:
            known.add(words)
    return out


def _matched(distinct: DataFrame, window: int) -> DataFrame:
    """(key, digest, first, mask, content) of distinct segments, which come sorted by key within partitions.

    Content is null but where segments of a key share a digest.
    """
    names = ["key", "digest", "first", "mask", "content"]

    def unmatched(rows: list[tuple]) -> pa.RecordBatch:
        return batch_of(rows, [0] * len(rows))

    def shard(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[2])
        return batch_of(rows, match_shard([(r[2], r[3].split(b" ")) for r in rows], window))

    def batch_of(rows: list[tuple], masks: list[int]) -> pa.RecordBatch:
        key, digest, first, content = zip(*rows, strict=True)
        times = Counter(zip(key, digest, strict=True))
        shown = [c if times[k, d] > 1 else None for k, d, c in zip(key, digest, content, strict=True)]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (key, digest, first, masks)), pa.array(shown, pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = chain.from_iterable(zip(*(b.column(c).to_pylist() for c in ("key", "digest", "first", "content")), strict=True) for b in batches)
        held: list[tuple] = []
        alone: list[tuple] = []
        for _, group in groupby(rows, key=lambda r: r[0]):
            own = list(group)
            # Windows of one key occur under no other: a single segment has nothing to match.
            (held if len(own) > 1 else alone).extend(own)
            if len(held) >= SHARD_SEGMENTS:
                yield shard(held)
                held = []
            if len(alone) >= SHARD_SEGMENTS:
                yield unmatched(alone)
                alone = []
        if held:
            yield shard(held)
        if alone:
            yield unmatched(alone)

    return distinct.select("key", "digest", "first", "content").mapInArrow(run, "key bigint, digest bigint, first bigint, mask bigint, content binary")


def _matched_by_window(distinct: DataFrame, window: int) -> DataFrame:
    """(key, digest, first, mask, content) of distinct segments of crowded anchors; content as in _matched()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for segment, content, first in zip(*(batch.column(c).to_pylist() for c in ("segment", "content", "first")), strict=True):
                words = content.split(b" ")
                rows += [(segment, first, i, b" ".join(words[i : i + window])) for i in range(len(words) - window + 1)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["segment", "first", "place", "words"])

    numbered = _shared.settle(distinct.select("key", "digest", "content", "first", F.monotonically_increasing_id().alias("segment")), "crowd")
    cut = _shared.settle(numbered.select("segment", "content", "first").mapInArrow(run, "segment bigint, first bigint, place int, words binary"), "windows")
    least = _shared.settle(cut.groupBy("words").agg(F.min("first").alias("low"), F.max("first").alias("high")).where("low < high").select("words", "low"), "least")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place"))
    masks = cut.join(least, "words").where("low < first").groupBy("segment").agg(F.bit_or(bit).alias("mask"))
    alike = numbered.groupBy("key", "digest").agg(F.count("*").alias("times"))
    rows = numbered.join(masks, "segment", "left").join(alike, ["key", "digest"])
    return _shared.settle(rows.select("key", "digest", "first", F.coalesce("mask", F.lit(0).cast("long")).alias("mask"), F.when(F.col("times") > 1, F.col("content")).alias("content")), "crowd-matched")


def _keyed(documents: DataFrame) -> DataFrame:
    text = _shared.text_or_empty()
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def repeats(documents: DataFrame, window: int = WINDOW, crowd: int = CROWD) -> DataFrame:
    """doc_id, text_key, spans: array of (start, mask), each bit of a mask one window that an earlier document has.

    text_key tells rows apart that share a doc_id.
    """
    texts = _keyed(documents).where("doc_id IS NOT NULL")
    found = _shared.settle(anchors(texts.select("doc_id", "text"), window), "anchors")
    shared = found.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low < high")
    shared = _shared.settle(shared.select("anchor", (F.col("n") > crowd).alias("crowded")), "shared")
    own = found.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"), F.collect_set(F.when(F.col("crowded"), F.col("anchor"))).alias("crowded"))
    segments = _shared.settle(_segments(texts.join(own, "doc_id"), window), "segments")
    _shared.discard(found)

    def distinct(of: DataFrame) -> DataFrame:
        return of.groupBy("key", "content").agg(F.min("doc_id").alias("first"), F.first("digest").alias("digest"))

    plain, crowded = segments.where("NOT crowded"), segments.where("crowded")
    matched = _shared.settle(_matched(distinct(plain).repartition("key").sortWithinPartitions("key"), window), "matched")
    if not crowded.isEmpty():
        matched = matched.unionByName(_matched_by_window(distinct(crowded), window))
    everywhere = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("windows")) - 1
    mask = F.when(F.col("doc_id") == F.col("first"), F.col("mask")).otherwise(everywhere)

    def spans(known: DataFrame, *on: str) -> DataFrame:
        rows = segments.select(*on, "doc_id", "text_key", "start", "windows").join(known.select(*on, "first", "mask"), list(on))
        return rows.select("doc_id", "text_key", F.struct("start", mask.alias("mask")).alias("span")).where("span.mask <> 0")

    out = spans(matched.where("content IS NULL"), "key", "digest")
    clash = matched.where("content IS NOT NULL")
    if not clash.isEmpty():  # different segments of a key with the same digest are told apart by their words
        out = out.unionByName(spans(clash, "key", "content"))
    return out.groupBy("doc_id", "text_key").agg(F.collect_set("span").alias("spans"))


def remove_repeats(documents: DataFrame, window: int = WINDOW, crowd: int = CROWD, only_changed: bool = False) -> DataFrame:
    """One row per document: doc_id, text_key, n_words, n_removed and kept, the words that stay joined by one space.

    With only_changed, only documents that lose words are returned.

    Null texts have no words. Rows that repeat a doc_id are one document
    each, but none precedes the other. A row without a doc_id neither loses
    words nor makes others lose any. Other columns don't pass; an empty
    table gives an empty result.
    """
    spans = _shared.settle(repeats(documents, window, crowd), "spans")
    joined = _keyed(documents).join(spans, ["doc_id", "text_key"], "inner" if only_changed else "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _shared.slices(batch, "text"):
                total, removed, kept = [], [], []
                for text, own in zip(texts, part.column("spans"), strict=True):
                    words = text.encode("utf-8", "surrogatepass").split()
                    total.append(len(words))
                    gone = 0
                    if own.is_valid:
                        change = np.zeros(len(words) + 1, np.int64)
                        start = own.values.field("start").to_numpy().astype(np.int64)
                        mask = own.values.field("mask").to_numpy()
                        for bit in range(int(mask.max()).bit_length()):
                            at = start[(mask >> bit & 1) > 0] + bit
                            np.add.at(change, at, 1)
                            np.add.at(change, at + window, -1)
                        stays = np.cumsum(change[:-1]) == 0
                        gone = len(words) - int(stays.sum())
                        words = compress(words, stays.tolist())
                    removed.append(gone)
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "text_key", "n_words", "n_removed", "kept"])

    return joined.select("doc_id", "text_key", "text", "spans").mapInArrow(run, "doc_id bigint, text_key bigint, n_words bigint, n_removed bigint, kept string")


def without_repeats(documents: DataFrame, window: int = WINDOW, crowd: int = CROWD) -> DataFrame:
    """The documents with all their columns; where words go, the text is what stays, joined by one space.

    Texts that lose nothing stay as they are, null included, and so do rows
    without a doc_id. A document that loses all its words stays with an empty
    text. Columns may have any name; none but the text changes, so a column
    of lengths still tells those of before. An empty table gives an empty
    result.
    """
    changed = remove_repeats(documents, window, crowd, only_changed=True).dropDuplicates(["doc_id", "text_key"])
    keyed = documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(_shared.text_or_empty()).alias("own_key"))
    joined = keyed.join(changed, (F.col("own_id") == F.col("doc_id")) & (F.col("own_key") == F.col("text_key")), "left")
    return joined.select(*(F.coalesce("kept", "row.text").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in documents.columns))


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(_shared.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
