"""Best-fit packing of tokenised documents by a linear grouping scheme.

Only the number of pieces of each length matters for a plan, and a plan has
at most `capacity` lengths to deal with, whatever the corpus. So the driver
gets a histogram and solves that: large lengths are sorted into groups of
equal cardinality and rounded up to the largest of their group; the few
rounded sizes are packed by configurations whose multiplicities come from a
linear programme (column generation); real lengths replace the rounded ones;
what is left over and all small lengths fill the gaps best-fit. The plan says,
for ranges of ranks within each length, which sequence and offset they get.
Executors rank the pieces and look theirs up.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import _shared, bpe

VOCABULARY = "byte_bpe_50k.json"
CAPACITY = 1024
END_ID = 2
GROUPS = 400
SMALL_SHARE = 3  # lengths up to capacity / SMALL_SHARE are small


# --- tokens ---------------------------------------------------------------


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte in the vocabulary's entries."""
    from tokenizers.pre_tokenizers import ByteLevel

    plain = [b for b in range(256) if chr(b).isprintable() and b != 0x20 and b != 0xAD]
    table = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
    assert set(table.values()) == set(ByteLevel.alphabet())
    return table


@lru_cache(maxsize=2)
def library_encoder(path: str):
    """Ids of one pre-token by the tokenizers library's model; its own byte alphabet is applied here.

    The library splits by the same pattern before its model sees a piece, so
    encoding the pieces of pretokens.boundaries() gives the ids of the text.
    """
    from tokenizers import Tokenizer

    model, table = Tokenizer.from_file(path).model, byte_alphabet()

    def ids(piece: str) -> list[int]:
        return [t.id for t in model.tokenize(piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(table))]

    return ids


def library_cache(path: str) -> bpe.Cache:
    return bpe.Cache(library_encoder(path))


def token_bytes(path: str, texts: list[str], cache: bpe.Cache) -> list[bytes]:
    """Ids of each text with the end id, as little-endian unsigned 32-bit integers."""
    end = END_ID.to_bytes(4, "little")
    return [ids + end for ids in bpe.encode_texts(texts, cache)[0]]


def narrowed(ids: bytes, width: int) -> bytes:
    """Ids of four bytes in so many bytes each; an error if one doesn't fit."""
    if width == 4:
        return ids
    wide = np.frombuffer(ids, "<u4")
    if len(wide) and int(wide.max()) >> 8 * width:
        raise ValueError(f"id {wide.max()} doesn't fit in {width} bytes")
    return wide.astype(f"<u{width}").tobytes()


def cut(n_tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: whole if it fits, else pieces of the capacity of which the first may be shorter."""
    first = n_tokens if n_tokens <= capacity else n_tokens % capacity or capacity
    return [(0, first)] + [(start, capacity) for start in range(first, n_tokens, capacity)]


def pieces(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, id_bytes: int = 4) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece, and its ids (binary, id_bytes each) if asked for.

    A null or empty text is one piece that holds the end id alone.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = library_cache(path)
        for batch in batches:
            for part, texts in _shared.slices(batch, "text"):
                rows, owner = [], []
                for i, ids in enumerate(token_bytes(path, texts, cache)):
                    narrow = narrowed(ids, id_bytes) if with_ids else b""
                    for number, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        rows.append((number, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), narrow[id_bytes * start : id_bytes * (start + length)]))
                        owner.append(i)
                number, start, length, crc, own = zip(*rows, strict=True)
                columns = [part.column("doc_id").take(pa.array(owner)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(own, pa.binary())] if with_ids else []), names)

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return documents.select("doc_id", "text").mapInArrow(run, schema)


# --- the plan -------------------------------------------------------------


@dataclass
class Bins:
    """So many sequences filled alike: slots are (length, how many)."""

    count: int
    slots: list[tuple[int, int]]


def group_large(large: list[tuple[int, int]], groups: int) -> list[tuple[int, list[list[int]]]]:
    """Lengths with counts, longest first, in groups of equal cardinality: (rounded length, [[length, count], ...])."""
    total = sum(c for _, c in large)
    per_group = max(1, -(-total // groups))
    out: list[tuple[int, list[list[int]]]] = []
    room = 0
    for length, count in large:
        while count:
            if not room:
                out.append((length, []))
                room = per_group
            n = min(room, count)
            out[-1][1].append([length, n])
            room -= n
            count -= n
    return out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Fractional packing of few sizes: configurations and their multiplicities, by column generation."""
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(40 * m):  # a safeguard: after so many rounds the configurations are valid still, only fewer
        amount = np.linalg.solve(basis, demand)
        price = np.linalg.solve(basis.T, np.ones(m))
        column, value = _best_configuration(sizes, price, capacity)
        if value <= 1 + 1e-9:
            break
        direction = np.linalg.solve(basis, column)
        ratio = np.full(m, np.inf)
        up = direction > 1e-9
        ratio[up] = np.maximum(amount[up], 0) / direction[up]
        basis[:, int(np.argmin(ratio))] = column
    amount = np.linalg.solve(basis, demand)
    return [(basis[:, k].round().astype(int), float(amount[k])) for k in range(m) if amount[k] > 1e-9]


def _best_configuration(sizes: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The configuration of the highest price: unbounded knapsack, one more item a round."""
    best = np.zeros(capacity + 1)
    rounds = []
    for _ in range(capacity // int(sizes.min())):
        more = np.full((len(sizes), capacity + 1), -np.inf)
        for i, size in enumerate(sizes):
            more[i, size:] = best[: capacity + 1 - size] + price[i]
        choice = more.argmax(0)
        new = more[choice, np.arange(capacity + 1)]
        took = new > best + 1e-12
        rounds.append(np.where(took, choice, -1))
        best = np.where(took, new, best)
    column, at = np.zeros(len(sizes)), capacity
    for choice in reversed(rounds):
        if choice[at] >= 0:
            column[choice[at]] += 1
            at -= int(sizes[choice[at]])
    return column, float(price @ column)


def substitute(groups: list[tuple[int, list[list[int]]]], chosen: list[tuple[np.ndarray, int]]) -> list[Bins]:
    """Fill configurations with real lengths; uses up the runs of each group, longest first."""
    out = []
    for column, count in chosen:
        slots = [g for g, k in enumerate(column) for _ in range(int(k))]
        while count:
            # Slots of one group take from the same run if it lasts, so that sequences are filled alike.
            wanted = {g: slots.count(g) for g in set(slots)}
            n = min([count, *(groups[g][1][0][1] // k for g, k in wanted.items())])
            if n:
                taken = [(groups[g][1][0][0], k) for g, k in sorted(wanted.items())]
                for g, k in wanted.items():
                    _take(groups[g][1], k * n)
            else:
                n, taken = 1, []
                for g in sorted(slots):
                    taken.append((groups[g][1][0][0], 1))
                    _take(groups[g][1], 1)
            out.append(Bins(n, taken))
            count -= n
    return out


def _take(runs: list[list[int]], n: int) -> None:
    runs[0][1] -= n
    if not runs[0][1]:
        runs.pop(0)


def best_fit(bins: list[Bins], items: list[tuple[int, int]], capacity: int) -> list[Bins]:
    """Put each length, longest first, where the least room stays; open sequences where none fits."""
    by_room: dict[int, list[Bins]] = defaultdict(list)
    for b in bins:
        by_room[capacity - sum(length * k for length, k in b.slots)].append(b)
    for length, count in sorted(items, reverse=True):
        room = length
        while count:
            while room <= capacity and not by_room.get(room):
                room += 1
            if room > capacity:
                each = capacity // length
                if full := count // each:
                    by_room[capacity - each * length].append(Bins(full, [(length, each)]))
                if rest := count % each:
                    by_room[capacity - rest * length].append(Bins(1, [(length, rest)]))
                break
            old = by_room[room].pop()
            each = min(room // length, count)
            n = min(old.count, count // each)
            if n < old.count:
                by_room[room].append(Bins(old.count - n, list(old.slots)))
            by_room[room - each * length].append(Bins(n, [*old.slots, (length, each)]))
            count -= n * each
            room = max(length, min(room, room - each * length))
    return [b for row in by_room.values() for b in row]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[Bins]:
    """Sequences for so many pieces of each length."""
    whole = [Bins(histogram[capacity], [(capacity, 1)])] if histogram.get(capacity) else []
    lengths = sorted(((x, c) for x, c in histogram.items() if x < capacity and c), reverse=True)
    small = [(x, c) for x, c in lengths if x * SMALL_SHARE <= capacity]
    grouped = group_large(lengths[: len(lengths) - len(small)], groups)
    bins: list[Bins] = []
    if grouped:
        rounded: dict[int, list[list[int]]] = defaultdict(list)
        for size, runs in grouped:
            rounded[size] += runs
        merged = sorted(rounded.items(), reverse=True)
        sizes = np.array([s for s, _ in merged])
        demand = np.array([sum(c for _, c in runs) for _, runs in merged], float)
        chosen = [(column, int(x + 1e-9)) for column, x in configurations(sizes, demand, capacity)]
        bins = substitute(merged, chosen)
        small += [(length, count) for _, runs in merged for length, count in runs]
    counted: dict[int, int] = defaultdict(int)
    for length, count in small:
        counted[length] += count
    return whole + best_fit(bins, list(counted.items()), capacity)


def places(bins: list[Bins]) -> dict[str, np.ndarray]:
    """For each length, from which rank on which sequences and offset: sorted by (length, rank)."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for b in bins:
        offset = 0
        for length, k in b.slots:
            for _ in range(k):
                rows.append((length, used[length], sequence, offset))
                used[length] += b.count
                offset += length
        sequence += b.count
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"key": (table[:, 0] << 48) + table[:, 1], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


# --- all pieces -----------------------------------------------------------


def pack(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pack all documents into sequences of at most `capacity` tokens.

    Returns for each piece doc_id, piece, start, length, ids_crc32,
    sequence_id and offset, gapless from 0 in each sequence. A document is
    its ids and the end id; only longer ones are cut. Null and empty texts
    are the end id alone; repeated rows are packed as often as they occur;
    an empty table gives an empty result; other columns don't pass.
    """
    cut_up = _shared.settle(pieces(documents, path, capacity), "pieces")
    # Sorted by length, a partition holds few lengths, so all its counts are few.
    ordered = cut_up.repartitionByRange("length", "doc_id", "piece").sortWithinPartitions("length", "doc_id", "piece")
    ordered = _shared.settle(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("at", 33)
    counts = ordered.groupBy(part.alias("part"), "length").agg(F.min("at").alias("first"), F.count("*").alias("n")).orderBy("length", "part").collect()
    histogram: dict[int, int] = defaultdict(int)
    firsts = []
    for row in counts:  # as many as there are partitions and lengths
        firsts.append((row["part"], row["length"], row["first"] - histogram[row["length"]]))
        histogram[row["length"]] += row["n"]
    table = places(plan(dict(histogram), capacity))
    firsts.sort()
    base_key = np.array([(p << 16) + length for p, length, _ in firsts], np.int64)
    base = np.array([b for *_, b in firsts], np.int64)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at, length = batch.column("at").to_numpy(), batch.column("length").to_numpy()
            rank = at - base[np.searchsorted(base_key, ((at >> 33) << 16) + length)]
            row = np.searchsorted(table["key"], (length << 48) + rank, "right") - 1
            sequence = table["sequence"][row] + rank - table["rank"][row]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(table["offset"][row])], [*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kind = documents.schema["doc_id"].dataType.simpleString()
    return ordered.mapInArrow(assign, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(_shared.table(spark, sf_dir, "documents"))
