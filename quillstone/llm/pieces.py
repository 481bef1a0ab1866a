"""SentencePiece encoding and decoding of whole texts, with the bytes each piece stands for.

A text is normalised first: at every place the longest prefix that the
model's compiled character map knows is replaced, any other character stays.
Which source byte each normalised character begins at is recorded on the
way, so every piece is projected back to a span of the original text. The
normalised text is cut where no piece of the vocabulary could reach across;
each different part is merged once and kept in a cache. Characters without a
piece become their UTF-8 bytes.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import _shared, bpe

MODEL = "piece_bpe_32k.model"
SPACE = "▁"  # stands for a space in pieces
REPLACEMENT = "�"


class CharacterMap:
    """A compiled character map: a double-array trie over UTF-8 prefixes whose values are places in a block of replacements.

    Layout (fixed by the file format): four bytes with the trie's size, the
    trie's 32-bit units, then replacements that end in NUL. In a unit, bits
    0-7 and 31 are the label, bit 8 says that a value follows, bit 9 scales
    the offset in bits 10-30.
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self._units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self._out = blob[4 + size :]
        self._opens: dict[str, bool] = {}

    def _walk(self, data: bytes) -> tuple[int, int, int]:
        """Bytes that the trie follows, bytes of the longest prefix with a replacement, and its value."""
        units = self._units
        unit = units[0]
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        longest = value = seen = 0
        for byte in data:
            node ^= byte
            if node >= len(units) or (units[node] & 0x800000FF) != byte:
                break
            unit = units[node]
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            seen += 1
            if unit & 0x100:
                longest, value = seen, units[node] & 0x7FFFFFFF
        return seen, longest, value

    def opens(self, char: str) -> bool:
        """Whether any replaced prefix begins with this character."""
        known = self._opens.get(char)
        if known is None:
            data = char.encode("utf-8", "surrogatepass")
            known = self._opens[char] = bool(self._units) and self._walk(data)[0] == len(data)
        return known

    def longest(self, text: str, at: int, most: int = 64) -> tuple[int, str] | None:
        """Characters of the longest prefix at this place that has a replacement, and the replacement."""
        data = text[at : at + most].encode("utf-8", "surrogatepass")
        seen, longest, value = self._walk(data)
        if seen == len(data) and at + most < len(text):
            return self.longest(text, at, 2 * most)
        if not longest:
            return None
        return len(data[:longest].decode("utf-8", "surrogatepass")), self._out[value : self._out.index(b"\0", value)].decode("utf-8")


def _widths(points: np.ndarray) -> np.ndarray:
    return 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Model:
    """What a model file says: pieces with their order of merging, bytes, the character map and its options."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        kinds = proto.SentencePiece
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE:
            raise ValueError("only models of merged pairs are read")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces) or proto.denormalizer_spec.precompiled_charsmap or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models with pieces of users' own, unused pieces, maps for decoding or white space as a suffix aren't read")
        spec = proto.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.plain = not spec.precompiled_charsmap and not self.squeeze and self.prefix and self.escape
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)
        self.unknown_surface = proto.trainer_spec.unk_surface
        normal = [(p.score, p.piece, i) for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL]
        order = {score: rank for rank, score in enumerate(sorted({score for score, _, _ in normal}, reverse=True))}
        self.ranks = {piece: order[score] for score, piece, _ in normal}
        self.ids = {piece: i for _, piece, i in normal}
        self.reserved = {p.piece: i for i, p in enumerate(proto.pieces) if p.type != kinds.NORMAL}
        self.byte_ids = [self.reserved[f"<0x{b:02X}>"] for b in range(256)] if proto.trainer_spec.byte_fallback else []
        self.size = len(proto.pieces)
        # By id: characters of a piece in normalised text, what it decodes to, and its byte if it is one.
        self.length = np.zeros(self.size, np.int64)
        self.surface, self.raw = [""] * self.size, [b""] * self.size
        self.byte = np.full(self.size, -1, np.int64)
        for piece, i in self.ids.items():
            self.length[i], self.surface[i] = len(piece), piece.replace(SPACE, " ")
        self.surface[self.unknown] = self.unknown_surface
        self.raw = [s.encode() for s in self.surface]
        for b, i in enumerate(self.byte_ids):
            self.byte[i], self.raw[i] = b, bytes([b])
        self.opened = frozenset(i for piece, i in self.ids.items() if piece.startswith(SPACE))
        self.special = np.ones(self.size, bool)
        self.special[list(self.ids.values())] = False
        # Characters of the vocabulary by number, others are 0, and which of them any piece has side by side.
        chars = sorted({c for piece in self.ids for c in piece})
        self.number = np.zeros(0x110000, np.int32)
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.beside = np.zeros((len(chars) + 1) ** 2, bool)
        self.rows = len(chars) + 1
        pairs = {a + b for piece in self.ids for a, b in pairwise(piece)}
        self.beside[[int(self.number[ord(p[0])]) * self.rows + int(self.number[ord(p[1])]) for p in pairs]] = True

    def encode_part(self, part: str) -> list[int]:
        """Ids of a part of normalised text that is merged by itself."""
        out: list[int] = []
        for a, b in pairwise(bpe.cuts(self.ranks, part)):
            piece = part[a:b]
            i = self.reserved.get(piece, self.ids.get(piece)) if b - a > 1 else self.ids.get(piece)
            if i is not None:
                out.append(i)
            elif self.byte_ids:
                out.extend(self.byte_ids[x] for x in piece.encode("utf-8", "surrogatepass"))
            else:
                out.append(self.unknown)
        return out

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and the source byte at which each of its characters begins, with one more for the end."""
        if self.plain:
            raise AssertionError("plain texts are normalised together")
        space = SPACE if self.escape else " "
        width = _widths(_points(text))
        at_byte = np.append(0, np.cumsum(width)).tolist()
        opening = {c for c in set(text) if self.map.opens(c)}
        out: list[str] = []
        begins: list[int] = []
        at, n = 0, len(text)

        def step(at: int) -> tuple[int, str]:
            found = self.map.longest(text, at) if text[at] in opening else None
            return found or (1, text[at])

        if self.squeeze:
            while at < n:
                taken, new = step(at)
                if new != " ":
                    break
                at += taken
        if at == n:
            return "", np.array([at_byte[at]], np.int64)
        if self.prefix:
            out.append(space)
            begins.append(at_byte[at])
        after_space = self.squeeze
        while at < n:
            taken, new = step(at)
            if after_space:
                new = new.lstrip(" ")
            if new:
                out.append(new.replace(" ", space))
                begins.extend([at_byte[at]] * len(new))
                if self.squeeze:
                    after_space = new.endswith(" ")
            at += taken
        end, joined = at_byte[n], "".join(out)
        if self.squeeze:
            kept = len(joined.rstrip(space))
            if kept < len(joined):
                end, joined = begins[kept], joined[:kept]
        return joined, np.array([*begins[: len(joined)], end], np.int64)

    def normalise_all(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
        """All normalised texts as one, where each begins in it and its end, and the source bytes of all texts, one more than characters for each text."""
        if self.plain:
            # The space before each text has no width; its byte is the first of the text.
            joined = "".join(" " + t if t else "" for t in texts)
            size = np.fromiter((len(t) + 1 if t else 0 for t in texts), np.int64, len(texts))
            first = np.append(0, np.cumsum(size))
            width = _widths(_points(joined))
            width[first[:-1][size > 0]] = 0
            sums = np.append(0, np.cumsum(width))
            number = np.repeat(np.arange(len(texts)), size + 1)
            begins = sums[np.arange(len(number)) - number] - sums[first[number]]
            return joined.replace(" ", SPACE), first, begins
        done = [self.normalise(t) for t in texts]
        first = np.append(0, np.cumsum([len(t) for t, _ in done]).astype(np.int64)) if done else np.zeros(1, np.int64)
        return "".join(t for t, _ in done), first, np.concatenate([b for _, b in done]) if done else np.zeros(0, np.int64)

    def parts(self, joined: str, first: np.ndarray) -> np.ndarray:
        """Where the parts begin that are merged by themselves: no piece has the two characters at a cut side by side, so none reaches across."""
        opens = np.zeros(len(joined) + 1, bool)
        opens[first] = True
        if joined:
            number = self.number[_points(joined)]
            opens[1:-1] |= ~self.beside[number[:-1] * self.rows + number[1:]]
        return np.flatnonzero(opens[:-1])

    def encode_flat(self, texts: list[str], cache: bpe.Cache) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, how many come before each text and in all, and the source bytes at which each piece begins and ends."""
        joined, first, begins = self.normalise_all(texts)
        places = self.parts(joined, first)
        ids, before_part = bpe.encode_pieces(joined, places, cache)
        ids = ids.astype(np.int64)
        before = before_part[np.searchsorted(places, first)] if len(places) else np.zeros(len(texts) + 1, np.int64)
        # Characters that each piece takes: the last byte of a character takes it, the bytes before take none.
        byte = self.byte[ids]
        following = np.append(byte[1:], -1)
        takes = np.where(byte >= 0, (following < 0x80) | (following >= 0xC0), self.length[ids])
        takes[ids == self.unknown] = 1
        stop = np.cumsum(takes)
        owner = np.repeat(np.arange(len(texts)), np.diff(before))
        starts, ends = begins[stop - takes + owner], begins[stop + owner]
        if not self.byte_ids and len(ids):
            # Without bytes, unknown characters in a row are one piece.
            again = np.append(False, (ids[1:] == self.unknown) & (ids[:-1] == self.unknown) & (owner[1:] == owner[:-1]))
            keep = np.flatnonzero(~again)
            last = np.append(keep[1:], len(ids)) - 1
            ids, starts, ends = ids[keep], starts[keep], ends[last]
            before = np.searchsorted(keep, before)
        return ids, before, starts, ends

    def decode(self, ids: list[int]) -> str:
        """The text that ids stand for. Bytes that aren't UTF-8 become U+FFFD each."""
        if ids and ids[0] in self.opened and (self.prefix or self.squeeze) and not self.squeeze:
            try:
                return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8")[1:]
            except UnicodeDecodeError:
                pass
        out: list[str] = []
        run = bytearray()
        start, stripped = True, False

        def flush() -> None:
            at = 0
            while at < len(run):
                lead = run[at]
                size = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
                try:
                    out.append(bytes(run[at : at + size]).decode("utf-8") if size else REPLACEMENT)
                    at += size or 1
                except UnicodeDecodeError:
                    out.append(REPLACEMENT)
                    at += 1
            run.clear()

        for i in ids:
            if self.byte[i] >= 0:
                run.append(int(self.byte[i]))
                continue
            flush()
            if stripped or any(out):
                start = False
            stripped = False
            text = self.surface[i]
            if start and i in self.opened and (self.prefix or self.squeeze):
                text = text[1:]
                stripped = not self.squeeze
            out.append(text)
        flush()
        return "".join(out)


@lru_cache(maxsize=4)
def load_model(path: str) -> Model:
    return Model(path)


def part_cache(model: Model) -> bpe.Cache:
    return bpe.Cache(lambda part: array("I", model.encode_part(part)))


def encode(documents: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text as the sentencepiece library does, without begin or end ids.

    Returns key, n_tokens long, ids array<int>, and begins and ends
    array<int>: the bytes of the original UTF-8 text that each piece stands
    for. Pieces of a text cover it in order; of a character in bytes the
    last one has the span and those before are empty, as is a piece that is
    only the space put before a text. A null text counts as empty; an empty
    text has no ids. An empty table gives no rows. Very long texts are
    encoded whole, one at a time (n log n steps where no space cuts them).
    Rows are kept as they are, repeats and null keys included; other columns
    don't pass, so their names may clash.
    """
    path = path or public_tokenizers.path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(path)
        cache = part_cache(model)
        for batch in batches:
            for part, texts in _shared.slices(batch, "t"):
                ids, before, starts, ends = model.encode_flat(texts, cache)
                offsets = pa.array(before, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (ids, starts, ends)]
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(np.diff(before), pa.int64()), *lists], ["k", "n_tokens", "ids", "begins", "ends"])

    kind = documents.schema[key].dataType.simpleString()
    out = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, n_tokens bigint, ids array<int>, begins array<int>, ends array<int>")
    return out.withColumnRenamed("k", key)


def decode(encoded: DataFrame, path: str | None = None, key: str = "doc_id") -> DataFrame:
    """The texts that ids stand for. Takes key, n_tokens and ids as encode() returns them; adds decoded string. Null ids count as none; ids outside the vocabulary are an error."""
    path = path or public_tokenizers.path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [model.decode(x or []) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("k", "n_tokens", "ids")), pa.array(texts, pa.string())], ["k", "n_tokens", "ids", "decoded"])

    kind = encoded.schema[key].dataType.simpleString()
    out = encoded.select(F.col(key).alias("k"), "n_tokens", "ids").mapInArrow(run, f"k {kind}, n_tokens bigint, ids array<int>, decoded string")
    return out.withColumnRenamed("k", key)


def op13_sentencepiece(spark, sf_dir: str) -> DataFrame:
    documents = _shared.table(spark, sf_dir, "documents")
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decode(encode(documents)).select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
