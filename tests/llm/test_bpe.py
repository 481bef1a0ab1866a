import hashlib
import random

import numpy as np
import public_tokenizers
import regex
import tiktoken
from tokenizers import Regex, pre_tokenizers

from quillstone.llm import bpe, pretokens

PATH = public_tokenizers.path(bpe.RANKS)


def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def odd_texts(n=3000):
    rng = random.Random(1)
    letters = "ab'sretvlmd 12\n\t é!?　 '  ½中́"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(n)] + ["", "'", "'s", " ", "  ", "\n", "a\n\nb", "x" * 3000, "é!" * 900, "it's we'll they've I'm he'd x're", "<|endoftext|>"]


def test_boundaries_are_those_of_the_pattern():
    texts = odd_texts()
    assert pretokens.split(texts) == [regex.findall(public_tokenizers.PATTERN, t) for t in texts]
    assert pretokens.split([]) == [] and pretokens.split(["", ""]) == [[], []]


def test_ids_are_those_of_the_library():
    texts, reference = odd_texts(), library()
    ids, _, _ = bpe.encode_texts(texts, bpe.rank_cache(PATH))
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [reference.encode_ordinary(t) for t in texts]


def test_a_small_cache_gives_the_same():
    texts = odd_texts(300)
    small = bpe.Cache(lambda p: bpe.merge(bpe.load_ranks(PATH), p.encode()), most=5, longest=4)
    assert bpe.encode_texts(texts, small)[0] == bpe.encode_texts(texts, bpe.rank_cache(PATH))[0]


def test_documents_round_trip(spark):
    texts = [None, *odd_texts(200), "wörter und words " * 20_000]
    rows = [(i, t, "ids", 1) for i, t in enumerate(texts)] + [(0, None, "ids", 1), (None, "no id", "ids", 1)]
    encoded = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int"))
    reference = library()
    for r in bpe.decode(encoded).collect():
        text = ("no id" if r.doc_id is None else texts[r.doc_id]) or ""
        assert r.decoded == text.encode() and r.n_tokens * 4 == len(r.ids)
        assert np.frombuffer(r.ids, "<u4").tolist() == reference.encode_ordinary(text)
    starts = {r.doc_id: np.frombuffer(r.piece_starts, "<u4").tolist() for r in encoded.collect()}
    for i, text in enumerate(texts):
        assert starts[i] == [m.start() for m in regex.finditer(public_tokenizers.PATTERN, text or "")]
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_digests(spark, sf_dir):
    found = bpe.op8_byte_bpe(spark, sf_dir).collect()
    reference = library()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert len(found) == len(texts)
    for r in found:
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_every_code_point_as_the_libraries_have_it():
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    texts = ["".join(f"{c}'s {c}{c}'LL 1{c}" for c in map(chr, points[i : i + 2000])) for i in range(0, len(points), 2000)]
    ids, _, _ = bpe.encode_texts(texts, bpe.rank_cache(PATH))
    reference = library()
    assert all(np.frombuffer(x, "<u4").tolist() == reference.encode_ordinary(t) for x, t in zip(ids, texts, strict=True))
    every, kinds = "".join(map(chr, points)), pretokens._kinds()
    for pattern, kind in ((r"\p{L}+", pretokens.LETTER), (r"\p{N}+", pretokens.NUMBER), (r"\s+", pretokens.SPACE)):
        runs = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every)
        assert {ord(c) for piece, _ in runs for c in piece} == set(np.flatnonzero(kinds == kind).tolist())


def test_pieces_of_equal_beginnings_and_lengths():
    rng = random.Random(4)
    words = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 22))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(50)) for _ in range(400)] + ["é" * 7, "é" * 8, "é" * 9, "\x00", "\x00\x00"]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_texts(texts, bpe.rank_cache(PATH))[0]] == [library().encode_ordinary(t) for t in texts]
