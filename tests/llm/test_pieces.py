import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from quillstone.llm import bpe, pieces

PATH = public_tokenizers.path(pieces.MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def odd_texts(n=2000, letters="ab  hello ▁ é①🙂中\n\t12'ſ"):
    rng = random.Random(1)
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(n)] + ["", " ", "   ", "▁", "▁▁▁▁▁", " " * 300, "x" * 3000, "é①" * 900, "<s></s><unk><0x41>", "a\0b", "", " "]


def compared_with_library(path, texts):
    library, model = sentencepiece.SentencePieceProcessor(model_file=path), pieces.load_model(path)
    ids, before, starts, ends = model.encode_flat(texts, pieces.part_cache(model))
    for i, text in enumerate(texts):
        own = slice(before[i], before[i + 1])
        expected = list(library.encode(text, return_type="proto").pieces) if text else []
        assert ids[own].tolist() == [p.id for p in expected], text
        spans = [(p.begin, p.end) for p in expected]
        assert list(zip(starts[own].tolist(), ends[own].tolist(), strict=True)) == spans, (text, spans)
        assert model.decode(ids[own].tolist()) == library.decode([p.id for p in expected]), text



def test_ids_spans_and_texts_are_those_of_the_library():
    compared_with_library(PATH, odd_texts())


@pytest.mark.parametrize("squeeze,prefix,fallback", [(True, True, True), (False, True, False), (True, False, True), (False, False, True)])
def test_a_model_with_a_character_map(tmp_path, squeeze, prefix, fallback):
    rules = sentencepiece_model_pb2.ModelProto()
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(PATH, "rb").read())
    proto.normalizer_spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.remove_extra_whitespaces, proto.normalizer_spec.add_dummy_prefix = squeeze, prefix
    if not fallback:
        proto.trainer_spec.byte_fallback = False
        for piece in proto.pieces:
            if piece.type == piece.BYTE:
                piece.type = piece.CONTROL
    path = tmp_path / "own.model"
    path.write_bytes(proto.SerializeToString())
    compared_with_library(str(path), odd_texts(1000, "ﬁ①½ Ａｂ　  éä​ﬁ한글한 x①▁‥\n\t­"))


def test_any_ids_decode_as_in_the_library():
    rng, model = random.Random(2), pieces.load_model(PATH)
    for _ in range(3000):
        ids = [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(262) for _ in range(rng.randrange(12))]
        assert model.decode(ids) == LIBRARY.decode(ids), ids


def test_a_small_cache_gives_the_same():
    texts, model = odd_texts(300), pieces.load_model(PATH)
    small = bpe.Cache(model.encode_part, most=5, longest=4)
    assert np.array_equal(model.encode_flat(texts, small)[0], model.encode_flat(texts, pieces.part_cache(model))[0])


def test_documents_round_trip(spark):
    texts = [None, *odd_texts(200), "wörter und words " * 20_000, "漢字" * 20_000]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(0, None, "x", 1), (None, "no id", "x", 1)]
    encoded = pieces.encode(spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int"))
    found = encoded.collect()
    assert len(found) == len(rows)
    for r in found:
        text = ("no id" if r.doc_id is None else texts[r.doc_id]) or ""
        assert r.ids == LIBRARY.encode(text) and r.n_tokens == len(r.ids) == len(r.begins)
        source = text.encode()
        assert b"".join(source[a:b] for a, b in zip(r.begins, r.ends, strict=True)) == source
    for r in pieces.decode(encoded).collect():
        assert r.decoded == LIBRARY.decode(LIBRARY.encode(("no id" if r.doc_id is None else texts[r.doc_id]) or ""))
    assert pieces.encode(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_digests(spark, sf_dir):
    found = pieces.op13_sentencepiece(spark, sf_dir).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert len(found) == len(texts)
    for r in found:
        ids = LIBRARY.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
