import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillstone.llm import packing, token_shards


@pytest.mark.parametrize("total", [1, 2, 3, 16, 17, 1000, 4097])
def test_permutation_is_a_bijection(total):
    slots = token_shards.permute(np.arange(total), total)
    assert sorted(slots.tolist()) == list(range(total))
    if total > 100:
        assert (slots == np.arange(total)).mean() < 0.1
        assert (token_shards.permute(np.arange(total), total, seed=1) != slots).mean() > 0.9


def test_round_trip_and_resume(spark):
    texts = [None, "", "one two", "é x" * 400] + [f"text {i} " * (i % 40) for i in range(80)]
    frame = spark.createDataFrame([(i, t, 0, "s") for i, t in enumerate(texts)] + [(None, "lost", 0, "s")], "doc_id long, text string, slot int, shard string")
    shards = token_shards.materialise(frame, tokens=32, shard_slots=16)
    rows = token_shards.read(shards, tokens=32, shard_slots=16, with_ids=True).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert all(r.shard == r.slot // 16 and r.byte_offset == r.slot % 16 * token_shards.stride(32) for r in rows)
    index = {r.slot: r for r in token_shards.index_of(shards, tokens=32).collect()}
    for r in rows:
        x = index[r.slot]
        assert (x.shard, x.byte_offset, -1 if x.doc_id is None else x.doc_id, x.piece, x.length, x.ids_crc32) == (r.shard, r.byte_offset, r.doc_id, r.piece, r.length, r.ids_crc32)
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    for i, text in [*enumerate(texts), (-1, "lost")]:
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        ids = [x for r in own for x in np.frombuffer(r.ids, "<u2").tolist()]
        assert ids == tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
    rest = token_shards.read(shards, tokens=32, shard_slots=16, from_slot=21).collect()
    assert sorted(r.slot for r in rest) == list(range(21, len(rows)))
    empty = token_shards.materialise(spark.createDataFrame([], "doc_id long, text string"))
    assert token_shards.read(empty).collect() == []


def test_query_reads_stored_ids_in_sequences_of_512(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "word " * 3000)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    stored = []
    real = token_shards.read
    monkeypatch.setattr(token_shards, "read", lambda *a, **b: stored.append(1) or real(*a, **b))
    rows = token_shards.op4_token_shards(spark, str(tmp_path)).collect()
    assert stored and max(r.length for r in rows) == 512 and len(rows) > 2


def one_slot(n, total, seed):
    """The permutation again, a number at a time."""
    bits = max(1, -(-max(1, total - 1).bit_length() // 2))
    mask, word = (1 << bits) - 1, (1 << 64) - 1
    while True:
        left, right = n >> bits, n & mask
        for r in range(6):
            x = (right + zlib.crc32(f"{seed}/{r}".encode())) * 0x9E3779B97F4A7C15 & word
            x = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & word
            left, right = right, left ^ ((x ^ (x >> 32)) & mask)
        n = left << bits | right
        if n < total:
            return n


@pytest.mark.parametrize("total", [1, 5, 333, 5000])
def test_permutation_one_by_one(total):
    assert token_shards.permute(np.arange(total), total, 9).tolist() == [one_slot(n, total, 9) for n in range(total)]


def test_query_holds_every_sequence_and_deals_shards_by_range(spark, sf_dir):
    rows = token_shards.op4_token_shards(spark, sf_dir).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = []
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        want += [(r.doc_id, k, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(packing.cut(len(ids), 512))]
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows) == sorted(want)
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    frame = spark.createDataFrame([(i, "x") for i in range(300)], "doc_id long, text string")
    files = token_shards.materialise(frame, shard_slots=4).select("shard", F.input_file_name().alias("file")).collect()
    by_file = {f: sorted(r.shard for r in files if r.file == f) for f in {r.file for r in files}}
    assert len(by_file) == 5 and all(own == list(range(own[0], own[0] + len(own))) for own in by_file.values())


def test_ids_that_do_not_fit_are_an_error():
    assert packing.narrowed(np.array([1, 65535], "<u4").tobytes(), 2) == np.array([1, 65535], "<u2").tobytes()
    with pytest.raises(ValueError, match="70000"):
        packing.narrowed(np.array([70000], "<u4").tobytes(), 2)
