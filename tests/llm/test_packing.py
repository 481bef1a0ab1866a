import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillstone.llm import packing


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_whole_fits_and_is_near_the_bound(seed):
    rng = random.Random(seed)
    histogram = Counter(min(1024, int(rng.paretovariate(0.6) * 20)) for _ in range(5000))
    bins = packing.plan(dict(histogram))
    found = Counter()
    for b in bins:
        assert sum(x * k for x, k in b.slots) <= 1024
        for x, k in b.slots:
            found[x] += k * b.count
    assert found == histogram
    bound = -(-sum(x * c for x, c in histogram.items()) // 1024)
    assert sum(b.count for b in bins) <= bound * 1.01 + 1


def test_cut():
    assert packing.cut(3, 4) == [(0, 3)]
    assert packing.cut(4, 4) == [(0, 4)]
    assert packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]
    assert packing.cut(8, 4) == [(0, 4), (4, 4)]


def test_documents(spark):
    rng = random.Random(1)
    texts = [None, "", "it's", " a  b\n", "é" * 300, "x" * 3000] + ["word " * rng.randrange(1, 900) for _ in range(60)]
    rows = [(i, t, "z", 1) for i, t in enumerate(texts)] + [(0, None, "z", 1)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, piece string, length int"), capacity=256).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    by_document, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        by_document[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert len(by_document[0]) == 2
    for i, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        own = sorted(by_document[i], key=lambda r: r.piece)[:: 2 if i == 0 else 1]
        assert [r.piece for r in own] == list(range(len(own)))
        assert sum(r.length for r in own) == len(ids)
        for r in own:
            part = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert len(part) == 4 * r.length and zlib.crc32(part) == r.ids_crc32
            assert r.length == 256 or r.piece == 0
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
