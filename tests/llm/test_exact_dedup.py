import hashlib
import random
from collections import defaultdict

import pytest

from quillstone.llm import exact_dedup

SCHEMA = "doc_id long, text string, keep_id string, lang string"


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[text or ""].append(doc_id)
    out = []
    for doc_id, text, *_ in rows:
        g = groups[text or ""]
        out.append((doc_id, max(g), len(g), doc_id == max(g), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out)


def texts():
    rng = random.Random(3)
    long = "".join(rng.choice("abcé ") for _ in range(700))
    base = ["", None, "a", "é", long, long + "x", "x" + long, long[:64], long[:65], long[:128], long[:64] * 3, long[:64] * 4, long[:32] * 3]
    return [(i, base[rng.randrange(len(base))], "clash", "en") for i in range(60)] + [(100, "", "", "")]


@pytest.mark.parametrize("bits", [64, 2])
def test_same_as_brute_force_even_when_keys_collide(spark, bits):
    rows = texts()
    found = exact_dedup.duplicates(spark.createDataFrame(rows, SCHEMA), block_bytes=32, key_bits=bits)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, found.collect())) == brute(rows)


def test_empty_table_and_kept_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.duplicates(empty).collect() == []
    rows = texts()
    kept = exact_dedup.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id for r in kept} == {r[1] for r in brute(rows)}
    assert kept[0].asDict().keys() == {"doc_id", "text", "keep_id", "lang"}
