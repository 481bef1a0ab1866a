import random

import pytest

import corpus_pipeline
from quillstone.llm import graph, near_texts, simhash

from .test_simhash import closure


def reference_shingles(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def near(x, y):
    return 5 * len(x & y) >= 4 * len(x | y)


def families(seed, families, copies, edits):
    rng = random.Random(seed)
    texts = []
    for _ in range(families):
        base = ["w%d" % rng.randrange(5000) for _ in range(rng.randrange(60, 250))]
        texts.append(" ".join(base))
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randrange(1, edits)):
                words[rng.randrange(len(words))] = "x%d" % rng.randrange(10**6)
            texts.append(" ".join(words))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("count", "copies", "most", "hubs"), [(25, 5, 8, 4), (2, 60, 3, 1)])
def test_links_against_brute_force(spark, count, copies, most, hubs):
    texts = [*families(9, count, copies, 9), "", " \t", "one two", "One  TWO"]
    sets = [reference_shingles(t) for t in texts]
    edges = near_texts.links(spark.createDataFrame(list(enumerate(texts)), "n long, text string"), most=most, hubs=hubs)
    assert all(near(sets[r.a], sets[r.b]) for r in edges.collect())
    found = {r.node: r.component for r in graph.components(edges).collect()}
    want = closure(list(range(len(texts))), lambda a, b: near(sets[a], sets[b]))
    assert {i: found.get(i, i) for i in want} == want


def test_stage_finds_copies_that_are_more_than_two_bits_apart(spark):
    texts = families(4, 6, 4, 5)
    sets, prints = [reference_shingles(t) for t in texts], [simhash.fingerprint(t) for t in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if near(sets[a], sets[b])]
    assert sum((prints[a] ^ prints[b]).bit_count() > 2 for a, b in pairs) > len(pairs) / 2
    want = closure(list(range(len(texts))), lambda a, b: near(sets[a], sets[b]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == set(want.values())
