import random

import pytest
import xxhash

from quillstone.llm import graph, simhash


def reference_fingerprint(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def closure(nodes, linked):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if linked(a, b) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_fingerprint():
    for text in ["", " \t\n", "One", "two Words", "a b c d a b c d", "É é A a B b c \x0b d\x1fe f"]:
        assert simhash.fingerprint(text) == reference_fingerprint(text)


@pytest.mark.parametrize("most", [2, 8])
def test_links_close_over_all_pairs_within_two_bits(spark, most):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    values = {0, 1, 3, (1 << 64) - 1}
    for _ in range(120):
        value = centre
        for _ in range(rng.randrange(7)):
            value ^= 1 << rng.randrange(20, 44)
        values.add(value)
    values |= {rng.getrandbits(64) for _ in range(30)}
    fps = dict(enumerate(sorted(values)))
    fps = {v - (1 << 64) if v >> 63 else v: v for v in fps.values()}
    edges = simhash.links(spark.createDataFrame([(v,) for v in fps], "fp long"), most=most)
    near = lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2
    assert all(near(r.a, r.b) for r in edges.collect())
    found = {r.node: r.component for r in graph.components(edges).collect()}
    assert {n: found.get(n, n) for n in fps} == closure(list(fps), near)


def test_documents(spark):
    rows = [(1, None, 0, "x"), (2, "", 0, "x"), (3, "Same words here now", 0, "x"), (4, "same WORDS here now", 0, "x"), (5, "same WORDS here now", 0, "x"), (9, "other text altogether", 0, "x"), (9, "other text altogether", 0, "x")]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp int, node string"))
    assert sorted((r.doc_id, r.component_id) for r in out.collect()) == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (9, 9), (9, 9)]
    assert {r.fingerprint for r in out.where("doc_id < 3").collect()} == {"0" * 16}
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
