import random

import numpy as np

from quillstone.llm import neighbours


def brute(rows, every, k):
    good = [(i, v) for i, v in rows if v and all(x is not None and x == x and abs(x) < 1e300 for x in v) and any(v)]
    out = []
    for q, a in good:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(b) == len(a))[:k]
            out += [(q, r, i, round(-s, 12)) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def test_same_as_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 480)]
    rows += [(500, None), (510, [0.0] * 5), (520, [1.0, None, 0.0, 0.0, 0.0]), (530, [float("nan"), 1.0, 1.0, 1.0, 1.0]), (540, [float("inf")] * 5), (560, [1.0, 2.0]), (561, [2.0, 2.0]), (562, [0.5, -2.0]), (580, [])]
    frame = spark.createDataFrame([(i, v, 0, "q") for i, v in rows], "vec_id long, embedding array<double>, rank int, v string")
    found = neighbours.search(frame, every=20, k=7, block_rows=64, block_queries=10)
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 12)) for r in found.collect()) == brute(rows, 20, 7)


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    two = neighbours.search(spark.createDataFrame([(0, [1.0, 0.0]), (3, [0.5, 0.5])], schema)).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in two] == [(0, 1, 3, 0.5)]
    assert neighbours.search(spark.createDataFrame([(0, [1.0, 0.0])], schema)).collect() == []
    assert neighbours.search(spark.createDataFrame([], schema)).collect() == []


def test_products_of_wide_vectors_are_exact():
    whole, *_ = neighbours.quantise(np.full((2, 1100), 1.0))
    assert int((whole[0] @ whole[1])) == 127 * 127 * 1100
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 1500))
    found = sorted(neighbours.nearest_of_block(np.arange(3), x[:3], np.arange(200), x, 9, tile_rows=50))
    scores = x[:3] @ x.T
    assert [(q, i) for q, i, _ in found] == sorted((q, int(i)) for q in range(3) for i in [i for i in np.argsort(-scores[q]) if i != q][:9])
