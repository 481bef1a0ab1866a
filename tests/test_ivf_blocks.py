import tracemalloc

import numpy as np
from tests.test_ivf import exact

from quillstone.operators import ivf


def test_scores_are_made_a_few_queries_at_a_time():
    rng = np.random.default_rng(2)
    v, center, codes, scale = rng.standard_normal((4000, 8)), rng.standard_normal(8), rng.integers(-127, 128, (5000, 8)).astype(np.float32), rng.random(5000)
    tracemalloc.start()
    places, scores = ivf.best_codes(v, center, codes, scale, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4000 * 5000 * 8 / 2  # all scores at once are 160 MB
    near = (v @ center)[:, None] + v @ codes.T * scale
    assert np.allclose(np.sort(scores, 1), np.sort(near, 1)[:, -10:], atol=1e-2) and places.shape == (4000, 10)


def test_queries_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ivf, "PART_ROWS", 60)
    monkeypatch.setattr(ivf, "QUERY_ROWS", 4)
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(12).tolist()) for i in range(400)]
    units = ivf.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).persist()
    centroids = ivf.train(units, lists=4)
    index = ivf.build(units, centroids).persist()
    found = ivf.search(units.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "v"), index, units, centroids, 10, 4)
    plan = found._jdf.queryExecution().toString()
    assert "block" in plan
    wanted = exact(rows, range(0, 400, 20), 10)
    rows = found.collect()
    assert {q: [r.vec_id for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == q] for q in wanted} == wanted
