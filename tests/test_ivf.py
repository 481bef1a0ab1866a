import numpy as np

from quillstone.operators import ivf
from quillstone.plans import relational


def exact(rows, queries, k):
    unit = {i: np.array(v, float) / np.linalg.norm(v) for i, v in rows if v is not None and np.isfinite(v).all() and np.any(v)}
    ids = sorted(unit)
    table = np.array([unit[i] for i in ids])
    return {q: [ids[j] for j in np.lexsort((ids, -(table @ unit[q])))[:k]] for q in queries if q in unit}


def recall(found, wanted):
    own = {}
    for r in found:
        own.setdefault(r.query_id, set()).add(r.vec_id)
    return sum(len(own[q] & set(w)) for q, w in wanted.items()) / sum(len(w) for w in wanted.values())


def test_recall_of_the_query(spark, sf_dir):
    """On vectors without any clusters, the hardest case."""
    found = relational.t_knn_ivf(spark, sf_dir).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    wanted = exact(rows, [i for i, _ in rows if i % 20 == 0], 20)
    assert recall(found, wanted) >= 0.9 and len(found) == 20 * len(wanted)


def test_every_row_is_indexed_and_hot_lists_are_parted(spark, monkeypatch):
    monkeypatch.setattr(ivf, "PART_ROWS", 50)
    rng = np.random.default_rng(1)
    centers = rng.standard_normal((6, 16)) * 3
    rows = [(i, (centers[0 if i % 3 else i % 6] + rng.standard_normal(16)).tolist()) for i in range(900)]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, rows[0][1])]
    units = ivf.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).persist()
    centroids = ivf.train(units, lists=6)
    index = ivf.build(units, centroids).persist()
    assert index.select("vec_id").distinct().count() == index.count() == 901
    assert index.groupBy("list").count().agg({"count": "max"}).first()[0] > 3 * ivf.PART_ROWS
    queries = units.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "v")
    wanted = exact(rows, range(0, 900, 20), 10)
    near, every = (ivf.search(queries, index, units, centroids, 10, probes).collect() for probes in (4, 6))
    assert recall(near, wanted) >= 0.9
    assert {q: [r.vec_id for r in sorted(every, key=lambda r: r["rank"]) if r.query_id == q] for q in wanted} == wanted
    none = ivf.usable(spark.createDataFrame([], "vec_id long, embedding array<double>"))
    assert ivf.search(queries, ivf.build(none, np.zeros((0, 16))), none, ivf.train(none)).collect() == []
