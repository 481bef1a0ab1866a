import tracemalloc

import pyarrow as pa

from quillstone.operators import contain


def test_few_texts_are_held_at_once():
    texts = [f"{i} " + "lorem " * 400 + ("needle" if i % 50 == 0 else "") for i in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array(texts)], ["k0", "t"])
    del texts
    tracemalloc.start()
    found = [r for b in contain._found([batch], 3, ["none", "needle"]) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [{"k0": i, "passage": 4} for i in range(0, 4000, 50)]
    assert peak < 2_000_000  # all texts are 10 MB


def test_one_automaton_a_task(spark, monkeypatch):
    monkeypatch.setattr(contain, "AUTOMATON_CHARS", 6)
    assert list(contain._dealt(["abc", "def", "g", "hijklmnop", "q"])) == [(0, ["abc", "def"]), (2, ["g"]), (3, ["hijklmnop"]), (4, ["q"])]
    texts = spark.createDataFrame([(1, "xabcg"), (2, "hijklmnopq"), (3, None)], "d int, text string")
    asked = spark.createDataFrame([(10, "abc"), (11, "def"), (12, "g"), (13, "hijklmnop"), (14, "q")], "question_id int, question string")
    out = contain.holding(texts, asked, ["d"])
    assert sorted(map(tuple, out.collect())) == [(1, 10), (1, 12), (2, 13), (2, 14)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 4
