import random

from quillstone.operators import contain


def test_same_as_trying_all(spark, monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab é") for _ in range(rng.randrange(40))) for _ in range(200)] + [None, "", "ab", "ab"]
    passages = ["".join(rng.choice("ab é") for _ in range(rng.randrange(1, 5))) for _ in range(40)] + ["", None, "ab", "ab"]
    left = spark.createDataFrame([(i, i % 3, t) for i, t in enumerate(texts)], "document_id int, page int, text string").repartition(3)
    right = spark.createDataFrame(list(enumerate(passages)), "question_id int, question string")
    expected = sorted((i, i % 3, q) for i, t in enumerate(texts) for q, p in enumerate(passages) if t and p and p in t)
    for chars in (contain.AUTOMATON_CHARS, 7):  # one automaton, and many
        monkeypatch.setattr(contain, "AUTOMATON_CHARS", chars)
        assert sorted(tuple(r) for r in contain.holding(left, right, ["document_id", "page"]).collect()) == expected
    assert contain.holding(left, right.limit(0), ["document_id"]).collect() == []


def test_clashing_names(spark):
    left = spark.createDataFrame([("x", 1, "one two")], "question_id string, passage int, body string")
    right = spark.createDataFrame([(7, "two")], "id int, words string")
    assert [tuple(r) for r in contain.holding(left, right, ["question_id", "passage"], "body", "id", "words").collect()] == [("x", 1, 7)]
