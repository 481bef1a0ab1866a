from pyspark.sql import functions as F

from quillstone.operators import retrieve

NAMES = ("alder", "birch", "cedar", "elder", "fir", "hazel", "larch", "maple", "rowan", "willow")


def rows(spark):
    lines = ["Effective date: 2026-01-0{}", "Annual fee: EUR {},000 for the service.", "The supplier shall keep the {} register.", "Organization: {} Ltd"]
    chunks = [(f"{n}:p1:c{i}", n, f"agreement_{n}.txt", 1, None, line.format(n if i > 1 else k + 1)) for k, n in enumerate(NAMES) for i, line in enumerate(lines)]
    chunks += [(f"note:p1:c{i}", "note", "note.txt", 1, None, f"A note on {n} and its fee.") for i, n in enumerate(NAMES[:4])]
    asked = [(i, f"What is the {what} of {n.title()}?") for i, (n, what) in enumerate((n, w) for n in (*NAMES, "oak") for w in ("annual fee", "effective date", "agreement", "colour"))]
    asked += [(1000, ""), (1001, "the"), (1002, "What is the note's fee for alder and birch in the agreement?"), (1003, "register")]
    return spark.createDataFrame(asked, "question_id int, question string"), spark.createDataFrame(chunks, "chunk_id string, document_id string, document_name string, page int, section string, text string")


def test_more_questions_than_one_set_rank_alike(spark, monkeypatch):
    asked, chunks = rows(spark)
    columns = ["question_id", "rank", "chunk_id", "score", "lexical_score", "dense_score", "entity_score", "intent", "document_id", "text"]
    want = sorted(map(tuple, retrieve.rank(asked, chunks, "lexical", 6).select(columns).collect()), key=str)
    for common in (0, 3, 200):
        assert sorted(map(tuple, retrieve.rank_by_words(asked, chunks, 6, common).select(columns).collect()), key=str) == want
    monkeypatch.setattr(retrieve, "MAX_QUESTIONS", asked.count() - 1)
    assert retrieve.rank(asked, chunks, "lexical", 6).agg(F.count("*")).first()[0] == len(want)
