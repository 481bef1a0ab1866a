import json

import pytest
from pyspark.sql import functions as F

from quillstone.operators import evaluation as E

CASES = "id string, kind string, expected_answer string, expected_citations array<struct<document_id:string,page:int,excerpt:string>>"
RANKED = "question_id string, rank int, chunk_id string, document_id string, page int, score double"
ANSWERS = "question_id string, status string, answer string, confidence double, citations array<struct<document_id:string,page:int,excerpt:string>>, latency_ms double"


@pytest.fixture(scope="module")
def frames(spark):
    gold = [("d1", 2, "Annual fee: EUR 48,000 a year")]
    cases = [
        ("right", "answerable", "EUR 48,000", gold), ("wrong", "answerable", "EUR 48,000", gold), ("date", "answerable", "2026-01-15", [("d2", 1, "Effective date: 15 January 2026")]),
        ("held", "unanswerable", None, []), ("two", "ambiguous", None, gold), ("steered", "adversarial", None, []), ("lost", "answerable", "x", gold), ("bad", "answerable", "x", gold),
    ]
    ranked = [(c, 1, f"{c}1", "d9", 1, 0.9) for c in ("right", "wrong", "date", "two", "bad")] + [("right", 2, "right2", "d1", 2, 0.8), ("date", 2, "date2", "d2", 1, 0.7), ("wrong", 6, "wrong6", "d1", 2, 0.1)]
    cited = [("d1", 2, "EUR 48,000")]
    answers = [
        ("right", "answered", "48 000 €", 0.9, cited, 10.0), ("wrong", "answered", "EUR 4,800", 0.9, [("d1", 1, "EUR 48,000"), ("d1", 2, "EUR")], 20.0), ("date", "answered", "It is 15 January 2026.", 0.8, [("d2", 1, "15 January 2026")], 30.0),
        ("held", "abstained", "", 0.0, [], 40.0), ("two", "answered", "EUR 48,000", 0.5, cited, 50.0), ("steered", "abstained", "", 0.0, [], 60.0), ("bad", "answered", "x", float("nan"), [], 70.0),
    ]
    return spark.createDataFrame(cases, CASES), spark.createDataFrame(ranked, RANKED), spark.createDataFrame(answers, ANSWERS)


def test_case_rows(frames):
    rows = {r.id: r for r in E.case_rows(*frames).collect()}
    assert (rows["right"].answer_match, rows["right"].citation_matches, rows["right"].expected_citation_matches) == (True, [True], [True])
    assert (rows["right"].retrieval_matches_at_5, rows["right"].retrieval_rank) == ([False, True], 2)
    assert (rows["wrong"].answer_match, rows["wrong"].citation_matches, rows["wrong"].retrieval_rank) == (False, [False, False], None)
    assert rows["date"].answer_match and rows["date"].citation_matches == [True]
    assert (rows["lost"].status, rows["lost"].error, rows["lost"].schema_error, rows["lost"].retrieval_completed) == ("error", "no answer", False, False)
    assert (rows["bad"].status, rows["bad"].error, rows["bad"].schema_error) == ("error", "confidence out of range", True)
    assert (rows["held"].status, rows["held"].retrieval_rank, rows["held"].expected_locations) == ("abstained", None, None)


def test_metrics_recalculation_and_integrity(spark, frames, tmp_path):
    E.case_rows(*frames).write.parquet(f"{tmp_path}/cases")
    cases = spark.read.parquet(f"{tmp_path}/cases")
    m = E.metrics(cases)
    row = m.first()
    assert (row.citation_correct, row.citation_returned, row.citation_expected, row.citation_expected_matched) == (2, 4, 3, 2)
    assert (row.answerable_correct, row.answerable_total, row.abstention_correct, row.abstention_total) == (2, 5, 2, 3)
    assert (row.errors, row.schema_errors, row.retrieval_hits_at_5) == (2, 1, 2)
    assert row.retrieval_mrr_at_5 == 0.2 and row.error_rate == 0.25 and row.verdict == "FAIL"
    assert (row.latency_median_ms, row.latency_p95_ms) == (40.0, 70.0)
    assert {r.drifted for r in E.recalculate(cases, None, m).collect()} == {False}
    off = m.withColumn("citation_recall", F.col("citation_recall") + 0.01).withColumn("errors", F.lit(3))
    assert {r.metric for r in E.recalculate(cases, None, off).where("drifted").collect()} == {"citation_recall", "errors"}
    assert E.integrity_errors(cases).collect() == []
    broken = cases.withColumn("retrieval_rank", F.when(F.col("id") == "right", 1).when(F.col("id") == "date", 9).otherwise(F.col("retrieval_rank"))).withColumn("latency_ms", F.when(F.col("id") == "held", -1.0).otherwise(F.col("latency_ms")))
    found = {(r.id, r.rule) for r in E.integrity_errors(broken).collect()}
    assert found == {("right", "rank differs from the matches"), ("date", "rank differs from the matches"), ("date", "rank beyond the passages"), ("held", "latency must be finite and not negative")}


def test_extraction_rows(spark):
    targets = spark.createDataFrame(
        [
            ("d1", "important_amounts", ["EUR 48,000", "EUR 48,000", "GBP 5"], [(None, 1, "fee EUR 48,000 paid"), (None, 1, "fee EUR 48,000 paid"), (None, 1, "nothing here")]),
            ("d1", "effective_date", ["2026-01-15"], [(None, 1, "from 15 January 2026 on")]), ("d1", "risks", None, None), ("d7", "obligations", ["keep the records"], [(None, 1, "keep the records")]),
        ],
        f"document_id string, field string, expected array<string>, citations {E.CITATIONS}",
    )
    cite = "citation struct<page:int,excerpt:string>"
    extracted = spark.createDataFrame([("d1", "important_amounts", 0, "48 000 €", (1, "EUR 48,000")), ("d1", "important_amounts", 1, "GBP 5", (2, "GBP 5")), ("d1", "effective_date", 0, "15 January 2026", (1, "15 January 2026")), ("d1", "risks", 0, "delay", (1, "may delay"))], f"document_id string, field string, value_ord int, value string, {cite}")
    rows = {(r.document_id, r.field): r for r in E.extraction_rows(targets, extracted).collect()}
    money = rows["d1", "important_amounts"]
    assert (money.value_decisions, money.citation_decisions, money.true_positive, money.predicted, money.gold) == ([True, False, True], [True, True, False], 1, 2, 3)
    assert (rows["d1", "effective_date"].true_positive, rows["d1", "risks"].predicted, rows["d1", "risks"].gold) == (1, 1, 0)
    assert (rows["d7", "obligations"].value_decisions, rows["d7", "obligations"].gold) == ([False], 1)
    out = E.metrics(spark.createDataFrame([], "id string, kind string, status string, answer_match boolean, citation_matches array<boolean>, expected_citation_matches array<boolean>, retrieval_rank int, error string, schema_error boolean, latency_ms double"), E.extraction_rows(targets, extracted)).first()
    assert (out.extraction_true_positive, out.extraction_predicted, out.extraction_gold, out.extraction_precision, out.extraction_recall) == (2, 4, 5, 0.5, 0.4)


METHODS = "method string, answerable_correct long, citation_correct long, abstention_correct long, retrieval_hits_at_5 long, extraction_f1 double, error_rate double"


@pytest.mark.parametrize(
    "reranked,want",
    [((7, 5, 5, 9), ("hybrid_rerank", True, 1, True)), ((7, 4, 5, 9), ("hybrid", False, 1, False)), ((6, 9, 9, 9), ("hybrid", False, 0, True))],
)
def test_method_selection(spark, reranked, want):
    rows = [("lexical", 6, 5, 4, 9, 0.9, 0.0), ("dense", 5, 9, 9, 9, 0.9, 0.0), ("hybrid", 6, 5, 5, 9, 0.9, 0.0), ("hybrid_rerank", *reranked, 0.9, 0.0)]
    assert tuple(E.select_method(spark.createDataFrame(rows, METHODS)).first()) == want
    even = [(m, 6, 5, 5, 9, 0.9, 0.0) for m in ("lexical", "dense", "hybrid", "hybrid_rerank")]
    assert E.select_method(spark.createDataFrame(even, METHODS)).first().selected == "lexical"


def test_strategies_and_digests(spark):
    schema = "configuration string, partition string, digest string, accuracy double, p double, r double"
    rows = [("a", "calibration", "x", 0.9, 0, 0), ("a", "selection", "s", 0.9, 0.7, 0.9), ("b", "calibration", "y", 0.9, 0, 0), ("b", "selection", "t", 0.9, 0.8, 0.75), ("c", "calibration", "z", 0.4, 0, 0), ("c", "selection", "u", 0.9, 1, 1), ("d", "calibration", "1", 0.9, 0, 0), ("d", "calibration", "2", 0.9, 0, 0), ("d", "selection", "v", 1, 1, 1)]
    found = E.select_strategy(spark.createDataFrame([(*r[:3], *map(float, r[3:])) for r in rows], schema), 0.8, ["p", "r"])
    assert [r.configuration for r in found.collect()] == ["b"]
    runs = spark.createDataFrame([("1", "a", "answered", "x"), ("1", "b", "abstained", ""), ("2", "b", "abstained", ""), ("2", "a", "answered", "x"), ("3", "a", "answered", "y"), ("3", "b", "abstained", "")], "run string, id string, status string, answer string").withColumns({"answer_match": F.lit(True), "citation_matches": F.array(F.lit(True)), "retrieval_rank": F.lit(1)})
    digests = {r.run: r.digest for r in E.run_digests(runs).collect()}
    assert digests["1"] == digests["2"] != digests["3"]


def test_answers_fit(spark):
    rows = [("48 000 €", "EUR 48,000", True), ("EUR 4,800", "EUR 48,000", False), ("from 1er février 2027 on", "2027-02-01", True), ("2027-02-02", "1 February 2027", False), ("The Owner is Ada", "owner is ada", True), ("Ada", "owner is ada", False)]
    found = spark.createDataFrame(rows, "a string, e string, w boolean").select(E.answer_fits(F.col("a"), F.col("e")).alias("f"), "w").collect()
    assert all(r.f == r.w for r in found), json.dumps([tuple(r) for r in found])
