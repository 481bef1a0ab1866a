import json

import pytest

from quillstone import cli
from quillstone.engine import Engine, Forbidden

ADMIN, READER = ("ann", "admin"), ("rob", "reader")
CORPUS = {"dataset_version": "v1", "synthetic_only": True, "license": "x", "documents": [{"id": "d1", "filename": "agreement_north.txt", "pages": ["Organization: North Ltd\nEffective date: 2026-01-15", "Annual fee: EUR 48,000 for the service.\nWrite to mina@example.test."]}, {"id": "d2", "filename": "register.txt", "pages": ["Owner: Ada Model."]}]}
CASES = {
    "dataset_version": "v1", "parameters_version": "p1", "mode": "m", "seed": 1,
    "cases": [
        {"id": "a", "split": "development", "kind": "answerable", "question": "What is the annual fee?", "expected_answer": "EUR 48,000", "document_ids": ["d1"], "expected_citations": [{"document_id": "d1", "page": 2, "excerpt": "Annual fee: EUR 48,000 for the service."}]},
        {"id": "b", "split": "development", "kind": "unanswerable", "question": "What colour is the sky?", "expected_citations": []},
        {"id": "c", "split": "holdout", "kind": "unanswerable", "question": "Which bird sings?", "expected_citations": []},
    ],
}


def test_requests(spark, tmp_path):
    engine = Engine(spark, f"{tmp_path}/engine")
    assert engine.health().first().status == "ok" and engine.ready()
    engine.put_users(spark.createDataFrame([("ann", "h1", "admin"), ("rob", "h2", "reader"), ("old", "h3", "reader")], "username string, password_hash string, role string"))
    engine.put_users(spark.createDataFrame([("old", "h3", None)], "username string, password_hash string, role string"))
    assert engine.sign_in("ann", lambda h: h == "h1") == ADMIN and engine.sign_in("ann", lambda h: False) is None and engine.sign_in("old", lambda h: True) is None
    assert engine.me(ADMIN).count() == 1 and engine.me(("ann", "reader")).count() == 0
    engine.put_dossiers(spark.createDataFrame([("x", "B", "", True), ("y", "A", "", True)], "id string, name string, description string, is_synthetic boolean"))
    assert [r.name for r in engine.dossiers(READER).collect()] == ["A", "B"]
    files = spark.createDataFrame([("1", "a.txt", "text/plain", b"Annual fee: EUR 48,000 for the service.\n\nWrite to mina@example.test."), ("2", "b.txt", "text/plain", b"Annual fee: EUR 48,000 for the service.\n\nWrite to mina@example.test."), ("3", "c.exe", "text/plain", b"x"), ("4", "d.pdf", "application/pdf", b"%PDF-1.4 broken")], "document_id string, filename string, declared string, data binary")
    with pytest.raises(Forbidden):
        engine.upload(READER, "x", files)
    found = {r.document_id: r.outcome for r in engine.upload(ADMIN, "x", files).collect()}
    assert found == {"1": "accepted", "2": "duplicate", "3": "unsupported_type", "4": "invalid_pdf"}
    assert [r.text for r in engine.content(READER, "1").collect()] == ["Annual fee: EUR 48,000 for the service.", "Write to [EMAIL REDACTED]."]
    assert {r.document_id for r in engine.documents(READER, "x").collect()} == {"1", "4"}
    answers = engine.ask(READER, "x", spark.createDataFrame([("q", "What is the annual fee?"), ("long", "x" * 1001)], "question_id string, question string")).collect()
    assert [(r.question_id, r.status, r.answer, r.supporting_document) for r in answers] == [("q", "answered", "EUR 48,000", "1")]
    assert {r.field for r in engine.extraction(READER, "x").collect()} == {"important_amounts"}
    assert engine.delete(ADMIN, ["1", "9"]) == 1 and engine.delete(ADMIN, ["1"]) == 0
    assert engine.content(READER, "1").count() == 0 and engine.document(READER, "1").count() == 0
    assert {r.status: r.documents for r in engine.status(ADMIN).collect()} == {"queued": 0, "processing": 0, "completed": 0, "failed": 1, "deleted": 1}
    actions = [r.action for r in engine.audit_events(ADMIN).collect()]
    assert sorted(actions) == sorted(["auth.login"] * 3 + ["document.upload", "question.ask", "document.delete"])
    with pytest.raises(Forbidden):
        engine.audit_events(READER)


def test_manifest_from_files(spark, tmp_path, capsys):
    for name, value in (("corpus", CORPUS), ("cases", CASES)):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    paths = [f"{tmp_path}/corpus.json", f"{tmp_path}/cases.json"]
    assert cli.main(["validate", *paths], spark) == 0
    assert cli.main(["evaluate", *paths, "--out", f"{tmp_path}/run"], spark) == 1  # no extraction targets: F1 is zero
    cases = {r.id: r for r in spark.read.parquet(f"{tmp_path}/run/cases").collect()}
    assert set(cases) == {"a", "b"}
    assert (cases["a"].status, cases["a"].answer_match, cases["a"].citation_matches, cases["a"].retrieval_rank, cases["a"].error) == ("answered", True, [True], 1, None)
    assert {r.document_id for r in cases["a"].retrieved} == {"d1"} and cases["b"].status == "abstained"
    row = spark.read.parquet(f"{tmp_path}/run/metrics").first()
    assert (row.citation_precision, row.citation_recall, row.citation_case_accuracy, row.abstention_accuracy, row.error_rate) == (1.0, 1.0, 1.0, 1.0, 0.0)
    assert cli.main(["recalculate", f"{tmp_path}/run"], spark) == 0
    (tmp_path / "cases.json").write_text(json.dumps(CASES | {"dataset_version": "v2"}))
    assert cli.main(["validate", *paths], spark) == 1
    with pytest.raises(ValueError, match="versions"):
        cli.main(["evaluate", *paths], spark)
    assert "version_differs" in capsys.readouterr().out


def test_only_development_is_run_on_request(spark, tmp_path):
    with pytest.raises(ValueError, match="development"):
        Engine(spark, f"{tmp_path}/e").run_evaluation(ADMIN, spark.range(1), spark.range(1), "holdout")
