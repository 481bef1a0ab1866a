import json

from quillstone.sources import datasets as D


def test_rules(spark, tmp_path):
    corpus = {"dataset_version": "1", "synthetic_only": True, "documents": [{"id": "a", "filename": "a.txt", "pages": ["Fee: EUR 5", " "]}, {"id": "a", "filename": "b.txt", "pages": []}]}
    cite = lambda page, text: {"document_id": "a", "page": page, "excerpt": text}
    cases = {"dataset_version": "1", "cases": [
        {"id": "ok", "split": "development", "kind": "answerable", "question": "Fee?", "expected_answer": "EUR 5", "expected_citations": [cite(1, "EUR 5")]},
        {"id": "wrong", "split": "test", "kind": "answerable", "question": "Fee", "document_ids": ["z"], "expected_citations": [cite(1, "EUR 6"), cite(9, "x")]},
        {"id": "none", "split": "holdout", "kind": "unanswerable", "question": "Fee?", "expected_answer": "x", "document_ids": [], "expected_citations": []},
    ]}
    for name, value in (("corpus", corpus), ("cases", cases)):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    c, k = D.read_json(spark, f"{tmp_path}/corpus.json", D.CORPUS), D.read_json(spark, f"{tmp_path}/cases.json", D.CASES)
    found = {(r.rule, r.id) for r in D.violations(c, k).collect()}
    assert found == {("duplicate_document", "a"), ("document_without_pages", "a"), ("blank_page", "a"), ("unknown_split", "wrong"), ("unknown_document", "wrong"), ("answer_missing", "wrong"), ("excerpt_not_on_page", "wrong"), ("citation_page_unknown", "wrong"), ("answer_unexpected", "none"), ("empty_scope", "none"), ("splits_overlap", "Fee?")}
    chunks = spark.createDataFrame([("c1", "a"), ("c2", "z")], "chunk_id string, document_id string")
    assert {tuple(r) for r in D.scoped(D.cases_of(k), chunks).collect()} == {("ok", "c1"), ("ok", "c2"), ("wrong", "c2")}


def test_manifests_and_runs(spark, tmp_path):
    files = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"yy"))], "name string, content binary")
    digest = "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"
    manifest = spark.createDataFrame([("a", 1, digest), ("b", 1, digest), ("c", 1, digest)], "name string, bytes int, sha256 string")
    assert {r.name: r.error for r in D.verified_files(files, manifest).collect()} == {"a": None, "b": "size", "c": "missing"}
    listed = spark.createDataFrame([(False, [(digest,), (digest,), ("no",)])], "synthetic_only boolean, documents array<struct<sha256:string>>")
    assert {(r.rule, r.digest) for r in D.allow_list_errors(listed).collect()} == {("not_synthetic", None), ("duplicate", digest), ("not_a_digest", "no")}
    for i, at in enumerate(("2026-01-01", "2026-01-02")):
        (tmp_path / f"r{i}.json").write_text(json.dumps({"schema_version": "evaluation-result-v1", "dataset_version": "1", "parameters_version": "1", "split": "development", "created_at": at}))
    (tmp_path / "x.json").write_text(json.dumps({"schema_version": "other"}))
    runs = D.newest_runs(spark, str(tmp_path), "schema_version string, dataset_version string, parameters_version string, split string, created_at string")
    assert [r.created_at for r in runs.collect()] == ["2026-01-02"]


def test_rules_on_ids_citations_and_targets(spark):
    corpus = spark.createDataFrame([("1", True, "x", [(" ", "a.txt", ["x"], None, None, None), ("d", "d.txt", ["Fee: EUR 5", "Date: 2026-01-01"], None, None, None)]), ("2", True, "x", [])], D.CORPUS)
    cite = lambda page, text, document="d": (document, page, text)
    rows = [
        ("", "development", "answerable", "q", " ", ["d", " "], [cite(1, "Fee"), (None, 1, "x"), cite(1, ""), cite(1, "x", "gone")]),
    ]
    target = lambda document, split, *fields: (document, split, list(fields))
    targets = [
        target("d", "development", ("renewal_date", ["2026-01-01"], [cite(2, "2026-01-01", None)]), ("important_amounts", ["EUR 5"], [cite(1, "EUR 6")])),
        target("gone", "other", ("colour", ["x", "y"], [cite(1, "x", "d")])),
        target("d", "holdout", ("document_type", ["a", " "], [cite(9, "a"), cite(1, "a")])),
        (None, "holdout", None),
    ]
    cases = spark.createDataFrame([("1", "p", "m", None, rows, targets)], f"{D.CASES}, extraction_targets {D.TARGETS}")
    found = {r.rule for r in D.violations(corpus, cases).collect()}
    new = {
        "no_documents", "blank_document_id", "blank_case_id", "answer_blank", "scope_with_blank", "citation_without_document", "citation_document_unknown", "citation_without_excerpt",
        "target_without_document", "target_document_unknown", "target_split_unknown", "target_without_fields", "target_field_unknown", "target_values_of_scalar", "target_value_blank",
        "target_citations_differ_from_values", "target_cites_another_document", "target_page_unknown", "target_excerpt_not_on_page",
    }
    assert new <= found and "target_field_twice" not in found
    assert {(r.rule, r.id) for r in D.manifest_errors(cases).collect()} == {("unknown_mode", "1"), ("seed_missing", "1")}
    assert {(r.kind, r.split): r.cases for r in D.case_counts(cases).collect() if r.cases} == {("answerable", "development"): 1}
