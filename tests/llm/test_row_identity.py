"""Rows with null and repeated doc_id through the stages that drop rows."""

import random

import corpus_pipeline
from quillstone.llm import exact_dedup, quality

from .test_quality import LABELS, corpus

SCHEMA = "doc_id long, text string, lang string"


def test_exact_dedup_by_row(spark):
    rows = [(None, "alone", "a"), (None, "twice", "b"), (None, "twice", "c"), (None, "named", "d"), (3, "named", "e"), (5, "kept five", "f"), (5, "later copy", "g"), (9, "later copy", "h"), (None, None, "i"), (None, "", "j")]
    kept = sorted(((r.doc_id, r.text or "") for r in exact_dedup.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert kept == sorted([(None, "alone"), (None, "twice"), (3, "named"), (5, "kept five"), (9, "later copy"), (None, "")], key=str)
    assert exact_dedup.keep_one(spark.createDataFrame([], SCHEMA)).collect() == []


def test_quality_by_row(spark):
    rows, labels = corpus(5, 400)
    good, junk = next(r for r in rows if "!!!" not in r[1]), next(r for r in rows if "!!!" in r[1])
    odd = [(7000, good[1], *good[2:]), (7000, junk[1], *junk[2:]), (None, good[1], *good[2:]), (None, junk[1], *junk[2:])]
    frame = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, score int")
    kept = quality.keep_good(frame, spark.createDataFrame(labels, LABELS)).where("doc_id IS NULL OR doc_id = 7000").collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(7000, good[1]), (None, good[1])], key=str)


def test_all_stages_keep_null_and_repeated_ids(spark, tmp_path):
    rng = random.Random(2)
    texts = [" ".join("w%d" % rng.randrange(4000) for _ in range(80)) for _ in range(8)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[1] + " end"), (4, texts[2]), (4, texts[3]), (8, texts[2] + " end"), (6, texts[4]), (None, texts[4] + " end"), (6, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
    found = sorted(((r.doc_id, texts.index(r.text.removesuffix(" end"))) for r in docs.collect()), key=str)
    assert found == sorted([(None, 0), (None, 1), (4, 2), (4, 3), (6, 4)], key=str)


def test_columns_of_any_name_and_long_texts(spark, tmp_path):
    rng = random.Random(3)
    passage = " ".join("p%d" % rng.randrange(9999) for _ in range(60))
    long = " ".join("w%d" % rng.randrange(9999) for _ in range(60_000))
    other = " ".join("v%d" % rng.randrange(9999) for _ in range(90))
    rows = [(1, long), (2, long + " end"), (3, long), (4, f"{other} {passage}"), (5, passage + " tail of five words here"), (6, ""), (7, None), (None, passage + " " + " ".join(f"u{i}" for i in range(50)))]
    names = ["text_key", "kept", "_kept", "_key", "row", "row_n", "own_id", "own_n", "keep_key", "keep_n", "seen_lang", "n", "spans", "node", "place"]
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in names)
    docs = spark.createDataFrame([(i, t, *(f"{c} of {i}" for c in names)) for i, t in rows], schema)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
    found = {r.doc_id: r for r in docs.collect()}
    assert set(found) == {2, 4, 5, 7, None} or set(found) == {2, 4, 5, 6, None}
    assert found[2].text == long + " end" and found[4].text == f"{other} {passage}" and found[5].text == "tail of five words here"
    assert found[None].text == rows[-1][1]  # a row without a doc_id neither loses words nor makes others lose any
    assert all(found[4][c] == f"{c} of 4" for c in names)
