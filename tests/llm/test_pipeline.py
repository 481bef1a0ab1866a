import random

import corpus_pipeline
from quillstone.llm import _shared, exact_dedup

from .test_near_texts import near as similar
from .test_near_texts import reference_shingles
from .test_simhash import closure
from .test_substrings import brute


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(7)
    words = ["w%d" % i for i in range(300)]
    rows, labels = [], []
    for i in range(240):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(20, 90)))
        if i % 5 == 0:
            text = text.upper().replace(" ", "!!! ")
        if i % 7 == 1 and i > 20:
            text = rows[i - 10][1]
        if i % 11 == 1 and i > 20:
            text = rows[i - 6][1] + " end"
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int("!!!" not in text), 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = _shared.table(spark, str(tmp_path), "documents")
    columns, frames = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        frames.append({r.doc_id: r for r in docs.collect()} if k < 4 else docs.collect())
    good, exact, near, cut, packed = frames
    clean = {i for i, q, _ in labels if q}
    assert len(set(good) & clean) >= 0.98 * len(clean) and len(set(good) - clean) <= 2
    last = {}
    for i in good:
        last[good[i].text] = max(i, last.get(good[i].text, i))
    assert set(exact) == set(last.values())
    sets = {i: reference_shingles(r.text) for i, r in exact.items()}
    label = closure(list(sets), lambda a, b: similar(sets[a], sets[b]))
    assert set(near) == {i for i in label if label[i] == i}
    want = {i: (kept, gone) for i, _, gone, kept in brute([(i, r.text) for i, r in near.items()], 13)}
    assert set(cut) == set(near)
    for i, r in cut.items():
        assert r.text == (want[i][0] if want[i][1] else near[i].text)
        assert (r.lang, r.source, r.n_chars) == ("en", "s", near[i].n_chars)
    assert {r.doc_id for r in packed} == set(cut)
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "ids_crc32").collect())) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed)


def test_released_tables_are_those_of_the_run(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i % 3}") for i in range(9)], "doc_id long, text string")
    out = exact_dedup.duplicates(docs)
    corpus_pipeline.exact_duplicates(spark, docs, "").count()
    corpus_pipeline.pack_sequences(spark, docs, "")
    assert out.count() == 9
