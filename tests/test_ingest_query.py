import duckdb

import __spark_entry__
from quillstone.streaming import ingest


def test_m_stream_ingest_takes_large_documents_and_the_smallest_of_equal_ones(spark, tmp_path, monkeypatch):
    # Limits on pages, characters and chunks made states that the SQL doesn't have; so did batches that hold one text twice.
    monkeypatch.setattr(ingest, "FILES", 1, raising=False)
    texts = ["Owner: Ada.", "Fee 1. " * 5001, "One page.\n\n" * 201, "a" * 1_000_001, "Owner: Ada.", "Owner: Ada."]
    rows = [(9 - i, text, "ab"[i == 5]) for i, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = __spark_entry__.queries()["m_stream_ingest"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()["m_stream_ingest"]).fetchall()
    assert len(want) == 5 and sorted(map(tuple, got)) == sorted(want)
