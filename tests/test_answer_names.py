import duckdb
import pytest

import __spark_entry__ as entries
from quillstone.operators import retrieve


@pytest.mark.parametrize("name", ["e_answer_grounded", "e_answer_extractive"])
def test_suppliers_with_long_keys_are_told_apart(spark, tmp_path, monkeypatch, name):
    keys = [*range(4), 10000, 99999, *range(100000, 100012), 1000000, 1000001, 7_000_000_010, 7_000_000_012]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    monkeypatch.setattr(retrieve, "MAX_QUESTIONS", len(keys) - 1)  # so many that they are joined
    db = duckdb.connect()
    db.sql(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    want = db.sql(entries.oracle_sql()[name]).fetchall()
    assert sorted(map(tuple, entries.queries()[name](spark, str(tmp_path)).collect())) == sorted(want)
