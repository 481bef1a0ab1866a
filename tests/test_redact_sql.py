import duckdb
import pytest

import __spark_entry__

#: Accents beside addresses, letters that fold, digits past ASCII, and numbers that share a separator.
TEXTS = [
    "josé.garcía@example.com", "éa@b.co", "ıa@b.co, İa@b.co and a@b.coſ", "ſYN-ID-4829 SYN-İD-4829 éSYN-ID-4829", "1234567890́ or ١234567890",
    "12345678901 470 12 34 56 78 90", "12345678901 12345678902 12345678903", "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19", "+32 470 12 34 56\n", "[PHONE REDACTED] 123456789", "plain", "", None,
    "1234567890\u0870 1234567890\u9ffd",  # letters since Unicode 14
]


@pytest.mark.parametrize("name", ["x_redact", "x_redact_email"])
def test_odd_texts_are_redacted_as_the_sql_says(spark, tmp_path, name):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = __spark_entry__.queries()[name](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(__spark_entry__.oracle_sql()[name]).fetchall())
