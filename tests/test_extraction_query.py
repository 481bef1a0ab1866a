import os

import duckdb

import __spark_entry__


def test_v_extraction_equals_its_sql(spark, sf_dir):
    # Its agreements were built without saying how firms are named, which is an error.
    got = __spark_entry__.queries()["v_extraction"](spark, sf_dir)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{os.path.join(sf_dir, 'supplier.parquet')}'")
    want = con.execute(__spark_entry__.oracle_sql()["v_extraction"]).fetchall()
    assert want and sorted(map(tuple, got.collect())) == sorted(want)
