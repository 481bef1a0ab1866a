import glob

import pytest
from pyspark.sql import functions as F

from quillstone.operators import suite

RESULT = "case_id string, correct boolean, latency_ms double"


def evaluation(spark, fail_at=None, seen=None):
    def run(cell):
        if seen is not None:
            seen.append((cell["configuration"], cell["partition"], cell["repetition"]))
        if cell["configuration"] == fail_at:
            raise RuntimeError("killed")
        return spark.createDataFrame([(f"{cell['partition']}{i}", i % 2 == 0 or cell["configuration"] == "B", 10.0 + i) for i in range(4)], RESULT)

    return run


def test_a_killed_suite_resumes_and_tampering_is_refused(spark, tmp_path):
    own = suite.Suite(spark, f"{tmp_path}/s", RESULT)
    planned = suite.cells(spark, {"A": "{}", "B": '{"k": 5}'}, ["calibration"], 2)
    with pytest.raises(RuntimeError, match="killed"):
        own.run(planned, evaluation(spark, fail_at="B"))
    assert own.ledger().count() == 2 and own.results().count() == 8 and not own.complete(planned)
    seen = []
    assert suite.Suite(spark, f"{tmp_path}/s", RESULT).run(planned, evaluation(spark, seen=seen)) == 2
    assert seen == [("B", "calibration", 1), ("B", "calibration", 2)] and own.complete(planned)
    assert own.run(planned, evaluation(spark)) == 0
    found = {r.configuration: (r.repetitions, r.stable, r.correct) for r in suite.summary(own.results().withColumn("correct", F.col("correct").cast("int")), own.ledger(), "correct").collect()}
    assert found == {"A": (2, True, 0.5), "B": (2, True, 1.0)}
    # Other parameters are other cells.
    assert own.pending(suite.cells(spark, {"A": '{"k": 9}'}, ["calibration"], 1)).count() == 1
    # Somebody edits a stored result.
    folder = sorted(glob.glob(f"{tmp_path}/s/tables/results/*"))[0]
    edited = spark.createDataFrame([tuple(r) for r in spark.read.parquet(folder).withColumn("correct", F.lit(True)).collect()], f"cell string, {RESULT}, commit bigint")
    edited.write.mode("overwrite").parquet(folder)
    with pytest.raises(suite.Tampered):
        own.run(planned, evaluation(spark))
    assert own.altered().count() == 1 and not own.complete(planned)


def test_digests_know_contents_not_order(spark):
    rows = [("c", 1, "x"), ("c", 2, None), ("c", 2, None), ("d", 1, "x")]
    frame = spark.createDataFrame(rows, "cell string, n int, s string")
    one, two = ({r.cell: (r.digest, r["rows"]) for r in suite.digests(f).collect()} for f in (frame, spark.createDataFrame(rows[::-1], frame.schema).repartition(3)))
    assert one == two and one["c"][1] == 3
    fewer = {r.cell: r.digest for r in suite.digests(spark.createDataFrame(rows[1:], frame.schema)).collect()}
    assert fewer["c"] != one["c"][0] and fewer["d"] == one["d"][0]
