import random

from pyspark.sql import Observation
from pyspark.sql import functions as F

from quillstone.streaming import metrics


def rows(frame):
    return sorted((r.metric, tuple(sorted(r.labels.items())), r.bound if r.bound is not None else -1.0, round(r.value, 9)) for r in frame.collect())


def test_histograms_of_parts_add_up(spark):
    rng = random.Random(1)
    data = [(rng.choice("ab"), rng.choice(["ok", "no", None]), rng.choice([0.004, 0.3, 0.25, 99.0, None, float("nan")])) for _ in range(200)]
    frame = spark.createDataFrame(data, "mode string, result string, seconds double")
    whole = metrics.histogram(frame, "search_duration_seconds")
    parts = [metrics.histogram(spark.createDataFrame(data[i::3], frame.schema), "search_duration_seconds") for i in range(3)]
    assert rows(metrics.merged(*parts)) == rows(whole)
    found = {(r.metric, r.labels["mode"], r.labels["result"], r.bound): r.value for r in whole.collect()}
    sound = [s for m, r, s in data if m == "a" and r is None and s is not None and s == s]
    assert found["search_duration_seconds_count", "a", "", None] == len(sound)
    assert found["search_duration_seconds_bucket", "a", "", 0.25] == sum(s <= 0.25 for s in sound)
    assert metrics.histogram(frame.limit(0), "search_duration_seconds").collect() == []


def test_quantiles_and_text(spark):
    frame = spark.createDataFrame([("m", 'say "x"\\', s) for s in (0.06, 0.07, 0.3, 0.4)] + [("z", "far", 50.0)], "mode string, result string, seconds double")
    own = metrics.histogram(frame, "search_duration_seconds")
    found = {r.labels["mode"]: r.value for r in metrics.quantile(own, "search_duration_seconds", 0.5).collect()}
    assert found == {"m": 0.075, "z": 10.0}
    lines = [r.line for r in metrics.exposition(own).collect()]
    assert 'quillstone_search_duration_seconds_bucket{mode="m",result="say \\"x\\"\\\\",le="0.075"} 2.0' in lines
    assert 'quillstone_search_duration_seconds_count{mode="z",result="far"} 1.0' in lines and sum('le="+Inf"' in x for x in lines) == 2


def test_observed_in_the_same_pass_and_in_a_stream(spark, tmp_path):
    states = spark.createDataFrame([("a", "completed"), ("b", "failed"), ("c", "completed"), ("d", None)], "document_id string, status string")
    seen = Observation("tasks")
    metrics.observed_tasks(states, seen).write.format("noop").mode("overwrite").save()
    assert seen.get == {"completed": 2, "failed": 1, "other": 1}
    listener = metrics.TaskMetrics()
    spark.streams.addListener(listener)
    try:
        for i in range(2):
            states.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(states.schema).parquet(f"{tmp_path}/in")
            counted = stream.observe("document_tasks", F.count_if(F.col("status") == "completed").alias("completed"))
            counted.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    finally:
        spark.streams.removeListener(listener)
    assert listener.counts == {"completed": 4} and listener.batches >= 2
