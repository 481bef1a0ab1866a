import random

from pyspark.sql import functions as F

from quillstone.streaming import ingest, rate_limit


def upload(spark, folder, rows):
    spark.createDataFrame(rows, ingest.UPLOAD).coalesce(1).write.mode("append").parquet(folder)


def test_ingest_is_idempotent(spark, tmp_path):
    uploads, engine = f"{tmp_path}/up", ingest.Ingest(spark, f"{tmp_path}/out")
    text = b"Organization: Northstar Ltd\nEffective date: 2026-01-15"
    upload(spark, uploads, [("a", "d1", "a.txt", "text/plain", text, 1, False), ("b", "d1", "b.txt", "text/plain", b"\xff", 1, False), ("c", "d2", "c.md", "text/markdown", b"# T\n\nx", 1, False)])
    engine.start(uploads, f"{tmp_path}/check").awaitTermination()
    first = {r.document_id: (r.status, r.error_code) for r in engine.status().collect()}
    assert first == {"a": ("completed", None), "b": ("failed", "invalid_text"), "c": ("completed", None)}
    upload(spark, uploads, [("a", "d1", "a.txt", "text/plain", text, 2, False), ("e", "d1", "again.txt", "text/plain", text, 1, False), ("c", "d2", "c.md", "text/markdown", b"", 1, True)])
    engine.start(uploads, f"{tmp_path}/check").awaitTermination()
    second = {r.document_id: r.status for r in engine.status().collect()}
    assert second == {"a": "completed", "b": "failed", "c": "deleted"}
    assert {r.document_id for r in engine.content().collect()} == {"a"}
    assert engine.table("fields").where("document_id = 'a' AND field = 'effective_date'").first().value == "2026-01-15"
    assert {r.action for r in ingest.audit_log(engine.table("status")).collect()} == {"document_completed", "document_failed", "document_deleted"}


def test_retry_rule(spark):
    rows = spark.createDataFrame([("x", 1, False), ("x", 3, False), ("x", 1, True), (None, 1, False)], "e string, a int, t boolean")
    status, delay = ingest.next_state(F.col("e"), F.col("a"), F.col("t"))
    assert [tuple(r) for r in rows.select(status, delay).collect()] == [("queued", 2), ("failed", None), ("failed", None), ("completed", None)]


def brute(rows, limit, window):
    logs, out = {}, {}
    for client, request, at in sorted(rows, key=lambda r: (r[2], r[1])):
        log = logs.setdefault(client, [])
        recent = [t for t in log if t > at - window]
        out[request] = len(recent) < limit
        if out[request]:
            log.append(at)
    return out


def test_rate_limit_batch_and_stream(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), i, rng.randrange(10_000_000)) for i in range(200)]
    schema = "client string, request_id long, micros long"
    frame = spark.createDataFrame(rows, schema)
    found = {r.request_id: r.admitted for r in rate_limit.limit_requests(frame, 5, 1_000_000).collect()}
    assert found == brute(rows, 5, 1_000_000)
    frame.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = rate_limit.limit_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 5, 1_000_000, expire=False)
    stream.writeStream.format("memory").queryName("limited").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(60)
    assert {r.request_id: r.admitted for r in spark.table("limited").collect()} == found


def bounded(rows, limit, window, most):
    known, out = {}, {}
    for client, request, at in sorted(rows, key=lambda r: (r[2], r[1])):
        if client not in known and len(known) >= most:
            del known[min(known, key=lambda c: (known[c][-1], c))]
        log = known.setdefault(client, [])
        log[:] = [t for t in log if t > at - window]
        out[request] = len(log) < limit
        if out[request]:
            log.append(at)
    return out, known


def test_bounded_limiter_forgets_who_came_least_lately(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice("abcdefgh"), i, 100_000 * i + rng.randrange(1000)) for i in range(120)]
    schema = "client string, request_id long, micros long"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", rate_limit.ROCKSDB)
    try:
        for part in (rows[:70], rows[70:]):  # two runs over one state
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = rate_limit.limit_stream_bounded(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 2, 3_000_000, clients=3, shards=1, expire=False)
            stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
        expected, known = bounded(rows, 2, 3_000_000, 3)
        assert {r.request_id: r.admitted for r in spark.read.parquet(f"{tmp_path}/out").collect()} == expected
        state = spark.read.format("statestore").option("stateVarName", "log").load(f"{tmp_path}/c")
        assert {r.c: r.m for r in state.select(F.col("user_map_key.client").alias("c"), F.col("user_map_value.micros").alias("m")).collect()} == known
        assert state.count() == 3
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
