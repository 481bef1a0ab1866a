import pytest
from pyspark.sql import functions as F

from quillstone.sources import storage
from quillstone.sources.snapshots import Store


def test_put_get_delete_and_guard(spark, tmp_path):
    files = storage.Files(Store(spark, f"{tmp_path}/s"))
    put = lambda *rows: files.put(spark.createDataFrame(list(rows), "key string, data binary"))
    put(("a/document.pdf", b"1"), ("b/document.txt", b"2"))
    pinned = files.store.snapshot()
    put(("a/document.pdf", b"3"))
    assert {r.key: bytes(r.data) for r in files.get(["a/document.pdf", "b/document.txt", "c"]).collect()} == {"a/document.pdf": b"3", "b/document.txt": b"2"}
    assert files.delete(["a/document.pdf", "c"]) == 1 and files.delete(["a/document.pdf"]) == 0
    assert files.get(["a/document.pdf"]).collect() == []
    assert bytes(files.get(["a/document.pdf"], pinned).first().data) == b"1"
    for key in ("../x", "a/../../x", "/etc/x", "a\\..\\x", "a//b", "", ".", None):
        with pytest.raises(ValueError, match="unsafe"):
            put(("fine", b"x"), (key, b"x"))
    with pytest.raises(ValueError, match="repeated"):
        put(("k", b"1"), ("k", b"2"))
    assert files.get(["fine", "k"]).collect() == []


def test_queue_counts_each_task_once(spark, tmp_path):
    queue = storage.Queue(Store(spark, f"{tmp_path}/q"))
    add = lambda *rows: queue.enqueue(spark.createDataFrame(list(rows), "document_id string, task_id string, correlation_id string"))
    add(("a", "t2", "x"), ("a", "t1", "y"), ("b", "t3", "z"))
    add(("b", "t4", "w"), ("c", "t5", "v"))
    assert sorted((r.job, r.task_id) for r in queue.waiting().collect()) == [("document:a", "t1"), ("document:b", "t3"), ("document:c", "t5")]
    done = lambda rows: {"done": rows.select("document_id")}
    with pytest.raises(RuntimeError):
        queue.consume(lambda rows: (_ for _ in ()).throw(RuntimeError("killed")))
    assert queue.consume(done) == 3 and queue.consume(done) == 0
    add(("a", "t9", "u"), ("d", "t6", "u"))  # a is remembered
    assert [r.document_id for r in queue.waiting().collect()] == ["d"]
    assert queue.consume(done) == 1
    assert sorted(r.document_id for r in queue.store.read("done", "document_id string").collect()) == ["a", "b", "c", "d"]
    # A batch reads what came after its offset, not the history.
    assert len(queue.waiting().inputFiles()) == 0
    forgetful = storage.Queue(queue.store, keep=0)
    forgetful.enqueue(spark.createDataFrame([("a", "t10", "u")], "document_id string, task_id string, correlation_id string"))
    assert forgetful.waiting().agg(F.max("task_id")).first()[0] == "t10"
