import pytest
from pyspark.sql import functions as F

from quillstone.engine import Engine
from quillstone.operators import service
from quillstone.sources import snapshots
from quillstone.streaming import ingest

ADMIN = ("ann", "admin")
ROW = "id int, v string"


def rows(spark, *values):
    return spark.createDataFrame([(v, str(v)) for v in values], ROW)


def ids(store, name, at=None):
    return sorted(r.id for r in store.read(name, ROW, at).collect())


def test_commits_are_seen_whole_and_pinned(spark, tmp_path):
    store = snapshots.Store(spark, f"{tmp_path}/s")
    assert store.snapshot().number == 0 and ids(store, "a") == []
    first = store.commit(store.snapshot(), append={"a": rows(spark, 1), "b": rows(spark, 10)})
    second = store.commit(first, append={"a": rows(spark, 2)}, replace={"b": store.read("b", ROW, first).select("id", "v").union(rows(spark, 11))})
    assert (ids(store, "a"), ids(store, "b")) == ([1, 2], [10, 11])
    assert (ids(store, "a", first), ids(store, "b", first)) == ([1], [10])
    assert {r["commit"] for r in store.read("a", ROW).collect()} == {1, 2} and second.number == 2
    with pytest.raises(snapshots.Conflict):
        store.commit(first, append={"a": rows(spark, 9)})
    assert ids(store, "a") == [1, 2]


def test_a_writer_that_dies_between_tables_leaves_nothing(spark, tmp_path, monkeypatch):
    store = snapshots.Store(spark, f"{tmp_path}/s")
    first = store.commit(store.snapshot(), append={"a": rows(spark, 1), "b": rows(spark, 1)})
    broken = rows(spark, 5).withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        store.commit(first, append={"a": rows(spark, 5), "b": broken})
    assert (ids(store, "a"), ids(store, "b"), store.snapshot().number) == ([1], [1], 1)
    monkeypatch.setattr(store, "_publish", lambda snapshot: (_ for _ in ()).throw(OSError("before the manifest")))
    with pytest.raises(OSError):
        store.commit(first, append={"a": rows(spark, 6)})
    monkeypatch.undo()
    store.commit(store.snapshot(), append={"a": rows(spark, 2)})
    assert ids(store, "a") == [1, 2]
    assert store.vacuum(keep=1) == 3 and ids(store, "a") == [1, 2]


def test_change_starts_anew_after_a_conflict(spark, tmp_path):
    store, seen = snapshots.Store(spark, f"{tmp_path}/s"), []

    def make(base):
        seen.append(base.number)
        if len(seen) == 1:  # somebody else is faster
            store.commit(base, append={"a": rows(spark, 1)})
        return {"append": {"a": rows(spark, 100 + len(ids(store, "a", base)))}}

    store.change(make)
    assert seen == [0, 1] and ids(store, "a") == [1, 101]
    store.compact("a", ROW)
    assert len(store.snapshot().tables["a"]) == 1 and ids(store, "a") == [1, 101]


def upload(*documents):
    return [(d, "x", f"{d}.txt", "text/plain", text, 1, False) for d, text in documents]


def test_stream_and_uploads_share_one_order(spark, tmp_path):
    engine = Engine(spark, f"{tmp_path}/e")
    files = spark.createDataFrame([("u", "u.txt", "text/plain", b"Annual fee: EUR 5.")], "document_id string, filename string, declared string, data binary")
    assert [r.outcome for r in engine.upload(ADMIN, "x", files).collect()] == ["accepted"]
    # The stream's first batch has number 0, and still sees what was uploaded before.
    batch = spark.createDataFrame(upload(("s", b"Annual fee: EUR 5."), ("t", b"Owner: Ada.")), ingest.UPLOAD)
    engine.ingest.handle(batch, 0)
    state = {r.document_id: r.status for r in engine.ingest.status().collect()}
    assert state == {"u": "completed", "t": "completed"}  # s has the contents of u
    before = engine.store.snapshot()
    engine.ingest.handle(batch, 0)  # handed in again after a failure: committed already
    assert engine.store.snapshot() == before
    assert engine.delete(ADMIN, ["u", "t", "nobody"]) == 2
    assert engine.ingest.content().count() == 0 and engine.ingest.content(before).count() == 2
    engine.ingest.handle(spark.createDataFrame(upload(("u", b"Annual fee: EUR 5.")), ingest.UPLOAD), 1)
    assert {r.status for r in engine.ingest.status().where("document_id IN ('u', 't')").collect()} == {"deleted"}
    events = [r.action for r in engine.audit_events(ADMIN).collect()]
    assert sorted(events) == ["document.delete", "document.delete", "document.upload"]


def test_replaced_file_is_never_missing(spark, tmp_path):
    for text in ("one", "two"):
        service.replace_file(spark, f"{tmp_path}/f", text)
        assert (tmp_path / "f").read_text() == text
