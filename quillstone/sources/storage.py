"""Stored files and a queue of tasks, as tables that change by commits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.sources.snapshots import Snapshot, Store

FILES = "key string, data binary, deleted boolean"
TASKS = "job string, document_id string, task_id string, correlation_id string"


def safe_key(key: Column) -> Column:
    """Whether a key names a place below the root: relative, with forward slashes, without empty, `.` or `..` segments."""
    parts = F.split(key, "/")
    return F.coalesce(~F.contains(key, F.lit("\\")) & ~F.contains(key, F.lit("\0")) & ~F.exists(parts, lambda p: p.isin("", ".", "..")), F.lit(False))


class Files:
    """Contents by key. A put replaces what the key had; a set of files is put or deleted at once."""

    def __init__(self, store: Store):
        self.store = store

    def _newest(self, at: Snapshot, keys: list[str] | None = None) -> DataFrame:
        rows = self.store.read("files", FILES, at)
        if keys is not None:
            rows = rows.where(F.col("key").isin(keys))
        newest = rows.groupBy("key").agg(F.max_by(F.struct("data", "deleted"), "commit").alias("f"))
        return newest.where("NOT f.deleted").select("key", "f.data")

    def put(self, files: DataFrame) -> None:
        """Takes key and data. Unsafe and repeated keys are an error, and nothing is put."""
        if bad := [r["key"] for r in files.where(~safe_key(F.col("key"))).limit(3).collect()]:
            raise ValueError(f"unsafe keys: {bad}")
        if twice := [r["key"] for r in files.groupBy("key").count().where("count > 1").limit(3).collect()]:
            raise ValueError(f"repeated keys: {twice}")
        rows = files.select("key", "data", F.lit(False).alias("deleted"))
        self.store.change(lambda base: {"append": {"files": rows}})

    def get(self, keys: list[str], at: Snapshot | None = None) -> DataFrame:
        """key and data of those that are there."""
        return self._newest(at or self.store.snapshot(), keys)

    def delete(self, keys: list[str]) -> int:
        """How many of these there were."""
        found = 0

        def changes(base: Snapshot) -> dict | None:
            nonlocal found
            gone = self._newest(base, keys).select("key", F.lit(None).cast("binary").alias("data"), F.lit(True).alias("deleted"))
            found = gone.count()
            return {"append": {"files": gone}} if found else None

        self.store.change(changes)
        return found


class Queue:
    """Tasks in the order of commits. What a consumer makes of a batch and how far it has come are one commit, so each task counts once."""

    def __init__(self, store: Store, consumer: str = "worker", keep: int = 1000):
        self.store, self.consumer, self.keep = store, consumer, keep

    def _offset(self, at: Snapshot) -> int:
        return at.streams.get(self.consumer, 0)

    def waiting(self, at: Snapshot | None = None) -> DataFrame:
        at = at or self.store.snapshot()
        return self.store.read("tasks", TASKS, at, self._offset(at))

    def enqueue(self, tasks: DataFrame) -> None:
        """Takes document_id, task_id and correlation_id. A document that waits, or was enqueued within the last `keep` commits, isn't taken again; of several tasks for one, the one with the least task_id is."""
        first = tasks.groupBy("document_id").agg(F.min_by(F.struct("task_id", "correlation_id"), "task_id").alias("t"))
        rows = first.select(F.concat(F.lit("document:"), "document_id").alias("job"), "document_id", "t.task_id", "t.correlation_id")

        def changes(base: Snapshot) -> dict:
            known = self.store.read("tasks", TASKS, base, min(self._offset(base), max(0, base.number - self.keep)))
            return {"append": {"tasks": rows.join(known.select("job"), "job", "left_anti")}}

        self.store.change(changes)

    def consume(self, handle: Callable[[DataFrame], dict[str, DataFrame]]) -> int:
        """Hand over all tasks that wait; rows that `handle` returns, by table, are committed with the new offset. How many tasks there were."""
        taken = 0

        def changes(base: Snapshot) -> dict | None:
            nonlocal taken
            rows = self.waiting(base)
            taken = rows.count()
            return {"append": handle(rows), "stream": (self.consumer, base.number)} if taken else None

        self.store.change(changes)
        return taken
