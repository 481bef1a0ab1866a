"""Ingest as a stream: uploads become pages, chunks and fields, exactly once for each document.

Uploads arrive as files in a folder. Every micro-batch is handled as tables:
duplicates and documents that are done are left out, sound ones are parsed
and written, and their task moves on. Chunks, fields, states and what a request
records beside them are published by one commit; a batch that was committed is
not taken again, and one that met another writer is handled anew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import extract
from quillstone.sources import parse
from quillstone.sources.snapshots import Snapshot, Store

UPLOAD = "document_id string, dossier_id string, filename string, media_type string, data binary, attempt int, deleted boolean"
CHUNKS = "chunk_id string, document_id string, page int, section string, ordinal int, text string"
FIELDS = "document_id string, field string, value_ord int, value string, citation struct<chunk_id:string,page:int,excerpt:string>"
STATUS = "document_id string, dossier_id string, digest string, status string, error_code string, attempts int"
WITHDRAWN = "document_id string"
TABLES = {"chunks": CHUNKS, "fields": FIELDS, "status": STATUS, "withdrawn": WITHDRAWN}
MAX_ATTEMPTS = 3
RETRY_SECONDS = 2
FILES = 1000  # that one batch takes at most


@dataclass(frozen=True)
class Limits:
    """What a document may hold at most to be taken: settings of an engine."""

    pages: int = 200
    chars: int = 1_000_000
    chunks: int = parse.MAX_CHUNKS


#: No document is refused for its size: a text, and an array, have no more elements than that.
UNLIMITED = Limits(2**31 - 1, 2**31 - 1, 2**31 - 1)


def next_state(error_code, attempts, terminal):
    """Status and delay in seconds after an attempt: (Column, Column)."""
    failed = error_code.isNotNull()
    again = failed & ~terminal & (attempts < MAX_ATTEMPTS)
    status = F.when(~failed, "completed").when(again, "queued").otherwise("failed")
    return status, F.when(again, attempts * RETRY_SECONDS)


class Ingest:
    """The tables of an engine under one folder, and the stream that fills them."""

    def __init__(self, spark: SparkSession, folder: str, limits: Limits = Limits()):
        self.spark, self.store, self.limits = spark, Store(spark, folder), limits

    def table(self, name: str, at: Snapshot | None = None) -> DataFrame:
        return self.store.read(name, TABLES[name], at)

    def status(self, at: Snapshot | None = None, of: DataFrame | None = None) -> DataFrame:
        """The newest state of every document, or of those named by `of` (document_id)."""
        rows = self.table("status", at)
        if of is not None:
            rows = rows.join(of.select("document_id"), "document_id", "left_semi")
        newest = rows.groupBy("document_id").agg(F.max_by(F.struct("dossier_id", "digest", "status", "error_code", "attempts", "commit"), "commit").alias("s"))
        return newest.select("document_id", "s.*")

    def withdrawn(self, at: Snapshot | None = None) -> DataFrame:
        """Documents that were deleted, also while a batch that holds them was under way."""
        return self.table("withdrawn", at).select("document_id").distinct()

    def withdraw(self, document_ids: list[str], record=None) -> int:
        """Delete documents; how many there were. `record` makes rows to commit beside them, by table, from the rows that go."""
        found = 0

        def changes(base: Snapshot) -> dict | None:
            nonlocal found
            named = self.spark.createDataFrame([(d,) for d in document_ids], WITHDRAWN)  # a request's list
            gone = self.status(base, named).where("status <> 'deleted'").select("document_id", "dossier_id", "digest")
            found = gone.count()
            if not found:
                return None
            states = gone.select("*", F.lit("deleted").alias("status"), F.lit("document_deleted").alias("error_code"), F.lit(0).alias("attempts"))
            return {"append": {"withdrawn": gone.select("document_id"), "status": states, **(record(gone) if record else {})}}

        self.store.change(changes)
        return found

    def handle(self, batch: DataFrame, number: int | None = None, record: dict[str, DataFrame] | None = None, stream: str = "uploads") -> None:
        """One micro-batch of uploads, committed whole; `number` is its place in a stream, `record` rows to commit beside it.

        An upload without data is one whose file can't be read now: it is
        queued again, until it has been tried MAX_ATTEMPTS times. What is
        wrong with a file itself is final.
        """

        def changes(base: Snapshot) -> dict | None:
            if number is not None and base.streams.get(stream, -1) >= number:
                return None
            return {"append": self._outcome(batch, base, held) | (record or {}), "stream": None if number is None else (stream, number)}

        held: list[DataFrame] = []
        try:
            self.store.change(changes)
        finally:
            for rows in held:
                rows.unpersist()

    def _outcome(self, batch: DataFrame, base: Snapshot, held: list[DataFrame]) -> dict[str, DataFrame]:
        """Rows to append, by table; what is held for them goes to `held`."""

        def hold(rows: DataFrame) -> DataFrame:
            held.append(rows.persist(StorageLevel.DISK_ONLY))
            return rows

        digest = F.sha2("data", 256)
        arrived = batch.withColumn("digest", digest).dropDuplicates(["document_id"])
        is_gone = F.col("gone").isNotNull() | F.coalesce("deleted", F.lit(False))
        arrived = arrived.join(self.withdrawn(base).withColumn("gone", F.lit(True)), "document_id", "left")
        withdrawn = arrived.where(is_gone)
        fresh = arrived.where(~is_gone).drop("gone")
        # Of equal contents in a dossier one is taken; files that can't be read have none yet.
        first = fresh.groupBy("dossier_id", F.coalesce("digest", "document_id").alias("same")).agg(F.min("document_id").alias("document_id"))
        fresh = fresh.join(first.select("document_id"), "document_id", "left_semi")
        # What the dossier holds under another id, and what is completed or withdrawn, is not taken again.
        alike = self.table("status", base).join(fresh.select("digest").where("digest IS NOT NULL"), "digest", "left_semi")
        known = hold(self.status(base, fresh.select("document_id").unionByName(alike.select("document_id"))))
        active = known.where("status IN ('completed', 'processing', 'queued')").select("dossier_id", "digest", F.col("document_id").alias("_other"))
        fresh = fresh.join(active, (fresh["dossier_id"] == active["dossier_id"]) & (fresh["digest"] == active["digest"]) & (fresh["document_id"] != active["_other"]), "left_anti")
        settled = known.where("status IN ('completed', 'deleted', 'failed')").select("document_id")
        fresh = hold(fresh.join(settled, "document_id", "left_anti"))
        tried = known.select("document_id", F.col("attempts").alias("_tried"))
        readable = fresh.where("data IS NOT NULL")
        pages, parse_errors = parse.parse(readable.select("document_id", "media_type", "data"), self.limits.pages, self.limits.chars, hold)
        chunks, chunk_errors = parse.document_chunks(pages, max_chunks=self.limits.chunks, hold=hold)
        chunks = hold(chunks)
        fields = extract.extract_labelled(chunks)
        unread = fresh.where("data IS NULL").select("document_id", F.lit("storage_unavailable").alias("error_code"))
        errors = parse_errors.unionByName(chunk_errors).unionByName(unread)
        attempts = F.coalesce("_tried", F.lit(0)) + 1
        outcome = fresh.join(errors, "document_id", "left").join(tried, "document_id", "left").withColumn("attempts", attempts)
        final = ~F.coalesce(F.col("error_code") == "storage_unavailable", F.lit(False))
        status, _ = next_state(F.col("error_code"), F.col("attempts"), final)
        done = outcome.select("document_id", "dossier_id", "digest", status.alias("status"), "error_code", "attempts")
        gone = withdrawn.select("document_id", "dossier_id", "digest", F.lit("deleted").alias("status"), F.lit("document_deleted").alias("error_code"), F.lit(0).alias("attempts"))
        return {"chunks": chunks, "fields": fields, "status": done.unionByName(gone)}

    def due(self) -> DataFrame:
        """document_id and seconds to wait of what is to be handed in again."""
        _, delay = next_state(F.col("error_code"), F.col("attempts"), F.lit(False))
        return self.status().where("status = 'queued'").select("document_id", delay.alias("seconds"))

    def start(self, uploads: str, checkpoint: str):
        """Take all files that are there, in micro-batches, and stop."""
        stream = self.spark.readStream.schema(UPLOAD).option("maxFilesPerTrigger", FILES).parquet(uploads)
        return stream.writeStream.foreachBatch(self.handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def content(self, at: Snapshot | None = None) -> DataFrame:
        """Chunks of completed documents that weren't withdrawn, at no time; all as of one snapshot."""
        at = at or self.store.snapshot()
        done = self.status(at).where("status = 'completed'").select("document_id")
        return self.table("chunks", at).join(self.withdrawn(at), "document_id", "left_anti").join(done, "document_id", "left_semi").drop("commit")


def audit_log(status: DataFrame) -> DataFrame:
    """One event for each state that a document came to."""
    return status.select("document_id", F.concat(F.lit("document_"), "status").alias("action"), F.when(F.col("error_code").isNull(), "success").otherwise("failure").alias("result"), F.to_json(F.struct("error_code", "attempts")).alias("metadata"), "commit")
