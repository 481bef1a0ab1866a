"""The engine as a service sees it: each request is a query over the tables of one folder, guarded by what the caller's role may do."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import patterns as P
from quillstone.operators import evaluation, providers, retrieve, service
from quillstone.sources import datasets, parse
from quillstone.sources.snapshots import Snapshot
from quillstone.streaming import ingest

AUDIT = "id string, actor string, action string, document_id string, result string, correlation_id string, metadata_safe map<string,string>, created_at timestamp"
USERS = "username string, password_hash string, role string, is_active boolean"
DOSSIERS = "id string, name string, description string, is_synthetic boolean"
RUNS = "id string, dataset_version string, parameters_version string, split string, mode string, metrics map<string,string>, verdict string, created_at timestamp"
TABLES = {"users": USERS, "dossiers": DOSSIERS, "audit_events": AUDIT, "evaluations": RUNS}
STATES = ("queued", "processing", "completed", "failed", "deleted")


class Forbidden(PermissionError):
    """The role may not do this."""


class Engine:
    """Tables, an ingest that fills them, and the providers of one mode. A caller is named by (username, role)."""

    def __init__(self, spark: SparkSession, folder: str, bundle: providers.Bundle | None = None):
        self.spark = spark
        self.bundle = bundle or providers.bundle("grounded")
        self.ingest = ingest.Ingest(spark, folder)
        self.store = self.ingest.store

    # --- tables ---

    def _table(self, name: str, at: Snapshot | None = None) -> DataFrame:
        return self.store.read(name, TABLES[name], at).drop("commit")

    def _events(self, caller, action: str, result: str = "success", documents: DataFrame | None = None, **safe: str) -> DataFrame:
        """An event, or one for each of the documents (document_id); what goes into it never holds documents' or questions' text."""
        rows = (self.spark.range(1).select(F.lit(None).cast("string").alias("document_id")) if documents is None else documents).select("document_id")
        entries = [F.lit(x) for k, v in safe.items() for x in (k, str(v))]
        return rows.select(
            F.expr("uuid()").alias("id"), F.lit(caller and caller[0]).cast("string").alias("actor"), F.lit(action).alias("action"), "document_id", F.lit(result).alias("result"),
            F.lit(str(uuid.uuid4())).alias("correlation_id"), F.create_map(*entries).cast("map<string,string>").alias("metadata_safe"), F.current_timestamp().alias("created_at"),
        )

    def _audit(self, caller, action: str, result: str = "success", **safe: str) -> None:
        """Record a request that changes nothing else."""
        self.store.change(lambda base: {"append": {"audit_events": self._events(caller, action, result, **safe)}})

    def _may(self, caller, action: str) -> None:
        if caller is None or action not in P.ROLE_ACTIONS.get(caller[1], ()):
            raise Forbidden(action)

    # --- requests ---

    def health(self) -> DataFrame:
        return self.spark.range(1).select(F.lit("ok").alias("status"))

    def ready(self) -> bool:
        return self.spark.range(1).count() == 1

    def put_users(self, named: DataFrame) -> None:
        self.store.change(lambda base: {"replace": {"users": service.upsert_users(self._table("users", base), named)}})

    def put_dossiers(self, rows: DataFrame) -> None:
        self.store.change(lambda base: {"append": {"dossiers": service.insert_new(self._table("dossiers", base), rows, ["id"])}})

    def sign_in(self, username: str, verify) -> tuple[str, str] | None:
        """The caller, if the user is active and `verify` takes the stored hash; both outcomes are recorded."""
        found = service.lookup(self._table("users"), "username", username).where("is_active").first()
        ok = found is not None and verify(found["password_hash"])
        self._audit((username, ""), "auth.login", "success" if ok else "failure")
        return (found["username"], found["role"]) if ok else None

    def me(self, caller) -> DataFrame:
        return service.lookup(self._table("users"), "username", caller[0]).where(F.col("is_active") & (F.col("role") == caller[1])).select("username", "role")

    def dossiers(self, caller) -> DataFrame:
        self._may(caller, "view_document")
        return self._table("dossiers").orderBy("name", "id")

    def documents(self, caller, dossier: str) -> DataFrame:
        self._may(caller, "view_document")
        return self.ingest.status().where((F.col("dossier_id") == dossier) & (F.col("status") != "deleted")).orderBy(F.desc("commit"), "document_id")

    def document(self, caller, document_id: str) -> DataFrame:
        self._may(caller, "view_document")
        return service.lookup(self.ingest.status(), "document_id", document_id).where("status <> 'deleted'")

    def content(self, caller, document_id: str) -> DataFrame:
        self._may(caller, "view_document")
        return service.lookup(self.ingest.content(), "document_id", document_id).select(F.col("chunk_id").alias("id"), "page", "section", "ordinal", "text").orderBy("page", "ordinal")

    def upload(self, caller, dossier: str, files: DataFrame, max_bytes: int = 10_000_000, allow_list: DataFrame | None = None) -> DataFrame:
        """Take files (document_id, filename, declared, data): document_id and outcome, accepted, duplicate or the code of what is wrong."""
        self._may(caller, "upload_document")
        listed = files if allow_list is None else service.admissible(files, allow_list)
        listed = listed.select("document_id").withColumn("listed", F.lit(True))
        wrong = parse.upload_error(F.col("filename"), F.col("declared"), F.col("data"), max_bytes)
        checked = files.join(listed, "document_id", "left").withColumn("code", F.when(F.col("listed").isNull(), "not_allowed").otherwise(wrong))
        sound = checked.where("code IS NULL").select("document_id", F.lit(dossier).alias("dossier_id"), "filename", parse.media_type(F.col("filename")).alias("media_type"), "data", F.lit(1).alias("attempt"), F.lit(False).alias("deleted"))
        self.ingest.handle(sound, record={"audit_events": self._events(caller, "document.upload", count=checked.count())})
        state = self.ingest.status(of=checked).select("document_id", "status", "error_code")
        out = checked.join(state, "document_id", "left").select("document_id", F.coalesce("code", F.when(F.col("status").isNull(), "duplicate").when(F.col("status") == "failed", F.col("error_code")).otherwise("accepted")).alias("outcome"))
        return out

    def delete(self, caller, document_ids: list[str]) -> int:
        """Withdraw documents: their state says so, and nothing derived from them is read any more. How many there were. States and events are one commit."""
        self._may(caller, "delete_document")
        return self.ingest.withdraw(document_ids, lambda gone: {"audit_events": self._events(caller, "document.delete", documents=gone)})

    def ask(self, caller, dossier: str, questions: DataFrame) -> DataFrame:
        """Answers to questions (question_id, question) of 1 to 1000 characters from a dossier's documents."""
        self._may(caller, "ask_question")
        asked = questions.where(F.length("question").between(1, 1000))
        at = self.store.snapshot()
        names = self.ingest.status(at).where(F.col("dossier_id") == dossier).select("document_id", F.col("document_id").alias("document_name"))
        chunks = self.ingest.content(at).join(names, "document_id")
        out = service.answer_view(self.bundle.ask(asked, chunks))
        self._audit(caller, "question.ask", mode=self.bundle.mode)
        return out.withColumn("mode", F.lit(self.bundle.mode))

    def extraction(self, caller, dossier: str) -> DataFrame:
        """Fields of completed documents, without what gives instructions."""
        self._may(caller, "view_extraction")
        at = self.store.snapshot()
        done = self.ingest.status(at).where((F.col("dossier_id") == dossier) & (F.col("status") == "completed")).select("document_id")
        fields = self.ingest.table("fields", at).drop("commit").join(done, "document_id", "left_semi")
        return fields.where(~retrieve.T.untrusted(F.col("value"))).orderBy("document_id", "field", "value_ord")

    def audit_events(self, caller, limit: int = 200) -> DataFrame:
        self._may(caller, "view_audit")
        return service.view(self._table("audit_events").orderBy(F.desc("created_at"), "id").limit(limit).withColumnRenamed("actor", "actor_id"), "audit_event")

    def evaluations(self, caller) -> DataFrame:
        self._may(caller, "view_document")
        return self._table("evaluations").orderBy(F.desc("created_at"), "id")

    def run_evaluation(self, caller, corpus: DataFrame, manifest: DataFrame, split: str = "development") -> DataFrame:
        """Evaluate a manifest and record the run. Only the development split may be asked for."""
        self._may(caller, "run_evaluation")
        if split != "development":
            raise ValueError("only the development split is evaluated on request")
        _, metrics = evaluate_manifest(corpus, manifest, split, self.bundle)
        head = manifest.select("dataset_version", "parameters_version").first()
        names = [c for c in metrics.columns if c != "verdict"]
        entries = F.create_map(*(x for n in names for x in (F.lit(n), F.col(n).cast("string"))))
        rows = metrics.select(F.lit(str(uuid.uuid4())).alias("id"), F.lit(head[0]).alias("dataset_version"), F.lit(head[1]).alias("parameters_version"), F.lit(split).alias("split"), F.lit(self.bundle.mode).alias("mode"), service.run_record(entries).alias("metrics"), "verdict", F.current_timestamp().alias("created_at"))
        kept = self.spark.createDataFrame(rows.collect(), RUNS)  # one row
        event = self._events(caller, "evaluation.run", kept.first()["verdict"].lower(), split=split)
        self.store.change(lambda base: {"append": {"evaluations": kept, "audit_events": event}})
        return kept

    def status(self, caller) -> DataFrame:
        """How many documents are in each state, states without any included."""
        self._may(caller, "view_audit")
        domain = self.spark.createDataFrame([(s,) for s in STATES], "status string")
        return domain.join(self.ingest.status().groupBy("status").count(), "status", "left").select("status", F.coalesce("count", F.lit(0)).alias("documents"))


def evaluate_manifest(corpus: DataFrame, manifest: DataFrame, split: str, bundle: providers.Bundle) -> tuple[DataFrame, DataFrame]:
    """Case rows and metrics of a manifest's cases of a split over its corpus.

    Personal data goes before chunks are made; a case's scope is the documents
    it names, or all.
    """
    versions = {r[0] for df in (corpus, manifest) for r in df.select("dataset_version").collect()}
    if len(versions) != 1:
        raise ValueError("corpus and manifest are of different versions")
    pages = datasets.pages_of(corpus)
    names = pages.select("document_id", F.col("filename").alias("document_name")).distinct()
    blocks = pages.select("document_id", F.col("page").cast("int").alias("page"), F.lit(0).alias("block"), F.lit(None).cast("string").alias("section"), "text")
    chunks, errors = parse.document_chunks(blocks)
    if failed := [r["document_id"] for r in errors.limit(5).collect()]:
        raise ValueError(f"documents with too many chunks: {', '.join(map(str, failed))}")
    chunks = providers.with_vectors(chunks.join(names, "document_id"), bundle.embedder)
    cases = datasets.cases_of(manifest).where(F.col("split") == split)
    asked = cases.select(F.col("id").alias("question_id"), "question", "document_ids")
    asked = providers.with_vectors(asked, bundle.embedder, "question").withColumnRenamed("embedding_model_id", "model_id")
    ranked = retrieve.rank(asked, chunks, bundle.method)
    answers = bundle.answers(asked, ranked)
    if "grounding_error" in answers.columns:
        answers = answers.withColumnRenamed("grounding_error", "error")
    rows = evaluation.case_rows(cases, ranked, answers)
    extraction = None
    if "extraction_targets" in manifest.columns:
        targets = manifest.select(F.explode("extraction_targets").alias("t")).where(F.coalesce(F.col("t.split"), F.lit("development")) == split)
        targets = targets.select(F.col("t.document_id").alias("document_id"), F.explode("t.fields").alias("f")).select("document_id", "f.field", "f.expected", "f.citations")
        extraction = evaluation.extraction_rows(targets, bundle.extraction(chunks))
    return rows, evaluation.metrics(rows, extraction)


def benchmark(corpus: DataFrame, manifest: DataFrame, split: str, bundle: providers.Bundle) -> tuple[DataFrame, DataFrame]:
    """Metrics of each retrieval method, and which one is kept."""
    from dataclasses import replace

    rows = None
    for method in retrieve.METHODS:
        _, metrics = evaluate_manifest(corpus, manifest, split, replace(bundle, method=method))
        own = metrics.withColumn("method", F.lit(method))
        rows = own if rows is None else rows.unionByName(own)
    found = rows.sparkSession.createDataFrame(rows.collect(), rows.schema)  # four rows, computed once
    return found, evaluation.select_method(found)
