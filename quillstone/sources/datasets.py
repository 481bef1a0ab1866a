"""JSON datasets, their rules, stored runs, and files held against a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CORPUS = "dataset_version string, synthetic_only boolean, license string, documents array<struct<id:string,filename:string,pages:array<string>,format:string,source_path:string,language:string>>"
CITATION = "struct<document_id:string,page:int,excerpt:string>"
CASES = f"dataset_version string, parameters_version string, mode string, seed long, cases array<struct<id:string,split:string,kind:string,question:string,expected_answer:string,document_ids:array<string>,expected_citations:array<{CITATION}>>>"
KINDS = ("answerable", "unanswerable", "ambiguous", "adversarial")
SPLITS = ("development", "holdout")
MIN_WORDS = 1
# Modes and field names that datasets hold.
MODES = ("extractive-local", "extractive-local-onnx", "grounded-local-v3")
SCALAR_FIELDS = ("organization_name", "document_type", "effective_date", "renewal_date")
LIST_FIELDS = ("important_amounts", "obligations", "responsible_people", "risks")
TARGETS = f"array<struct<document_id:string,split:string,fields:array<struct<field:string,expected:array<string>,citations:array<{CITATION}>>>>>"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a file, with a declared schema; anything else fails."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def pages_of(corpus: DataFrame) -> DataFrame:
    """document_id, filename, page (from 1) and text."""
    documents = corpus.select(F.explode("documents").alias("d")).select(F.col("d.id").alias("document_id"), "d.filename", F.posexplode("d.pages").alias("at", "text"))
    return documents.select("document_id", "filename", (F.col("at") + 1).alias("page"), "text")


def cases_of(cases: DataFrame) -> DataFrame:
    return cases.select("dataset_version", F.explode("cases").alias("c")).select("dataset_version", "c.*")


def scoped(cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, chunk_id): the chunks that a case may use; all where it names no documents."""
    named = cases.where("document_ids IS NOT NULL").select("id", F.explode("document_ids").alias("document_id")).join(chunks.select("chunk_id", "document_id"), "document_id").select("id", "chunk_id")
    free = cases.where("document_ids IS NULL").select("id")
    return named.unionByName(chunks.select("chunk_id").join(F.broadcast(free), F.lit(True)).select("id", "chunk_id"))  # a stated set of cases


def violations(corpus: DataFrame, cases: DataFrame) -> DataFrame:
    """(rule, id) for everything in a corpus and its cases that breaks a rule."""
    pages, rows = pages_of(corpus), cases_of(cases)
    documents = corpus.select(F.explode("documents").alias("d")).select("d.*")
    cited = rows.select("id", "kind", F.explode("expected_citations").alias("c")).select("id", "kind", "c.*")
    held = cited.join(pages.select("document_id", "page", F.col("text").alias("on_page")), ["document_id", "page"], "left")
    count = F.coalesce(F.size("expected_citations"), F.lit(0))
    unknown = rows.select("id", F.explode("document_ids").alias("document_id")).join(documents.select(F.col("id").alias("document_id")), "document_id", "left_anti")

    def rule(name: str, frame: DataFrame, broken: Column | None = None, key: str = "id") -> DataFrame:
        found = frame if broken is None else frame.where(F.coalesce(broken, F.lit(True)))
        return found.select(F.lit(name).alias("rule"), F.col(key).cast("string").alias("id"))

    rules = [
        rule("duplicate_document", documents.groupBy("id").count(), F.col("count") > 1),
        rule("document_without_pages", documents, F.coalesce(F.size("pages"), F.lit(0)) < 1),
        rule("blank_page", pages, F.trim("text") == "", "document_id"),
        rule("blank_name", documents, F.coalesce(F.trim("filename"), F.lit("")) == ""),
        rule("not_synthetic", corpus, ~F.coalesce("synthetic_only", F.lit(False)), "dataset_version"),
        rule("version_differs", cases.join(corpus.select("dataset_version"), "dataset_version", "left_anti"), None, "dataset_version"),
        rule("duplicate_case", rows.groupBy("id").count(), F.col("count") > 1),
        rule("unknown_kind", rows, ~F.col("kind").isin(*KINDS)),
        rule("unknown_split", rows, ~F.col("split").isin(*SPLITS)),
        rule("blank_question", rows, F.coalesce(F.trim("question"), F.lit("")) == ""),
        rule("question_too_long", rows, F.length("question") > 1000),
        rule("empty_scope", rows.where("document_ids IS NOT NULL"), F.size("document_ids") < 1),
        rule("unknown_document", unknown),
        rule("answer_missing", rows.where("kind = 'answerable'"), F.col("expected_answer").isNull()),
        rule("answer_unexpected", rows.where("kind <> 'answerable'"), F.col("expected_answer").isNotNull()),
        rule("citation_missing", rows.where("kind = 'answerable'"), count < 1),
        rule("citation_unexpected", rows.where("kind = 'unanswerable'"), count > 0),
        rule("citation_page_unknown", held, F.col("on_page").isNull()),
        rule("excerpt_not_on_page", held.where("on_page IS NOT NULL"), ~F.contains("on_page", "excerpt")),
        rule("splits_overlap", rows.where("split = 'development'").select("question").intersect(rows.where("split = 'holdout'").select("question")), None, "question"),
    ]
    rules += [
        rule("no_documents", corpus, F.coalesce(F.size("documents"), F.lit(0)) < 1, "dataset_version"),
        rule("blank_document_id", documents, F.coalesce(F.trim("id"), F.lit("")) == ""),
        rule("blank_case_id", rows, F.coalesce(F.trim("id"), F.lit("")) == ""),
        rule("answer_blank", rows.where("kind = 'answerable' AND expected_answer IS NOT NULL"), F.trim("expected_answer") == ""),
        rule("scope_with_blank", rows.where("document_ids IS NOT NULL"), F.exists("document_ids", lambda x: F.coalesce(F.trim(x), F.lit("")) == "")),
        rule("citation_without_document", cited, F.coalesce(F.trim("document_id"), F.lit("")) == ""),
        rule("citation_document_unknown", cited.where("document_id IS NOT NULL").join(documents.select(F.col("id").alias("document_id")), "document_id", "left_anti")),
        rule("citation_without_excerpt", held.where("on_page IS NOT NULL"), F.coalesce(F.col("excerpt"), F.lit("")) == ""),
    ]
    if "extraction_targets" in cases.columns:
        rules += [rule(name, frame, None, "document_id") for name, frame in _target_violations(cases, documents, pages).items()]
    out = rules[0]
    for more in rules[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _target_violations(cases: DataFrame, documents: DataFrame, pages: DataFrame) -> dict[str, DataFrame]:
    """Rows (document_id) that break a rule on what is to be extracted, by rule."""
    targets = cases.select(F.explode("extraction_targets").alias("t")).select("t.document_id", "t.split", F.col("t.fields").alias("fields"))
    fields = targets.select("document_id", F.explode("fields").alias("f")).select("document_id", "f.field", "f.expected", "f.citations")
    wanted, given = F.coalesce(F.size("expected"), F.lit(0)), F.coalesce(F.size("citations"), F.lit(0))
    cited = fields.where(wanted > 0).select("document_id", F.explode("citations").alias("c")).select("document_id", F.coalesce("c.document_id", "document_id").alias("cited"), "c.page", "c.excerpt")
    own = cited.where("cited = document_id").join(pages.select("document_id", "page", F.col("text").alias("on_page")), ["document_id", "page"], "left")
    return {
        "target_without_document": targets.where(F.coalesce(F.trim("document_id"), F.lit("")) == ""),
        "target_document_unknown": targets.where("document_id IS NOT NULL").join(documents.select(F.col("id").alias("document_id")), "document_id", "left_anti"),
        "target_split_unknown": targets.where(~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))),
        "target_without_fields": targets.where("fields IS NULL"),
        "target_field_unknown": fields.where(~F.coalesce(F.col("field").isin(*SCALAR_FIELDS, *LIST_FIELDS), F.lit(False))),
        "target_values_of_scalar": fields.where(F.col("field").isin(*SCALAR_FIELDS) & (wanted > 1)),
        "target_value_blank": fields.where(F.exists("expected", lambda x: F.coalesce(F.trim(x), F.lit("")) == "")),
        "target_field_twice": fields.groupBy("document_id", "field").count().where("count > 1"),
        "target_citations_differ_from_values": fields.where(wanted != given),
        "target_cites_another_document": cited.where("cited <> document_id"),
        "target_page_unknown": own.where("on_page IS NULL"),
        "target_excerpt_not_on_page": own.where("on_page IS NOT NULL").where(~F.coalesce(F.contains("on_page", "excerpt"), F.lit(False))),
    }


def manifest_errors(cases: DataFrame) -> DataFrame:
    """(rule, id) of a manifest whose head doesn't say what an evaluation has to know; id is its version."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    checks = {
        "version_missing": blank("dataset_version"), "parameters_missing": blank("parameters_version"), "unknown_mode": ~F.coalesce(F.col("mode").isin(*MODES), F.lit(False)),
        "seed_missing": F.col("seed").isNull(), "cases_missing": F.col("cases").isNull(),
    }
    named = F.filter(F.array(*(F.when(broken, F.lit(name)) for name, broken in checks.items())), lambda x: x.isNotNull())
    return cases.select(F.explode(named).alias("rule"), F.coalesce("dataset_version", F.lit("")).alias("id"))


def case_counts(cases: DataFrame) -> DataFrame:
    """kind, split and how many cases there are of both, combinations without any included."""
    spark = cases.sparkSession
    domain = spark.createDataFrame([(k, s) for k in KINDS for s in SPLITS], "kind string, split string")
    counts = cases_of(cases).groupBy("kind", "split").agg(F.count("*").alias("cases"))
    return domain.join(counts, ["kind", "split"], "left").na.fill({"cases": 0})


def newest_runs(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Of stored evaluation results the newest of each dataset, parameters and split, with the file it is in."""
    runs = spark.read.schema(schema).option("multiLine", True).json(folder).withColumn("path", F.col("_metadata.file_path")).where("schema_version = 'evaluation-result-v1'")
    newest = Window.partitionBy("dataset_version", "parameters_version", "split").orderBy(F.desc("created_at"), F.desc("path"))
    return runs.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n").orderBy("path")


def verified_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """name and error of every file of a manifest (name, bytes, sha256): missing, size, digest, or null if sound. Files: name, content."""
    found = files.select("name", F.length("content").alias("n"), F.sha2("content", 256).alias("digest"))
    joined = manifest.join(found, "name", "left")
    error = F.when(F.col("digest").isNull(), "missing").when(F.col("n") != F.col("bytes"), "size").when(F.col("digest") != F.lower("sha256"), "digest")
    return joined.select("name", error.alias("error"))


def allow_list_errors(manifest: DataFrame) -> DataFrame:
    """(rule, digest) of an allow-list (synthetic_only, documents array<struct<sha256>>) that must not be used."""
    digests = manifest.select(F.explode("documents.sha256").alias("digest"))
    bad = digests.where(~F.coalesce(F.col("digest").rlike("^[0-9a-f]{64}$"), F.lit(False))).select(F.lit("not_a_digest").alias("rule"), "digest")
    twice = digests.groupBy("digest").count().where("count > 1").select(F.lit("duplicate").alias("rule"), "digest")
    real = manifest.where(~F.coalesce("synthetic_only", F.lit(False))).select(F.lit("not_synthetic").alias("rule"), F.lit(None).cast("string").alias("digest"))
    return bad.unionByName(twice).unionByName(real)
