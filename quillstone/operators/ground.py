"""What an answer must satisfy before it leaves the engine, and gates that scorers put on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as T

ANSWER_FIELDS = "status string, answerable boolean, answer string, confidence double, supporting_document string, supporting_page int, supporting_excerpt string, ambiguity_reason string, extracted_fields map<string,array<string>>, supporting_chunk_ids array<string>, citations array<struct<chunk_id:string,document_id:string,document_name:string,page:int,section:string,excerpt:string>>"
DECISION_KEYS = ("ambiguity_reason", "answer", "answerable", "confidence", "extracted_fields", "supporting_document", "supporting_excerpt", "supporting_page")
PARTIAL = "The passage does not entail the proposed answer strongly enough."
PARTIAL_REASON = "The candidate answer is only partially supported by local NLI."
CONTRADICTED = "The proposed answer conflicts with the retrieved passage."


def grounding_errors(answers: DataFrame, ranked: DataFrame) -> DataFrame:
    """question_id and error: the first rule that an answer breaks, or null."""
    return with_grounding_error(answers, ranked).select("question_id", F.col("grounding_error").alias("error"))


def checked(answers: DataFrame, ranked: DataFrame) -> DataFrame:
    """The answers with grounding_error; those that break a rule are withheld with status `error`."""
    held = with_grounding_error(answers, ranked)
    sound = F.col("grounding_error").isNull()
    blank = {"status": F.lit("error"), "answerable": F.lit(False), "answer": F.lit(""), "confidence": F.lit(0.0)}
    out = []
    for field in held.schema.fields:
        kept = F.col(field.name)
        if field.name not in ("question_id", "grounding_error"):
            kept = F.when(sound, kept).otherwise(blank.get(field.name, F.lit(None)).cast(field.dataType)).alias(field.name)
        out.append(kept)
    return held.select(*out)


def with_grounding_error(answers: DataFrame, ranked: DataFrame) -> DataFrame:
    """The answers with grounding_error, the first rule that each breaks, or null.

    Answers hold question_id and ANSWER_FIELDS. Each is held against the
    chunks ranked for its question, twenty or so, which are gathered beside it.
    """
    chunk = F.struct("chunk_id", "document_id", "document_name", F.col("page").cast("int").alias("page"), "text")
    gathered = ranked.groupBy("question_id").agg(F.collect_list(chunk).alias("_chunks"))
    answers = answers.drop("grounding_error")
    rows = answers.join(gathered, "question_id", "left").withColumn("_chunks", F.coalesce("_chunks", F.array().cast(gathered.schema["_chunks"].dataType)))
    c = F.col
    excerpt, reason = c("supporting_excerpt"), c("ambiguity_reason")
    empty = lambda x: F.coalesce(F.size(x), F.lit(0)) < 1
    values = F.flatten(F.map_values(F.coalesce("extracted_fields", F.create_map().cast("map<string,array<string>>"))))
    told = F.concat(F.array("answer", "supporting_excerpt"), F.transform("citations", lambda x: x["excerpt"]), values)
    rows = rows.withColumn("_told", F.filter(F.coalesce(told, F.array("answer", "supporting_excerpt")), lambda x: x.isNotNull()))
    unsafe = F.exists("_told", lambda x: T.untrusted(x))
    here = F.filter("_chunks", lambda x: (x["document_id"] == c("supporting_document")) & (x["page"] == c("supporting_page")))
    rows = rows.withColumn("_here", here)
    folded = T.fold(excerpt)
    said = F.contains(folded, T.fold(c("answer"))) | (c("answer") == F.concat(F.lit("Yes. "), excerpt)) | (c("answer") == F.concat(F.lit("No. "), excerpt))
    cited = F.forall(
        F.coalesce("citations", F.array().cast("array<struct<chunk_id:string,document_id:string,document_name:string,page:int,section:string,excerpt:string>>")),
        lambda x: F.exists("_chunks", lambda k: (k["chunk_id"] == x["chunk_id"]) & (k["document_id"] == x["document_id"]) & (k["page"] == x["page"]) & (k["document_name"] == x["document_name"]) & F.contains(k["text"], x["excerpt"])),
    )
    known = F.transform("_chunks", lambda k: k["chunk_id"])
    fields_said = F.forall(values, lambda v: v.isNotNull() & (v != "") & F.contains(folded, T.fold(v)))
    fields_named = F.forall(F.map_entries(F.coalesce("extracted_fields", F.create_map().cast("map<string,array<string>>"))), lambda e: (e["key"] != "") & (F.size(e["value"]) > 0))
    rules = [
        (F.isnan("confidence") | ~c("confidence").between(0, 1) | c("confidence").isNull(), "confidence out of range"),
        (~c("status").isin("answered", "partially_supported", "ambiguous", "abstained"), "invalid status"),
        ((c("status") == "answered") != c("answerable"), "status and answerable differ"),
        ((c("status") == "answered") & reason.isNotNull(), "an answer has no ambiguity reason"),
        (c("status").isin("partially_supported", "ambiguous") & (F.coalesce(reason, F.lit("")) == ""), "uncertainty needs a reason"),
        (~empty(F.array_except("supporting_chunk_ids", known)), "supporting chunk does not exist"),
        (unsafe, "untrusted instruction"),
        (excerpt.isNull() & (c("supporting_document").isNotNull() | c("supporting_page").isNotNull()), "location without an excerpt"),
        (excerpt.isNull() & (c("status") != "abstained"), "incomplete grounding"),
        (excerpt.isNull() & (reason.isNotNull() | ~empty(values) | ~empty(c("supporting_chunk_ids")) | ~empty(c("citations"))), "abstention with evidence"),
        (excerpt.isNull(), None),
        (c("status") == "abstained", "abstention with evidence"),
        (c("supporting_document").isNull() | c("supporting_page").isNull(), "excerpt without a location"),
        (~F.exists("_chunks", lambda k: k["document_id"] == c("supporting_document")), "supporting document does not exist"),
        (F.size("_here") == 0, "supporting page does not exist"),
        (~F.exists("_here", lambda k: F.contains(k["text"], excerpt)), "excerpt is not on the page"),
        ((c("status") == "answered") & ~said, "answer is not in the excerpt"),
        (~fields_named, "invalid field"),
        (~fields_said, "field is not in the excerpt"),
        (~F.exists("_here", lambda k: F.array_contains("supporting_chunk_ids", k["chunk_id"]) & F.contains(k["text"], excerpt)), "supporting chunk is not the cited passage"),
        (~cited, "citation is not grounded"),
    ]
    error = F.when(F.lit(False), F.lit(None).cast("string"))
    for broken, name in rules:
        error = error.when(F.coalesce(broken, F.lit(False)), F.lit(name))
    return rows.select(*answers.columns, error.alias("grounding_error"))


def nli_gate(drafts: DataFrame, entail_at: float, contradict_at: float) -> DataFrame:
    """Keep, weaken or withdraw drafts by a scorer's entailment and contradiction, which they hold as columns."""
    c = F.col
    kept_answer = (c("status") == "answered") & (c("entailment") >= entail_at)
    withdrawn = (c("status") == "answered") & ~kept_answer & (c("contradiction") >= contradict_at)
    kept_conflict = (c("status") == "ambiguous") & (c("contradiction") >= contradict_at)
    judged = c("status").isin("answered", "ambiguous") & c("entailment").isNotNull()
    weak = judged & ~kept_answer & ~withdrawn & ~kept_conflict
    gone = lambda name, kind: F.when(judged & withdrawn, F.lit(None).cast(kind)).otherwise(c(name)).alias(name)
    status = F.when(judged & withdrawn, "abstained").when(weak, "partially_supported").otherwise(c("status"))
    return drafts.select(
        "question_id",
        status.alias("status"),
        (status == "answered").alias("answerable"),
        F.when(judged & withdrawn, CONTRADICTED).when(weak, PARTIAL).otherwise(c("answer")).alias("answer"),
        F.when(judged & (withdrawn | kept_conflict), c("contradiction")).when(judged, c("entailment")).otherwise(c("confidence")).alias("confidence"),
        gone("supporting_document", "string"),
        gone("supporting_page", "int"),
        gone("supporting_excerpt", "string"),
        F.when(judged & withdrawn, F.lit(None).cast("string")).when(weak, PARTIAL_REASON).otherwise(c("ambiguity_reason")).alias("ambiguity_reason"),
    )


def decision_error(raw: Column) -> Column:
    """Why a model's JSON decision is not taken; null if it is sound."""
    parsed = F.try_parse_json(raw)
    kind = lambda name: F.coalesce(F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant")), F.lit("MISSING"))
    get = lambda name, to: F.try_variant_get(parsed, f"$.{name}", to)
    keys = F.array_sort(F.json_object_keys(raw))
    wanted = F.lit(list(DECISION_KEYS))
    number = kind("confidence").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    text_or_null = F.lit(True)
    for name in ("answer", "supporting_document", "supporting_excerpt", "ambiguity_reason"):
        text_or_null = text_or_null & kind(name).isin("STRING", "VOID")
    page = kind("supporting_page")
    answerable, answer, reason = get("answerable", "boolean"), get("answer", "string"), get("ambiguity_reason", "string")
    support = F.concat_ws("", get("supporting_document", "string"), get("supporting_page", "string"), get("supporting_excerpt", "string"))
    fields = kind("extracted_fields")
    return (
        F.when(parsed.isNull(), "not JSON")
        .when(keys.isNull(), "not an object")
        .when(F.size(F.array_except(keys, wanted)) > 0, "unexpected keys")
        .when(F.size(F.array_except(wanted, keys)) > 0, "missing keys")
        .when(kind("answerable") != "BOOLEAN", "answerable must be a boolean")
        .when(~number, "confidence must be a number")
        .when(~get("confidence", "double").between(0, 1), "confidence out of range")
        .when(~((page == "VOID") | ((page == "BIGINT") & (get("supporting_page", "int") >= 1))), "page must be a positive integer or null")
        .when(~text_or_null, "texts must be strings or null")
        .when(~fields.startswith("OBJECT"), "extracted_fields must be an object")
        .when(answerable & (F.trim(F.coalesce(answer, F.lit(""))) == ""), "an answer is needed")
        .when(answerable & reason.isNotNull(), "an answer has no ambiguity reason")
        .when(~answerable & reason.isNull() & (answer.isNotNull() | (support != "") | (fields != "OBJECT<>")), "an abstention holds nothing")
        .when(~answerable & reason.isNotNull() & answer.isNotNull(), "an ambiguity has no answer")
    )


def protocol_outcome(kind: Column, status: Column, correct: Column) -> Column:
    """How a case came out: as its kind asks for or not."""
    wanted = F.when(kind == "answerable", (status == "answered") & correct).when(kind == "ambiguous", status == "ambiguous").otherwise(status == "abstained")
    return F.when(F.coalesce(wanted, F.lit(False)), "as_expected").when((kind != "answerable") & (status == "answered"), "answered_without_ground").when((kind == "answerable") & (status == "abstained"), "missed").otherwise("other")


def answer_metrics(cases: DataFrame) -> DataFrame:
    """One row of metrics over cases: kind, status, answer_match, returned, returned_right, gold, gold_found, error, schema_error."""
    from quillstone.operators.evaluate import ratio

    asked = F.col("kind") == "answerable"
    of = lambda name: F.sum(F.when(asked, F.col(name)).otherwise(0))
    good_case = asked & (F.col("status") == "answered") & F.col("answer_match") & (F.col("returned_right") > 0)
    abstained = ~asked & (F.col("status") == F.when(F.col("kind") == "ambiguous", "ambiguous").otherwise("abstained"))
    return cases.agg(
        ratio(of("returned_right"), of("returned")).alias("citation_precision"),
        ratio(of("gold_found"), of("gold")).alias("citation_recall"),
        ratio(F.count_if(good_case), F.count_if(asked)).alias("citation_case_accuracy"),
        ratio(F.count_if(abstained), F.count_if(~asked)).alias("abstention_accuracy"),
        ratio(F.count_if("error"), F.count("*")).alias("error_rate"),
        ratio(F.count_if("schema_error"), F.count("*")).alias("schema_error_rate"),
    )
