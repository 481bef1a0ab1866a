"""What a service around the engine reads and writes: views, guards, deletions, upserts, records, display."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillstone.functions import patterns as P
from quillstone.operators import grounded

# --- views ----------------------------------------------------------------


def view(rows: DataFrame, name: str) -> DataFrame:
    """The columns of a named view, in its order; those that aren't there are null."""
    has = set(rows.columns)
    return rows.select(*(F.col(c) if c in has else F.lit(None).alias(c) for c in P.VIEWS[name]))


def answer_view(answers: DataFrame) -> DataFrame:
    """Answers of either engine in one shape: where support isn't given by itself, the first citation gives it."""
    has, first = set(answers.columns), F.try_element_at("citations", F.lit(1))
    given = lambda name, other: (F.coalesce(F.col(name), other) if name in has else other).alias(name)
    return answers.select(
        "question_id", "status", "answer", "confidence", "citations", given("answerable", F.col("status") == "answered"), given("supporting_document", first["document_id"]),
        given("supporting_page", first["page"]), given("supporting_excerpt", first["excerpt"]), given("ambiguity_reason", F.lit(None).cast("string")),
        (F.col("extracted_fields") if "extracted_fields" in has else F.create_map().cast("map<string,array<string>>")).alias("extracted_fields"),
    )


def lookup(rows: DataFrame, key: str, value) -> DataFrame:
    """The row with a key: a filter that reaches the files' statistics."""
    return rows.where(F.col(key) == F.lit(value))


def listing(documents: DataFrame, dossier: str) -> DataFrame:
    """A dossier's documents that aren't deleted, newest first."""
    return documents.where((F.col("dossier_id") == dossier) & F.col("deleted_at").isNull()).orderBy(F.desc("created_at"), "id")


# --- guards ---------------------------------------------------------------


def allowed(principals: DataFrame, action: Column) -> DataFrame:
    """Principals whose role may do what is asked for."""
    pairs = F.array(*(F.lit(f"{r}:{a}") for r, actions in P.ROLE_ACTIONS.items() for a in actions))
    return principals.where(F.array_contains(pairs, F.concat_ws(":", "role", action)))


def principals_of(tokens: DataFrame, users: DataFrame) -> DataFrame:
    """Users whose token (user_id, role) names them as they are: active and in the same role."""
    active = users.where("is_active").select(F.col("id").alias("user_id"), "username", "role")
    return tokens.join(active, ["user_id", "role"]).select("user_id", "username", "role")


def admissible(documents: DataFrame, allow_list: DataFrame) -> DataFrame:
    """Documents (data) whose digest is on the allow-list."""
    return documents.join(allow_list.select(F.lower("sha256").alias("listed")), F.sha2("data", 256) == F.col("listed"), "left_semi")


def sound_number(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value < float("inf"))


# --- writes ---------------------------------------------------------------


def soft_delete(documents: DataFrame, tasks: DataFrame, derived: dict[str, DataFrame], gone: DataFrame, at: Column) -> dict[str, DataFrame]:
    """All tables after the documents in `gone` (document_id) are withdrawn.

    Documents keep their row, their unfinished task fails, and what was
    derived from them goes. What is withdrawn already stays as it was.
    """
    ids = gone.select(F.col("document_id").alias("gone_id")).distinct()
    marked = documents.join(ids, F.col("id") == F.col("gone_id"), "left").withColumn("goes", F.col("gone_id").isNotNull() & F.col("deleted_at").isNull())
    kept = marked.select(*(F.when(F.col("goes"), F.lit("deleted")).otherwise(F.col(c)).alias(c) if c == "status" else F.when(F.col("goes"), at).otherwise(F.col(c)).alias(c) if c == "deleted_at" else F.col(c) for c in documents.columns))
    open_ = tasks.join(ids, F.col("document_id") == F.col("gone_id"), "left").withColumn("goes", F.col("gone_id").isNotNull() & ~F.col("status").isin("completed", "failed"))
    change = {"status": F.lit("failed"), "error_code": F.lit("document_deleted"), "completed_at": at}
    done = open_.select(*(F.when(F.col("goes"), change[c]).otherwise(F.col(c)).alias(c) if c in change else F.col(c) for c in tasks.columns))
    rest = {name: rows.join(ids, F.col("document_id") == F.col("gone_id"), "left_anti") for name, rows in derived.items()}
    return {"documents": kept, "tasks": done, **rest}


def upsert_users(users: DataFrame, named: DataFrame) -> DataFrame:
    """Users (username, password_hash, role, is_active) after those named are inserted or refreshed; a null role deactivates."""
    new = named.select("username", F.col("password_hash").alias("new_hash"), F.col("role").alias("new_role"), F.lit(True).alias("is_named"))
    both = users.join(new, "username", "full_outer").where("role IS NOT NULL OR new_role IS NOT NULL")
    return both.select("username", F.coalesce("new_hash", "password_hash").alias("password_hash"), F.coalesce("new_role", "role").alias("role"), F.when(F.col("is_named"), F.col("new_role").isNotNull()).otherwise(F.col("is_active")).alias("is_active"))


def insert_new(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """What an idempotent insert appends: rows whose key isn't there, each key once."""
    return rows.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def run_record(metrics: Column) -> Column:
    """The metrics of a run's record: all entries (a map) but those that are columns or rows of their own."""
    return F.map_filter(metrics, lambda k, _: ~k.isin(*P.RUN_COLUMNS))


def write_new(rows: DataFrame, path: str) -> None:
    """Write JSON where nothing is yet; an error if there is."""
    rows.write.mode("errorifexists").json(path)


def claim(spark: SparkSession, path: str, content: str) -> bool:
    """Create a file that must not exist, as a lock; False if someone else did."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(hadoop):
        return False
    try:
        out = files.create(hadoop, False)
    except Exception:
        if files.exists(hadoop):  # somebody was faster
            return False
        raise
    out.write(bytearray(content.encode()))
    out.close()
    return True


def replace_file(spark: SparkSession, path: str, content: str) -> None:
    """Write a small file under another name and rename it over the old one, so that nobody reads half of it or finds none."""
    fs = spark._jvm.org.apache.hadoop.fs
    final, part = fs.Path(path), fs.Path(f"{path}.part")
    files = final.getFileSystem(spark._jsc.hadoopConfiguration())
    final, part = files.makeQualified(final), files.makeQualified(part)
    out = files.create(part, True)
    out.write(bytearray(content.encode()))
    out.close()
    over = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    fs.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration()).rename(part, final, over)


# --- payloads -------------------------------------------------------------


def sanitized(value, unsafe: Callable[[str], bool] = grounded.untrusted):
    """A JSON value without what gives instructions, or None if nothing of it may stay.

    A mapping whose excerpt does goes as a whole, and so does one whose value
    has lost its citations. Of a list's texts those go that do, and all if
    what is left does together.
    """
    if isinstance(value, str):
        return None if unsafe(value) else value
    if isinstance(value, dict):
        if isinstance(value.get("excerpt"), str) and unsafe(value["excerpt"]):
            return None
        kept = {k: s for k, v in value.items() if (s := sanitized(v, unsafe)) is not None}
        uncited = "value" in value and "citations" in value and kept.get("value") not in (None, "", []) and not kept.get("citations")
        return None if uncited else kept
    if isinstance(value, list):
        texts = [v for v in value if isinstance(v, str) and not unsafe(v)]
        together = unsafe("\n".join(texts))
        items = (v for v in value if not isinstance(v, str) or (not unsafe(v) and not (together and v.strip())))
        return [s for v in items if (s := sanitized(v, unsafe)) is not None]
    return value


@F.pandas_udf(StringType())
def sanitize_payload(payload: pd.Series) -> pd.Series:
    """sanitized() of JSON texts; keys keep their order."""
    return payload.map(lambda p: None if p is None else json.dumps(sanitized(json.loads(p)), ensure_ascii=False, separators=(",", ":")))


def user_prompt(questions: DataFrame, ranked: DataFrame, passages: int = 3) -> DataFrame:
    """question_id and the JSON that a language model gets: the question, its first passages, and what is asked of the answer, with sorted keys."""
    item = F.struct("document_id", "document_name", "page", "section", "text")
    first = ranked.where(F.col("rank") <= passages).groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("rank", item.alias("x")))).alias("found"))
    contract = F.struct(*(F.lit(True).alias(c) for c in sorted(P.PROMPT_CONTRACT)))
    rows = questions.join(first, "question_id", "left")
    content = F.coalesce(F.transform("found", lambda f: f["x"]), F.array().cast("array<struct<document_id:string,document_name:string,page:int,section:string,text:string>>"))
    body = F.struct(contract.alias("evidence_output_contract"), F.lit(P.PROMPT_TYPE).alias("message_type"), content.alias("untrusted_document_content"), F.col("question").alias("user_question"))
    return rows.select("question_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("prompt"))


# --- display --------------------------------------------------------------


def upsert_first(rows: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The new rows, then the others that don't share a key with them: with `place` 0 and 1."""
    return new.withColumn("place", F.lit(0)).unionByName(rows.join(new.select(key), key, "left_anti").withColumn("place", F.lit(1)))


def progress(documents: DataFrame) -> DataFrame:
    """How many documents are completed, and whether any isn't through yet."""
    return documents.agg(F.count_if(F.col("status") == "completed").alias("completed"), F.coalesce(F.bool_or(F.col("status").isin("queued", "processing")), F.lit(False)).alias("pending"))


def shown(values: Column, missing: str, nothing: str) -> Column:
    """A field's values (an array) as text."""
    return F.when(values.isNull(), missing).when(F.size(values) == 0, nothing).otherwise(F.array_join(values, " · "))


def percentage(share: Column, missing: str) -> Column:
    """Per cent with one decimal, after a comma."""
    plain = F.replace(F.format_number(share * 100, 1), F.lit(","), F.lit(""))
    return F.coalesce(F.concat(F.replace(plain, F.lit("."), F.lit(",")), F.lit(" %")), F.lit(missing))


def field_rows(payloads: DataFrame) -> DataFrame:
    """document_id, field, value and citations (JSON) of each entry of a payload that is a field: it has a value and an array of citations."""
    entries = payloads.select("document_id", F.explode(F.from_json("payload", "map<string,string>")).alias("field", "entry"))
    parts = entries.withColumn("parts", F.from_json("entry", "map<string,string>"))
    citations = F.element_at("parts", "citations")
    guard = F.map_contains_key("parts", "value") & F.coalesce(citations.startswith("["), F.lit(False))
    return parts.where(guard).select("document_id", "field", F.element_at("parts", "value").alias("value"), citations.alias("citations"))


def search(rows: DataFrame, columns: list[str], asked: str) -> DataFrame:
    """Rows whose columns hold a text, whatever its case."""
    wanted = asked.strip().lower()
    return rows.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(wanted))) if wanted else rows


def threshold_label(similarity: Column, threshold: float) -> Column:
    if not 0 <= threshold <= 1:
        raise ValueError("a threshold is a finite number from 0 to 1")
    return F.when(similarity >= threshold, "at or above").otherwise("below")
