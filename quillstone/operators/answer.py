"""Extractive answers with exact citations, or a reason why there is none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import patterns as P
from quillstone.functions import text as T
from quillstone.operators import retrieve, trust


def evidence_key(intent: Column, segment: Column) -> Column:
    """What makes two pieces of evidence the same value."""
    found = lambda pattern: F.coalesce(F.nullif(F.regexp_extract(segment, f"(?iu){pattern}", 0), F.lit("")), segment)
    return (
        F.when(intent.isin("effective_date", "renewal_date"), T.fold(found(P.DATE)))
        .when(intent == "important_amounts", F.regexp_replace(T.fold(found(P.AMOUNT)), r"\s+", ""))
        .when(intent.isin("duration", "notification_deadline"), T.fold(found(P.DEADLINE)))
        .otherwise(T.fold(segment))
    )


def adversarial(question: Column) -> Column:
    folded, out = T.fold(question), F.lit(False)
    for pattern in P.ADVERSARIAL:
        out = out | folded.rlike(pattern)
    return out


def answer(questions: DataFrame, ranked: DataFrame) -> DataFrame:
    """question_id, status, answer, confidence, citations of every question, from its ranked chunks.

    The first safe segment that is evidence for the question's intent counts
    for each chunk. Different values for a question that has one answer make
    it ambiguous; no evidence, or a question that tries to steer, abstains.
    """
    asked = questions.select("question_id", "question", retrieve.question_intent(F.col("question")).alias("intent"), adversarial(F.col("question")).alias("steers"), T.fold(F.col("question")).rlike(P.BROAD_SCOPE).alias("broad"))
    rows = ranked.drop("intent").join(asked.drop("question"), "question_id")
    cut = trust.admitted(rows.withColumn("_segments", T.segments(F.col("text"))), "_segments")
    first = F.try_element_at(F.filter("_segments", lambda s: retrieve.intent_evidence(F.col("intent"), s)), F.lit(1))
    item = F.struct("rank", F.col("excerpt").isNotNull().alias("found"), evidence_key(F.col("intent"), F.col("excerpt")).alias("key"), "excerpt", "score", "entity_score", "chunk_id", "document_id", "document_name", "page", "section")
    gathered = cut.withColumn("excerpt", first).groupBy("question_id").agg(F.sort_array(F.collect_list(item)).alias("ranked"))  # as many as were ranked
    joined = asked.join(gathered, "question_id", "left").withColumn("ranked", F.coalesce("ranked", F.array().cast(gathered.schema["ranked"].dataType)))
    named = F.exists("ranked", lambda x: x["entity_score"] > 0)
    scoped = F.when(~F.col("broad") & named, F.filter("ranked", lambda x: x["entity_score"] > 0)).otherwise(F.col("ranked"))
    out = joined.withColumn("evidence", F.filter(scoped, lambda x: x["found"]))
    keys = F.array_distinct(F.transform("evidence", lambda x: x["key"]))
    out = out.withColumn("distinct", F.transform(keys, lambda k: F.element_at(F.filter("evidence", lambda x: x["key"] == k), 1)))
    documents = F.size(F.array_distinct(F.transform("distinct", lambda x: x["document_id"])))
    conflict = (F.size("distinct") > 1) & ((documents == 1) | F.col("broad") | (F.col("intent") == "notification_deadline"))
    best = F.try_element_at("evidence", F.lit(1))
    status = (
        F.when(F.col("steers"), "refused")
        .when(F.col("intent").isNull() | (F.size("evidence") == 0), "insufficient")
        .when((F.col("intent") == "renewal_date") & best["excerpt"].rlike(f"(?iu){P.MISSING_DATE}"), "no_renewal")
        .when(F.col("intent").isin(*P.SINGULAR_INTENTS) & conflict, "conflict")
        .otherwise("answered")
    )
    out = out.withColumn("reason", status)
    text = F.when(F.col("reason") == "answered", best["excerpt"])
    for reason, words in P.ANSWERS.items():
        text = F.when(F.col("reason") == reason, words).otherwise(text)
    cited = F.when(F.col("reason").isin("answered", "no_renewal"), F.slice("evidence", 1, 1)).when(F.col("reason") == "conflict", F.slice("distinct", 1, 2)).otherwise(F.slice("evidence", 1, 0))
    citations = F.transform(cited, lambda x: F.struct(*(x[c].alias(c) for c in ("chunk_id", "document_id", "document_name", "page", "section", "excerpt"))))
    least = F.least(F.col("distinct")[0]["score"], F.col("distinct")[1]["score"])
    confidence = F.when(F.col("reason") == "refused", 1.0).when(F.col("reason") == "insufficient", 0.0).when(F.col("reason") == "conflict", least).when(F.col("reason") == "no_renewal", best["score"]).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), best["score"])))
    return out.select("question_id", F.when(F.col("reason") == "answered", "answered").when(F.col("reason") == "conflict", "ambiguous").otherwise("abstained").alias("status"), text.alias("answer"), confidence.alias("confidence"), citations.alias("citations"))
