"""Evaluation of answers and extraction against a manifest, and its recalculation from stored rows.

Everything is a table: one row for each case, one for each extracted field,
one for the metrics. What a case holds is small (its passages, citations and
gold), so it is compared inside the row, by Column functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import patterns as P
from quillstone.functions import text as T
from quillstone.operators import evaluate
from quillstone.operators.evaluate import f1, ratio

AT = 5
DRIFT = 0.001001  # of a recorded metric, that rounding may explain
STATUSES = ("answered", "partially_supported", "ambiguous", "abstained")
CITATIONS = "array<struct<document_id:string,page:int,excerpt:string>>"
COUNTS = (
    "citation_correct", "citation_returned", "citation_expected", "citation_expected_matched", "answerable_correct", "answerable_total", "retrieval_hits_at_5",
    "abstention_correct", "abstention_total", "errors", "schema_errors",
)
EXTRACTION_COUNTS = ("extraction_true_positive", "extraction_predicted", "extraction_gold")


# --- comparisons ----------------------------------------------------------


def citation_fits(returned: Column, gold: Column) -> Column:
    """Whether a citation says, in two words or more, what one of the gold citations of its document and page says."""
    said = T.normalize(returned["excerpt"])
    same_place = lambda g: (g["document_id"] == returned["document_id"]) & (g["page"] == returned["page"])
    return (F.size(F.split(said, " ")) >= 2) & F.coalesce(F.exists(gold, lambda g: same_place(g) & F.contains(T.normalize(g["excerpt"]), said)), F.lit(False))


def answer_fits(answer: Column, expected: Column) -> Column:
    """Whether an answer holds the expected date, or an amount of the expected value, or else the expected words."""
    folded = T.normalize(expected)
    month = "|".join(P.MONTH_NUMBERS)
    dated = expected.rlike(r"\b\d{4}-\d{2}-\d{2}\b") | folded.rlike(rf"\b\d{{1,2}}(?:er)?\s+(?:{month})\s+\d{{4}}\b") | folded.rlike(rf"\b(?:{month})\s+\d{{1,2}}\s+\d{{4}}\b")
    dates = F.regexp_extract_all(answer, F.lit(r"\d{4}-\d{2}-\d{2}|\d{1,2}(?:er)?\s+[A-Za-zÀ-ÿ]+\s+\d{4}|[A-Za-zÀ-ÿ]+\s+\d{1,2},?\s+\d{4}"), F.lit(0))
    priced = expected.rlike(r"(?:EUR|USD|GBP|[$€£]).*\d|\d.*(?:EUR|USD|GBP|[$€£])")
    wanted = T.iso_date(expected)
    fits = F.when(dated, F.exists(dates, lambda d: T.iso_date(d) == wanted)).when(priced, F.arrays_overlap(T.money_values(answer), T.money_values(expected))).otherwise(F.contains(T.normalize(answer), folded))
    return F.coalesce(fits, F.lit(False))


def contract_error(status: Column, answer: Column, confidence: Column, citations: Column) -> Column:
    """Why an answer isn't of the form that is agreed; null if it is."""
    loose = F.exists(citations, lambda c: c["document_id"].isNull() | c["page"].isNull() | c["excerpt"].isNull())
    return (
        F.when(~F.coalesce(status.isin(*STATUSES), F.lit(False)), "unknown status")
        .when(answer.isNull(), "answer must be text")
        .when(confidence.isNull() | F.isnan(confidence) | ~confidence.between(0, 1), "confidence out of range")
        .when(citations.isNull() | loose, "incomplete citation")
    )


# --- cases ----------------------------------------------------------------


def case_rows(cases: DataFrame, ranked: DataFrame, answers: DataFrame, at: int = AT) -> DataFrame:
    """One row for each case with what was found, said and expected.

    cases: id, kind, expected_answer, expected_citations. ranked: question_id,
    rank, chunk_id, document_id, page, score. answers: question_id, status,
    answer, confidence, citations, and error (null, or why there is no answer,
    such as a broken grounding rule) and latency_ms if they are known. A case
    without an answer is an error, and so is one that breaks the contract;
    both are rows like any other.
    """
    passages = ranked.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", F.col("document_id").cast("string").alias("document_id"), "page", "score"))).alias("retrieved"))
    has = set(answers.columns)
    given = answers.select(
        "question_id", "status", "answer", "confidence", F.transform("citations", lambda c: F.struct(c["document_id"].cast("string").alias("document_id"), c["page"].cast("int").alias("page"), c["excerpt"].alias("excerpt"))).alias("citations"),
        (F.col("error") if "error" in has else F.lit(None)).cast("string").alias("error"), (F.col("latency_ms") if "latency_ms" in has else F.lit(None)).cast("double").alias("latency_ms"), F.lit(True).alias("present"),
    )
    wanted = cases.select("id", "kind", "expected_answer", F.coalesce(F.col("expected_citations"), F.array()).cast(CITATIONS).alias("gold"))
    rows = wanted.join(given, F.col("id") == F.col("question_id"), "left").drop("question_id").join(passages, F.col("id") == F.col("question_id"), "left").drop("question_id")

    broken = contract_error(F.col("status"), F.col("answer"), F.col("confidence"), F.col("citations"))
    error = F.when(F.col("present").isNull(), "no answer").otherwise(F.coalesce("error", broken))
    rows = rows.withColumn("error", error).withColumn("schema_error", F.coalesce(F.col("present") & F.col("error").isNotNull(), F.lit(False)))
    asked, sound = F.col("kind") == "answerable", F.col("error").isNull()
    rows = rows.withColumn("citations", F.when(sound, F.col("citations")).otherwise(F.array().cast(CITATIONS)))
    first = F.filter("retrieved", lambda r: r["rank"] <= at)
    rows = rows.withColumns({
        "retrieval_completed": F.col("retrieved").isNotNull(),
        "retrieved": F.coalesce("retrieved", F.array().cast(passages.schema["retrieved"].dataType)),
        "expected_locations": F.when(asked, F.array_sort(F.array_distinct(F.transform("gold", lambda g: F.struct(g["document_id"].alias("document_id"), g["page"].alias("page")))))),
        "retrieval_matches_at_5": F.when(asked, F.coalesce(F.transform(first, lambda r: F.exists("gold", lambda g: (g["document_id"] == r["document_id"]) & (g["page"] == r["page"]))), F.array().cast("array<boolean>"))),
        "citation_matches": F.transform("citations", lambda c: citation_fits(c, F.col("gold"))),
        "expected_citation_matches": F.when(sound, F.transform("gold", lambda g: F.exists("citations", lambda c: citation_fits(c, F.array(g))))).otherwise(F.array().cast("array<boolean>")),
        "answer_match": F.when(sound, F.col("expected_answer").isNotNull() & answer_fits(F.col("answer"), F.coalesce("expected_answer", F.lit("")))).otherwise(False),
        "status": F.when(sound, F.col("status")).otherwise("error"),
    })
    place = F.array_position("retrieval_matches_at_5", F.lit(True))
    return rows.select(
        "id", "kind", "status", F.when(sound, F.col("answer")).alias("answer"), "answer_match", "citations", "citation_matches", "expected_citation_matches",
        "retrieval_matches_at_5", "expected_locations", F.nullif(place, F.lit(0)).cast("int").alias("retrieval_rank"), "retrieval_completed", "retrieved", "error", "schema_error", "latency_ms",
    )


# --- extraction -----------------------------------------------------------


def extraction_rows(targets: DataFrame, extracted: DataFrame) -> DataFrame:
    """One row for each field of a target: expected and actual values, which of them fit, and the counts.

    targets: document_id, field, expected (array of values, or null) and
    citations (gold; one for each value if as many, else all for all; a null
    document_id is the target's). extracted: document_id, field, value_ord,
    value, citation. Values are matched one to one in the order of the gold;
    a value counts if its citation fits as well. A target without extraction
    has nothing but gold.
    """
    cited = F.struct(F.coalesce(F.col("citation.document_id").cast("string"), F.col("document_id").cast("string")).alias("document_id"), F.col("citation.page").cast("int").alias("page"), F.col("citation.excerpt").alias("excerpt")) if "document_id" in extracted.schema["citation"].dataType.names else F.struct(F.col("document_id").cast("string").alias("document_id"), F.col("citation.page").cast("int").alias("page"), F.col("citation.excerpt").alias("excerpt"))
    found = extracted.groupBy("document_id", "field").agg(F.sort_array(F.collect_list(F.struct("value_ord", "value", cited.alias("citation")))).alias("found"))
    rows = targets.join(found, ["document_id", "field"], "left").withColumn("found", F.coalesce("found", F.array().cast(found.schema["found"].dataType)))
    own = F.transform(F.coalesce(F.col("citations"), F.array()).cast(CITATIONS), lambda g: F.struct(F.coalesce(g["document_id"], F.col("document_id").cast("string")).alias("document_id"), g["page"].alias("page"), g["excerpt"].alias("excerpt")))
    rows = rows.withColumns({"expected": F.coalesce("expected", F.array().cast("array<string>")), "gold": own})
    kind = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for item in P.FIELD_KINDS.items() for x in item)), F.col("field")), F.lit("text"))
    rows = rows.withColumn("kind", kind)
    aligned = F.size("gold") == F.size("expected")
    asked = F.transform("expected", lambda e, i: F.struct(e.alias("value"), F.exists("found", lambda x: citation_fits(x["citation"], F.when(aligned, F.array(F.get("gold", i))).otherwise(F.col("gold")))).alias("cited")))
    rows = rows.withColumn("asked", asked)
    state = "struct<used:array<int>,values:array<boolean>,right:bigint>"
    begin = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<boolean>").alias("values"), F.lit(0).cast("long").alias("right")).cast(state)

    def step(s: Column, e: Column) -> Column:
        free = F.filter("found", lambda x: ~F.array_contains(s["used"], x["value_ord"].cast("int")) & T.value_matches(x["value"], e["value"], F.col("kind")))
        hit = F.size(free) > 0
        taken = hit & e["cited"]
        return F.struct(F.when(taken, F.array_append(s["used"], F.get(free, F.lit(0))["value_ord"].cast("int"))).otherwise(s["used"]).alias("used"), F.array_append(s["values"], hit).alias("values"), (s["right"] + taken.cast("long")).alias("right")).cast(state)

    rows = rows.withColumn("matched", F.aggregate("asked", begin, step))
    return rows.select(
        "document_id", "field", F.col("expected").alias("expected_values"), F.transform("found", lambda x: x["value"]).alias("actual_values"), F.col("matched.values").alias("value_decisions"),
        F.transform("asked", lambda a: a["cited"]).alias("citation_decisions"), F.col("matched.right").alias("true_positive"), F.size("found").cast("long").alias("predicted"), F.size("expected").cast("long").alias("gold"),
    )


# --- metrics --------------------------------------------------------------


def _true(flags: str) -> Column:
    return F.size(F.filter(flags, lambda x: x))


def metrics(cases: DataFrame, extraction: DataFrame | None = None) -> DataFrame:
    """One row: the counts, the ratios (six decimals) and the verdict."""
    asked, c = F.col("kind") == "answerable", F.col
    of = lambda n: F.coalesce(F.sum(F.when(asked, n).otherwise(0)), F.lit(0)).cast("long")
    good = asked & (c("status") == "answered") & c("answer_match") & (_true("citation_matches") > 0)
    held_back = ~asked & (c("status") == F.when(c("kind") == "ambiguous", "ambiguous").otherwise("abstained"))
    counted = cases.agg(
        of(_true("citation_matches")).alias("citation_correct"), of(F.size("citation_matches")).alias("citation_returned"), of(F.size("expected_citation_matches")).alias("citation_expected"),
        of(_true("expected_citation_matches")).alias("citation_expected_matched"), F.count_if(good).alias("answerable_correct"), F.count_if(asked).alias("answerable_total"),
        F.count_if(asked & c("retrieval_rank").isNotNull()).alias("retrieval_hits_at_5"), F.count_if(held_back).alias("abstention_correct"), F.count_if(~asked).alias("abstention_total"),
        F.count_if(c("error").isNotNull()).alias("errors"), F.count_if("schema_error").alias("schema_errors"),
        F.count("*").alias("case_count"), F.coalesce(F.sum(F.when(asked, 1 / c("retrieval_rank"))), F.lit(0.0)).alias("reciprocal"),
        F.coalesce(F.median("latency_ms"), F.lit(0.0)).alias("latency_median_ms"), F.coalesce(evaluate.nearest_rank(c("latency_ms"), 0.95), F.lit(0.0)).alias("latency_p95_ms"),
    )
    if extraction is None:
        counted = counted.select("*", *(F.lit(0).cast("long").alias(n) for n in EXTRACTION_COUNTS))
    else:
        sums = (F.coalesce(F.sum(n.removeprefix("extraction_")), F.lit(0)).cast("long").alias(n) for n in EXTRACTION_COUNTS)
        counted = counted.join(F.broadcast(extraction.agg(*sums)), F.lit(True))  # one row each
    out = counted.select("*", *(F.round(x, 6).alias(n) for n, x in _ratios().items()))
    return evaluate.verdict(out.drop("reciprocal").withColumns({n: F.round(n, 3) for n in ("latency_median_ms", "latency_p95_ms")}))


def _ratios() -> dict[str, Column]:
    c = F.col
    p, r = ratio(c("extraction_true_positive"), c("extraction_predicted")), ratio(c("extraction_true_positive"), c("extraction_gold"))
    return {
        "citation_precision": ratio(c("citation_correct"), c("citation_returned")),
        "citation_recall": ratio(c("citation_expected_matched"), c("citation_expected")),
        "citation_case_accuracy": ratio(c("answerable_correct"), c("answerable_total")),
        "retrieval_recall_at_5": ratio(c("retrieval_hits_at_5"), c("answerable_total")),
        "retrieval_mrr_at_5": ratio(c("reciprocal"), c("answerable_total")),
        "abstention_accuracy": ratio(c("abstention_correct"), c("abstention_total")),
        "extraction_precision": p,
        "extraction_recall": r,
        "extraction_f1": f1(p, r),
        "error_rate": ratio(c("errors"), c("case_count")),
        "schema_error_rate": ratio(c("schema_errors"), c("case_count")),
    }


def integrity_errors(cases: DataFrame, at: int = AT) -> DataFrame:
    """(id, rule) of stored case rows that contradict themselves."""
    c = F.col
    derived = F.transform(F.filter("retrieved", lambda r: r["rank"] <= at), lambda r: F.exists("expected_locations", lambda g: (g["document_id"] == r["document_id"]) & (g["page"] == r["page"])))
    asked = c("kind") == "answerable"
    place = F.nullif(F.array_position(F.coalesce(c("retrieval_matches_at_5"), F.array().cast("array<boolean>")), F.lit(True)), F.lit(0))
    rules = [
        ((c("status") == "error") & c("schema_error").isNull(), "schema error flag is missing"),
        (F.isnan("latency_ms") | (c("latency_ms") < 0) | (c("latency_ms") == float("inf")), "latency must be finite and not negative"),
        (asked & c("retrieval_completed").isNull(), "retrieval state is missing"),
        (~c("retrieval_completed") & (F.size("retrieved") > 0), "passages of a retrieval that didn't complete"),
        (asked & (F.coalesce(F.size("expected_locations"), F.lit(0)) < 1), "expected locations are missing"),
        (asked & F.exists("expected_locations", lambda g: g["document_id"].isNull() | g["page"].isNull() | (g["page"] < 1)), "invalid expected location"),
        (asked & F.exists("retrieved", lambda r: r["document_id"].isNull() | r["page"].isNull()), "invalid passage"),
        (asked & ~c("retrieval_matches_at_5").eqNullSafe(derived), "matches differ from the passages"),
        (asked & ~c("retrieval_rank").cast("long").eqNullSafe(place), "rank differs from the matches"),
        (c("retrieval_rank") > F.size("retrieved"), "rank beyond the passages"),
    ]
    broken = F.filter(F.array(*(F.when(F.coalesce(x, F.lit(False)), F.lit(name)) for x, name in rules)), lambda x: x.isNotNull())
    return cases.select("id", F.explode(broken).alias("rule"))


def recalculate(cases: DataFrame, extraction: DataFrame | None, recorded: DataFrame) -> DataFrame:
    """metric, recorded, recalculated, drifted: every metric again from the stored rows, against the one row that was recorded."""
    now = metrics(cases, extraction)
    names = [n for n in (*_ratios(), "latency_median_ms", "latency_p95_ms", *COUNTS, *EXTRACTION_COUNTS) if n in recorded.columns]
    long = lambda df, to: df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias(to)) for n in names))).alias("x")).select("x.*")
    both = long(recorded, "recorded").join(long(now, "recalculated"), "metric")
    unsound = F.col("recorded").isNull() | F.isnan("recorded") | (F.col("recorded") < 0)
    return both.select("metric", "recorded", "recalculated", (unsound | (F.abs(F.col("recorded") - F.col("recalculated")) > DRIFT)).alias("drifted"))


# --- choices --------------------------------------------------------------


def select_method(results: DataFrame) -> DataFrame:
    """Which retrieval method is kept, of one row of metrics for each: selected, reranker_retained, additional.

    The most correct answers decide, then correct citations, abstentions and
    hits; of equals the simplest. The reranker has to bring a correct answer
    more than the hybrid without making anything worse, and to beat the best
    of the others.
    """
    simple = F.element_at(F.create_map(*(F.lit(x) for i, m in enumerate(("lexical", "dense", "hybrid", "hybrid_rerank")) for x in (m, i))), F.col("method"))
    key = F.struct("answerable_correct", "citation_correct", "abstention_correct", "retrieval_hits_at_5", (-simple).alias("simple"))
    rows = results.withColumn("key", key)
    of = lambda method: F.max_by(F.struct(*results.columns, "key"), F.col("method") == method)
    base = F.max(F.when(F.col("method") != "hybrid_rerank", F.struct("key", "method")))
    one = rows.agg(base.alias("base"), of("hybrid").alias("h"), of("hybrid_rerank").alias("r"))  # four rows
    no_worse = F.lit(True)
    for name in ("citation_correct", "abstention_correct", "retrieval_hits_at_5", "extraction_f1"):
        no_worse = no_worse & (F.col(f"r.{name}") >= F.col(f"h.{name}"))
    no_worse = no_worse & (F.col("r.error_rate") <= F.col("h.error_rate"))
    more = F.col("r.answerable_correct") - F.col("h.answerable_correct")
    kept = (more >= 1) & no_worse
    beats = F.col("r.key") > F.col("base.key")
    return one.select(F.when(kept & beats, "hybrid_rerank").otherwise(F.col("base.method")).alias("selected"), kept.alias("reranker_retained"), more.alias("additional"), no_worse.alias("no_regression"))


def run_digests(cases: DataFrame, run: str = "run") -> DataFrame:
    """One digest for each run over what it decided, in order of case: equal runs made the same decisions."""
    said = F.sha2(F.to_json(F.struct("id", "status", "answer", "answer_match", "citation_matches", "retrieval_rank")), 256)
    return cases.groupBy(run).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", said.alias("d")))), lambda x: x["d"]), ""), 256).alias("digest"), F.count("*").alias("cases"))


def select_strategy(runs: DataFrame, calibration_at: float, key: list[str]) -> DataFrame:
    """The configuration that is kept, or none: configuration, partition, repetition, digest, accuracy and metrics of each run.

    A configuration must reproduce its decisions in all repetitions, and reach
    the gate on the calibration partition; of those the one whose worst metric
    on the selection partition is best stays.
    """
    gate = runs.where("partition = 'calibration'").groupBy("configuration").agg(F.min("accuracy").alias("least"), F.countDistinct("digest").alias("ways")).where((F.col("least") >= calibration_at) & (F.col("ways") == 1))
    chosen = runs.where("partition = 'selection'").groupBy("configuration").agg(F.countDistinct("digest").alias("ways"), *(F.min(k).alias(k) for k in key)).where("ways = 1").drop("ways")
    return evaluate.select_best(chosen.join(gate.select("configuration"), "configuration", "left_semi"), key, [])


def newest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows of each key the newest."""
    place = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("newest_place", F.row_number().over(place)).where("newest_place = 1").drop("newest_place")
