"""Metrics of answers, retrieval and extraction against gold data."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import patterns as P
from quillstone.functions import text as T


def ratio(part: Column, whole: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def citation_matches(returned: DataFrame, gold: DataFrame) -> DataFrame:
    """Returned citations with `correct`: a gold citation of the case has that document and page and contains the excerpt, of two words or more.

    Both sides: case_id, document_id, page, excerpt; returned has an ord.
    """
    given = returned.withColumn("_r", T.normalize(F.col("excerpt"))).where(F.size(F.split("_r", " ")) >= 2)
    known = gold.select("case_id", "document_id", "page", T.normalize(F.col("excerpt")).alias("_g"))
    right = given.join(known, ["case_id", "document_id", "page"]).where(F.contains("_g", "_r")).select("case_id", "ord").distinct().withColumn("correct", F.lit(True))
    return returned.join(right, ["case_id", "ord"], "left").withColumn("correct", F.coalesce("correct", F.lit(False)))


def retrieval_metrics(ranked: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """recall and mrr at k over the cases in gold (case_id, document_id, page)."""
    hits = ranked.where(F.col("rank") <= k).join(gold.select("case_id", "document_id", "page").distinct(), ["case_id", "document_id", "page"], "left_semi")
    best = hits.groupBy("case_id").agg(F.min("rank").alias("first"))
    cases = gold.select("case_id").distinct().join(best, "case_id", "left")
    return cases.agg(ratio(F.count("first"), F.count("*")).alias("recall"), ratio(F.sum(F.coalesce(1 / F.col("first"), F.lit(0.0))), F.count("*")).alias("mrr"))


def greedy_matches(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Match the values of each (document_id, field) one to one, in gold order, to the first that fits.

    Greedy matching has an order, so a field's values, few as they are, are
    matched together; which pairs fit is decided by Column functions before.
    """
    kind = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for item in P.FIELD_KINDS.items() for x in item)), F.col("field")), F.lit("text"))
    fits = gold.join(predicted.withColumnsRenamed({"value": "actual", "value_ord": "actual_ord"}), ["document_id", "field"]).where(T.value_matches(F.col("actual"), F.col("value"), kind)).select("document_id", "field", "value_ord", "actual_ord")

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        used: set[int] = set()
        out = []
        for gold_ord, group in rows.sort_values(["value_ord", "actual_ord"]).groupby("value_ord"):
            free = [a for a in group["actual_ord"] if a not in used]
            if free:
                used.add(free[0])
                out.append((rows["document_id"].iloc[0], rows["field"].iloc[0], gold_ord, free[0]))
        return pd.DataFrame(out, columns=["document_id", "field", "value_ord", "actual_ord"])

    return fits.groupBy("document_id", "field").applyInPandas(match, fits.schema)


def nearest_rank(value: Column, share: float) -> Column:
    """The smallest value that at least this share of all values don't exceed."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {value._jc.toString()})")


def verdict(metrics: DataFrame) -> DataFrame:
    """Add PASS or FAIL: all minima reached, both error rates exactly zero."""
    good = F.lit(True)
    for name, least in P.TARGET_MINIMA.items():
        good = good & (F.col(name) >= least)
    for name in P.TARGET_ZEROS:
        good = good & (F.col(name) == 0)
    return metrics.withColumn("verdict", F.when(F.coalesce(good, F.lit(False)), "PASS").otherwise("FAIL"))


def failing_targets(metrics: DataFrame) -> DataFrame:
    """metric, observed, target of every target that is missed."""
    names = [*P.TARGET_MINIMA, *P.TARGET_ZEROS]
    long = metrics.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("observed"), F.lit(P.TARGET_MINIMA.get(n, 0.0)).alias("target")) for n in names))).alias("x")).select("x.*")
    return long.where(F.when(F.col("metric").isin(*P.TARGET_ZEROS), F.col("observed") != 0).otherwise(F.col("observed") < F.col("target")))


def select_best(configurations: DataFrame, metrics: list[str], ties: list[str]) -> DataFrame:
    """The configuration whose worst metric is best; ties by further columns, descending; none if still tied."""
    worst = F.least(*(F.col(m) for m in metrics))
    order = [F.desc("worst"), *(F.desc(t) for t in ties)]
    ranked = configurations.withColumn("worst", worst).withColumn("place", F.dense_rank().over(Window.orderBy(*order)))  # a few configurations
    first = ranked.where("place = 1")
    return first.join(first.groupBy("place").count().where("count = 1"), "place", "left_semi").drop("place")


def stable(runs: DataFrame) -> DataFrame:
    """Whether all runs of a configuration made the same decisions; medians of latency, the largest memory, the sum of time."""
    return runs.groupBy("configuration").agg((F.countDistinct("digest") == 1).alias("stable"), F.median("latency_ms").alias("median_ms"), F.max("rss_bytes").alias("max_rss"), F.sum("wall_ms").alias("total_ms"))


def changed_cases(baseline: DataFrame, candidate: DataFrame, columns: list[str]) -> DataFrame:
    """case_id and whether any column differs between two runs, nulls compared as values; cases of one run only differ."""
    a, b = baseline.withColumn("_a", F.lit(True)), candidate.withColumnsRenamed({c: f"_b_{c}" for c in columns}).withColumn("_b", F.lit(True))
    differs = F.col("_a").isNull() | F.col("_b").isNull()
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    return a.join(b, "case_id", "full_outer").select("case_id", differs.alias("changed"))
