"""Metrics of requests, documents and providers, as mergeable rows.

A metric row is (metric, labels, bound, value): a counter has one row for its
labels, a histogram one for each bucket (how many were at most `bound`), and
its sum and count. Rows of different jobs, batches and partitions are added,
so metrics of any stretch of time are a sum over stored rows. Observations
ride on a query that runs anyway and need no second pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Seconds (fixed values: the bounds that dashboards of such services expect).
BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0, float("inf"))
ROW = "metric string, labels map<string,string>, bound double, value double"
METRICS = {
    "http_requests_total": ("counter", ("method", "route", "status")),
    "http_request_duration_seconds": ("histogram", ("method", "route")),
    "search_duration_seconds": ("histogram", ("mode", "result")),
    "document_tasks_total": ("counter", ("result",)),
    "model_errors_total": ("counter", ("provider",)),
}


def _labels(metric: str) -> Column:
    return F.create_map(*(x for name in METRICS[metric][1] for x in (F.lit(name), F.coalesce(F.col(name).cast("string"), F.lit("")))))


def counter(events: DataFrame, metric: str) -> DataFrame:
    """How many events there are of each combination of the metric's labels, which are columns; a null label is empty."""
    names = METRICS[metric][1]
    counts = events.groupBy(*names).agg(F.count("*").cast("double").alias("value"))
    return counts.select(F.lit(metric).alias("metric"), _labels(metric).alias("labels"), F.lit(None).cast("double").alias("bound"), "value")


def histogram(events: DataFrame, metric: str, seconds: str = "seconds") -> DataFrame:
    """Cumulative buckets, sum and count of durations. Those that are null or not a number don't count."""
    names = METRICS[metric][1]
    took = F.col(seconds).cast("double")
    sound = events.where(took.isNotNull() & ~F.isnan(took))
    within = [F.count_if(took <= b).cast("double").alias(f"b{i}") for i, b in enumerate(BOUNDS)]
    wide = sound.groupBy(*names).agg(*within, F.sum(took).alias("total"))
    rows = F.array(
        *(F.struct(F.lit("_bucket").alias("part"), F.lit(float(b)).alias("bound"), F.col(f"b{i}").alias("value")) for i, b in enumerate(BOUNDS)),
        F.struct(F.lit("_sum").alias("part"), F.lit(None).cast("double").alias("bound"), F.col("total").alias("value")),
        F.struct(F.lit("_count").alias("part"), F.lit(None).cast("double").alias("bound"), F.col(f"b{len(BOUNDS) - 1}").alias("value")),
    )
    return wide.select(_labels(metric).alias("labels"), F.explode(rows).alias("r")).select(F.concat(F.lit(metric), F.col("r.part")).alias("metric"), "labels", "r.bound", "r.value")


def merged(*parts: DataFrame) -> DataFrame:
    """Metric rows of several jobs, added."""
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    keyed = every.withColumn("key", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("labels")))))
    return keyed.groupBy("metric", "key", "bound").agg(F.first("labels").alias("labels"), F.sum("value").alias("value")).select("metric", "labels", "bound", "value")


def quantile(rows: DataFrame, metric: str, q: float) -> DataFrame:
    """(labels, value): a quantile of a histogram, by a straight line inside its bucket; the last finite bound where it lies beyond."""
    own = rows.where(F.col("metric") == f"{metric}_bucket").groupBy(F.to_json(F.map_from_entries(F.array_sort(F.map_entries("labels")))).alias("key"))
    lists = own.agg(F.first("labels").alias("labels"), F.array_sort(F.collect_list(F.struct("bound", "value"))).alias("b"))  # as many as there are bounds
    wanted = q * F.element_at("b", -1)["value"]
    at = F.size(F.filter("b", lambda x: x["value"] < wanted))
    low = F.when(at > 0, F.get("b", at - 1)).otherwise(F.struct(F.lit(0.0).alias("bound"), F.lit(0.0).alias("value")))
    here = F.get("b", at)
    inside = low["bound"] + (here["bound"] - low["bound"]) * (wanted - low["value"]) / F.nullif(here["value"] - low["value"], F.lit(0.0))
    return lists.select("labels", F.when(here["bound"] == float("inf"), low["bound"]).otherwise(F.coalesce(inside, low["bound"])).alias("value"))


def exposition(rows: DataFrame, prefix: str = "quillstone_") -> DataFrame:
    """One line of text for each metric row, in the format that scrapers read."""
    def escaped(value: Column) -> Column:
        for plain, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
            value = F.replace(value, F.lit(plain), F.lit(written))
        return value

    shown = F.when(F.col("bound") == float("inf"), "+Inf").otherwise(F.format_string("%s", F.col("bound")))
    pairs = F.concat(F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit('="'), escaped(e["value"]), F.lit('"'))), F.when(F.col("bound").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit('le="'), shown, F.lit('"')))))
    return rows.select(F.concat(F.lit(prefix), "metric", F.lit("{"), F.array_join(pairs, ","), F.lit("} "), F.col("value").cast("string")).alias("line"))


def observed_tasks(outcome: DataFrame, observation: Observation) -> DataFrame:
    """The same rows (with `status`); counts of completed, failed and other ones are in the observation when they have been written."""
    status = F.col("status")
    return outcome.observe(observation, F.count_if(status == "completed").alias("completed"), F.count_if(status == "failed").alias("failed"), F.count_if(~F.coalesce(status.isin("completed", "failed"), F.lit(False))).alias("other"))


class TaskMetrics(StreamingQueryListener):
    """Adds up what a stream's queries observed under one name, as they make progress."""

    def __init__(self, name: str = "document_tasks"):
        self.name, self.counts, self.batches = name, {}, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.name)
        self.batches += 1
        if seen is not None:
            for result, n in seen.asDict().items():
                self.counts[result] = self.counts.get(result, 0) + int(n)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
