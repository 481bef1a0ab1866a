"""Suites of evaluations that can be stopped and taken up again.

A cell is one configuration on one partition of a dataset, once. Its result
and its entry in the ledger are one commit, so a cell is there whole or not at
all, and what is left to do is an anti-join. An entry holds a digest of the
result's contents, which doesn't depend on how rows are ordered or filed; a
suite whose stored results don't have the digests that its ledger says isn't
taken up.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.sources.snapshots import Snapshot, Store

CELL = "cell string, configuration string, parameters string, partition string, repetition int"
LEDGER = f"{CELL}, digest string, rows bigint, seconds double"


class Tampered(RuntimeError):
    """Stored results aren't those that were recorded."""


def cells(spark: SparkSession, configurations: dict[str, str], partitions: list[str], repetitions: int) -> DataFrame:
    """All cells of a suite; a cell is named by what it stands for, its parameters included."""
    rows = [(name, parameters, p, r) for name, parameters in sorted(configurations.items()) for p in partitions for r in range(1, repetitions + 1)]
    named = spark.createDataFrame(rows, "configuration string, parameters string, partition string, repetition int")
    return named.select(F.sha2(F.to_json(F.struct("configuration", "parameters", "partition", "repetition")), 256).alias("cell"), "*")


def digests(rows: DataFrame, key: str = "cell") -> DataFrame:
    """(key, digest, rows): of the contents of each key's rows, in any order. Rows count as often as they occur.

    Sums of the words of the rows' digests are aggregated partially; no group is gathered.
    """
    own = rows.select(key, F.sha2(F.to_json(F.struct(*sorted(c for c in rows.columns if c not in (key, "commit"))), {"ignoreNullFields": "false"}), 256).alias("sha"))
    words = [F.sum(F.conv(F.substring("sha", 8 * i + 1, 8), 16, 10).cast("long")).alias(f"w{i}") for i in range(8)]
    return own.groupBy(key).agg(F.count("*").alias("rows"), *words).select(key, F.sha2(F.concat_ws("|", "rows", *(f"w{i}" for i in range(8))), 256).alias("digest"), "rows")


class Suite:
    """Results (any columns of a fixed schema) and ledger of one suite, in a store of their own."""

    def __init__(self, spark: SparkSession, folder: str, result_schema: str):
        self.spark, self.store, self.schema = spark, Store(spark, folder), f"cell string, {result_schema}"

    def ledger(self, at: Snapshot | None = None) -> DataFrame:
        return self.store.read("ledger", LEDGER, at).drop("commit")

    def results(self, at: Snapshot | None = None) -> DataFrame:
        return self.store.read("results", self.schema, at).drop("commit")

    def pending(self, planned: DataFrame, at: Snapshot | None = None) -> DataFrame:
        return planned.join(self.ledger(at).select("cell"), "cell", "left_anti").orderBy("configuration", "partition", "repetition")

    def altered(self, at: Snapshot | None = None) -> DataFrame:
        """(cell, recorded, found): cells whose stored results are not those of the ledger, and results without an entry."""
        at = at or self.store.snapshot()
        found = digests(self.results(at)).select("cell", F.col("digest").alias("found"))
        recorded = self.ledger(at).where("rows > 0").select("cell", F.col("digest").alias("recorded"))
        return recorded.join(found, "cell", "full_outer").where(~F.col("recorded").eqNullSafe(F.col("found")))

    def run(self, planned: DataFrame, evaluate: Callable[[dict], DataFrame], most: int | None = None) -> int:
        """Evaluate what is pending, a cell (as a dictionary) at a time, each a job of its own; how many were. `most` stops after so many."""
        if bad := [r["cell"] for r in self.altered().limit(3).collect()]:
            raise Tampered(", ".join(bad))
        todo = [r.asDict() for r in self.pending(planned).collect()]  # as many as the suite has cells
        for cell in todo[:most]:
            began = time.perf_counter()
            rows = evaluate(cell).select(F.lit(cell["cell"]).alias("cell"), "*").persist()
            try:
                found = digests(rows).first()
                entry = (*(cell[c.split()[0]] for c in CELL.split(", ")), found["digest"] if found else None, found["rows"] if found else 0, time.perf_counter() - began)
                ledger = self.spark.createDataFrame([entry], LEDGER)
                self.store.change(lambda base: {"append": {"results": rows, "ledger": ledger}})  # noqa: B023
            finally:
                rows.unpersist()
        return len(todo[:most])

    def complete(self, planned: DataFrame) -> bool:
        return self.pending(planned).isEmpty() and self.altered().isEmpty()


def summary(results: DataFrame, ledger: DataFrame, *measures: str) -> DataFrame:
    """Per configuration and partition: how many repetitions, whether they all have the same result, and the mean of each measure."""
    means = [F.avg(m).alias(m) for m in measures]
    per_cell = results.groupBy("cell").agg(*means)
    return ledger.join(per_cell, "cell", "left").groupBy("configuration", "partition").agg(F.count("*").alias("repetitions"), (F.count_distinct("digest") <= 1).alias("stable"), *(F.avg(m).alias(m) for m in measures))
