"""Commands: validate a dataset, evaluate it, choose a retrieval method, recalculate a stored run."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from quillstone import engine
from quillstone.operators import evaluation, providers, service
from quillstone.sources import datasets


def shown(rows: DataFrame) -> str:
    """A few rows as JSON, sorted."""
    return json.dumps(sorted((json.loads(x) for x in rows.toJSON().collect()), key=str), ensure_ascii=False, indent=1)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 if all is well, 1 if a dataset breaks rules, targets are missed or metrics drifted."""
    parser = argparse.ArgumentParser(prog="quillstone")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("validate", "evaluate", "benchmark"):
        command = commands.add_parser(name)
        command.add_argument("corpus")
        command.add_argument("cases")
        if name != "validate":
            command.add_argument("--split", default="development", choices=("development",))
            command.add_argument("--mode", default="grounded")
        if name == "evaluate":
            command.add_argument("--out", help="a new folder for case rows and metrics")
    recalculate = commands.add_parser("recalculate")
    recalculate.add_argument("run", help="a folder that evaluate wrote")
    options = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("quillstone").getOrCreate()

    if options.command == "recalculate":
        cases = spark.read.parquet(f"{options.run}/cases")
        recorded = spark.read.schema(spark.read.parquet(f"{options.run}/metrics").schema).parquet(f"{options.run}/metrics")
        drift = evaluation.recalculate(cases, None, recorded).where("drifted")
        broken = evaluation.integrity_errors(cases)
        print(shown(drift), shown(broken), sep="\n")
        return int(not (drift.isEmpty() and broken.isEmpty()))

    corpus, cases = datasets.read_json(spark, options.corpus, datasets.CORPUS), datasets.read_json(spark, options.cases, datasets.CASES)
    if options.command == "validate":
        found = datasets.violations(corpus, cases)
        print(shown(found))
        return int(not found.isEmpty())
    bundle = providers.bundle(options.mode)
    if options.command == "benchmark":
        rows, chosen = engine.benchmark(corpus, cases, options.split, bundle)
        print(shown(rows), shown(chosen), sep="\n")
        return 0
    rows, metrics = engine.evaluate_manifest(corpus, cases, options.split, bundle)
    if options.out:
        rows.write.mode("errorifexists").parquet(f"{options.out}/cases")
        rows = spark.read.parquet(f"{options.out}/cases")
        metrics = evaluation.metrics(rows)
        metrics.write.mode("errorifexists").parquet(f"{options.out}/metrics")
        service.write_new(metrics, f"{options.out}/summary")
    row = metrics.first()
    print(json.dumps(row.asDict(), indent=1))
    return int(row["verdict"] != "PASS")


if __name__ == "__main__":
    raise SystemExit(main())
