"""Frozen runs: what went into them, whether it is still the same, and what must hold before a single attempt."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprint(files: DataFrame) -> DataFrame:
    """One digest over the names and contents of some files, in order of name: name, zero byte, content, zero byte."""
    zero = F.lit(b"\x00")
    parts = files.select("name", F.concat(F.col("name").cast("binary"), zero, F.col("content"), zero).alias("part"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("name", F.hex("part").alias("hex")))), lambda x: x["hex"])
    return parts.agg(F.sha2(F.unhex(F.array_join(listed, "")), 256).alias("fingerprint"), F.count("*").alias("files"))  # a few source files


def freeze_record(files: DataFrame) -> DataFrame:
    """name, bytes, sha256 of every file that a run depends on."""
    return files.select("name", F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def record_digest(record: DataFrame) -> DataFrame:
    """The digest of a whole record, whatever the order of its rows."""
    line = F.concat_ws(" ", "sha256", F.col("bytes").cast("string"), "name")
    return record.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("record_sha256"))


def differences(attested: DataFrame, found: DataFrame) -> DataFrame:
    """key, attested, found and what is wrong (missing, unexpected, differs) of two key-value tables that should be equal."""
    a, b = attested.select("key", F.col("value").alias("attested"), F.lit(True).alias("in_a")), found.select("key", F.col("value").alias("found"), F.lit(True).alias("in_b"))
    both = a.join(b, "key", "full_outer")
    wrong = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "unexpected").when(~F.col("attested").eqNullSafe(F.col("found")), "differs")
    return both.select("key", "attested", "found", wrong.alias("wrong")).where("wrong IS NOT NULL")


def preflight(stages: list[tuple[str, Callable[[], DataFrame]]], spark) -> DataFrame:
    """stage, place, ok and problems: every check (a function that gives rows of what is wrong) in order, up to the first that fails."""
    done = []
    for place, (name, check) in enumerate(stages):
        problems = check().count()
        done.append((name, place, problems == 0, problems))
        if problems:
            break
    return spark.createDataFrame(done, "stage string, place int, ok boolean, problems long")


def may_start(passed: DataFrame, wanted: int) -> bool:
    """Whether all stages were run and are sound: only then the single attempt may be claimed."""
    row = passed.agg(F.count("*").alias("n"), F.coalesce(F.bool_and("ok"), F.lit(False)).alias("ok")).first()
    return row["ok"] and row["n"] == wanted


def finalised(runs: DataFrame, recalculated: DataFrame, repetitions: int) -> DataFrame:
    """configuration and whether it may be final: enough runs, one digest, no metric that drifted when recalculated."""
    drift = recalculated.groupBy("configuration").agg(F.count_if("drifted").alias("drifted"))
    counted = runs.groupBy("configuration").agg(F.count("*").alias("runs"), F.countDistinct("digest").alias("ways"))
    ok = (F.col("runs") >= repetitions) & (F.col("ways") == 1) & (F.coalesce("drifted", F.lit(0)) == 0)
    return counted.join(drift, "configuration", "left").select("configuration", "runs", ok.alias("final"))
