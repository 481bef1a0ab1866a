"""The boundary between what documents say and what they try to make a reader do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as T


def with_blocked(frame: DataFrame, values: str, blocked: str = "blocked", product: str | None = None) -> DataFrame:
    """Add an array of booleans beside an array of fragments: which of them must not be used.

    Unsafe fragments are. If the others together are unsafe, all that aren't
    blank are: an instruction may be split over lines. Fragments are only
    looked at one by one where all of them together hold a word that an
    instruction needs, and held against the patterns only where they hold one
    themselves; `product` is a name that instructions may address.
    """
    may, folded, flags, rest = "_may", "_folded", "_flags", "_rest"
    # Folded fragments joined by a space fold to the same as the joined fragments.
    out = frame.withColumn(may, T.may_instruct(T.strong_fold(F.array_join(values, "\n", "")), product))
    out = out.withColumn(folded, F.when(F.col(may), F.transform(values, lambda v: T.strong_fold(F.coalesce(v, F.lit(""))))))
    told = lambda f: F.when(T.may_instruct(f, product), T.instructs(f, product)).otherwise(False)
    out = out.withColumn(flags, F.transform(folded, told))
    safe = F.filter(F.arrays_zip(F.col(folded).alias("f"), F.col(flags).alias("b")), lambda x: ~x["b"] & (x["f"] != ""))
    joined = F.regexp_replace(F.array_join(F.transform(safe, lambda x: x["f"]), " "), r"\bover\s+ride\b", "override")
    out = out.withColumn(rest, T.let(joined, told))
    every = F.transform(values, lambda v: T.strip(v) != "")
    merged = F.when(F.col(may), F.when(F.col(rest), F.zip_with(flags, every, lambda a, b: a | b)).otherwise(F.col(flags)))
    return out.withColumn(blocked, F.coalesce(merged, F.transform(values, lambda _: F.lit(False)))).drop(may, folded, flags, rest)


def admitted(frame: DataFrame, values: str) -> DataFrame:
    """Keep only the fragments that may be used."""
    kept = F.transform(F.filter(F.arrays_zip(F.col(values).alias("v"), F.col("_blocked").alias("b")), lambda x: ~x["b"]), lambda x: x["v"])
    return with_blocked(frame, values, "_blocked").withColumn(values, kept).drop("_blocked")


def sanitize_values(extracted: DataFrame) -> DataFrame:
    """Drop extracted rows whose value or excerpt gives instructions; a value without a citation goes, too."""
    return extracted.where(~T.untrusted(F.col("value")) & F.col("excerpt").isNotNull() & ~T.untrusted(F.col("excerpt")))
