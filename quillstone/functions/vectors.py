"""Vectors: products, norms and feature-hash embeddings."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_DIMENSION = 384


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Divided by its norm; a zero vector stays as it is."""
    length = norm(a)
    return F.when(length == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / length))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def cosine_of_units(a: Column, b: Column) -> Column:
    return clamp(dot(a, b), -1.0, 1.0)


def similarity(a: Column, b: Column) -> Column:
    """Cosine moved to 0 ... 1."""
    return clamp((dot(a, b) + 1) / 2, 0.0, 1.0)


def hash_model_id(dimension: int = HASH_DIMENSION) -> str:
    return f"deterministic-hash-v1:{dimension}"


@lru_cache(maxsize=200_000)
def _word_features(word: str, dimension: int) -> tuple[tuple[int, float], ...]:
    """Place and sign of a word and of its padded trigrams, given by BLAKE2b."""
    padded = f"  {word}  "
    features = (word, *(padded[i : i + 3] for i in range(len(padded) - 2)))
    values = (int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "big") for f in features)
    return tuple((v % dimension, 1.0 - 2.0 * (v & 1)) for v in values)


def hash_vector(text: str, dimension: int = HASH_DIMENSION) -> list[float]:
    """Signed counts of words and their trigrams, with unit norm."""
    counts = [0.0] * dimension
    for word, n in Counter(re.findall(r"[a-z0-9]+", text.casefold())).items():
        for place, sign in _word_features(word, dimension):
            counts[place] += sign * n
    length = math.sqrt(math.fsum(x * x for x in counts))
    return [x / length for x in counts] if length else counts


def hash_embedding(dimension: int = HASH_DIMENSION):
    """A vectorised function of a text column. Spark has no BLAKE2b, so this one runs in Python."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hash_vector(t or "", dimension))

    return embed
