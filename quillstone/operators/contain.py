"""Which texts hold which passages, word for word.

Passages are a stated set. They become one automaton that finds all of them
in a single pass over a text, whatever their number; no pair of a text and a
passage that it doesn't hold is ever made. An automaton is built for at most
so many characters; more passages are dealt to several, and a pass over the
texts is made for each, so that a task holds one automaton and a few texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CHARS = 64_000_000  # of all passages, which travel with the tasks
AUTOMATON_CHARS = 4_000_000  # of those in one automaton
SLICE_ROWS = 100  # texts looked at together


def _dealt(passages: list[str]) -> Iterator[tuple[int, list[str]]]:
    """The passages in parts, one for each automaton, each with the place where it begins."""
    begin = chars = 0
    for at, passage in enumerate(passages):
        if at > begin and chars + len(passage) > AUTOMATON_CHARS:
            yield begin, passages[begin:at]
            begin, chars = at, 0
        chars += len(passage)
    yield begin, passages[begin:]


def _found(batches: Iterator[pa.RecordBatch], first: int, passages: list[str]) -> Iterator[pa.RecordBatch]:
    """The batches' rows without their text `t`, one for each passage that it holds, and that passage's place."""
    automaton = ahocorasick.Automaton()
    for at, passage in enumerate(passages, first):
        automaton.add_word(passage, at)
    automaton.make_automaton()
    for batch in batches:
        for begin in range(0, batch.num_rows, SLICE_ROWS):
            part, rows, held = batch.slice(begin, SLICE_ROWS), [], []
            for at, own in enumerate(part.column("t").to_pylist()):
                here = sorted({i for _, i in automaton.iter(own)}) if own else []
                rows += [at] * len(here)
                held += here
            if rows:
                kept = part.drop_columns(["t"]).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(held, pa.int32())], schema=pa.schema([*kept.schema, pa.field("passage", pa.int32())]))


def holding(texts: DataFrame, passages: DataFrame, keys: list[str], text: str = "text", key: str = "question_id", passage: str = "question") -> DataFrame:
    """(keys, key): each text with each passage it holds, once, however often it does.

    Null and empty passages are held by none, null texts hold none. Passages
    that are equal are all found. Repeated texts are rows of their own.
    """
    rows = passages.select(F.col(key).alias("k"), F.col(passage).alias("p")).where("length(p) > 0")
    if (rows.agg(F.sum(F.length("p"))).first()[0] or 0) > MAX_CHARS:
        raise ValueError(f"passages of more than {MAX_CHARS} characters: ask in blocks")
    known: dict[str, list] = {}
    for k, p in map(tuple, rows.collect()):
        known.setdefault(p, []).append(k)
    spelled, names = list(known), list(known.values())
    kind = {f.name: f.dataType.simpleString() for f in (*texts.schema, *passages.schema)}
    wide = texts.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keys)), F.col(text).alias("t"))
    ddl = ", ".join([f"k{i} {kind[c]}" for i, c in enumerate(keys)] + ["passage int"])
    parts = _dealt(spelled) if spelled else ()
    passes = [wide.mapInArrow(partial(_found, first=first, passages=own), ddl) for first, own in parts] or [texts.sparkSession.createDataFrame([], ddl)]
    out = reduce(DataFrame.unionAll, passes)
    table = texts.sparkSession.createDataFrame([(i, n) for i, own in enumerate(names) for n in own], f"passage int, {key} {kind[key]}")
    named = out.join(F.broadcast(table), "passage")
    return named.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keys)), key)
