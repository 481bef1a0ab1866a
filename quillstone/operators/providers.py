"""Where other models plug in: embedders, rerankers, scorers, language models, answering and extraction."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import patterns as P
from quillstone.functions import text as T
from quillstone.functions import vectors as V
from quillstone.operators import answer, extract, ground, grounded, retrieve, service


class Embedder(Protocol):
    """Unit vectors of texts. `load` runs once in each Python worker and gives a function of a batch."""

    model_id: str
    dimension: int

    def load(self) -> Callable[[list[str]], np.ndarray]: ...


class NliScorer(Protocol):
    """Probabilities of (contradiction, neutral, entailment) for pairs of premise and hypothesis."""

    def load(self) -> Callable[[list[tuple[str, str]]], np.ndarray]: ...


class LanguageModel(Protocol):
    """The JSON decision that a model gives to each prompt."""

    def load(self) -> Callable[[list[str]], list[str]]: ...


@dataclass(frozen=True)
class HashEmbedder:
    dimension: int = V.HASH_DIMENSION

    @property
    def model_id(self) -> str:
        return V.hash_model_id(self.dimension)

    def load(self) -> Callable[[list[str]], np.ndarray]:
        return lambda texts: np.array([V.hash_vector(t, self.dimension) for t in texts])


def vector_errors(vectors: np.ndarray, expected: int, dimension: int) -> str | None:
    """Why a batch of vectors can't be used; None if it can."""
    if len(vectors) != expected:
        return "not one vector for each text"
    if vectors.ndim != 2 or vectors.shape[1] != dimension:
        return "wrong dimension"
    if not np.isfinite(vectors).all():
        return "components must be finite"
    return "a vector is zero" if not vectors.any(1).all() else None


def embed(embedder: Embedder, batch: int = 32):
    """A Column function from texts to vectors; null and empty texts get null. The model is loaded once a worker."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = embedder.load()
        for texts in parts:
            out: list = [None] * len(texts)
            at = [i for i, t in enumerate(texts) if t]
            for k in range(0, len(at), batch):
                own = at[k : k + batch]
                vectors = np.asarray(model([texts.iloc[i] for i in own]), float)
                if error := vector_errors(vectors, len(own), embedder.dimension):
                    raise ValueError(error)
                for i, v in zip(own, vectors.tolist(), strict=True):
                    out[i] = v
            yield pd.Series(out, index=texts.index, dtype=object)

    return run


def with_vectors(rows: DataFrame, embedder: Embedder, column: str = "text") -> DataFrame:
    """Each different text is embedded once."""
    texts = rows.select(F.col(column).alias("embedded_text")).where("embedded_text IS NOT NULL").distinct()
    known = texts.withColumn("embedding", embed(embedder)("embedded_text"))
    return rows.join(known, F.col(column) == F.col("embedded_text"), "left").drop("embedded_text").withColumn("embedding_model_id", F.lit(embedder.model_id))


def pooled(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The mean of the token vectors that the mask keeps."""
    weight = mask[..., None].astype(float)
    return (states * weight).sum(1) / np.maximum(weight.sum(1), 1e-9)


def softmax(logits: np.ndarray) -> np.ndarray:
    """Shares that add up to one, however large the logits are."""
    raised = np.exp(logits - logits.max(-1, keepdims=True))
    return raised / raised.sum(-1, keepdims=True)


def with_nli(drafts: DataFrame, scorer: NliScorer, entail_at: float, contradict_at: float) -> DataFrame:
    """Drafts (question, answer, supporting_excerpt, ...) after a scorer has judged whether the excerpt entails the answer."""

    @F.pandas_udf("struct<contradiction:double,neutral:double,entailment:double>")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = scorer.load()
        for premise, hypothesis in parts:
            out = pd.DataFrame(np.nan, index=premise.index, columns=["contradiction", "neutral", "entailment"])
            known = premise.notna() & hypothesis.notna()
            if known.any():
                out.loc[known] = np.asarray(model(list(zip(premise[known], hypothesis[known], strict=True))), float)
            yield out

    scored = drafts.withColumn("nli", score("supporting_excerpt", F.concat_ws(" ", "question", "answer")))
    shares = {n: F.when(~F.isnan(F.col(f"nli.{n}")), F.col(f"nli.{n}")) for n in ("entailment", "contradiction")}
    return ground.nli_gate(scored.withColumns(shares).drop("nli"), entail_at, contradict_at)


def model_answers(questions: DataFrame, ranked: DataFrame, model: LanguageModel, passages: int = 3) -> DataFrame:
    """question_id, ground.ANSWER_FIELDS and grounding_error of a language model's JSON decisions.

    A decision that isn't sound, values that its excerpt doesn't hold, and
    answers that break a grounding rule are withheld with status `error`.
    """
    @F.pandas_udf("string")
    def complete(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = model.load()
        for prompts in parts:
            yield pd.Series(run(prompts.tolist()), index=prompts.index)

    raw = service.user_prompt(questions, ranked, passages).withColumn("raw", complete("prompt"))
    shape = "answerable boolean, answer string, confidence double, supporting_document string, supporting_page int, supporting_excerpt string, ambiguity_reason string, extracted_fields map<string,array<string>>"
    rows = raw.withColumn("decision_error", ground.decision_error(F.col("raw"))).withColumn("d", F.from_json("raw", shape))
    excerpt = F.col("d.supporting_excerpt")
    place = F.struct("chunk_id", F.col("document_id").cast("string").alias("document_id"), "document_name", F.col("page").cast("int").alias("page"), "section", "text")
    shown = ranked.where(F.col("rank") <= passages).groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("rank", place.alias("c")))).alias("shown"))
    rows = rows.join(shown, "question_id", "left")
    holds = lambda s: (s["c"]["document_id"] == F.col("d.supporting_document")) & (s["c"]["page"] == F.col("d.supporting_page")) & F.contains(s["c"]["text"], excerpt)
    support = F.transform(F.filter(F.coalesce("shown", F.array().cast(shown.schema["shown"].dataType)), holds), lambda s: s["c"])
    cited = F.transform(F.slice(support, 1, 1), lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["document_id"].alias("document_id"), c["document_name"].alias("document_name"), c["page"].alias("page"), c["section"].alias("section"), excerpt.alias("excerpt")))
    status = F.when(F.col("d.answerable"), "answered").when(F.col("d.ambiguity_reason").isNotNull(), "ambiguous").otherwise("abstained")
    text = F.coalesce(F.col("d.answer"), F.when(status == "ambiguous", P.GROUNDED_ANSWERS["conflict"]).otherwise(P.GROUNDED_ANSWERS["insufficient"]))
    drafts = rows.select(
        "question_id", status.alias("status"), F.col("d.answerable").alias("answerable"), text.alias("answer"), "d.confidence", "d.supporting_document", "d.supporting_page", "d.supporting_excerpt", "d.ambiguity_reason",
        F.coalesce("d.extracted_fields", F.create_map().cast("map<string,array<string>>")).alias("extracted_fields"), F.transform(cited, lambda c: c["chunk_id"]).alias("supporting_chunk_ids"), cited.alias("citations"), "decision_error",
    )
    held = ground.checked(drafts.where("decision_error IS NULL").drop("decision_error"), ranked)
    bad = drafts.where("decision_error IS NOT NULL").select(*(
        {"status": F.lit("error"), "answerable": F.lit(False), "answer": F.lit(""), "confidence": F.lit(0.0), "question_id": F.col("question_id"), "grounding_error": F.col("decision_error")}.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
        for f in held.schema.fields
    ))
    return held.unionByName(bad)


def values_supported(values: Column, excerpt: Column) -> Column:
    """Whether an excerpt holds every value, folded."""
    return F.coalesce(F.forall(values, lambda v: F.contains(T.fold(excerpt), T.fold(v))), F.lit(False))


def as_list(value: Column, is_list: bool) -> Column:
    """A value or a list as a list; nothing is an empty one."""
    return F.coalesce(value, F.array()) if is_list else F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.array(value.cast("string")))


#: The JSON schema that constrains a model's decision.
DECISION_SCHEMA = json.dumps(
    {
        "type": "object",
        "additionalProperties": False,
        "required": list(ground.DECISION_KEYS),
        "properties": {
            "answerable": {"type": "boolean"},
            "answer": {"type": ["string", "null"]},
            "confidence": {"type": "number", "minimum": 0, "maximum": 1},
            "supporting_document": {"type": ["string", "null"]},
            "supporting_page": {"type": ["integer", "null"], "minimum": 1},
            "supporting_excerpt": {"type": ["string", "null"]},
            "ambiguity_reason": {"type": ["string", "null"]},
            "extracted_fields": {"type": "object"},
        },
    },
    sort_keys=True,
)


@dataclass(frozen=True)
class Bundle:
    """What answers questions and reads documents in a mode: each a function of tables."""

    mode: str
    embedder: Embedder
    answers: Callable[[DataFrame, DataFrame], DataFrame]
    extraction: Callable[[DataFrame], DataFrame]
    method: str = "hybrid"
    options: dict = field(default_factory=dict)

    def ask(self, questions: DataFrame, chunks: DataFrame, limit: int = P.RETRIEVAL_LIMIT) -> DataFrame:
        """Answers to questions from chunks, which are embedded if they aren't yet."""
        asked = with_vectors(questions, self.embedder, "question").withColumnRenamed("embedding_model_id", "model_id")
        known = chunks if "embedding" in chunks.columns else with_vectors(chunks, self.embedder)
        return self.answers(asked, retrieve.rank(asked, known, self.method, limit))


#: Thresholds that a frozen runtime may use: support and partial support.
REGISTERED = {"A": (P.SUPPORT_AT, P.PARTIAL_AT), "B": (0.56, 0.42)}


def bundle(mode: str, embedder: Embedder | None = None, thresholds: str = "A") -> Bundle:
    """The providers of a mode: extractive, grounded, or semantic (grounded, with an embedder that is given). Others are an error."""
    if thresholds not in REGISTERED:
        raise ValueError(f"thresholds {thresholds} are not registered")
    support, partial = REGISTERED[thresholds]
    if mode == "extractive":
        return Bundle(mode, embedder or HashEmbedder(), answer.answer, extract.extract_labelled)
    if mode == "grounded":
        limits = grounded.Thresholds(support, partial)
        return Bundle(mode, embedder or HashEmbedder(), lambda q, r: grounded.answer(q, r, limits), extract.extract_prose)
    if mode == "semantic":
        if embedder is None:
            raise ValueError("the semantic mode needs an embedder")
        limits = grounded.Thresholds(support, partial, Comparison(embedder))
        return Bundle(mode, embedder, lambda q, r: grounded.answer(q, r, limits), extract.extract_prose)
    raise ValueError(f"unknown mode {mode}")


@dataclass
class Comparison:
    """How alike two texts are by an embedder, which is loaded in the worker that asks."""

    embedder: Embedder

    def __call__(self, a: str, b: str) -> float:
        model = _loaded.get(self.embedder.model_id) or _loaded.setdefault(self.embedder.model_id, self.embedder.load())
        x, y = np.asarray(model([a, b]), float)
        return float(np.clip((x @ y + 1) / 2, 0, 1))


_loaded: dict[str, Callable] = {}
