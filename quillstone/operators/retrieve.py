"""Lexical, dense, hybrid and reranked retrieval for a whole set of questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from quillstone.functions import patterns as P
from quillstone.functions import text as T
from quillstone.operators import scoring, trust
from quillstone.sources.tables import settle

METHODS = ("lexical", "dense", "hybrid", "hybrid_rerank")
MAX_QUESTIONS = 10_000
MAX_CHARS = 4_000_000  # of the words of all questions
BLOCK_QUESTIONS = 500  # scored in one pass
COMMON = 200  # a word that more documents hold is common


def question_features(questions: DataFrame) -> DataFrame:
    """Add tokens, fields, scope and intent to (question_id, question)."""
    out = questions.withColumn("q_tokens", T.lexical_tokens(F.col("question")))
    return out.withColumns({"q_fields": F.array_intersect("q_tokens", F.lit(list(P.FIELD_TOKENS))), "q_scope": T.document_scope(F.col("question")), "intent": question_intent(F.col("question"))})


def question_intent(question: Column) -> Column:
    folded = T.fold(question)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for intent, needed in P.INTENTS:
        hit = F.lit(True)
        for pattern in needed:
            hit = hit & folded.rlike(pattern)
        out = out.when(hit, intent)
    return out


def document_features(chunks: DataFrame, vocabulary: list[str] | None) -> DataFrame:
    """What of the questions' words each document holds, one row a document.

    document_id, chunks (chunk_id, said, and vectors where there are any),
    about (words of its name, sections and texts), name_tokens, identity (what
    names it: file name and lines with an organisation's label or legal form).
    Of the texts' words those that are asked for are kept; None for all. A row is as large as a document; chunks that are
    partitioned by document aren't exchanged.
    """
    none = F.array().cast("array<string>")
    lines = F.filter(F.split("text", r"\r\n|[\n\r]"), lambda x: T.strip(x).rlike(f"(?iu){P.IDENTITY_LINE}"))
    vectors = [c for c in ("embedding", "embedding_model_id") if c in chunks.columns]
    held = F.when(F.size("lines") == 0, none).otherwise(T.lexical_tokens(F.array_join("lines", " ")))
    words = chunks.select("document_id", "document_name", "chunk_id", *vectors, T.lexical_tokens_among(F.col("text"), vocabulary).alias("said"), lines.alias("lines"), F.when(F.col("section").isNull(), none).otherwise(T.lexical_tokens(F.col("section"))).alias("section"))
    words = words.select("document_id", "document_name", "chunk_id", *vectors, "section", held.alias("lines"), "said")
    every = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    grouped = words.groupBy("document_id").agg(F.first("document_name").alias("name"), F.collect_list(F.struct("chunk_id", *vectors, "said")).alias("chunks"), every(F.array_union("said", "section")).alias("about"), every("lines").alias("lines"))
    named = grouped.withColumn("name_tokens", T.lexical_tokens(F.col("name")))
    return named.select("document_id", "chunks", F.array_union("about", "name_tokens").alias("about"), "name_tokens", F.array_union("lines", "name_tokens").alias("identity"))


def _asked(questions: DataFrame) -> list[Row]:
    """The questions with tokens, fields, scopes and vectors, in order; a stated set of a checked size."""
    features = question_features(questions).drop("question")
    rows = features.limit(MAX_QUESTIONS + 1).collect()
    if len(rows) > MAX_QUESTIONS:
        raise ValueError(f"more than {MAX_QUESTIONS} questions: ask in blocks")
    if sum(len(t) for r in rows for t in r["q_tokens"]) > MAX_CHARS:
        raise ValueError(f"questions of more than {MAX_CHARS} letters: ask in blocks")
    return sorted(rows, key=lambda r: r["question_id"])


def _naming(features: DataFrame, vocabulary: list[str]) -> dict[str, object]:
    """Words of the questions that name one document alone, and which: at most as many as there are words."""
    naming = features.sparkSession.createDataFrame([(t,) for t in vocabulary if len(t) >= 4 and t not in P.GENERIC_TOKENS], "token string")
    held = features.select("document_id", F.explode("identity").alias("token")).join(F.broadcast(naming), "token")
    rare = held.groupBy("token").agg(F.min("document_id").alias("least"), F.max("document_id").alias("most")).where("least = most")
    return {r["token"]: r["least"] for r in rare.collect()}


def _block(rows: list[Row], named: dict[str, object]) -> scoring.Asked:
    get = lambda name: [r[name] if name in r else None for r in rows]
    scopes = get("document_ids")
    return scoring.Asked(
        get("question_id"), get("q_tokens"), [set(r["q_fields"]) for r in rows], get("q_scope"), get("model_id"), [list(v) if v else None for v in get("embedding")],
        [None if x is None else set(x) for x in scopes], {t: d for t, d in named.items() if any(t in r["q_tokens"] for r in rows)},
    )


def candidates(features: DataFrame, asked: scoring.Asked, lexical: int, dense: int, with_entities: bool = False) -> DataFrame:
    """The best chunks of each question by either score, and all of the documents it names: q, chunk_id, scores as whole numbers of 1e-8.

    Every task keeps its best; only those leave it.
    """
    found = features.mapInArrow(lambda batches: scoring.best(asked, batches, lexical, dense, with_entities), scoring.CANDIDATE_DDL).dropDuplicates(["q", "chunk_id"])
    place = lambda *order: F.row_number().over(Window.partitionBy("q").orderBy(*order))
    by_dense = place(F.desc("compatible"), F.desc("dense"), "chunk_id")
    ranked = found.withColumns({"_lexical": place(F.desc("lexical"), "chunk_id"), "_dense": F.when(F.col("compatible"), by_dense)})
    return ranked.where((F.col("_lexical") <= lexical) | (F.col("_dense") <= dense) | (F.col("entity") & F.lit(with_entities))).drop("_lexical", "_dense")


def with_ranks(found: DataFrame, features: DataFrame, asked: scoring.Asked) -> DataFrame:
    """Add lexical_rank and dense_rank among all chunks, by counting those that stand before a candidate; null dense_rank where vectors can't be compared."""
    rows = [tuple(r) for r in found.select("q", "chunk_id", "lexical", "dense", "compatible").collect()]
    places = scoring.Places(rows, len(asked.question_ids))
    counts = features.mapInArrow(lambda batches: places.counts(asked, batches), scoring.COUNT_DDL)
    own = found.sparkSession.createDataFrame([(q, which, place, 0, chunk) for (which, q, chunk), place in places.places.items()], f"{scoring.COUNT_DDL}, chunk_id string")
    before = counts.groupBy("q", "which", "place").agg(F.sum("n").alias("n")).unionByName(own, allowMissingColumns=True)
    so_far = Window.partitionBy("q", "which").orderBy("place").rangeBetween(Window.unboundedPreceding, 0)
    ranks = before.withColumn("rank", F.sum("n").over(so_far)).where("chunk_id IS NOT NULL")
    return found.join(ranks.groupBy("q", "chunk_id").agg(F.max(F.when(F.col("which") == 0, F.col("rank"))).alias("lexical_rank"), F.max(F.when(F.col("which") == 1, F.col("rank"))).alias("dense_rank")), ["q", "chunk_id"])


def rank(questions: DataFrame, chunks: DataFrame, method: str = "hybrid", limit: int = P.RETRIEVAL_LIMIT) -> DataFrame:
    """The best chunks of each question: question_id, chunk_id, rank, score, what it is made of, and the chunk's own columns.

    Questions, with `embedding` and `model_id` for dense scores and
    `document_ids` for a scope if they have one, are a stated set of at most
    MAX_QUESTIONS, asked in blocks; chunk_id is a key. No pair of a question and
    a chunk leaves the task that scores it unless it may be in the result.
    More questions than that are ranked by words alone, by rank_by_words().

    Fused methods need a chunk's ranks among all chunks. A chunk behind the
    place 60 + 2k by both scores has a fused score below 1 / (2 (60 + k)),
    which each of the k best by words surpasses; so the first 60 + 2k by
    either score, and the chunks of documents that a question names, hold the
    k best. Their exact ranks come from a second pass, which counts.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    if limit < 1:
        raise ValueError("limit must be at least 1")
    if method == "lexical" and "document_ids" not in questions.columns and questions.count() > MAX_QUESTIONS:
        return rank_by_words(questions, chunks, limit)
    rows = _asked(questions)
    vocabulary = sorted({t for r in rows for t in r["q_tokens"]})
    features = settle(document_features(chunks, vocabulary), "features")
    named = _naming(features, vocabulary)
    again = method == "hybrid_rerank"
    most = max(4 * limit, 20) if again else limit
    kind = questions.schema["question_id"].dataType.simpleString()
    parts = []
    for at in range(0, max(1, len(rows)), BLOCK_QUESTIONS):
        own = rows[at : at + BLOCK_QUESTIONS]
        ids = questions.sparkSession.createDataFrame([(q, r["question_id"]) for q, r in enumerate(own)], f"q int, question_id {kind}")
        parts.append(_best_of_block(_block(own, named), features, method, most).join(F.broadcast(ids), "q").drop("q"))
    best = reduce(DataFrame.unionByName, parts)
    known = questions.sparkSession.createDataFrame([(r["question_id"], r["intent"], r["q_tokens"]) for r in rows], f"question_id {kind}, intent string, q_tokens array<string>")
    texts = chunks.select("chunk_id", "document_id", "document_name", "page", "section", "text")
    out = best.join(F.broadcast(known), "question_id").join(texts, "chunk_id")
    if not again:
        return out.withColumn("rerank_score", F.lit(None).cast("double"))
    return _top(with_rerank_score(out.drop("rank")), "question_id", [F.desc("rerank_score"), F.desc("score"), "chunk_id"], limit)


def rank_by_words(questions: DataFrame, chunks: DataFrame, limit: int = P.RETRIEVAL_LIMIT, common: int = COMMON) -> DataFrame:
    """rank() by words for any number of questions; their table is joined, not collected.

    What chunks score by common words alone is the same for all questions
    that differ in rare words only: of these kinds of questions there are at
    most MAX_QUESTIONS, and each has its best chunks. Documents that hold a
    rare word of a question, or that it names, meet it by equality joins, at
    most `common` a word, and are scored by all its words. A rare word never
    lowers a score, so the best of both are the best of all.
    """
    asked = settle(question_features(questions).select("question_id", "intent", "q_tokens", "q_fields", "q_scope"), "questions")
    features = settle(document_features(chunks, None), "features")
    tokens = asked.select("question_id", F.explode("q_tokens").alias("token"))
    wanted = tokens.select("token").distinct()
    held = settle(features.select("document_id", F.explode("about").alias("token")).join(wanted, "token", "left_semi"), "held")
    spread = held.groupBy("token").agg(F.count("*").alias("documents"))
    naming = wanted.where((F.length("token") >= 4) & ~F.col("token").isin(*P.GENERIC_TOKENS))
    named = features.select("document_id", F.explode("identity").alias("token")).join(naming, "token", "left_semi").groupBy("token").agg(F.min("document_id").alias("document_id"), F.max("document_id").alias("most")).where("document_id = most").drop("most")
    entities = tokens.join(named, "token").select("question_id", "document_id").distinct()
    counted = tokens.join(spread, "token", "left").withColumn("common", F.coalesce("documents", F.lit(0)) > common)
    shared = counted.where("common").groupBy("question_id").agg(F.sort_array(F.collect_set("token")).alias("shared"))  # of one question
    kind = [F.coalesce("shared", F.array().cast("array<string>")).alias("shared"), F.size("q_tokens").alias("size"), F.size("q_fields").alias("fields"), F.col("q_scope").alias("scope"), F.col("naming").isNotNull().alias("naming")]
    kinds = asked.join(shared, "question_id", "left").join(entities.select("question_id", F.lit(True).alias("naming")).distinct(), "question_id", "left").select("question_id", F.struct(*kind).alias("kind"))
    kinds = settle(kinds, "kinds")
    different = [r["kind"] for r in kinds.select("kind").distinct().limit(MAX_QUESTIONS + 1).collect()]
    if len(different) > MAX_QUESTIONS:
        raise ValueError(f"questions of more than {MAX_QUESTIONS} kinds: ask in blocks")
    best = []
    for at in range(0, len(different), BLOCK_QUESTIONS):
        own = different[at : at + BLOCK_QUESTIONS]
        found = candidates(features, _of_kinds(own), limit, 0)
        table = questions.sparkSession.createDataFrame([(q, k) for q, k in enumerate(own)], f"q int, kind {kinds.schema['kind'].dataType.simpleString()}")
        best.append(found.join(F.broadcast(table), "q").select("kind", "chunk_id", "lexical"))
    of_kind = reduce(DataFrame.unionByName, best).join(chunks.select("chunk_id", "document_id"), "chunk_id")
    by_kind = kinds.join(of_kind, kinds["kind"].eqNullSafe(of_kind["kind"])).select("question_id", "document_id", "chunk_id", "lexical")
    rare = counted.where("NOT common").select("question_id", "token").join(held, "token").select("question_id", "document_id")
    pairs = rare.withColumn("entity", F.lit(0.0)).unionByName(entities.withColumn("entity", F.lit(1.0))).groupBy("question_id", "document_id").agg(F.max("entity").alias("entity"))
    pairs = settle(pairs, "pairs")
    met = pairs.join(asked, "question_id").join(kinds.select("question_id", F.col("kind.naming").alias("naming")), "question_id").join(features, "document_id")
    own = met.withColumn("in_document", F.size(F.array_intersect("about", "q_tokens"))).withColumn("in_scope", F.coalesce(F.array_contains("name_tokens", F.col("q_scope")), F.lit(False)).cast("double"))
    own = own.select("question_id", "entity", "naming", "q_tokens", "q_fields", "q_scope", "in_document", "in_scope", F.explode("chunks").alias("c")).select("*", F.col("c.chunk_id").alias("chunk_id"))
    exact = own.select("question_id", "chunk_id", _lexical_score().alias("lexical"), "entity")
    others = by_kind.join(pairs.select("question_id", "document_id"), ["question_id", "document_id"], "left_anti").select("question_id", "chunk_id", "lexical", F.lit(0.0).alias("entity"))
    top = _top(exact.unionByName(others), "question_id", [F.desc("lexical"), "chunk_id"], limit)
    score = F.col("lexical") / scoring.UNIT
    out = top.select("question_id", "chunk_id", "rank", score.alias("score"), score.alias("lexical_score"), F.lit(0.0).alias("dense_score"), F.col("entity").alias("entity_score"))
    texts = chunks.select("chunk_id", "document_id", "document_name", "page", "section", "text")
    return out.join(asked.select("question_id", "intent", "q_tokens"), "question_id").join(texts, "chunk_id").withColumn("rerank_score", F.lit(None).cast("double"))


def _of_kinds(kinds: list[Row]) -> scoring.Asked:
    """A question for each kind: its common words, and words that no text holds in place of the rare ones."""
    tokens, fields = [], []
    for k in kinds:
        none = [f"\x00{i}" for i in range(k["size"] - len(k["shared"]))]
        own = [t for t in k["shared"] if t in P.FIELD_TOKENS]
        tokens.append([*k["shared"], *none])
        fields.append({*own, *none[: k["fields"] - len(own)]})
    nothing = [None] * len(kinds)
    return scoring.Asked(list(range(len(kinds))), tokens, fields, [k["scope"] for k in kinds], nothing, nothing, nothing, naming=[k["naming"] for k in kinds])


def _lexical_score() -> Column:
    """What scoring makes of a question and a chunk, as a whole number of 1e-8."""
    has, share = F.size("q_fields") > 0, F.size(F.array_intersect("c.said", "q_tokens")) / F.greatest(F.lit(1), F.size("q_tokens"))
    document = F.col("in_document") / F.greatest(F.lit(1), F.size("q_tokens"))
    fields = F.when(has, F.size(F.array_intersect("c.said", "q_fields")) / F.size("q_fields")).otherwise(0.0)
    terms = fields, share, document, F.col("entity"), F.col("in_scope")
    cases = [sum((t * w for t, w in zip(terms[1:], weights[1:], strict=True)), terms[0] * weights[0]) for weights in scoring.WEIGHTS]
    naming = F.col("naming")
    score = F.when(has & naming, cases[0]).when(has & F.col("q_scope").isNotNull(), cases[1]).when(has, cases[2]).when(naming, cases[3]).otherwise(cases[4])
    return F.floor(score * scoring.UNIT + 0.5 + 1e-7).cast("long")


def _best_of_block(asked: scoring.Asked, features: DataFrame, method: str, most: int) -> DataFrame:
    lexical, dense = (F.col(c) / scoring.UNIT for c in ("lexical", "dense"))
    if method in ("lexical", "dense"):
        found = candidates(features, asked, most * (method == "lexical"), most * (method == "dense"))
        scored = found.withColumn("score", lexical if method == "lexical" else dense)
        order = [F.desc("score"), "chunk_id"]
    else:
        wide = P.RRF_K + 2 * most
        found = with_ranks(settle(candidates(features, asked, wide, wide, True), "candidates"), features, asked)
        one, two = 1 / (P.RRF_K + F.col("lexical_rank")), 1 / (P.RRF_K + F.col("dense_rank"))
        fused = F.when(F.col("dense_rank").isNull(), one).otherwise((one + two) / 2) + P.ENTITY_BOOST * F.col("entity").cast("double")
        scored = found.withColumn("score", F.round(fused, 8))
        order = [F.desc("score"), F.desc("lexical"), "chunk_id"]
    return _top(scored, "q", order, most).select("q", "chunk_id", "rank", "score", lexical.alias("lexical_score"), dense.alias("dense_score"), F.col("entity").cast("double").alias("entity_score"))


def _top(scored: DataFrame, key: str, order: list, limit: int) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= limit)


def with_rerank_score(ranked: DataFrame) -> DataFrame:
    """1 for direct evidence of the question's intent in a safe segment, plus a quarter of the token coverage."""
    cut = trust.admitted(ranked.withColumn("_segments", T.segments(F.col("text"))), "_segments")
    direct = F.coalesce(F.exists("_segments", lambda s: intent_evidence(F.col("intent"), s)), F.lit(False)).cast("double")
    coverage = F.size(F.array_intersect("q_tokens", T.lexical_tokens(F.col("text")))) / F.greatest(F.size("q_tokens"), F.lit(1))
    return cut.withColumn("rerank_score", F.round(direct + 0.25 * coverage, 8)).drop("_segments")


def intent_evidence(intent: Column, segment: Column) -> Column:
    """Whether a segment is direct evidence for an intent; false without one."""
    folded = T.fold(segment)
    dated = segment.rlike(f"(?iu){P.DATE}")
    timed = segment.rlike(f"(?iu){P.DEADLINE}")
    upper = (F.upper(segment) == segment) & (F.lower(segment) != segment)
    rules = {
        "renewal_date": folded.rlike(P.RENEWAL_EVIDENCE) & (dated | segment.rlike(f"(?iu){P.MISSING_DATE}")),
        "effective_date": dated & folded.rlike(P.EFFECTIVE_EVIDENCE) & ~folded.rlike(P.NOT_EFFECTIVE_EVIDENCE),
        "notification_deadline": folded.rlike(P.NOTIFICATION_EVIDENCE) & timed,
        "duration": timed & folded.rlike(P.DURATION_EVIDENCE),
        "document_type": folded.rlike(P.TYPE_LABEL) | (folded.rlike(P.TYPE_WORD) & upper),
        "important_amounts": segment.rlike(f"(?iu){P.AMOUNT}"),
        "responsible_people": folded.rlike(P.RESPONSIBLE_LABEL),
        "risks": folded.rlike(P.RISK_EVIDENCE),
        "organization_name": folded.rlike(P.ORGANIZATION_EVIDENCE),
        "obligations": folded.rlike(P.OBLIGATION_EVIDENCE),
        "severity": folded.rlike(P.SEVERITY_EVIDENCE),
    }
    out = F.when(F.lit(False), F.lit(False))
    for name, rule in rules.items():
        out = out.when(intent == name, rule)
    return out.otherwise(False)
