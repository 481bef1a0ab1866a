"""Scores of a block of chunks against a block of questions, as matrices.

What the questions ask for (tokens, fields, scopes, vectors) is a stated set
of a checked size and travels with the task. Scores are whole numbers of
1e-8, so that equal ones tie on every run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

UNIT = 100_000_000
_CELLS = 2_000_000  # scores made at once
#: Of fields, words, the document's words, entity and scope: with fields and a name, with fields in a scope, with fields, with a name, and else.
WEIGHTS = ((0.40, 0.15, 0.10, 0.35, 0.0), (0.50, 0.15, 0.10, 0.0, 0.25), (0.65, 0.25, 0.10, 0.0, 0.0), (0.0, 0.55, 0.10, 0.35, 0.0), (0.0, 0.8, 0.2, 0.0, 0.0))


def rounded(x: np.ndarray) -> np.ndarray:
    """Whole numbers of 1e-8, halves away from zero; what lies within rounding error of a half counts as one."""
    return (np.sign(x) * np.floor(np.abs(x) * UNIT + 0.5 + 1e-7)).astype(np.int64)


@dataclass
class Asked:
    """A block of questions."""

    question_ids: list
    tokens: list[list[str]]
    fields: list[set]
    scopes: list[str | None]
    model_ids: list[str | None]
    vectors: list[list[float] | None]
    document_ids: list[set | None]
    named: dict[str, object] = field(default_factory=dict)  # tokens that name one document alone
    naming: list[bool] | None = None  # questions that name a document which isn't told here

    def __post_init__(self):
        n = len(self.question_ids)
        self.word = {t: i for i, t in enumerate(sorted({t for own in self.tokens for t in own}))}
        asks: list[list[tuple[int, bool]]] = [[] for _ in self.word]
        for q, own in enumerate(self.tokens):
            for t in own:
                asks[self.word[t]].append((q, t in self.fields[q]))
        self.degree = np.array([len(x) for x in asks] or [0], np.int64)
        self.begin = np.append(0, np.cumsum(self.degree))
        self.asked_by = np.array([q for own in asks for q, _ in own], np.int64)
        self.as_field = np.array([f for own in asks for _, f in own], bool)
        self.size = np.array([max(1, len(x)) for x in self.tokens], float)
        self.n_fields = np.array([len(x) for x in self.fields], float)
        self.entities: dict[object, list[int]] = {}
        for q, own in enumerate(self.tokens):
            for document in {self.named[t] for t in own if t in self.named}:
                self.entities.setdefault(document, []).append(q)
        self.distinctive = np.array(self.naming, bool) if self.naming else np.zeros(n, bool)
        self.distinctive[[q for own in self.entities.values() for q in own]] = True
        self.scoped = np.array([s is not None for s in self.scopes], bool)
        self.by_scope = {s: np.flatnonzero([x == s for x in self.scopes]) for s in set(self.scopes) - {None}}
        self.by_model = {m: np.array([x == m for x in self.model_ids]) for m in set(self.model_ids) - {None}}
        self.by_length = {}
        for length in {len(v) for v in self.vectors if v}:
            at = [q for q, v in enumerate(self.vectors) if v and len(v) == length]
            self.by_length[length] = np.array(at), np.array([self.vectors[q] for q in at], float)
        self.limited = [q for q, x in enumerate(self.document_ids) if x is not None]
        # What its fields, its words, the document's words, being named and being in scope count for each question.
        has, distinct = self.n_fields > 0, self.distinctive
        self.weights = np.select([has & distinct, has & self.scoped, has, distinct], [np.array([x]).T for x in WEIGHTS[:4]], np.array([WEIGHTS[4]]).T)

    def hits(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """How many of its tokens, and of its fields, each question shares with each list of words: lists x questions."""
        n, width = len(lists), len(self.question_ids)
        spelled = lists.flatten().dictionary_encode()
        known = np.array([self.word.get(t, -1) for t in spelled.dictionary.to_pylist()] or [-1], np.int64)
        words = known[spelled.indices.to_numpy(zero_copy_only=False)] if len(spelled) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(n), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        row, words = row[words >= 0], words[words >= 0]
        degree = self.degree[words]
        at = np.repeat(self.begin[words] - np.append(0, np.cumsum(degree))[:-1], degree) + np.arange(degree.sum())
        cell = np.repeat(row, degree) * width + self.asked_by[at]
        shape = (n, width)
        return np.bincount(cell, minlength=n * width).reshape(shape), np.bincount(cell[self.as_field[at]], minlength=n * width).reshape(shape)


@dataclass
class Block:
    """Scores of some chunks, in the order of chunk_id: chunks x questions."""

    chunk_ids: np.ndarray
    lexical: np.ndarray
    dense: np.ndarray
    entity: np.ndarray
    compatible: np.ndarray
    allowed: np.ndarray


def blocks(asked: Asked, batch: pa.RecordBatch) -> Iterator[Block]:
    """Takes rows of document_features(); a block holds whole documents."""
    sizes = batch.column("chunks").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    most = _CELLS // max(1, len(asked.question_ids))
    begin = held = 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            yield _block(asked, batch.slice(begin, i - begin))
            begin, held = i, 0
        held += size
    if held:
        yield _block(asked, batch.slice(begin))


def _block(asked: Asked, rows: pa.RecordBatch) -> Block:
    lists = rows.column("chunks")
    chunks = lists.flatten()
    chunk_ids = np.array(chunks.field("chunk_id").to_pylist(), object)
    back = np.repeat(np.arange(rows.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    n, width = len(chunk_ids), len(asked.question_ids)
    local, in_fields = asked.hits(chunks.field("said"))
    # What a document is about is the same for all of its chunks.
    documents, names = rows.column("document_id").to_pylist(), rows.column("name_tokens").to_pylist()
    document_hits = asked.hits(rows.column("about"))[0][back]
    entity, in_scope, allowed = (np.full((len(documents), width), x) for x in (False, False, True))
    for k, (d, own) in enumerate(zip(documents, names, strict=True)):
        entity[k, asked.entities.get(d, [])] = True
        for scope in asked.by_scope.keys() & set(own or []):
            in_scope[k, asked.by_scope[scope]] = True
        for q in asked.limited:
            allowed[k, q] = d in asked.document_ids[q]
    entity, in_scope, allowed = entity[back], in_scope[back], allowed[back]
    terms = np.divide(in_fields, asked.n_fields, out=np.zeros((n, width)), where=asked.n_fields > 0), local / asked.size, document_hits / asked.size, entity, in_scope
    lexical = np.zeros((n, width))
    for term, weight in zip(terms, asked.weights, strict=True):
        if weight.any():
            lexical += term * weight
    dense, compatible = np.zeros((n, width), np.int64), np.zeros((n, width), bool)
    if "embedding" in chunks.type.names:
        models = chunks.field("embedding_model_id").dictionary_encode()
        same = np.array([asked.by_model.get(m, np.zeros(width, bool)) for m in [*models.dictionary.to_pylist(), None]])
        compatible = same[models.indices.fill_null(len(same) - 1).to_numpy(zero_copy_only=False)]
        vectors, dense = chunks.field("embedding"), np.zeros((n, width))
        lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        for length, (at, theirs) in asked.by_length.items():
            having = np.flatnonzero(lengths == length)
            if len(having):
                own = vectors.take(pa.array(having)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, length)
                dense[np.ix_(having, at)] = np.clip(own @ theirs.T, -1.0, 1.0)
        dense = rounded(np.where(compatible & np.isfinite(dense), dense, 0.0))
    order = np.argsort(chunk_ids)
    return Block(*(x[order] for x in (chunk_ids, rounded(lexical), dense, entity, compatible, allowed)))


def best(asked: Asked, batches: Iterator[pa.RecordBatch], lexical: int, dense: int, with_entities: bool) -> Iterator[pa.RecordBatch]:
    """A task's candidates for each question: its best by either score, ties to the smaller chunk_id, and chunks of documents that the question names. A chunk may come more than once."""
    tops: dict[tuple[int, int], list[tuple]] = {}
    for batch in batches:
        for block in blocks(asked, batch):
            n = len(block.chunk_ids)
            row = lambda i, q: (q, block.chunk_ids[i], int(block.lexical[i, q]), int(block.dense[i, q]), bool(block.entity[i, q]), bool(block.compatible[i, q]))  # noqa: B023, E731
            for which, scores, most in ((0, block.lexical, lexical), (1, block.dense, dense)):
                if not most:
                    continue
                fit = block.allowed & block.compatible if which else block.allowed
                # Only what a question's last place so far lets in is looked at one by one.
                last = np.array([-top[-1][0] if len(top := tops.setdefault((which, q), [])) >= most else np.iinfo(np.int64).min for q in range(len(asked.question_ids))])
                good = fit & (scores >= last)
                for q in np.flatnonzero(good.any(0)).tolist():
                    top, own = tops[which, q], scores[:, q]
                    at = np.flatnonzero(good[:, q])
                    if len(at) > most:
                        at = at[np.argpartition(-own[at] * n + at, most)[:most]]
                    if len(at):
                        top.extend((int(-own[i]), block.chunk_ids[i], row(i, q)) for i in at.tolist())
                        top.sort()
                        del top[most:]
            if with_entities and block.entity.any():
                yield _batch([row(i, q) for i, q in zip(*(x.tolist() for x in np.nonzero(block.entity & block.allowed)), strict=True)], CANDIDATE)
    yield _batch([row for top in tops.values() for _, _, row in top], CANDIDATE)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


CANDIDATE = pa.schema([("q", pa.int32()), ("chunk_id", pa.string()), ("lexical", pa.int64()), ("dense", pa.int64()), ("entity", pa.bool_()), ("compatible", pa.bool_())])
CANDIDATE_DDL = "q int, chunk_id string, lexical bigint, dense bigint, entity boolean, compatible boolean"


class Places:
    """Where chunks stand among the candidates of each question, by either score."""

    def __init__(self, candidates: list[tuple[int, str, int, int, bool]], questions: int):
        """Candidates are (q, chunk_id, lexical, dense, compatible)."""
        self.ids = np.array(sorted({c[1] for c in candidates}), object)
        number = {c: i for i, c in enumerate(self.ids)}
        self.keys: list[list[np.ndarray]] = [[], []]
        self.places: dict[tuple[int, int, str], int] = {}
        own: list[list[list[tuple[int, str]]]] = [[[] for _ in range(questions)] for _ in range(2)]
        for q, chunk, lexical, dense, compatible in candidates:
            own[0][q].append((self._key(lexical, 2 * number[chunk] + 1), chunk))
            if compatible:
                own[1][q].append((self._key(dense, 2 * number[chunk] + 1), chunk))
        for which in range(2):
            for q in range(questions):
                own[which][q].sort()
                self.keys[which].append(np.array([k for k, _ in own[which][q]], np.int64))
                self.places.update({(which, q, chunk): i for i, (_, chunk) in enumerate(own[which][q])})

    @staticmethod
    def _key(score, place):
        return -score * (1 << 33) + place

    def counts(self, asked: Asked, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A histogram for each question and score: how many of a task's chunks stand before each candidate, or are it, and after the one before."""
        total = [[np.zeros(len(k) + 1, np.int64) for k in keys] for keys in self.keys]
        for batch in batches:
            for block in blocks(asked, batch):
                place = np.searchsorted(self.ids, block.chunk_ids)
                same = np.append(self.ids, None)[place] == block.chunk_ids
                place = 2 * place + same
                for which, scores in enumerate((block.lexical, block.dense)):
                    fit = block.allowed & block.compatible if which else block.allowed
                    for q, keys in enumerate(self.keys[which]):
                        at = np.searchsorted(keys, self._key(scores[fit[:, q], q], place[fit[:, q]]))
                        total[which][q] += np.bincount(at, minlength=len(keys) + 1)
        rows = [(q, which, int(i), int(x[i])) for which, own in enumerate(total) for q, x in enumerate(own) for i in np.flatnonzero(x)]
        yield _batch(rows, COUNT)


COUNT = pa.schema([("q", pa.int32()), ("which", pa.int32()), ("place", pa.int64()), ("n", pa.int64())])
COUNT_DDL = "q int, which int, place bigint, n bigint"
