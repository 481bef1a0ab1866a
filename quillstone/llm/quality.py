"""Quality classifier by co-training.

One classifier sees a document's text, the other its metadata. Both learn
from a bounded sample of labelled documents; over rounds, each adds the
unlabelled documents it is most sure about, with the label it gives them, to
what the other learns from. At last both views are calibrated on labelled
documents kept apart, combined, and every document is scored.

A document counts as good if it is labelled of good quality and not toxic.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import _shared

LABELLED = 6000  # documents to fit and calibrate on, at most, besides
LABELLED_CLASS = 1000  # of each class, which are there whatever its share is
FEW = 20  # documents of a class held out, below which cross-fitting takes the place of holding out
FOLDS = 5
UNLABELLED = 4000  # documents to exchange pseudo-labels of, at most
ROUNDS = 3
ADD = 300  # pseudo-labels of each class that a view may give in a round
SURE = 0.98
WORD_BUCKETS = 1 << 18
MIN_DOCUMENTS = 8  # of the labelled sample, for a word to become a feature
WORDS = 500  # features at most, those that tell most about the label
BINS = 12
FALSE_REJECTS = 0.002  # of good documents held out, at most, by the chosen threshold
METADATA_BUCKETS = 256

_GROUPS = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32,), "line": (10,), "mark": [b for b in range(33, 127) if not chr(b).isalnum()], "high": range(128, 256)}
_GROUP_OF = np.zeros((256, len(_GROUPS)))
for _i, _members in enumerate(_GROUPS.values()):
    _GROUP_OF[list(_members), _i] = 1


_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def plain_words(data: bytes) -> set[bytes]:
    """Distinct words, ASCII capitals in lower case and marks left out."""
    return set(data.translate(_PLAIN).split())


def word_bucket(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 7) % WORD_BUCKETS


def shape(data: bytes, words: list[bytes], distinct: int) -> list[float]:
    """What the text looks like, whatever its words: shares of kinds of bytes, repetition, lengths."""
    n = len(data)
    shares = (np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _GROUP_OF / max(1, n)).tolist()
    lines = data.split(b"\n")
    count = len(words)
    return [*shares, math.log1p(count), distinct / max(1, count), n / max(1, count), len(set(lines)) / len(lines), math.log1p(n / len(lines))]


SHAPES = len(_GROUPS) + 5


def metadata_features(source: str | None, lang: str | None, n_chars: int | None) -> list[int]:
    """Buckets of the source, the language, the magnitude of the length, and source with language."""
    size = -1 if n_chars is None or n_chars < 0 else int(2 * math.log2(n_chars + 1))
    named = (f"s{source}", f"l{lang}", f"n{size}", f"x{source}|{lang}")
    return [xxhash.xxh64_intdigest(x) % METADATA_BUCKETS for x in named]


@dataclass
class Linear:
    """Logistic regression on sets of features."""

    weights: np.ndarray
    intercept: float

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[r].sum() + self.intercept for r in rows])


def fit(rows: list[np.ndarray], labels: np.ndarray, size: int, penalty: float, steps: int = 120, even: bool = False) -> Linear:
    """Minimise the summed log loss plus penalty / 2 times the squared weights, by L-BFGS; if even, both classes weigh the same."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    sign = np.where(labels > 0.5, 1.0, -1.0)
    share = np.where(sign > 0, (sign > 0).mean(), (sign < 0).mean())
    weight = 0.5 / share if even else np.ones(len(sign))

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = sign * (np.bincount(owner, w[column], len(rows)) + w[-1])
        pull = -sign * weight / (1 + np.exp(np.clip(z, -500, 500)))
        grad = np.append(np.bincount(column, pull[owner], size), pull.sum()) + penalty * np.append(w[:-1], 0)
        return float((weight * np.logaddexp(0, -z)).sum() + penalty / 2 * (w[:-1] ** 2).sum()), grad

    w = np.zeros(size + 1)
    value, grad = loss(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, held = grad.copy(), []
        for s, y, rho in reversed(past):
            a = rho * (s @ q)
            held.append(a)
            q -= a * y
        if past:
            s, y, _ = past[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, float(np.linalg.norm(q)))
        for (s, y, rho), a in zip(past, reversed(held), strict=True):
            q += s * (a - rho * (y @ q))
        step, slope = 1.0, float(grad @ q)
        while True:
            new = w - step * q
            new_value, new_grad = loss(new)
            if new_value <= value - 1e-4 * step * slope or step < 1e-8:
                break
            step /= 2
        s, y = new - w, new_grad - grad
        if s @ y > 1e-12:
            past = [*past[-8:], (s, y, 1 / (s @ y))]
        done = value - new_value < 1e-7 * max(1.0, abs(value))
        w, value, grad = new, new_value, new_grad
        if done:
            break
    return Linear(w[:-1], float(w[-1]))


def calibrate(logits: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept that turn logits (one column a view) into log odds of being good."""
    x = np.column_stack([logits, np.ones(len(logits))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (p - labels) + 1e-2 * w)
        w -= step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


@dataclass
class Model:
    """Both views, how they are combined, and the threshold below which a document is rejected."""

    text: Linear
    metadata: Linear
    words: dict[int, int]
    edges: list[list[float]]
    blend: tuple[np.ndarray, float]
    views: list[tuple[np.ndarray, float]] = field(default_factory=list)
    threshold: float = 0.5
    exchanged: list[tuple[int, int]] = field(default_factory=list)

    def shape_features(self, values: list[float]) -> list[int]:
        first = len(self.words)
        return [first + i * BINS + int(np.searchsorted(self.edges[i], v)) for i, v in enumerate(values)]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def telling_words(bad: np.ndarray, good: np.ndarray, n_bad: int, n_good: int) -> np.ndarray:
    """The buckets with the largest chi-square of presence against the label."""
    total, n = bad + good, n_bad + n_good
    expected = total * (n_bad / n)
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = (bad - expected) ** 2 * n**3 / (total * (n - total) * n_bad * n_good)
    chi[(total < MIN_DOCUMENTS) | (total >= n)] = -1
    best = np.argsort(-chi, kind="stable")[:WORDS]
    return np.sort(best[chi[best] > 0])


def sample_features(documents: DataFrame) -> DataFrame:
    """doc_id, distinct word buckets, shape and metadata features of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _shared.slices(batch, "text"):
                buckets, shapes = [], []
                for text in texts:
                    data = text.encode("utf-8", "surrogatepass")
                    words = data.split()
                    buckets.append(sorted({word_bucket(w) for w in plain_words(data)}))
                    shapes.append(shape(data, words, len(set(words))))
                meta = [metadata_features(*x) for x in zip(*(part.column(c).to_pylist() for c in ("source", "lang", "n_chars")), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(buckets, pa.list_(pa.int32())), pa.array(shapes, pa.list_(pa.float64())), pa.array(meta, pa.list_(pa.int32()))], ["doc_id", "buckets", "shape", "metadata"])

    return documents.mapInArrow(run, "doc_id bigint, buckets array<int>, shape array<double>, metadata array<int>")


def _view(documents: DataFrame) -> DataFrame:
    """The columns that classifiers see; those of metadata count as null where they are missing."""
    columns = set(documents.columns)
    meta = [(F.col(c) if c in columns else F.lit(None)).cast(kind).alias(c) for c, kind in (("source", "string"), ("lang", "string"), ("n_chars", "long"))]
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), _shared.text_or_empty().alias("text"), *meta)


def train(documents: DataFrame, labels: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED, rounds: int = ROUNDS, a_class: int = LABELLED_CLASS) -> Model | None:
    """Co-train on a bounded sample, chosen by a hash of doc_id; None only if there are not both good and other documents labelled.

    The sample has the first `labelled` labelled documents, and the first
    `a_class` of each class. A fourth is held out to calibrate and to choose
    the threshold; where that leaves few of a class, each document is scored
    by models that haven't seen it, and the last model is fitted on all.
    """
    order = F.xxhash64("doc_id", F.lit(11))
    marked = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(((F.min("quality") == 1) & (F.max("toxic") == 0)).cast("int").alias("good"))
    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL")
    known = _shared.settle(ids.join(marked, "doc_id").distinct(), "labelled")
    parts = [known.orderBy(order, "doc_id").limit(labelled), *(known.where(F.col("good") == g).orderBy(order, "doc_id").limit(a_class) for g in (0, 1))]
    pool = ids.join(marked, "doc_id", "left_anti").withColumn("good", F.lit(-1)).orderBy(order, "doc_id").limit(unlabelled)
    chosen = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(pool).dropDuplicates(["doc_id"])
    sample = sample_features(_view(documents).join(F.broadcast(chosen.select("doc_id")), "doc_id"))  # at most labelled + 2 a_class + unlabelled ids
    rows = sample.join(chosen, "doc_id").orderBy("doc_id").toArrow().to_pandas().drop_duplicates("doc_id")
    good = rows["good"].to_numpy()
    if not ((good == 1).any() and (good == 0).any()):
        return None

    draw = np.array([xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True), 3) for i in rows["doc_id"]], np.uint64)
    apart, labels_known = draw % 4 == 0, good >= 0
    held = labels_known & apart
    if min(((good == g) & part).sum() for g in (0, 1) for part in (held, ~apart)) >= FEW:
        model, features = _cotrain(rows, good, labels_known & ~apart, held, rounds)
        at = np.flatnonzero(held)
        _finish(model, _logits(model, features, at), good[at])
        return model

    # Dealt by class. The only document of a class is in all folds.
    fold = np.full(len(good), -1)
    for g in (0, 1):
        own = np.flatnonzero(good == g)
        if len(own) > 1:
            fold[own[np.argsort(draw[own], kind="stable")]] = np.arange(len(own)) % FOLDS
    views: list[tuple[np.ndarray, float]] = []
    at = np.flatnonzero(labels_known)
    for turns in (0, rounds):  # without pseudo-labels first, to calibrate the views that give them
        logits = np.empty((len(good), 2))
        for k in range(-1, FOLDS):
            out = labels_known & (fold == k)
            if out.any():
                model, features = _cotrain(rows, good, labels_known & ((fold != k) | (fold < 0)), None, turns, views)
                logits[out] = _logits(model, features, np.flatnonzero(out))
        views = [calibrate(logits[at, v : v + 1], good[at]) for v in (0, 1)]
    model, _ = _cotrain(rows, good, labels_known, None, rounds, views)
    model.views = views
    _finish(model, logits[at], good[at])
    return model


def _logits(model: Model, features: list[list[np.ndarray]], at: np.ndarray) -> np.ndarray:
    return np.column_stack([v.logits([f[i] for i in at]) for v, f in zip((model.text, model.metadata), features, strict=True)])


def _finish(model: Model, logits: np.ndarray, good: np.ndarray) -> None:
    """Combine the views and choose the threshold, by documents that weren't learned from."""
    model.blend = calibrate(logits, good)
    score = _sigmoid(logits @ model.blend[0] + model.blend[1])
    clean = np.sort(score[good == 1])
    model.threshold = float(min(0.5, clean[int(FALSE_REJECTS * len(clean))])) if len(clean) else 0.5


def _cotrain(rows, good: np.ndarray, learn: np.ndarray, held: np.ndarray | None, rounds: int, calibrated: list[tuple[np.ndarray, float]] | None = None) -> tuple[Model, list[list[np.ndarray]]]:
    """Fit both views on `learn` and pseudo-labels; also the features of all rows. Calibrates on `held`, if any, else takes what is `calibrated`."""
    free = good < 0
    counts = [np.bincount(np.concatenate([np.zeros(0, np.int64), *rows["buckets"][learn & (good == g)]]).astype(np.int64), minlength=WORD_BUCKETS) for g in (0, 1)]
    words = {int(b): i for i, b in enumerate(telling_words(*counts, int((learn & (good == 0)).sum()), int((learn & (good == 1)).sum())))}
    shapes = np.stack(rows["shape"])
    edges = [sorted(set(np.quantile(shapes[learn, i], np.linspace(0, 1, BINS + 1)[1:-1]).tolist())) for i in range(SHAPES)]
    model = Model(Linear(np.zeros(1), 0), Linear(np.zeros(1), 0), words, edges, (np.zeros(2), 0))
    place = np.full(WORD_BUCKETS, -1, np.int64)
    place[list(words)] = list(words.values())
    text_rows = [np.concatenate([(own := place[b.astype(np.int64)])[own >= 0], model.shape_features(s)]).astype(np.int64) for b, s in zip(rows["buckets"], shapes.tolist(), strict=True)]
    meta_rows = [np.asarray(m, np.int64) for m in rows["metadata"]]
    views = [(text_rows, len(words) + SHAPES * BINS, 1.0), (meta_rows, METADATA_BUCKETS, 5.0)]

    given: list[dict[int, int]] = [{}, {}]  # pseudo-labels that each view has got from the other
    fitted: list[Linear] = []
    for turn in range(rounds + 1):
        fitted = []
        for (features, size, penalty), extra in zip(views, given, strict=True):
            at = [*np.flatnonzero(learn).tolist(), *extra]
            y = np.array([*good[learn].tolist(), *extra.values()])
            fitted.append(fit([features[i] for i in at], y, size, penalty, even=held is None))
        if held is not None:
            model.views = [calibrate(v.logits([f[i] for i in np.flatnonzero(held)])[:, None], good[held]) for v, (f, *_) in zip(fitted, views, strict=True)]
        elif calibrated:
            model.views = calibrated
        if turn == rounds:
            break
        for own in (0, 1):
            other, (a, b) = 1 - own, model.views[own]
            open_ids = [i for i in np.flatnonzero(free).tolist() if i not in given[other]]
            if not open_ids or a[0] <= 0:
                continue
            p = _sigmoid(fitted[own].logits([views[own][0][i] for i in open_ids]) * a[0] + b)
            ranked = np.argsort(p, kind="stable")
            given[other] |= {open_ids[i]: 0 for i in ranked[:ADD].tolist() if p[i] <= 1 - SURE}
            given[other] |= {open_ids[i]: 1 for i in ranked[::-1][:ADD].tolist() if p[i] >= SURE}
        model.exchanged.append((len(given[1]), len(given[0])))
    model.text, model.metadata = fitted
    return model, [text_rows, meta_rows]


def _scorer(model: Model):
    """A function of texts and metadata (source, lang, n_chars) that gives the logits of both views."""
    table = model.text.weights
    by_bucket = {b: float(table[i]) for b, i in model.words.items()}

    class Weights(dict):
        def __missing__(self, word: bytes) -> float:
            if len(self) > 400_000:
                self.clear()
            value = self[word] = by_bucket.get(word_bucket(word), 0.0)
            return value

    weight = Weights().__getitem__

    def logits_of(texts: list[str], metadata: Iterator[tuple]) -> np.ndarray:
        logits = np.empty((len(texts), 2))
        for i, text in enumerate(texts):
            data = text.encode("utf-8", "surrogatepass")
            words = data.split()
            found = model.shape_features(shape(data, words, len(set(words))))
            logits[i, 0] = sum(map(weight, plain_words(data))) + table[found].sum() + model.text.intercept
        for i, x in enumerate(metadata):
            logits[i, 1] = model.metadata.weights[metadata_features(*x)].sum() + model.metadata.intercept
        return logits

    return logits_of


def score(documents: DataFrame, model: Model | None, threshold: float | None = None) -> DataFrame:
    """doc_id, text_score, metadata_score, score and kept for every row; without a model all are kept with score null."""
    if model is None:
        nothing = F.lit(None).cast("double")
        return documents.select(F.col("doc_id").cast("long").alias("doc_id"), nothing.alias("text_score"), nothing.alias("metadata_score"), nothing.alias("score"), F.lit(True).alias("kept"))
    least = model.threshold if threshold is None else threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logits_of = _scorer(model)
        for batch in batches:
            for part, texts in _shared.slices(batch, "text"):
                logits = logits_of(texts, zip(*(part.column(c).to_pylist() for c in ("source", "lang", "n_chars")), strict=True))
                alone = [_sigmoid(logits[:, v] * a[0] + b) for v, (a, b) in enumerate(model.views)]
                both = _sigmoid(logits @ model.blend[0] + model.blend[1])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, (*alone, both)), pa.array(both >= least)], ["doc_id", "text_score", "metadata_score", "score", "kept"])

    return _view(documents).mapInArrow(run, "doc_id bigint, text_score double, metadata_score double, score double, kept boolean")


def classify(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Train on the labels and score all documents.

    Null texts count as empty; null or missing metadata is a value of its
    own; labels with nulls are left out, and a document with several labels
    is good if all say so. Rows stay as they are, repeats included; an empty
    table gives an empty result, and without labels of both kinds every
    document is kept with score null.
    """
    return score(documents, train(documents, labels, **options))


def keep_good(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows that are not rejected, with all their columns, whatever their names.

    Each row counts by itself, also where doc_id is null or repeats. A null
    text counts as empty; an empty table gives an empty result, and without
    labels of both kinds all rows stay.
    """
    model = train(documents, labels, **options)
    if model is None:
        return documents
    names, seen = documents.columns, ["source", "lang", "n_chars"]
    prefix = "seen_" + "_" * max(map(len, names))  # longer than any name there is
    view = [(F.col(c) if c in names else F.lit(None)).cast(kind).alias(prefix + c) for c, kind in zip(seen, ("string", "string", "long"), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logits_of = _scorer(model)
        for batch in batches:
            for part, texts in _shared.slices(batch, "text"):
                logits = logits_of(texts, zip(*(part.column(prefix + c).to_pylist() for c in seen), strict=True))
                yield part.select(names).filter(pa.array(_sigmoid(logits @ model.blend[0] + model.blend[1]) >= model.threshold))

    return documents.select("*", *view).mapInArrow(run, documents.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_shared.table(spark, sf_dir, "documents"), _shared.table(spark, sf_dir, "labels"))
