import random

import numpy as np
import pytest

from quillstone.llm import quality


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["w%d" % rng.randrange(3000) for _ in range(3000)]
    rows, labels = [], []
    for i in range(n):
        kind = rng.choice(["good", "good", "good", "junk", "toxic"])
        text = [rng.choice(words) for _ in range(rng.randrange(30, 200))]
        if kind == "junk":
            text = [w.upper() + "!!!" for w in text]
        if kind == "toxic":
            for _ in range(6):
                text.insert(rng.randrange(len(text)), rng.choice(["vile", "nasty,", "Horrid"]))
        rows.append((i, " ".join(text), "de" if kind == "junk" else "en", f"s{rng.randrange(4)}", 0))
        labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    return rows, labels


DOCUMENTS, LABELS = "doc_id long, text string, lang string, source string, score int", "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    rows, labels = corpus(1, 1600)
    frame = spark.createDataFrame(rows, DOCUMENTS)
    known = spark.createDataFrame([x for x in labels if x[0] < 900] + [(5, None, 0), (None, 1, 0)], LABELS)
    out = {r.doc_id: r for r in quality.classify(frame, known).collect()}
    good = {i: q == 1 and t == 0 for i, q, t in labels}
    test = range(900, 1600)
    assert np.mean([out[i].kept for i in test if good[i]]) > 0.98
    assert np.mean([out[i].kept for i in test if not good[i]]) < 0.1
    kept = quality.keep_good(frame, known)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {i for i in out if out[i].kept}


def test_views_exchange_pseudo_labels(spark):
    rows, labels = corpus(2, 900)
    model = quality.train(spark.createDataFrame(rows, DOCUMENTS), spark.createDataFrame(labels[:500], LABELS))
    assert len(model.exchanged) == quality.ROUNDS and model.exchanged[-1][0] > 0


def test_nulls_empty_and_no_labels(spark):
    rows, labels = corpus(3, 300)
    odd = [(None, None, None, None, None), (1000, "", None, None, 1), (1001, "x" * 200_000, "en", "s1", 1), (5, rows[5][1], "en", "s1", 0)]
    frame = spark.createDataFrame(rows + odd, DOCUMENTS)
    assert quality.classify(frame, spark.createDataFrame(labels, LABELS)).count() == len(rows) + 4
    nothing = spark.createDataFrame([], LABELS)
    assert {(r.kept, r.score) for r in quality.classify(frame, nothing).collect()} == {(True, None)}
    assert quality.keep_good(frame, nothing).count() == len(rows) + 4
    assert quality.classify(spark.createDataFrame([], DOCUMENTS), spark.createDataFrame(labels, LABELS)).collect() == []


@pytest.mark.parametrize("n_bad", [3, 19])
def test_few_bad_labels_still_reject(spark, n_bad):
    rows, labels = corpus(6, 1200)
    bad = [i for i, q, _ in labels if not q]
    known = [x for x in labels if x[0] in set(bad[:n_bad]) or (x[1] == 1 and x[2] == 0 and x[0] < 800)]
    out = {r.doc_id: r for r in quality.classify(spark.createDataFrame(rows, DOCUMENTS), spark.createDataFrame(known, LABELS)).collect()}
    assert np.mean([out[i].kept for i in bad[n_bad:]]) < 0.2
    assert np.mean([out[i].kept for i, q, t in labels if q == 1 and t == 0 and i >= 800]) > 0.97


def test_rare_class_outside_the_first_labels(spark):
    rows, labels = corpus(8, 900)
    frame, known = spark.createDataFrame(rows, DOCUMENTS), spark.createDataFrame([x for x in labels if x[2] == 0], LABELS)
    out = {r.doc_id: r.kept for r in quality.classify(frame, known, labelled=30).collect()}
    assert np.mean([out[i] for i, q, _ in labels if not q]) < 0.1
    assert {r.kept for r in quality.classify(frame, known.where("quality = 1")).collect()} == {True}
    assert quality.train(frame, known.where("quality = 1 OR doc_id = %d" % next(i for i, q, _ in labels if not q))) is not None


def newton(dense, labels, penalty, weight):
    """The same objective as fit()'s, by Newton's method on a dense matrix; the intercept is free."""
    x = np.column_stack([dense, np.ones(len(dense))])
    ridge = np.diag([penalty] * dense.shape[1] + [0.0])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (weight * (p - labels)) + ridge @ w
        w -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, grad)
    return w


@pytest.mark.parametrize("even", [False, True])
def test_fit_against_newtons_method(even):
    rng = np.random.default_rng(4)
    dense = (rng.random((300, 12)) < 0.3).astype(float)
    labels = (rng.random(300) < 1 / (1 + np.exp(-(dense @ rng.normal(size=12) - 0.5)))).astype(int)
    share = np.where(labels == 1, labels.mean(), 1 - labels.mean())
    model = quality.fit([np.flatnonzero(r) for r in dense], labels, 12, 0.7, even=even)
    want = newton(dense, labels, 0.7, 0.5 / share if even else np.ones(300))
    assert np.abs(model.weights - want[:-1]).max() < 5e-3 and abs(model.intercept - want[-1]) < 5e-3


def test_calibration_and_word_choice_by_hand():
    rng = np.random.default_rng(5)
    logits = rng.normal(size=(500, 2)) * 2
    labels = (rng.random(500) < 1 / (1 + np.exp(-(logits @ [1.5, -0.5] + 0.3)))).astype(int)
    a, b = quality.calibrate(logits, labels)
    x = np.column_stack([logits, np.ones(500)])
    w = np.append(a, b)
    assert np.abs(x.T @ (1 / (1 + np.exp(-x @ w)) - labels) + 1e-2 * w).max() < 1e-6  # the gradient is zero there
    bad, good = np.zeros(50), np.zeros(50)
    bad[:4], good[:4] = (30, 10, 20, 2), (2, 40, 10, 2)
    def chi(b, g, nb=40, ng=80):
        table = np.array([[b, g], [nb - b, ng - g]], float)
        expected = table.sum(1)[:, None] * table.sum(0)[None] / table.sum()
        return ((table - expected) ** 2 / expected).sum()
    order = sorted((i for i in range(3)), key=lambda i: -chi(bad[i], good[i]))
    chosen = quality.telling_words(bad, good, 40, 80).tolist()
    assert chosen == [0, 1, 2] and 3 not in chosen and chi(bad[order[0]], good[order[0]]) >= chi(bad[order[-1]], good[order[-1]])
