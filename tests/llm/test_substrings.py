import random

import pytest

from quillstone.llm import substrings


def brute(rows, window):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, words in split:
        for a in range(len(words) - window + 1):
            key = tuple(words[a : a + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, words in split:
        gone = set()
        for a in range(len(words) - window + 1):
            if i is not None and first[tuple(words[a : a + window])] < i:
                gone.update(range(a, a + window))
        out.append((i, len(words), len(gone), b" ".join(w for p, w in enumerate(words) if p not in gone).decode()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(40)] + ["é", " x", "A", "a"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randrange(10, 60))] for _ in range(6)]
    rows = []
    for i in range(70):
        words = []
        for _ in range(rng.randrange(4)):
            p = list(rng.choice(passages))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "edit"
            words += p[rng.randrange(3) :] + [rng.choice(vocabulary) for _ in range(rng.randrange(20))]
        rows.append((rng.randrange(60), rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [(200, None), (201, ""), (202, "a a " * 40), (203, "a a " * 40), (1, rows[3][1]), (None, rows[4][1])]
    return rows


@pytest.mark.parametrize("seed,crowd,window", [(1, 1024, 13), (2, 3, 13), (3, 5, 4)])
def test_same_as_brute_force(spark, seed, crowd, window):
    rows = corpus(seed)
    frame = spark.createDataFrame([(i, t, "k", 0) for i, t in rows], "doc_id long, text string, key string, spans int")
    found = substrings.remove_repeats(frame, window=window, crowd=crowd).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found), key=str) == brute(rows, window)


def test_empty_table(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_automaton():
    rng = random.Random(4)
    known = substrings.SuffixAutomaton()
    added = ["".join(rng.choice("ab") for _ in range(12)) for _ in range(6)]
    for s in added:
        known.add(list(s))
    probe = "".join(rng.choice("abc") for _ in range(60))
    want = [max(n for n in range(e + 1) if any(probe[e - n : e] in s for s in added)) for e in range(1, 61)]
    assert known.matches(list(probe)) == want
