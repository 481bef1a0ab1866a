import hashlib
import random
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from quillstone.llm import _shared, align, pieces

A = Tokenizer.from_file(public_tokenizers.path(align.VOCABULARY))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))


def _alphabet():
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


BACK = _alphabet()
assert set(BACK) == set(ByteLevel.alphabet())


def tokens(text):
    """Ids and byte ranges of either tokenizer, by the libraries; none where they don't give the text back."""
    if not text:
        return [], []
    source = (" " + text).encode()
    out = []
    for ids, data in (
        ((a := A.encode(" " + text, add_special_tokens=False).ids), [bytes(BACK[c] for c in A.id_to_token(i)) for i in a]),
        ((b := B.encode(text)), [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]),
    ):
        if b"".join(data) != source:
            return [], []
        spans, at = [], 0
        for i, x in zip(ids, data, strict=True):
            spans.append((i, at, at + len(x)))
            at += len(x)
        out.append(spans)
    return tuple(out)


def brute(texts):
    rows, held = [], Counter()
    for text in texts:
        a, b = tokens(text)
        links = [(x, y) for x, s, e in a for y, t, f in b if s < f and t < e]
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, begin = [], 0
        for end in ends:
            groups.append(",".join(str(x) for x, s, e in a if begin <= s and e <= end) + "|" + ",".join(str(x) for x, s, e in b if begin <= s and e <= end))
            begin = end
        held.update(set(links))
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    most = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    return [(na, nb, ng, len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), digest) for na, nb, ng, links, digest in rows]


def found(spark, texts, tmp_path):
    rows = [(i, t, 7, "x") for i, t in enumerate(texts)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, slice int, pairs string").repartition(3)
    documents.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    out = align.op11_cross_tokenizer(spark, str(tmp_path)).collect()
    assert len(out) == len(texts)
    return [tuple(r)[1:] for r in sorted(out, key=lambda r: r.doc_id)]


def test_rows_equal_brute_force(spark, tmp_path):
    rng = random.Random(5)
    letters = ["the", " the", "wörter", "é", "①", "🙂", "中", "  ", "\n", "<|endoftext|>", "</s>", "isn't", "12", "345", " of", "ab", "x"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(150)]
    texts += [None, "", " ", "▁", "a ▁ b", "▁x", "the", "the", "the the", "x" * 400, "a\0b", "\t"]
    assert found(spark, texts, tmp_path) == brute(texts)


def test_documents_equal_brute_force(spark, sf_dir, tmp_path):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect() if len(r.text or "") < 3000][:60]
    assert found(spark, texts, tmp_path) == brute(texts)


def test_long_texts_repeated_rows_and_null_keys(spark):
    long = "wörter und words " * 20_000
    rows = [(1, "the end", 1), (1, "the end", 1), (None, "the end", 1), (2, long, 1), (3, "漢字" * 5000, 1)]
    out = align.score(_shared.settle(align.align(spark.createDataFrame(rows, "id long, body string, slice int"), key="id", text="body"), "t"), "id").collect()
    assert len(out) == 5 and sorted((r.id or 0) for r in out) == [0, 1, 1, 2, 3]
    same = {(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in out if r.id in (1, None)}
    assert len(same) == 1
    na, nb, ng, nl, best, total, groups = same.pop()
    assert groups == ";".join(f"{a}|{b}" for a, b in zip(A.encode(" the end").ids, B.encode("the end"), strict=True)) and total == 3 * nl and best == nl
    assert next(r for r in out if r.id == 2).n_a == len(A.encode(" " + long).ids)


def test_counts_and_empty_table(spark):
    aligned = _shared.settle(align.align(spark.createDataFrame([(1, "the end"), (2, "the"), (3, None)], "doc_id long, text string")), "t")
    assert sorted(r.documents for r in align.pair_counts(aligned).collect()) == [1, 2]
    empty = align.align(spark.createDataFrame([], "doc_id long, text string"))
    assert align.score(_shared.settle(empty, "t")).collect() == []
