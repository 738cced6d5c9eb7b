"""Inputs and scores of the quality machine against plain Python, one text at a time."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tests.llm.cases import DOCS, documents, frame, words

from tideline.llm import factorization as Q
from tideline.llm.words import Hasher, text_bytes


def plain_inputs(text, n_chars):
    """Index to value, as the module states its inputs."""
    text = text or ""
    data = text.encode()
    w = [x.encode() for x in words(text)]
    hasher = Hasher(Q._SEED)

    def hashed(word):
        raw = np.frombuffer(word, np.uint8)
        return int(hasher.strings(raw, np.array([0]), np.array([len(raw)]))[0])

    amount = lambda chars: sum(b in chars for b in data)
    symbol, shout = b"#*$%&<>|~^=+_{}[]\\@", b"!"
    n, size, lines = max(len(w), 1), max(len(data), 1), amount(b"\n")
    closed = sum(data[k] == 10 and data[k - 1] in b".!?:;\"')" for k in range(1, len(data)))
    stats = [
        amount(symbol) / size, amount(bytes(range(65, 91))) / size, amount(b"0123456789") / size,
        amount(b".,;:?") / n, amount(shout) / n, amount(b"|") / n, lines / n, amount(bytes(range(128, 256))) / size,
        1 - len(set(w)) / n, sum(a == b for a, b in zip(w, w[1:], strict=False)) / n,
        sum(x[-1] in symbol + shout for x in w) / n, sum(map(len, w)) / n / 32,
        math.log1p(len(w)) / 16, math.log1p(len(data)) / 24, (lines - closed) / (lines + 1),
        0 if n_chars is None else math.log1p(max(n_chars, 0)) / 24,
    ]
    out = {}
    base = 1 << Q.WORD_BITS
    for k, value in enumerate(min(max(s, 0), 1) for s in stats):
        step = min(int(math.log2(value * 1023 + 1) * 1.6), 15)
        if k == 15 and n_chars is None:
            step = 15
        out[base + 16 * k + step] = 0.5
        out[base + 256 + k] = value
    cells = Counter(hashed(x) >> (64 - Q.WORD_BITS) for x in w)
    norm = math.sqrt(sum(math.log1p(c) ** 2 for c in cells.values()))
    return out | {cell: math.log1p(c) / norm for cell, c in cells.items()}


def machine(seed=1):
    draw = np.random.default_rng(seed)
    return Q.Machine(0.3, draw.normal(0, 1, Q.SIZE).astype(np.float32), draw.normal(0, 0.3, (Q.SIZE, 4)).astype(np.float32))


def plain_score(m, inputs):
    """All pairs, not the sum-of-squares identity."""
    items = [(k, v) for k, v in inputs.items() if v]
    x = np.array([v for _, v in items])
    vectors = m.vectors[[k for k, _ in items]].astype(float) * x[:, None]
    margin = m.bias + float(m.weights[[k for k, _ in items]].astype(float) @ x)
    for i in range(len(items)):
        margin += float((vectors[i + 1 :] @ vectors[i]).sum())
    return 1 / (1 + math.exp(-min(max(margin, -40), 40)))


TEXTS = [
    None, "", "\n", "\nstarts with a line end", "ends.", "\n\nafter an end", "one", "aa aa aa bb!", "A|B # C\nd.\n\"e\"\nf",
    "é漢字 ünï\t\x0b x", "x" * 5000, "the same words again. " * 400,
]


def test_inputs_of_each_text_are_its_own():
    texts = TEXTS + [r[1] for r in documents(8, 40)]
    chars = [None if k % 5 == 0 else 7 * k - 10 for k in range(len(texts))]
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    numbers = np.array([math.nan if c is None else float(c) for c in chars])
    x = Q.document_inputs(data, offsets, numbers, Hasher(Q._SEED))
    for k, (text, c) in enumerate(zip(texts, chars, strict=True)):
        part = slice(x.first[k], x.first[k + 1])
        got = dict(zip(x.index[part].tolist(), x.value[part].tolist(), strict=True))
        assert got == pytest.approx(plain_inputs(text, c), abs=1e-5), text


def test_scores_are_those_of_all_pairs(spark):
    rows = documents(9, 30) + [(900 + k, t, None, None, k if k % 2 else None, *[None] * 5) for k, t in enumerate(TEXTS)]
    rows = [r for r in rows if len(words(r[1])) < 2000]
    m = machine()
    got = Q.score_quality(frame(spark, rows), m, threshold=0.3)
    want = Counter()
    for r in rows:
        want[r[0], round(plain_score(m, plain_inputs(r[1], r[4])), 3)] += 1
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        near = [k for k in want if k[0] == r["doc_id"] and abs(k[1] - r["score"]) < 2e-3]
        assert near, r
        assert r["predicted"] == int(r["score"] >= 0.3)


def test_the_fit_takes_rows_in_hash_order(spark):
    rows = [(k, f"{'good plain words here' if k % 2 else '### $$$ buy'} {k}", None, None, 1, *[None] * 5) for k in range(300)]
    rows += [rows[7], (7, "another text of one id", *[None] * 8)]
    marks = spark.createDataFrame([(k, k % 2) for k in range(300)] + [(7, 0)], "doc_id long, quality int")
    one = Q.train_quality(frame(spark, rows, 1), marks, max_rows=40)
    other = Q.train_quality(frame(spark, rows[::-1], 6), marks.repartition(5), max_rows=40)
    assert one.bias == other.bias and (one.vectors == other.vectors).all()


def test_columns_of_any_name_pass_through(spark):
    rows = spark.createDataFrame([(1, "text", 2, 0.5, "x")], "doc_id long, text string, `a``b` int, label double, `c.d` string")
    marks = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    got = Q.score_quality(rows, Q.train_quality(rows, marks))
    assert got.columns == ["doc_id", "a`b", "label", "c.d", "held_out", "score", "predicted"] and got.count() == 1
    assert Q.train_quality(spark.createDataFrame([], DOCS), marks) is None
