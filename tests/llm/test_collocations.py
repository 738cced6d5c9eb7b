"""Misra-Gries summaries, and collocations against counting everything."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.cases import DOCS, frame, lower

from tideline.llm.collocations import _CODEC, _add_up, _count, _send, _summarise, mine_collocations
from tideline.llm.misra_gries import Summary

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), max_size=60), min_size=1, max_size=8), st.integers(2, 12))
def test_summary_loses_no_frequent_key(parts, threshold):
    mass = sum(map(len, parts))
    summary = Summary(mass // threshold + 1)
    true = Counter()
    for part in parts:
        true.update(part)
        keys, counts = np.unique(np.array(part, np.uint32), return_counts=True)
        summary.add(keys, counts)
        summary.settle()
        assert len(summary.keys) <= summary.capacity
    alive = set(summary.survivors(threshold).tolist())
    assert {k for k, n in true.items() if n >= threshold} <= alive
    assert summary.lost <= mass // (summary.capacity + 1) < threshold
    for k, n in zip(summary.keys.tolist(), summary.counts.tolist(), strict=True):
        assert n <= true[k] <= n + summary.lost


def test_summaries_merge():
    draw = np.random.default_rng(2)
    data = (draw.pareto(1.0, 20_000) * 3).astype(np.uint32)
    whole = Summary(len(data) // 50 + 1)
    for part in np.split(data, 10):
        one = Summary(whole.capacity)
        one.add(*np.unique(part, return_counts=True))
        whole.merge(one)
    keys, counts = np.unique(data, return_counts=True)
    assert set(keys[counts >= 50].tolist()) <= set(whole.survivors(50).tolist())


def brute(rows, threshold=30, keep=2000, longest=4):
    counts, totals = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", lower(text)):
            w = re.findall("[^ \\t]+", piece)
            totals[lang] += len(w)
            own = counts.setdefault(lang, Counter())
            for n in range(1, longest + 1):
                own.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= threshold}
        left = []
        for p, a in candidates.items():
            longer = [
                b for q, b in candidates.items()
                if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            ]
            if longer and 100 * max(longer) >= 80 * a:
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            left.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(left)[:keep], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def corpus(n=220):
    draw = random.Random(9)
    vocabulary = ["".join(draw.choice("abcdéßXYZ") for _ in range(draw.randint(1, 5))) for _ in range(60)]
    fixed = [[draw.choice(vocabulary) for _ in range(draw.randint(2, 6))] for _ in range(12)]
    rows = []
    for k in range(n):
        body = ""
        for _ in range(draw.randint(0, 25)):
            part = draw.choice(fixed) if draw.random() < 0.5 else [draw.choice(vocabulary) for _ in range(3)]
            body += draw.choice([" ", "\t", "  "]).join(part) + draw.choice([" ", " ", ". ", "\n", ",", "\x0b", ";;"])
        lang = draw.choice(["en", "en", "de", None, ""])
        rows.append((k, body, lang, *[None] * 7))
    rows += [(900 + k, t, "en", *[None] * 7) for k, t in enumerate([None, "", " \t ", "...", "one", "x" * 5000])]
    rows += [rows[3]] * 5 + [(None, "same words here " * 40, "rare", *[None] * 7)]
    # A very long text without marks, and one with.
    rows.append((901, "long run " * 20_000, "fr", *[None] * 7))
    rows.append((902, "cut here. and there, " * 20_000, "fr", *[None] * 7))
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.mark.parametrize("limits", [{}, {"pack_bytes": 2_000, "part_mass": 3_000}])
def test_collocations(spark, rows, limits):
    got = mine_collocations(frame(spark, rows), **limits)
    want = brute(rows)
    assert len(want) > 30 and {r[0] for r in want} >= {"en", "de", "und", "", "fr"}
    assert got.columns == COLUMNS
    assert sorted(tuple(r) for r in got.collect()) == want


def test_collocations_keep_the_first(spark, rows):
    got = mine_collocations(frame(spark, rows), keep=7, threshold=10, spread=3)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 10, 7)


def test_collocations_of_nothing(spark):
    assert mine_collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert mine_collocations(frame(spark, [(1, None, None, *[None] * 7)])).count() == 0
    with pytest.raises(ValueError, match="threshold"):
        mine_collocations(spark.createDataFrame([], DOCS), threshold=300)


def test_a_pack_sends_a_partition_one_row():
    """What the packs send does not grow with the phrases they share."""
    draw = np.random.default_rng(3)
    bodies = [" ".join(f"w{k}" for k in draw.integers(0, 40, 3_000)).encode() for _ in range(6)]
    packs = pa.table(
        {
            "pack": pa.array(range(6), pa.int64()), "lang": ["en", "de"] * 3, "n_words": [3_000] * 6,
            "n_bytes": [len(b) for b in bodies], "body": [pa.compress(b, codec=_CODEC, asbytes=True) for b in bodies],
        }
    )
    parts, threshold = 3, 30
    sent = pa.Table.from_batches(list(_send(4, parts)(iter(packs.to_batches()))))
    answers = pa.concat_tables(
        [_summarise(threshold)(sent.filter(np.array(sent.column("part")) == p)) for p in range(parts)]
    )
    counted = [
        _count(4, parts)(packs.slice(k, 1), answers.filter(np.array(answers.column("pack")) == k)) for k in range(6)
    ]
    assert all(0 < t.num_rows <= parts for t in counted)
    counted = pa.concat_tables(counted)
    got = Counter()
    for p in range(parts):
        for r in _add_up(threshold)(counted.filter(np.array(counted.column("part")) == p)).to_pylist():
            assert r["size"] == len(r["phrase"].split()) and (r["lang"], r["phrase"]) not in got
            got[r["lang"], r["phrase"]] = r["n"]
    want = Counter()
    for lang, body in zip(["en", "de"] * 3, bodies, strict=True):
        words = body.decode().split()
        want.update((lang, " ".join(words[i : i + n])) for n in range(1, 5) for i in range(len(words) - n + 1))
    assert got == {k: n for k, n in want.items() if n >= threshold} and len(got) > 40
