"""Alignment of two tokenizers against the libraries, token by token."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.cases import DOCS, documents, frame
from tokenizers import Tokenizer

from tideline.llm.alignment import ByteLevel, Pieces, align, align_documents, alignment_statistics, lockstep, pair_bound
from tideline.llm.token_files import byte_alphabet

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def whole():
    """Ids and bytes of a text's tokens, from the libraries alone."""
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    back = {chr(c): k for k, c in byte_alphabet().items()}

    def spell_b(k):
        piece = b.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece[:3] == "<0x" else piece.replace("▁", " ").encode()

    def run(text):
        if not text:
            return [], []
        mine = [(k, bytes(back[c] for c in a.id_to_token(k))) for k in a.encode(" " + text, add_special_tokens=False).ids]
        theirs = [(k, spell_b(k)) for k in b.encode(text)]
        spaced = (" " + text).encode()
        if b"".join(x for _, x in mine) != spaced or b"".join(x for _, x in theirs) != spaced:
            return [], []
        return mine, theirs

    return run


def brute(texts, whole):
    """Counts and digest of each text."""
    groups, pairs = [], Counter()
    for text in texts:
        mine, theirs = whole(text)
        a_end, b_end = np.cumsum([len(x) for _, x in mine]).tolist(), np.cumsum([len(x) for _, x in theirs]).tolist()
        links = [(i, b_end.index(e)) for i, e in enumerate(a_end) if e in set(b_end)]
        own, i, j = [], 0, 0
        for x, y in links:
            own.append(([k for k, _ in mine[i : x + 1]], [k for k, _ in theirs[j : y + 1]]))
            i, j = x + 1, y + 1
        pairs.update((a[-1], b[-1]) for a, b in own)
        groups.append((len(mine), len(theirs), own))
    highest = {}
    for (_, b), n in pairs.items():
        highest[b] = max(highest.get(b, 0), n)
    out = []
    for n_a, n_b, own in groups:
        last = [(a[-1], b[-1]) for a, b in own]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in own)
        out.append(
            (
                n_a, n_b, len(own), len(own), sum(pairs[p] == highest[p[1]] for p in last), sum(pairs[p] for p in last),
                hashlib.sha256(text.encode()).hexdigest() if own else "",
            )
        )
    return out


ODD = [
    None, "", " ", "   ", "a ", " a", "a  ", "  two  blanks  ", "\n", "\t\ta\r\n", "<s>", "</s> <unk>", "<0x41>", "<|endoftext|> x",
    "▁", "a▁b", "é漢字😀", "é ﬁ ①  　", "\x00\x7f", "x" * 3000, "don't stop", "😀" * 400, "ab" * 5000 + " end",
]


def texts(n=400):
    draw = random.Random(11)
    letters = "abcdeXYZ 019.,'!?\n\t  éß漢字😀-_<>|"
    return ODD + ["".join(draw.choice(letters) for _ in range(draw.randint(0, 120))) for _ in range(n)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 5), max_size=30), st.integers(0, 1 << 30)), max_size=6), st.integers(1, 9))
def test_lockstep_is_the_common_ends(docs, lane):
    a_end, b_end, edge, at = [], [], [], 0
    for sizes, seed in docs:
        n = sum(sizes)
        cuts = sorted({int(x) for x in np.random.default_rng(seed).integers(1, n + 1, 6)} | {n}) if n else []
        a_end += [at + int(x) for x in np.cumsum(sizes)]
        b_end += [at + x for x in cuts]
        edge += list(range(at, at + n, lane))
        at += n
    a, b = lockstep(np.array(a_end, np.int64), np.array(b_end, np.int64), np.array([*edge, at]))
    common = sorted(set(a_end) & set(b_end))
    assert [a_end[k] for k in a] == common == [b_end[k] for k in b]


def test_ids_are_those_of_the_whole_text(whole):
    some = texts()
    x = align(pa.array(some, pa.string()), ByteLevel(A_PATH), Pieces(B_PATH))
    for k, text in enumerate(some):
        mine, theirs = whole(text)
        assert x.a_ids[x.first_a[k] : x.first_a[k + 1]].tolist() == [i for i, _ in mine], text
        assert x.b_ids[x.first_b[k] : x.first_b[k + 1]].tolist() == [i for i, _ in theirs], text


def test_statistics(spark, whole):
    rows = documents() + [(3000 + k, t, *[None] * 8) for k, t in enumerate(texts(150))]
    rows += [rows[-1], rows[-1]]
    got = alignment_statistics(frame(spark, rows), A_PATH, B_PATH)
    assert got.columns == COLUMNS
    want = [(r[0], *w) for r, w in zip(rows, brute([r[1] for r in rows], whole), strict=True)]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_aligned_documents(spark, whole):
    rows = [(k, t) for k, t in enumerate(texts(60))]
    got = {r["doc_id"]: r for r in align_documents(spark.createDataFrame(rows, "doc_id long, text string"), A_PATH, B_PATH).collect()}
    for k, text in rows:
        mine, theirs = whole(text)
        a_end, b_end = np.cumsum([len(x) for _, x in mine]).tolist(), np.cumsum([len(x) for _, x in theirs]).tolist()
        r = got[k]
        assert r["a_ids"] == [i for i, _ in mine] and r["b_ids"] == [i for i, _ in theirs]
        assert r["ends"] == sorted(set(a_end) & set(b_end))
        assert [a_end[i] for i in r["a_places"]] == r["ends"] == [b_end[i] for i in r["b_places"]]


def test_pairs_stay_within_their_bound(whole):
    a, b = ByteLevel(A_PATH), Pieces(B_PATH)
    seen = set()
    for text in texts():
        mine, theirs = whole(text)
        b_end = dict(zip(np.cumsum([len(x) for _, x in theirs]).tolist(), theirs, strict=True))
        for end, one in zip(np.cumsum([len(x) for _, x in mine]).tolist(), mine, strict=True):
            if end in b_end:
                seen.add((one, b_end[end]))
    assert all(x.endswith(y) or y.endswith(x) for (_, x), (_, y) in seen)
    assert len({(i, j) for (i, _), (j, _) in seen}) <= pair_bound(a.tokens, b.tokens) < 1_000_000


def test_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert alignment_statistics(empty, A_PATH, B_PATH).count() == 0
    assert align_documents(empty, A_PATH, B_PATH).count() == 0
