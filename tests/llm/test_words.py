"""Hashes of long words, and units told apart by their bytes."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tests.llm.cases import frame
from tokenizers import Tokenizer

from tideline.llm.ngram_join import near_duplicates
from tideline.llm.token_files import UnitEncoder
from tideline.llm.units import UnitCache
from tideline.llm.window_dedup import remove_repeated_windows
from tideline.llm.words import Hasher

BPE = public_tokenizers.path("byte_bpe_50k.json")
SWAP = str.maketrans("ab", "ba")


def balanced(doublings: int) -> tuple[str, str]:
    """A word and its mirror that every polynomial modulo 2^64 hashes alike."""
    word = "a"
    for _ in range(doublings):
        word += word.translate(SWAP)
    return word, word.translate(SWAP)


@pytest.mark.parametrize("doublings", range(13))
def test_long_words_have_hashes_of_their_own(doublings):
    x, y = (np.frombuffer(w.encode(), np.uint8) for w in balanced(doublings))
    for seed in (1, 31, 53):
        h = Hasher(seed)
        one, other = (h.strings(w, np.array([0]), np.array([len(w)]))[0] for w in (x, y))
        assert one != other


def test_windows_of_unlike_long_words_stay(spark):
    x, y = balanced(10)
    same = " ".join(f"w{k}" for k in range(34))
    got = remove_repeated_windows(frame(spark, [(1, f"{x} {same}", *[None] * 8), (2, f"{y} {same}", *[None] * 8)]))
    assert [r["n_removed"] for r in got.collect()] == [0, 0]


def test_documents_of_unlike_long_words_do_not_link(spark):
    x, y = balanced(10)
    got = near_duplicates(frame(spark, [(1, x, *[None] * 8), (2, y, *[None] * 8)]))
    assert sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == [(1, 1), (2, 2)]


def test_units_of_unlike_long_words_have_their_own_ids():
    tokenizer = Tokenizer.from_file(BPE)
    texts = [w for k in (4, 5, 10) for w in balanced(k)] * 2
    ids, counts = UnitEncoder(BPE)(pa.array(texts))
    for text, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert own[:-1].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_units_are_told_apart_by_bytes_when_hashes_agree():
    class Blind(Hasher):
        def strings(self, data, start, end):
            return np.full(len(start), 7, np.uint64)

    spelled = lambda units: (np.array([b for u in units for b in u], np.uint32), np.array([len(u) for u in units]))
    cache = UnitCache(spelled, Blind())
    for text in (b"one two one six", b"six one", b"seven", b""):
        data = np.frombuffer(text, np.uint8)
        first = np.flatnonzero(np.concatenate([[True], data[1:] == 0x20])) if len(data) else np.zeros(0, np.int64)
        ids, size = cache(data, first, np.append(first[1:], len(data)))
        assert bytes(ids.tolist()) == text and size.sum() == len(text)


def test_cache_keeps_what_it_met_before():
    asked = []

    def spelled(units):
        asked.append(len(units))
        return np.frombuffer(b"".join(units), np.uint8).astype(np.uint32), np.array([len(u) for u in units])

    cache = UnitCache(spelled, kept=600_000)
    draw = np.random.default_rng(4)
    data = np.frombuffer(b"".join(b"%06d" % k for k in range(400_000)), np.uint8)
    for lot in np.split(draw.permutation(400_000), 4) * 2:
        first = lot * 6
        ids, size = cache(data, first, first + 6)
        assert (size == 6).all()
        assert (ids.reshape(-1, 6) == data.reshape(-1, 6)[lot]).all()
    assert asked == [100_000] * 4
