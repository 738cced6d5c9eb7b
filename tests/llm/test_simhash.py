"""BK-trees, the dealing of fingerprints, and SimHash components against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.cases import DOCS, documents, frame, lower, words

from tideline.llm.bk_tree import build
from tideline.llm.simhash import finer_masks, first_masks, link_fingerprints, near_fingerprints


def spell(text):
    w = words(lower(text))
    grams = [" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, radius=2):
    """Each value's component, named by its least value."""
    values = sorted(set(values))
    array = np.array(values, np.uint64)
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, v in enumerate(array):
        for j in np.flatnonzero(np.bitwise_count(array[:k] ^ v) <= radius).tolist():
            parent[max(root(j), root(k))] = min(root(j), root(k))
    return {v: values[root(k)] for k, v in enumerate(values)}


def cluster(seed=5, n=300):
    """Random values, balls around some of them, and a chain."""
    draw = np.random.default_rng(seed)
    value = draw.integers(0, 1 << 64, n, dtype=np.uint64)
    flips = lambda k: np.bitwise_xor.reduce(np.uint64(1) << draw.integers(0, 64, (200, k), dtype=np.uint64), axis=1)
    balls = [value[j] ^ flips(k) for j in range(3) for k in (1, 2, 4, 6)]
    chain = np.bitwise_xor.accumulate(np.uint64(3) << np.arange(0, 62, 2, dtype=np.uint64)) ^ value[9]
    edge = np.array([0, 1, 3, (1 << 64) - 1, 1 << 63], np.uint64)
    return np.unique(np.concatenate([value, *balls, chain, edge]))


def test_trees_find_what_brute_force_finds():
    value = np.random.default_rng(1).permutation(cluster())
    group = np.arange(len(value)) % 3
    trees, roots = build(value, group)
    assert sorted(trees.value.tolist()) == sorted(value.tolist()) and roots.tolist() == [0, 1, 2]
    query, node = trees.search(value, np.searchsorted(roots, group), 2)
    got = {(int(value[a]), int(trees.value[b])) for a, b in zip(query, node, strict=True)}
    near = (np.bitwise_count(value[:, None] ^ value[None, :]) <= 2) & (group[:, None] == group[None, :])
    assert got == {(int(value[a]), int(value[b])) for a, b in zip(*np.nonzero(near), strict=True)}


def test_edges_are_distances_to_the_parent():
    value = cluster(3)
    trees, _ = build(value, np.zeros(len(value), np.int64))
    parent, edge = trees.child_key >> 7, trees.child_key & 127
    child = trees.value[trees.roots :]
    assert (np.bitwise_count(child ^ trees.value[parent]) == edge).all()
    # A child's key is its own, and keys ascend, so children are a range by edge.
    assert (np.diff(trees.child_key) > 0).all()


@settings(max_examples=100, deadline=None)
@given(st.integers(0, (1 << 64) - 1), st.sets(st.integers(0, 63), max_size=2), st.integers(1, 1 << 40))
def test_near_values_share_a_group_at_every_depth(value, flipped, n):
    other = value
    for b in flipped:
        other ^= 1 << b
    masks = first_masks(n, 2, 4096)
    for _ in range(6):
        shared = [m for m in masks if value & m == other & m]
        assert shared
        finer = finer_masks(masks, 2)
        masks = {m: w for k in shared if k in finer for m, w in finer[k].items()}
        if not masks:
            break


@pytest.mark.parametrize(
    "limits", [{}, {"broadcast_bytes": 0}, {"tree_size": 8, "limit": 16}, {"tree_size": 8, "limit": 4, "broadcast_bytes": 0}]
)
def test_links_connect_the_components(spark, limits):
    value = cluster()
    rows = spark.createDataFrame([(int(v),) for v in value.view(np.int64)], "value long").repartition(3)
    links = [tuple(r) for r in link_fingerprints(rows, **limits).collect()]
    a, b = np.array(links, np.int64).T.view(np.uint64)
    assert (np.bitwise_count(a ^ b) <= 64).all()
    want = components(value.tolist())
    parent = {v: v for v in value.tolist()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = sorted((root(x), root(y)))
        parent[y] = x
    assert {v: root(v) for v in parent} == want


def brute(rows):
    prints = [spell(r[1]) for r in rows]
    named = components(prints)
    least = {}
    for r, p in zip(rows, prints, strict=True):
        if r[0] is not None:
            least[named[p]] = min(least.get(named[p], r[0]), r[0])
    return sorted(((r[0], f"{p:016x}", least.get(named[p])) for r, p in zip(rows, prints, strict=True)), key=repr)


def test_near_fingerprints(spark):
    rows = documents()
    draw = random.Random(4)
    base = [f"w{draw.randrange(300)}" for _ in range(4000)]
    for k in range(30):
        near = list(base)
        near[draw.randrange(len(near))] = "other"
        rows.append((2000 + k, " ".join(near), *[None] * 8))
    rows.append((5000, "Word " * 400_000, *[None] * 8))
    got = near_fingerprints(frame(spark, rows)).select("doc_id", "fingerprint", "component_id")
    want = brute(rows)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert sum(c is not None and c != d for d, _, c in want) > 20


def test_nothing(spark):
    assert near_fingerprints(spark.createDataFrame([], DOCS)).count() == 0
