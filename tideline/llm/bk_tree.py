"""BK-trees over 64-bit fingerprints, built and searched by array operations.

In a BK-tree every node's children are keyed by their Hamming distance to it,
and all that hangs below the child at distance d is at distance d too. By the
triangle inequality a search within radius r from a node at distance d need
only follow the edges d - r .. d + r.

A ``Forest`` holds many trees, one per group of fingerprints. Nodes are in
breadth-first order, so a node's children are a range sorted by edge.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tideline.llm.words import run_starts

#: A distance between 64-bit values has seven bits.
_EDGE_BITS = 7
#: Pairs of query and node that a search holds at once.
_FRONT = 1 << 20


@dataclass
class Forest:
    """Fingerprints by node; parent and edge of each as one number; each group's root."""

    value: np.ndarray
    child_key: np.ndarray
    roots: int

    @property
    def nbytes(self) -> int:
        return self.value.nbytes + self.child_key.nbytes

    def search(self, query: np.ndarray, root: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices of queries and nodes within the radius, each query starting at its root."""
        found_query, found_node = [], []
        stack = [(np.arange(len(query)), root)]
        while stack:
            which, node = stack.pop()
            if len(which) > _FRONT:
                half = len(which) // 2
                stack += [(which[half:], node[half:]), (which[:half], node[:half])]
                continue
            distance = np.bitwise_count(query[which] ^ self.value[node]).astype(np.int64)
            near = distance <= radius
            found_query.append(which[near])
            found_node.append(node[near])
            base = node << _EDGE_BITS
            lo = np.searchsorted(self.child_key, base + np.maximum(distance - radius, 0), "left")
            hi = np.searchsorted(self.child_key, base + distance + radius, "right")
            size = hi - lo
            some = np.flatnonzero(size)
            if len(some):
                size = size[some]
                before = np.cumsum(size) - size
                child = np.repeat(lo[some] - before, size) + np.arange(int(size.sum()))
                stack.append((np.repeat(which[some], size), child + self.roots))
        return np.concatenate(found_query), np.concatenate(found_node)


def build(value: np.ndarray, group: np.ndarray) -> tuple[Forest, np.ndarray]:
    """A tree for each group of distinct fingerprints, and the group of each root.

    A group's first fingerprint is its root, the first of those at one distance
    from a node is its child at that edge, as if they were inserted one by one.
    """
    order = np.argsort(group, kind="stable")
    value, below = value[order], group[order]
    first = run_starts(below)
    root_group = below[first]
    nodes, keys = [value[first]], []
    made = 0
    below = np.cumsum(np.concatenate([[0], below[1:] != below[:-1]])) if len(below) else below
    while len(value):
        # below: for each fingerprint the node, of this level, whose tree it is in.
        pivot = nodes[-1][below]
        distance = np.bitwise_count(value ^ pivot).astype(np.int64)
        rest = np.flatnonzero(distance)
        value, key = value[rest], (below[rest] + made << _EDGE_BITS) | distance[rest]
        made += len(nodes[-1])
        if not len(value):
            break
        order = np.argsort(key, kind="stable")
        value, key = value[order], key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        nodes.append(value[new])
        keys.append(key[new])
        below = np.cumsum(new) - 1
    child_key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    return Forest(np.concatenate(nodes), child_key, len(first)), root_group
