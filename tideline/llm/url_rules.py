"""URL allow and block rules in a trie over reversed host labels, then path segments.

The trie travels to the tasks in a broadcast as long as the rules together are
shorter than ``max_broadcast_chars``; a longer list is laid out in blocks of
that size, one trie each, and the longest of the blocks' answers wins, so the
size of a broadcast never depends on the list.

Defined results: a null url, or one without ``://``, has an empty host and
path and matches only a rule with neither. Of several rules that fit, the one
with the longest host and path together wins, then the longer host; of rules
with the same host and path, block wins. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULTS = ("host", "path", "rule", "verdict")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass
class PathNode:
    below: dict[str, PathNode] = field(default_factory=dict)
    #: Rules that end here with the start of one more segment.
    ends: dict[str, Rule] = field(default_factory=dict)


@dataclass
class HostNode:
    below: dict[str, HostNode] = field(default_factory=dict)
    anywhere: Rule | None = None
    paths: PathNode | None = None


class Trie:
    """Rules by reversed host labels; each host holds a trie of path segments."""

    def __init__(self, rules: list[Rule]):
        self.root = HostNode()
        for rule in sorted(rules, key=lambda r: r.verdict == "block"):
            node = self.root
            for label in reversed(rule.host.split(".")) if rule.host else ():
                node = node.below.setdefault(label, HostNode())
            if not rule.path:
                node.anywhere = rule
                continue
            if node.paths is None:
                node.paths = PathNode()
            *whole, last = rule.path.split("/")[1:]
            at = node.paths
            for segment in whole:
                at = at.below.setdefault(segment, PathNode())
            at.ends[last] = rule

    @staticmethod
    def _in_path(node: PathNode, path: str) -> Rule | None:
        best = None
        for segment in path.split("/")[1:]:
            for cut in range(len(segment), -1, -1):
                if (rule := node.ends.get(segment[:cut])) is not None:
                    best = rule
                    break
            node = node.below.get(segment)
            if node is None:
                return best
        return best

    def find(self, host: str, path: str) -> Rule | None:
        best, node = None, self.root
        labels = host.split(".") if host else []
        while True:
            for rule in (
                node.anywhere,
                self._in_path(node.paths, path) if node.paths and path else None,
            ):
                if rule is not None and (best is None or len(rule.name) >= len(best.name)):
                    best = rule
            if not labels or (node := node.below.get(labels.pop())) is None:
                return best


def _blocks(rules: list[Rule], limit: int) -> Iterator[list[Rule]]:
    block, used = [], 0
    for rule in rules:
        if block and used + len(rule.name) > limit:
            yield block
            block, used = [], 0
        block.append(rule)
        used += len(rule.name)
    yield block


def judge_urls(
    pages: DataFrame,
    rules: list[Rule],
    *,
    default: str = "allow",
    max_broadcast_chars: int = 8_000_000,
) -> DataFrame:
    """Host, path, the rule that decides and the verdict of every row's url."""
    url = F.coalesce(F.col("url"), F.lit(""))
    # The pattern runs over line ends too; without "://" there is nothing to take.
    rest = F.regexp_extract(url, "(?s)^.*?://(.*)$", 1)
    host = F.translate(
        F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    other = [c for c in pages.columns if c not in RESULTS]
    df = pages.select(*other, host.alias("host"), path.alias("path"))
    if "url" not in other:
        raise ValueError("pages need a url column")
    spark = pages.sparkSession
    found = []
    for k, block in enumerate(_blocks(rules, max_broadcast_chars)):
        shared = spark.sparkContext.broadcast(Trie(block))

        @F.pandas_udf("rule string, verdict string, hosted int")
        def find(hosts, paths, shared=shared):
            import pandas as pd

            trie = shared.value
            hits = [trie.find(h, p) for h, p in zip(hosts, paths, strict=True)]
            return pd.DataFrame(
                {
                    "rule": [r and r.name for r in hits],
                    "verdict": [r and r.verdict for r in hits],
                    "hosted": [len(r.host) if r else 0 for r in hits],
                }
            )

        df = df.withColumn(f"__hit{k}", find("host", "path"))
        found.append(F.col(f"__hit{k}"))
    best = F.array_max(
        F.array(
            *(
                F.struct(
                    F.coalesce(F.length(h["rule"]), F.lit(-1)).alias("length"), h["hosted"], h["rule"], h["verdict"]
                )
                for h in found
            )
        )
    )
    return df.select(
        *other, "host", "path", best["rule"].alias("rule"),
        F.coalesce(best["verdict"], F.lit(default)).alias("verdict"),
    )
