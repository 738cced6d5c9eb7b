"""The pipeline's stages on a small table, each against a plain version on its own input."""

from __future__ import annotations

import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tests.llm.cases import documents, frame, lower, words
from tests.llm.test_operators import near_groups

from tideline.llm.line_rules import LineRules, clean_documents
from tideline.session import materialize

ROOT = Path(corpus_pipeline.__file__).parent
STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [r for r in documents(5, 80) if r[1] is not None]
    return frame(spark, rows).select(*corpus_pipeline.COLUMNS).cache()


def plain(df):
    return [tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect()]


def test_stages_are_the_five_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_join", "decontaminate", "mix", "tokens"]


def lines_left(text):
    """Lines that no rule fails, by the rules' own statements and plain Python."""
    rules = LineRules()
    left = []
    for line in (text or "").split("\n"):
        w = words(line)
        if not w:
            continue
        symbols = len(re.findall(f"[{rules_symbols()}]", line))
        capitals = len(re.findall("[A-Z]", line))
        failed = (
            symbols * 100 > len(w) * rules.line_symbol_percent
            or (len(w) > 1 and capitals * 100 > len(line) * rules.line_capital_percent)
            or (len(w) >= rules.open_line_words and not re.search(rules.ends, line))
            or len(re.split(rules.separators, line)) > rules.menu_separators
            or re.search(rules.boilerplate, line)
        )
        if not failed:
            left.append(line)
    return left


def rules_symbols():
    from tideline.llm.line_rules import SYMBOLS

    return SYMBOLS


def test_quality_stage_keeps_what_the_rules_keep(spark):
    rules = LineRules()
    rows = documents(5, 80)
    prose = "\n".join(" ".join(f"{w}{k}" for w in "a plain sentence of words that goes on and then ends".split()) + "." for k in range(8))
    rows += [(k, text, "en", "s", 1, *[None] * 5) for k, text in enumerate([prose, prose + "\nHome | News | About | More", None, ""], 700)]
    got = plain(STAGE["quality_rules"](spark, frame(spark, rows), ""))
    want = []
    for r in rows:
        w = words(r[1])
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        repeat = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
        if len(w) < rules.min_words or 100 * len(repeat) > rules.max_repeat_percent * len(w):
            continue
        left = lines_left(r[1])
        if 100 * sum(len(words(x)) for x in left) >= rules.min_left_percent * len(w):
            want.append((r[0], "\n".join(left), r[2], r[3], len("\n".join(left))))
    assert len(want) >= 2 and Counter(got) == Counter(want)


def test_decontaminated_documents_hold_no_window(spark, tmp_path):
    token = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    rows = documents(6, 60)
    long = next(r[1] for r in rows if len(words(r[1])) > 100)
    items = [("a", " ".join(long.split()[20:34])), ("b", "one"), ("c", None), ("d", "..."), ("e", " ".join(f"q{k}" for k in range(12)))]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    windows = set()
    for _, text in items:
        w = token.findall(lower(text))
        windows |= {tuple(w[i : i + 10]) for i in range(max(len(w) - 9, 1))} if w else set()

    def hit(text):
        w = token.findall(lower(text))
        return any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))

    got = plain(STAGE["decontaminate"](spark, frame(spark, rows), str(tmp_path)))
    want = [tuple(r[:5]) for r in rows if not hit(r[1])]
    assert 0 < len(want) < len(rows) and Counter(got) == Counter(want)


def test_stages_take_empty_tables_and_nulls(spark, tmp_path):
    spark.createDataFrame([("a", "some item text")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    nulls = [(None, None, None, None, None, *[None] * 5), (1, "", "en", None, 0, *[None] * 5), (2, None, "en", "s", None, *[None] * 5)]
    for rows in ([], nulls):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame(spark, rows), str(tmp_path))
            n = out.count()
            assert name == "tokens" or out.columns == corpus_pipeline.COLUMNS
            assert n == (0 if not rows or name in ("quality_rules", "mix") else len(rows)), name


def test_one_document_of_each_group_stays(spark, docs):
    rows = plain(docs)
    got = plain(STAGE["ngram_join"](spark, docs, ""))
    assert set(got) <= set(rows)
    groups = defaultdict(set)
    sets, group = near_groups(rows)
    for row, own, g in zip(rows, sets, group, strict=True):
        if own:
            groups[g].add(row[:2])
    kept = Counter(g[:2] for g in got)
    assert all(v == 1 for v in kept.values())
    for members in groups.values():
        stays = [m for m in members if m in kept]
        ids = [m[0] for m in members if m[0] is not None]
        assert len(stays) == 1 and (not ids or stays[0][0] == min(ids))
    assert {r[:2] for r in rows if not words(r[1])} <= set(kept)


def test_mix_repeats_and_cuts_to_the_targets(spark, docs):
    rows = [r for r in plain(docs) if r[0] is not None]
    docs = spark.createDataFrame(rows, docs.schema)
    got = plain(STAGE["mix"](spark, docs, ""))
    size, taken = Counter(), Counter()
    body = defaultdict(set)
    for r in rows:
        size[r[3]] += len(words(r[1]))
        body[r[0]].add(tuple(words(r[1])))
    for g in got:
        taken[g[3]] += len(words(g[1]))
        own = words(g[1])
        assert any(not Counter(own) - Counter(b) for b in body[g[0]])
    assert abs(sum(taken.values()) - sum(size.values())) <= 70 * len(size)
    assert all(taken[s] <= 3 * size[s] for s in size)


def test_tokens_stage_is_the_tokenizer(spark, docs):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted(tuple(r) for r in STAGE["tokens"](spark, docs, "").select("n_tokens", "ids_crc32").collect())
    ids = [coder.encode(r[1] or "", add_special_tokens=False).ids + [0] for r in plain(docs)]
    assert got == sorted((len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for i in ids)


def test_run_over_the_given_documents(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    rows = sorted(out.collect(), key=lambda r: r["start"])
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)


def test_clean_documents_of_the_given_table_stay(spark, sf_dir):
    """Prose that the labels call good is not thrown out by the line rules."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = materialize(clean_documents(docs).join(marks, "doc_id"), "judged")
    good = judged.where("quality = 1 AND NOT base_failed")
    assert good.where("NOT kept").count() <= 0.01 * good.count()
    assert judged.where("quality = 0 AND kept").count() <= 0.1 * judged.where("quality = 0").count()


def test_the_rest_works_without_this_folder():
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('tideline.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'churn_report' in e.queries() and not any(n.startswith('op') and n[2].isdigit() for n in e.queries())\n"
        "assert 'pipeline' not in e.queries()\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and "pipeline" not in entry.oracle_sql()


def test_queries_equal_their_sql(spark, duck, sf_dir):
    from tests.compare import compare

    from tideline.llm.queries import ORACLES, QUERIES

    for name in sorted(ORACLES):
        message, rows = compare(QUERIES[name](spark, sf_dir), duck, ORACLES[name])
        assert (name, message) == (name, "") and rows > 0
