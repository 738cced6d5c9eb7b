"""Each operator against a plain version, over odd rows; and over an empty table."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tests.llm.cases import DOCS, WORD, documents, frame, lower, words

from tideline.llm.apportion import sainte_lague
from tideline.llm.byte_shards import byte_shards
from tideline.llm.components import connect
from tideline.llm.decontaminate import find_contamination
from tideline.llm.factorization import score_quality, train_quality
from tideline.llm.line_rules import clean_documents
from tideline.llm.mixing import mix_sources
from tideline.llm.ngram_join import near_duplicates
from tideline.llm.suffix_dedup import remove_repeated_bytes
from tideline.llm.token_files import read_ids, token_digests, write_tokens
from tideline.llm.url_rules import Rule, judge_urls
from tideline.llm.window_dedup import remove_repeated_windows
from tideline.session import scratch_path

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def found(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def expected(items):
    return sorted(items, key=repr)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def test_window_dedup(docs, rows):
    size = 35
    seen = Counter(tuple(w[i : i + size]) for w in (words(r[1]) for r in rows) for i in range(len(w) - size + 1))
    want = []
    for r in rows:
        w = words(r[1])
        drop = {k for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for k in range(i, i + size)}
        want.append((r[0], len(w), len(drop), " ".join(x for k, x in enumerate(w) if k not in drop)))
    assert sum(x[2] for x in want) > 0
    got = remove_repeated_windows(docs)
    assert found(got, "doc_id", "n_words", "n_removed", "kept_text") == expected(want)
    # A sketch that is full estimates every window repeated and changes nothing.
    tiny = remove_repeated_windows(docs, max_cells=1 << 16, bucket_keys=50)
    assert found(tiny, "doc_id", "n_words", "n_removed", "kept_text") == expected(want)


def test_suffix_dedup(spark, rows):
    """Of one id, the row read first is the first; here its text comes first in one partition."""
    ordered = in_order(rows)
    docs = frame(spark, ordered, 1).coalesce(1).sortWithinPartitions("doc_id", "text")
    ordered = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    seen, want = set(), []
    for doc_id, text in ordered:
        data = (text or "").encode()
        gone = set()
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                gone.update(range(i, i + 100))
            seen.add(data[i : i + 100])
        spans = sum(1 for k in gone if k - 1 not in gone)
        want.append((doc_id, len(data), len(gone), spans, bytes(b for k, b in enumerate(data) if k not in gone)))
    got = [tuple(r) for r in remove_repeated_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()]
    assert sum(x[2] for x in want) > 0
    assert sorted([(*g[:4], bytes(g[4])) for g in got], key=repr) == expected(want)


def test_line_rules(docs, rows):
    want = []
    for r in rows:
        text = r[1] or ""
        w = words(text)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        repeat = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
        lines = [x for x in text.split("\n") if words(x)]
        base = len(w) < 50 or 100 * len(repeat) > 50 * len(w)
        want.append(
            (r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat), base)
        )
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = clean_documents(docs)
    assert found(got, *columns) == expected(want)
    assert got.where("base_failed AND kept").isEmpty()


def test_line_rules_drop_lines_and_reject(spark):
    good = "\n".join(" ".join(f"{w}{k}" for w in "a plain sentence of words that goes on and then ends".split()) + "." for k in range(6))
    page = "Home | News | About | Contact\n" + good + "\nAll rights reserved."
    junk = "\n".join(f"alpha{k}### beta{k}*** gamma{k}$$$ delta{k}%%% eps{k}&&& zeta{k}###" for k in range(20))
    loud = "\n".join(f"ALPHA{k}!! BETA!! GAMMA{k}!! DELTA!! EPSILON!! ZETA!!" for k in range(20))
    rows = [(1, good), (2, page), (3, junk), (4, loud)]
    got = {r["doc_id"]: r for r in clean_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k]["kept"] for k in (1, 2, 3, 4)] == [True, True, False, False]
    assert got[1]["clean_text"] == good and got[2]["clean_text"] == good
    assert got[2]["n_menu_lines"] == 1 and got[2]["n_boilerplate_lines"] == 1


def test_sainte_lague_is_highest_quotients():
    draw = np.random.default_rng(4)
    for _ in range(200):
        weights = draw.integers(0, 50, draw.integers(1, 9)).astype(float)
        seats = int(draw.integers(0, 120))
        given = np.zeros(len(weights), int)
        if weights.sum():
            for _ in range(seats):
                given[np.argmax(weights / (2 * given + 1))] += 1
        got = sainte_lague(weights, seats)
        assert got.sum() == given.sum()
        quotient = lambda g: sorted(w / (2 * k - 1) for w, n in zip(weights, g, strict=True) for k in range(1, n + 1))
        assert quotient(got) == pytest.approx(quotient(given))


def test_mix_sources(docs, rows):
    got = [r.asDict(recursive=True) for r in mix_sources(docs).collect()]
    assert expected((g["doc_id"], g["source"], g["size"]) for g in got) == expected((r[0], r[3], len(words(r[1]))) for r in rows)
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(words(r[1]))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(size.values()))
    while True:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
            free.remove(s)
    target |= {s: level * weight[s] for s in free}
    taken = defaultdict(int)
    for g in got:
        assert g["source_size"] == size[g["source"]]
        assert g["target"] == pytest.approx(target[g["source"]])
        assert 0 <= g["taken"] <= 3 * g["size"]
        assert g["taken"] == g["passes"] * g["size"] + sum(s["end"] - s["start"] for s in g["spans"])
        assert all(0 <= s["start"] < s["end"] <= g["size"] for s in g["spans"])
        taken[g["source"]] += g["taken"]
    for s in names:
        assert abs(taken[s] - target[s]) <= 70
    again = mix_sources(docs.repartition(5))
    key = ["doc_id", "source", "size", "taken"]
    assert found(again, *key) == expected(tuple(g[k] for k in key) for g in got)


def test_byte_shards(docs, rows):
    got = byte_shards(docs, 4).collect()
    assert expected((g["doc_id"], g["size"], g["text_crc32"]) for g in got) == expected(
        (r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows
    )
    total = sum(g["size"] for g in got)
    ordered = sorted(got, key=lambda g: g["start"])
    at = 0
    for g in ordered:
        assert g["start"] == at and g["shard"] == (2 * at + g["size"]) * 4 // (2 * total)
        at += g["size"]
    ids = [(g["doc_id"] is not None, g["doc_id"] or 0) for g in ordered]
    assert ids == sorted(ids)
    for k in range(4):
        assert sorted(g["slot"] for g in got if g["shard"] == k) == list(range(sum(g["shard"] == k for g in got)))


def benchmark(rows):
    token = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    own = [token.findall(lower(r[1])) for r in rows]
    long = [w for w in own if len(w) > 60]
    return token, [
        ("10", " ".join(long[0][3:30]).upper()), ("9", "; ".join(long[1][5:16])), ("2", " ".join(long[2][-4:])),
        ("2", "never seen anywhere at all"), ("7", None), ("8", " .,! "), (None, " ".join(long[3][10:21])),
        ("5", " ".join(long[0][3:30])),
    ]


@pytest.mark.parametrize("block", [16_000_000, 40])
def test_decontaminate(spark, docs, rows, block):
    token, items = benchmark(rows)
    windows = defaultdict(set)
    for item, text in items:
        w = token.findall(lower(text))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(item)
    sizes = {len(w) for w in windows}
    want = []
    for r in rows:
        w = token.findall(lower(r[1]))
        hit, ids = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    ids |= windows[g] - {None}
        want.append((r[0], len(w), len(hit), len(ids), ",".join(sorted(ids)), bool(hit)))
    assert any(x[5] for x in want)
    got = find_contamination(docs, spark.createDataFrame(items, "item_id string, text string"), block_chars=block)
    have = [(g["doc_id"], g["n_words"], g["n_hit"], g["n_items"], ",".join(g["items"]), g["contaminated"]) for g in got.collect()]
    assert expected(have) == expected(want)


def test_decontaminate_finds_words_longer_than_a_polynomial_hash(spark):
    """Words of more than 16 bytes, in bytes or in letters, hash alike in items and documents."""
    item = "one two three four arciónciónosarmici six seven eight nine averyveryverylongword eleven twelve"
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, "Arciónciónosarmici"), (3, "one two")], "doc_id long, text string")
    items = [("a", item), ("b", "arciónciónosarmici"), ("c", "averyveryverylongword")]
    got = find_contamination(docs, spark.createDataFrame(items, "item_id string, text string"))
    have = {g["doc_id"]: (g["n_words"], g["n_hit"], g["items"]) for g in got.collect()}
    assert have == {1: (14, 12, ["a", "b", "c"]), 2: (1, 1, ["b"]), 3: (2, 0, [])}


def test_token_files(spark, docs, rows):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(BPE)
    odd = ["<|endoftext|> and  <|endoftext|>", "a  b \n\n c\u3000d", "it's 'll '", "tail  "]
    many = docs.select("doc_id", "text").union(
        spark.createDataFrame([(1000 + k, t) for k, t in enumerate(odd)], "doc_id long, text string")
    )
    texts = [(r[0], r[1]) for r in rows] + [(1000 + k, t) for k, t in enumerate(odd)]
    folder = scratch_path(spark, "tokens-test")
    write_tokens(many, BPE, folder)
    got = sorted(read_ids(spark, folder).collect(), key=lambda g: g["start"])
    want = [(d, coder.encode(t or "", add_special_tokens=False).ids + [0]) for d, t in texts]
    assert expected((g["doc_id"], list(g["ids"])) for g in got) == expected(want)
    at = 0
    for g in got:
        assert g["start"] == at and g["n_tokens"] == len(g["ids"])
        at += g["n_tokens"]
    ids = [(g["doc_id"] is not None, g["doc_id"] or 0) for g in got]
    assert ids == sorted(ids)
    digest = token_digests(many, BPE)
    assert found(digest, "doc_id", "n_tokens", "ids_crc32") == expected(
        (d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in want
    )


def near_groups(rows, threshold=80):
    """Each row's shingles and the number of its group."""
    sets = []
    for r in rows:
        w = words(lower(r[1]))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    return sets, [root(i) for i in range(len(rows))]


def near_brute(rows):
    sets, group = near_groups(rows)
    ids = defaultdict(list)
    for r, g in zip(rows, group, strict=True):
        ids[g].append(r[0])
    least = {g: min((d for d in own if d is not None), default=None) for g, own in ids.items()}
    return [(r[0], len(s), least[g] if s else r[0]) for r, s, g in zip(rows, sets, group, strict=True)]


def test_near_duplicates(docs, rows):
    got = near_duplicates(docs)
    assert found(got, "doc_id", "n_shingles", "component_id") == expected(near_brute(rows))
    # Blocks so small that components are cut by size class give the same.
    cut = near_duplicates(docs, block_shingles=300)
    assert found(cut, "doc_id", "n_shingles", "component_id") == expected(near_brute(rows))


def test_near_duplicates_of_a_large_group(spark):
    rows = []
    base = [f"w{k}" for k in range(120)]
    for k in range(150):
        own = list(base)
        own[k % 120] = f"x{k}"
        if k % 3 == 0:
            own[(k * 7 + 40) % 120] = f"y{k}"
        rows.append((k, " ".join(own), *[None] * 8))
    rows += [(1000 + k, " ".join(f"z{k}-{j}" if j > 60 else f"w{j}" for j in range(120)), *[None] * 8) for k in range(100)]
    got = near_duplicates(frame(spark, rows))
    assert found(got, "doc_id", "n_shingles", "component_id") == expected(near_brute(rows))


def test_components(spark):
    draw = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in draw.integers(0, 400, (260, 2)) if a != b] + [(k, k + 1) for k in range(1000, 1300)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    got = {r["node"]: r["label"] for r in connect(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got.keys() == parent.keys()
    pairs = {(got[x], root(x)) for x in parent}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


RULES = [
    Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"), Rule("block", "a.example.org", "/x/pre"), Rule("allow", "", "/free/"),
    Rule("block", "exact.example", ""), Rule("allow", "dup", "/"), Rule("block", "dup", "/"),
]
URLS = [
    None, "", "no scheme.net/", "http://net", "http://net/", "HTTP://A.NET/x?y#z", "https://m.example.net/en/25#top",
    "https://example.net/en", "https://notexample.net/en/", "ftp://x.example.com/de/a/b", "x://example.com/DE/",
    "http://b.org/fr/", "http://b.org/fr", "http://a.example.org/x/prefix", "http://a.example.org/x/pr",
    "http://else.where/free/", "http://exact.example", "http://exact.example?q=/x/", "://net/", "a://b://net/",
    "http://dup/", "http://q.dup/\nline", "http:///free/", "http://.net/",
]


@pytest.mark.parametrize("limit", [8_000_000, 20])
def test_url_rules(spark, limit):
    pages = spark.createDataFrame([(k, u, "own", "x") for k, u in enumerate(URLS)], "page_id long, url string, rule string, extra string")
    want = []
    for k, url in enumerate(URLS):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = lower(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [
            r for r in RULES
            if (host == r.host or host.endswith("." + r.host) or not r.host) and path.startswith(r.path)
        ]
        best = max(fits, key=lambda r: (len(r.name), len(r.host), r.verdict == "block"), default=None)
        want.append((k, host, path, best and best.name, best.verdict if best else "allow"))
    got = judge_urls(pages, RULES, max_broadcast_chars=limit)
    assert found(got, "page_id", "host", "path", "rule", "verdict") == expected(want)
    assert "extra" in got.columns


def test_quality_machine_separates_junk_it_never_saw(spark):
    rows, labels = [], []
    draw = np.random.default_rng(2)
    for k in range(400):
        body = ["".join(draw.choice(list("abcdefgh"), 5)) for _ in range(60)]
        bad = k % 4 == 0
        rows.append((k, " ".join(w + "###" if bad else w for w in body) + ".", 300))
        labels.append((k, int(not bad)))
    rows += [(900, None, None), (901, "", 0), (None, "abc def", 7)]
    labels += [(None, 1), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    machine = train_quality(docs, marks)
    got = {r["doc_id"]: r for r in score_quality(docs, machine).collect()}
    assert len(got) == len(rows)
    for k, mark in labels[:400]:
        assert got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0)
        if got[k]["held_out"]:
            assert got[k]["predicted"] == mark and got[k]["predicted"] == int(got[k]["score"] >= 0.3)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    # The labels of the held-out fold change nothing.
    flipped = [(k, 1 - m) if k is not None and m is not None and zlib.crc32(str(k).encode()) % 5 == 0 else (k, m) for k, m in labels]
    other = train_quality(docs, spark.createDataFrame(flipped, "doc_id long, quality int"))
    again = {r["doc_id"]: r["score"] for r in score_quality(docs, other).collect()}
    assert again == {k: r["score"] for k, r in got.items()}


def test_factorisation_machine_margin_is_the_pairwise_sum():
    from tideline.llm.factorization import SIZE, Inputs, Machine

    draw = np.random.default_rng(6)
    m = Machine(0.3, draw.normal(size=SIZE).astype(np.float32), draw.normal(size=(SIZE, 4)).astype(np.float32))
    index, value = draw.choice(SIZE, 12, replace=False), draw.normal(size=12).astype(np.float32)
    got = m.margin(Inputs(index, value, np.array([0, 5, 12])))
    for k, (lo, hi) in enumerate([(0, 5), (5, 12)]):
        want = 0.3 + sum(m.weights[index[i]] * value[i] for i in range(lo, hi))
        want += sum(m.vectors[index[i]] @ m.vectors[index[j]] * value[i] * value[j] for i in range(lo, hi) for j in range(lo, i))
        assert got[k] == pytest.approx(want, rel=1e-4)


def test_empty_tables(spark, empty):
    assert remove_repeated_windows(empty).count() == 0
    assert remove_repeated_bytes(empty).count() == 0
    assert clean_documents(empty).count() == 0
    assert mix_sources(empty).count() == 0
    assert byte_shards(empty).count() == 0
    nothing = spark.createDataFrame([], "item_id string, text string")
    assert find_contamination(empty, nothing).count() == 0
    assert token_digests(empty, BPE).count() == 0
    assert near_duplicates(empty).count() == 0
    marks = spark.createDataFrame([], "doc_id long, quality int")
    assert train_quality(empty, marks) is None
    assert score_quality(empty, None).count() == 0
    assert judge_urls(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0


def test_no_benchmark_and_no_labels(spark, docs, rows):
    nothing = spark.createDataFrame([], "item_id string, text string")
    clean = find_contamination(docs, nothing)
    assert clean.count() == len(rows) and clean.where("contaminated").isEmpty()
    counts = found(clean, "doc_id", "n_words")
    token = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    assert counts == expected((r[0], len(token.findall(lower(r[1])))) for r in rows)
    marks = spark.createDataFrame([], "doc_id long, quality int")
    scored = score_quality(docs, train_quality(docs, marks))
    assert scored.count() == len(rows) and scored.where("score <> 0.5").isEmpty()


def test_hash_of_kept_text_is_of_utf8(spark):
    got = remove_repeated_windows(spark.createDataFrame([(1, "é  ß\u3000x")], "doc_id long, text string")).first()
    assert got["kept_text"] == " ".join(WORD.findall("é  ß\u3000x"))
    assert hashlib.sha256(got["kept_text"].encode()).hexdigest()
