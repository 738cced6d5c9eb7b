"""Phrase collocations: exact scores of frequent word n-grams, found by Misra-Gries summaries.

1. Packs. Texts are folded and laid end to end, a few megabytes a language, in
   the shared folder. Phrases never cross a mark or a line end, so texts are
   parted by line ends and a text longer than a pack is cut at one of its own
   marks.
2. First pass. Every n-gram of 1 to 4 words of a pack gets a key; keys are
   dealt to hash partitions, and a pack sends each partition its distinct keys
   with counts, so that a phrase that fills a third of the corpus is one key a
   pack. A partition merges what its packs sent into one Misra-Gries summary
   whose capacity exceeds its mass divided by the threshold: no n-gram as
   frequent as the threshold is lost. What survives goes back to the packs, a
   bit for each key they sent.
3. Second pass. Packs count exactly the n-grams whose key survived, by their
   words and not by keys, and send each partition its phrases as one row. A
   partition sums the counts by phrase, so what becomes a row of its own is
   frequent over all packs. Keys that collide only let a rare n-gram into this
   pass, where its count ends it.
4. Scores. Every part of a frequent phrase is frequent itself, so the counts
   hold all that the scores need: left and right parts are joined by phrase,
   and products are decimals.

Partitions grow with the corpus, so a summary's memory does not. Only the first
``keep`` phrases of each language are ranked together, after each of
``spread`` parts of a language has kept its own first.

Defined results: null text has no words; null ``lang`` is ``und``; a language
without candidates has no rows. Repeated rows count again. Pieces are parted by
``[.,;:!?]`` and by 0x0A to 0x0D, words by blanks and tabs; A-Z are folded.
Texts of any length count whole; a run of text without any mark is held in one
task. Only text and lang are read, so other columns may have any name; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.misra_gries import Summary
from tideline.llm.tables import text_of
from tideline.llm.words import Hasher, find_words, lower_ascii, mix, run_starts, text_bytes
from tideline.session import materialize

LONGEST = 4
UNKNOWN = "und"
_MARKS = b".,;:!?\n\x0b\x0c\r"
_CODEC = "zstd"
_SEED = 97
#: Packs' worth of text that a task may hold, over all languages.
_WAITING = 6


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, np.bool_)
    table[list(chars)] = True
    return table


def _cuts(body: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """The text in parts of about ``limit`` bytes, each ended by a mark."""
    if len(body) <= limit:
        yield body
        return
    marks = np.flatnonzero(_class(_MARKS)[body])
    lo = 0
    while len(body) - lo > limit:
        k = int(np.searchsorted(marks, lo + limit))
        if k == len(marks):
            break
        yield body[lo : marks[k] + 1]
        lo = int(marks[k]) + 1
    yield body[lo:]


def _pack(limit: int):
    """Folded texts of one language as one row, of about ``limit`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        waiting: dict[str, list[bytes]] = {}
        held: dict[str, int] = {}

        def flush(lang: str) -> pa.RecordBatch:
            nonlocal number
            body = b"\n".join(waiting.pop(lang))
            del held[lang]
            number += 1
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number - 1], pa.int64()),
                    pa.array([lang]),
                    pa.array([len(_Words(np.frombuffer(body, np.uint8)).start)], pa.int64()),
                    pa.array([len(body)], pa.int64()),
                    pa.array([pa.compress(body, codec=_CODEC, asbytes=True)], pa.binary()),
                ],
                names=["pack", "lang", "n_words", "n_bytes", "body"],
            )

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            data, offsets = text_bytes(batch.column("text"))
            for k in np.flatnonzero(np.diff(offsets)).tolist():
                lang = langs[k]
                for part in _cuts(lower_ascii(data[offsets[k] : offsets[k + 1]]), limit):
                    waiting.setdefault(lang, []).append(part.tobytes())
                    held[lang] = held.get(lang, 0) + len(part)
                    if held[lang] >= limit:
                        yield flush(lang)
                    elif sum(held.values()) >= _WAITING * limit:
                        # Many languages: the fullest pack goes out before it is full.
                        yield flush(max(held, key=held.get))
        for lang in sorted(held):
            yield flush(lang)

    return run


_PACKED = "pack long, lang string, n_words long, n_bytes long, body binary"


class _Words:
    """Words of a pack, and which n-grams lie within a piece."""

    def __init__(self, body: np.ndarray):
        self.body = body
        inside = ~_class(_MARKS + b" \t")
        words = find_words(body, np.array([0, len(body)]), inside)
        self.start, self.end = words.start, words.end
        self.piece = np.cumsum(_class(_MARKS)[body], dtype=np.int64)[self.start] if len(body) else self.start

    def places(self, size: int) -> np.ndarray:
        """First words of the n-grams of that many words."""
        n = len(self.start) - size + 1
        return np.flatnonzero(self.piece[size - 1 :] == self.piece[: max(n, 0)]) if n > 0 else np.zeros(0, np.int64)


def _body(packs: pa.RecordBatch | pa.Table, k: int) -> np.ndarray:
    n = packs.column("n_bytes")[k].as_py()
    if not n:
        return np.zeros(0, np.uint8)
    return np.frombuffer(pa.decompress(packs.column("body")[k].as_buffer(), decompressed_size=n, codec=_CODEC), np.uint8)


class _Keys:
    """Partition and 32-bit key of every n-gram of a pack."""

    def __init__(self, lang: str, words: _Words, longest: int, parts: int, hasher: Hasher):
        name = np.frombuffer(lang.encode(), np.uint8)
        salt = hasher.strings(name, np.array([0]), np.array([len(name)]))
        hashes = hasher.strings(words.body, words.start, words.end)
        self.places = [words.places(n) for n in range(1, longest + 1)]
        whole = [mix(hasher.windows(hashes, n + 1)[at] ^ salt) for n, at in enumerate(self.places)]
        value = np.concatenate(whole)
        # The upper half deals, the lower half is the key.
        part = (value >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        self.value = part << np.uint64(32) | value & np.uint64(0xFFFFFFFF)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Ascending distinct partition-and-key numbers, and how often each occurs."""
        ordered = np.sort(self.value)
        first = run_starts(ordered)
        return ordered[first], np.diff(np.append(first, len(ordered)))


def _by_part(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The partitions that occur, and where their keys begin and end."""
    part = (value >> np.uint64(32)).astype(np.int64)
    first = run_starts(part)
    return part[first], np.append(first, len(part))


def _planes(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys as steps, byte plane by byte plane, then the counts; compressed."""
    steps = np.diff(keys, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T
    raw = np.ascontiguousarray(steps).tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes()
    return pa.compress(raw, codec=_CODEC, asbytes=True)


def _unplanes(raw: pa.Buffer, n: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(pa.decompress(raw, decompressed_size=5 * n, codec=_CODEC), np.uint8)
    steps = np.ascontiguousarray(data[: 4 * n].reshape(4, n).T).view("<u4").ravel()
    return np.cumsum(steps, dtype=np.uint32), data[4 * n :].astype(np.int64)


def _send(longest: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(_SEED)
        for batch in batches:
            for k in range(batch.num_rows):
                words = _Words(_body(batch, k))
                value, count = _Keys(batch.column("lang")[k].as_py(), words, longest, parts, hasher).distinct()
                part, edge = _by_part(value)
                spans = [slice(a, b) for a, b in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part, pa.int64()),
                        pa.array(np.full(len(part), batch.column("pack")[k].as_py(), np.int64)),
                        pa.array(np.diff(edge), pa.int64()),
                        pa.array([int(count[s].sum()) for s in spans], pa.int64()),
                        pa.array([_planes(value[s].astype(np.uint32), count[s]) for s in spans], pa.binary()),
                    ],
                    names=["part", "pack", "n_keys", "mass", "keys"],
                )

    return run


def _summarise(threshold: int):
    """Merge what a partition was sent; for each row the keys that may be frequent.

    Counts above 255 travel as 255: with a threshold below that they are
    frequent either way, and a smaller mass only lowers what is lost.
    """

    def run(table: pa.Table) -> pa.Table:
        sizes = table.column("n_keys").to_pylist()
        mass = sum(table.column("mass").to_pylist())
        summary = Summary(mass // threshold + 1)
        for k, n in enumerate(sizes):
            summary.add(*_unplanes(table.column("keys")[k].as_buffer(), n))
        alive = summary.survivors(threshold)
        bits = []
        for k, n in enumerate(sizes):
            keys, _ = _unplanes(table.column("keys")[k].as_buffer(), n)
            at = np.minimum(np.searchsorted(alive, keys), max(len(alive) - 1, 0))
            bits.append(np.packbits(alive[at] == keys if len(alive) else np.zeros(n, np.bool_)).tobytes())
        return pa.table({"pack": table.column("pack"), "part": table.column("part"), "alive": pa.array(bits, pa.binary())})

    return run


def _count(longest: int, parts: int):
    """Exact counts of the n-grams of a pack whose key survived, by their words: a row for each partition."""

    def run(packs: pa.Table, answers: pa.Table) -> pa.Table:
        hasher = Hasher(_SEED)
        by_part = dict(zip(answers.column("part").to_pylist(), answers.column("alive").to_pylist(), strict=True))
        out: list[pa.Table] = []
        for k in range(packs.num_rows):
            lang = packs.column("lang")[k].as_py()
            words = _Words(_body(packs, k))
            keys = _Keys(lang, words, longest, parts, hasher)
            value, _ = keys.distinct()
            part, edge = _by_part(value)
            alive = np.zeros(len(value), np.bool_)
            for p, a, b in zip(part.tolist(), edge[:-1], edge[1:], strict=True):
                alive[a:b] = np.unpackbits(np.frombuffer(by_part[p], np.uint8), count=b - a)
            chosen = value[alive]
            at = np.minimum(np.searchsorted(chosen, keys.value), max(len(chosen) - 1, 0))
            mine = chosen[at] == keys.value if len(chosen) else np.zeros(len(keys.value), np.bool_)
            cuts = np.cumsum([len(x) for x in keys.places])[:-1]
            mine, dealt = np.split(mine, cuts), np.split((keys.value >> np.uint64(32)).astype(np.int64), cuts)
            out.append(_phrases(lang, words, [(p[m], d[m]) for p, m, d in zip(keys.places, mine, dealt, strict=True)]))
        return pa.concat_tables(out) if out else _COUNTED.empty_table()

    return run


_COUNTED = pa.schema(
    [("part", pa.int64()), ("lang", pa.string()), ("n_phrases", pa.int64()), ("n_bytes", pa.int64()), ("phrases", pa.binary())]
)


def _word_ids(words: _Words) -> tuple[np.ndarray, pa.Array]:
    """Each word's place in a dictionary of the words, and the dictionary."""
    if not len(words.start):
        return np.zeros(0, np.int64), pa.array([], pa.binary())
    # Words and what lies between them, turn by turn.
    edges = np.column_stack([words.start, words.end]).ravel().astype(np.int32)
    raw = [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(words.body))]
    coded = pa.Array.from_buffers(pa.binary(), len(edges) - 1, raw).dictionary_encode()
    return coded.indices.to_numpy()[::2].astype(np.int64), coded.dictionary


def _phrases(lang: str, words: _Words, places: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """Count n-grams at the given places, each with its partition; n-grams are equal if their words are."""
    ids, names = _word_ids(words)
    phrases, counts, parts = [], [], []
    for size, (at, part) in enumerate(places, 1):
        # The number of an n-gram: of its first words, then of that and the next word.
        code = ids[at]
        for step in range(1, size):
            code = np.unique(code, return_inverse=True)[1] * len(names) + ids[at + step]
        _, sample, n = np.unique(code, return_index=True, return_counts=True)
        first = at[sample]
        columns = [names.take(pa.array(ids[first + step])) for step in range(size)]
        phrases.append(pc.binary_join_element_wise(*columns, b" ") if size > 1 else columns[0])
        counts.append(n)
        parts.append(part[sample])
    part, n = np.concatenate(parts), np.concatenate(counts)
    order = np.argsort(part, kind="stable")
    text = pa.concat_arrays(phrases).take(pa.array(order))
    part, n = part[order], n[order]
    first = run_starts(part)
    edge = np.append(first, len(part))
    raw = [_pressed(text.slice(a, b - a), n[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
    return pa.table(
        [
            pa.array(part[first], pa.int64()), pa.array([lang] * len(first), pa.string()), pa.array(np.diff(edge), pa.int64()),
            pa.array([size for size, _ in raw], pa.int64()), pa.array([body for _, body in raw], pa.binary()),
        ],
        schema=_COUNTED,
    )


def _pressed(text: pa.Array, counts: np.ndarray) -> tuple[int, bytes]:
    """Counts, lengths and letters of phrases: their size, and all of them compressed."""
    letters, offsets = text_bytes(text.cast(pa.large_binary()))
    raw = counts.astype("<i8").tobytes() + np.diff(offsets).astype("<i8").tobytes() + letters.tobytes()
    return len(raw), pa.compress(raw, codec=_CODEC, asbytes=True)


def _unpressed(raw: pa.Buffer, n: int, n_bytes: int) -> tuple[pa.Array, np.ndarray]:
    """Phrases and their counts."""
    data = pa.decompress(raw, decompressed_size=n_bytes, codec=_CODEC)
    counts, sizes = np.frombuffer(data, "<i8", 2 * n).reshape(2, n)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), data.slice(16 * n)]), counts


#: Phrases that a partition holds unsummed, beside as many as it has summed up.
_UNSUMMED = 1 << 19


def _add_up(threshold: int):
    """Sum the counts of a partition's phrases over all packs; the frequent ones."""

    def run(table: pa.Table) -> pa.Table:
        langs: dict[str, int] = {}
        summed = pa.table({"lang": pa.array([], pa.int32()), "phrase": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
        waiting, held = [summed], 0

        def settle() -> pa.Table:
            both = pa.concat_tables(waiting).group_by(["lang", "phrase"], use_threads=False).aggregate([("n", "sum")])
            return both.rename_columns({"n_sum": "n"}).select(["lang", "phrase", "n"])

        for k in range(table.num_rows):
            lang = langs.setdefault(table.column("lang")[k].as_py(), len(langs))
            n = table.column("n_phrases")[k].as_py()
            phrase, counts = _unpressed(table.column("phrases")[k].as_buffer(), n, table.column("n_bytes")[k].as_py())
            waiting.append(pa.table({"lang": pa.array(np.full(n, lang, np.int32)), "phrase": phrase, "n": pa.array(counts)}))
            held += n
            if held > max(summed.num_rows, _UNSUMMED):
                summed = settle()
                waiting, held = [summed], 0
        summed = settle()
        frequent = summed.filter(pc.greater_equal(summed.column("n"), threshold))
        phrase = frequent.column("phrase").cast(pa.string())
        size = pc.add(pc.count_substring(phrase, " "), 1).cast(pa.int32())
        names = pa.array(list(langs), pa.string())
        return pa.table({"lang": names.take(frequent.column("lang")), "phrase": phrase, "size": size, "n": frequent.column("n")})

    return run


def frequent_phrases(
    docs: DataFrame, *, threshold: int = 30, longest: int = LONGEST, pack_bytes: int = 4 << 20, part_mass: int = 30_000_000
) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, size and n of every n-gram found ``threshold`` times or more; lang and n of all words."""
    if not 1 < threshold <= 255:
        raise ValueError("threshold must be from 2 to 255")
    spark = docs.sparkSession
    packs = materialize(
        docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), text_of("text").alias("text"))
        .mapInArrow(_pack(pack_bytes), _PACKED),
        "phrase-packs",
    )
    totals = packs.groupBy("lang").agg(F.sum("n_words").alias("n"))
    words = totals.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), longest * words // part_mass + 1)
    answers = materialize(
        packs.mapInArrow(_send(longest, parts), "part long, pack long, n_keys long, mass long, keys binary")
        .groupBy("part").applyInArrow(_summarise(threshold), "pack long, part long, alive binary"),
        "phrase-answers",
    )
    frequent = (
        packs.groupBy("pack").cogroup(answers.groupBy("pack"))
        .applyInArrow(_count(longest, parts), "part long, lang string, n_phrases long, n_bytes long, phrases binary")
        .groupBy("part").applyInArrow(_add_up(threshold), "lang string, phrase string, size int, n long")
    )
    return materialize(frequent, "frequent-phrases"), totals


def _cut_scores(frequent: DataFrame) -> DataFrame:
    """Each candidate with its lowest-scoring cut: lang, phrase, size, a, l, r, score."""
    candidates = frequent.where("size >= 2").withColumnRenamed("n", "a")
    words = F.split("phrase", " ")
    cuts = candidates.select(
        "lang", "phrase", "size", "a",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.col("size") - 1),
                lambda k: F.struct(
                    k.alias("k"),
                    F.array_join(F.slice(words, 1, k), " ").alias("head"),
                    F.array_join(F.slice(words, k + 1, F.col("size") - k), " ").alias("tail"),
                ),
            )
        ).alias("c"),
    ).select("lang", "phrase", "size", "a", "c.*")
    known = frequent.select(F.col("lang").alias("lang_"), F.col("phrase").alias("part"), F.col("n"))
    left = known.select(F.col("lang_"), F.col("part").alias("head_"), F.col("n").alias("l"))
    right = known.select(F.col("lang_"), F.col("part").alias("tail_"), F.col("n").alias("r"))
    joined = (
        cuts.join(left, (cuts["lang"] == left["lang_"]) & (cuts["head"] == left["head_"])).drop("lang_", "head_")
        .join(right, (cuts["lang"] == right["lang_"]) & (cuts["tail"] == right["tail_"])).drop("lang_", "tail_")
    )
    score = F.expr("cast(cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0)) div (l + r) as bigint)")
    scored = joined.withColumn("score", score)
    return (
        scored.groupBy("lang", "phrase", "size", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")
    )


def _absorbed(frequent: DataFrame) -> DataFrame:
    """lang, phrase and the largest count of a longer candidate that holds its words."""
    words = F.split("phrase", " ")
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("size") - 1),
            lambda n: F.transform(
                F.sequence(F.lit(1), F.col("size") - n + 1), lambda at: F.array_join(F.slice(words, at, n), " ")
            ),
        )
    )
    return (
        frequent.where("size >= 3")
        .select("lang", "n", F.explode(inner).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    )


def mine_collocations(
    docs: DataFrame, *, keep: int = 2000, absorb_percent: int = 80, spread: int = 64, **mining: int
) -> DataFrame:
    """The first ``keep`` phrases of every language: lang, rank, phrase, a, l, r, n, score.

    A phrase that a longer candidate holds is dropped when that one is at least
    ``absorb_percent`` % as frequent.
    """
    frequent, totals = frequent_phrases(docs, **mining)
    left = _cut_scores(frequent).join(_absorbed(frequent), ["lang", "phrase"], "left").where(
        F.col("longer").isNull()
        | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * absorb_percent)
    )
    first = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    part = F.pmod(F.xxhash64("phrase"), F.lit(spread))
    own = Window.partitionBy("lang", "part").orderBy(*first)
    some = left.withColumn("part", part).withColumn("own", F.row_number().over(own)).where(F.col("own") <= keep)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*first)).cast("long"))
    return ranked.where(F.col("rank") <= keep).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
