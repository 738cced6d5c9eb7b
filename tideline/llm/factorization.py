"""Quality of documents by a factorisation machine.

Inputs are hashed words, statistics of a text's structure, and the n_chars
column as metadata; ids, languages, sources and labels are never inputs. All
pairs of inputs interact through vectors of ``factors`` numbers, and as

    sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

a score costs one pass over a document's inputs. The machine is fitted on the
driver from at most ``max_rows`` labelled documents outside the held-out fold,
drawn by a hash of their id (the one bounded sample here); scoring reads every
whole text inside Spark tasks and shuffles nothing.

Defined results: null text counts as empty; every document has a score, empty
ones too; null n_chars is an input of its own. Labels with a null id or label
teach nothing; of several labels of one id the least counts. Without labels
every score is 0.5. Repeated rows get equal scores. A text of any length is
scored whole. An empty table gives no rows. Columns called like a result are
replaced, all others are passed on whatever their names are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.tables import quoted, text_of
from tideline.llm.words import Hasher, find_words, packs, text_bytes, visible_bytes

RESULTS = ("held_out", "score", "predicted")
WORD_BITS = 14
_BINS = 16
_STATS = 16
SIZE = (1 << WORD_BITS) + _STATS * _BINS + _STATS
_SEED = 11


def _mask(chars: bytes) -> np.ndarray:
    table = np.zeros(256, np.bool_)
    table[list(chars)] = True
    return table


_MARKS = {
    "symbol": _mask(b"#*$%&<>|~^=+_{}[]\\@"),
    "upper": _mask(bytes(range(0x41, 0x5B))),
    "digit": _mask(b"0123456789"),
    "stop": _mask(b".,;:?"),
    "shout": _mask(b"!"),
    "bar": _mask(b"|"),
    "line": _mask(b"\n"),
    "wide": _mask(bytes(range(0x80, 0x100))),
}


@dataclass
class Inputs:
    """Sparse rows: the inputs of row k are at first[k]:first[k + 1]."""

    index: np.ndarray
    value: np.ndarray
    first: np.ndarray


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def document_inputs(data: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray, hasher: Hasher) -> Inputs:
    """Inputs of some documents; n_chars is NaN where it is null."""
    docs = len(offsets) - 1
    words = find_words(data, offsets, visible_bytes())
    n = words.counts
    hashes = hasher.words(data, words)
    owner = words.document()
    size = np.diff(offsets)

    def share(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[at[1:]] - total[at[:-1]]

    marks = {name: share(table[data], offsets) for name, table in _MARKS.items()}
    order = np.lexsort((hashes, owner))
    same = (hashes[order][1:] == hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    distinct = n - np.bincount(owner[order][1:][same], minlength=docs)
    next_same = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    repeats = np.bincount(owner[1:][next_same], minlength=docs)
    last = data[words.end - 1] if len(words.end) else data[:0]
    odd_end = np.bincount(owner, weights=(_MARKS["symbol"] | _MARKS["shout"])[last], minlength=docs)
    letters = np.bincount(owner, weights=(words.end - words.start), minlength=docs)
    line_ends = np.flatnonzero(data == 0x0A)
    # What stands before a text's first byte is another text.
    closed = line_ends[~np.isin(line_ends, offsets)]
    closed = closed[np.isin(data[closed - 1], list(b".!?:;\"')"))]
    open_lines = marks["line"] - (np.searchsorted(closed, offsets[1:]) - np.searchsorted(closed, offsets[:-1]))
    known = ~np.isnan(n_chars)
    stats = np.stack(
        [
            _ratio(marks["symbol"], size), _ratio(marks["upper"], size), _ratio(marks["digit"], size),
            _ratio(marks["stop"], n), _ratio(marks["shout"], n), _ratio(marks["bar"], n),
            _ratio(marks["line"], n), _ratio(marks["wide"], size),
            1 - _ratio(distinct, n), _ratio(repeats, n), _ratio(odd_end, n),
            _ratio(letters, n) / 32, np.log1p(n) / 16, np.log1p(size) / 24,
            _ratio(open_lines, marks["line"] + 1),
            np.where(known, np.log1p(np.maximum(np.nan_to_num(n_chars), 0)) / 24, 0),
        ]
    )
    stats = np.clip(stats, 0, 1)
    # Each statistic enters as it is and as one of 16 steps, finer towards zero.
    step = np.minimum(np.log2(stats * 1023 + 1) * 1.6, _BINS - 1).astype(np.int64)
    step[-1, ~known] = _BINS - 1
    base = 1 << WORD_BITS
    number = np.arange(_STATS)[:, None]
    # Words: hashed counts, damped, of length 1 together.
    cell = owner * (1 << WORD_BITS) + (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    cell, count = np.unique(cell, return_counts=True)
    word_owner, word_index = cell >> WORD_BITS, cell & (1 << WORD_BITS) - 1
    weight = np.log1p(count)
    norm = np.sqrt(np.bincount(word_owner, weights=weight**2, minlength=docs))
    index = np.concatenate([word_index, (base + number * _BINS + step).ravel(), np.broadcast_to(base + _STATS * _BINS + number, stats.shape).ravel()])
    value = np.concatenate([weight / norm[word_owner], np.full(stats.size, 0.5), stats.ravel()])
    of = np.concatenate([word_owner, np.tile(np.arange(docs), _STATS), np.tile(np.arange(docs), _STATS)])
    order = np.argsort(of, kind="stable")
    return Inputs(
        index[order].astype(np.int32), value[order].astype(np.float32), np.searchsorted(of[order], np.arange(docs + 1))
    )


@dataclass
class Machine:
    """bias + linear weights + pairwise interactions of rank ``vectors.shape[1]``."""

    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def margin(self, x: Inputs) -> np.ndarray:
        if len(x.first) < 2:
            return np.zeros(0)
        linear = np.add.reduceat(self.weights[x.index] * x.value, x.first[:-1])
        scaled = self.vectors[x.index] * x.value[:, None]
        sums = np.add.reduceat(scaled, x.first[:-1])
        squares = np.add.reduceat(scaled * scaled, x.first[:-1])
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(1)

    def score(self, x: Inputs) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def _rows_of(x: Inputs, rows: np.ndarray) -> Inputs:
    size = x.first[rows + 1] - x.first[rows]
    end = np.cumsum(size)
    at = np.repeat(x.first[rows] - (end - size), size) + np.arange(end[-1])
    return Inputs(x.index[at], x.value[at], np.concatenate([[0], end]))


def fit(
    x: Inputs, y: np.ndarray, *, factors: int = 8, epochs: int = 8, batch: int = 128,
    rate: float = 0.1, decay: float = 1e-4, seed: int = 5,
) -> Machine:
    """Logistic loss by AdaGrad over seeded minibatches; both labels weigh the same in all."""
    draw = np.random.default_rng(seed)
    weight = np.where(y > 0, len(y) / max(2 * (y > 0).sum(), 1), len(y) / max(2 * (y <= 0).sum(), 1))
    m = Machine(
        0.0,
        np.zeros(SIZE, np.float32),
        draw.normal(0, 0.02, (SIZE, factors)).astype(np.float32),
    )
    seen_w, seen_v = np.full(SIZE, 1e-2, np.float32), np.full((SIZE, factors), 1e-2, np.float32)
    for _ in range(epochs):
        order = draw.permutation(len(y))
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            part = _rows_of(x, rows)
            error = ((m.score(part) - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
            size = np.diff(part.first)
            scaled = m.vectors[part.index] * part.value[:, None]
            sums = np.add.reduceat(scaled, part.first[:-1])
            each = np.repeat(error, size) * part.value
            used, place = np.unique(part.index, return_inverse=True)
            grad_w = np.bincount(place, weights=each, minlength=len(used)) + decay * m.weights[used]
            inner = each[:, None] * (np.repeat(sums, size, axis=0) - scaled)
            order_in = np.argsort(place, kind="stable")
            grad_v = np.add.reduceat(inner[order_in], np.searchsorted(place[order_in], np.arange(len(used))))
            grad_v += decay * m.vectors[used]
            seen_w[used] += grad_w**2
            seen_v[used] += grad_v**2
            m.weights[used] -= rate * grad_w / np.sqrt(seen_w[used])
            m.vectors[used] -= rate / 4 * grad_v / np.sqrt(seen_v[used])
            m.bias -= rate * float(error.sum())
    return m


def _batches(batch: pa.RecordBatch, hasher: Hasher) -> Iterator[tuple[int, int, Inputs]]:
    data, offsets = text_bytes(batch.column("text"))
    chars = batch.column("n_chars").cast(pa.float64()).to_numpy(zero_copy_only=False)
    for lo, hi in packs(offsets):
        yield lo, hi, document_inputs(
            data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], chars[lo:hi], hasher
        )


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher(_SEED)
    for batch in batches:
        for lo, hi, x in _batches(batch, hasher):
            edge = pa.array(x.first.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("label").slice(lo, hi - lo),
                    pa.ListArray.from_arrays(edge, pa.array(x.index)),
                    pa.ListArray.from_arrays(edge, pa.array(x.value)),
                ],
                names=["label", "index", "value"],
            )


def _score(shared, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, machine = Hasher(_SEED), shared.value
        for batch in batches:
            score = np.full(batch.num_rows, 0.5)
            if machine is not None:
                for lo, hi, x in _batches(batch, hasher):
                    score[lo:hi] = machine.score(x)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(score)], names=[*columns, "score"]
            )

    return run


def _inputs_of(docs: DataFrame, *other: Column) -> DataFrame:
    chars = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select(*other, text_of("text").alias("text"), chars.alias("n_chars"))


def held_out(doc_id: Column) -> Column:
    """The fold that no score may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train_quality(
    docs: DataFrame, labels: DataFrame, *, max_rows: int = 12_000, label: str = "quality"
) -> Machine | None:
    """A machine fitted on at most ``max_rows`` labelled rows outside the held-out fold.

    Beyond the bound the ids with the least hashes are taken, and of a repeated
    id the row with the least text hash, so a rerun fits the same rows.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("__id")).agg(F.min(label).cast("double").alias("__target"))
    )
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    columns = [c for c in ("doc_id", "text", "n_chars") if c in docs.columns]
    labelled = docs.select(*columns).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    texts = F.min(F.struct(F.xxhash64(text_of("text")).alias("key"), *(c for c in columns if c != "doc_id")))
    one_each = labelled.groupBy("doc_id", "__target").agg(texts.alias("row")).select("__target", "row.*")
    # As arrays, not as Python rows: the bound on rows is then small in the driver too.
    rows = (
        _inputs_of(one_each, F.col("__target").alias("label"))
        .mapInArrow(_features, "label double, index array<int>, value array<float>")
        .toArrow()
        .combine_chunks()
    )
    if not rows.num_rows:
        return None
    index, value = (rows.column(c).combine_chunks() for c in ("index", "value"))
    size = index.value_lengths().to_numpy(zero_copy_only=False)
    x = Inputs(index.flatten().to_numpy(), value.flatten().to_numpy(), np.concatenate([[0], np.cumsum(size)]))
    label_of = rows.column("label").to_numpy()
    # Rows arrive in no fixed order; the fit must not depend on it.
    total = np.add.reduceat(x.index.astype(np.float64) * x.value, x.first[:-1])
    order = np.lexsort((label_of, size, total))
    return fit(_rows_of(x, order), label_of[order])


def score_quality(docs: DataFrame, machine: Machine | None, *, threshold: float = 0.3) -> DataFrame:
    """Every document with held_out, score and predicted."""
    # Columns travel under plain names, as Arrow functions don't take every name.
    keep = {f"__{i}": c for i, c in enumerate(docs.columns) if c not in (*RESULTS, "text", "n_chars")}
    own = [F.col(quoted(c)).alias(k) for k, c in keep.items()]
    passed = docs.select(*own).schema
    scored = _inputs_of(docs, *own).mapInArrow(
        _score(docs.sparkSession.sparkContext.broadcast(machine), list(keep)),
        T.StructType([*passed, T.StructField("score", T.DoubleType())]),
    )
    doc_id = next(k for k, c in keep.items() if c == "doc_id")
    return scored.select(
        *(F.col(k).alias(c) for k, c in keep.items()), held_out(F.col(doc_id)).alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )
