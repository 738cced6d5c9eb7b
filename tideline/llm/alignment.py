"""Alignment of two tokenizers' tokens over the same bytes.

Each text, with one blank before it, is encoded by a byte-level BPE (A) and a
sentencepiece model (B). Tokens are ranges of bytes. Where a token of A and a
token of B end together, they link, and the text is cut into groups.

1. Encoding. Both tokenizers encode each distinct unit once a worker
   (``units``): no token reaches across a unit's edges.
2. Merging. A pack's documents are merged in lockstep: one state vector holds
   for every document its place among A's and B's tokens. Each step compares
   the ends of all current tokens at once, emits a link and a cut where they
   agree, and advances the pointer that is behind, or both. Finished documents
   are taken out of the vector. A document longer than ``lane`` bytes runs as
   several entries of the vector, each of which has the tokens that end in its
   stretch, so one long document doesn't hold up a pack.
3. Counts. Links are counted by id pair, in the packs first. Of two tokens that
   end together the shorter is a suffix of the longer, so there are at most as
   many pairs as tokens have suffixes in the other vocabulary: some hundred
   thousand for the two vocabularies (``pair_bound``), whatever the corpus is.
   The table is collected and broadcast on the strength of that bound, which is
   checked.
4. A second pass over the links kept for each pack looks up their counts.

Defined results: null and empty texts, and texts whose tokens do not give back
the bytes, as the model may rewrite some characters, have no tokens and zeros
everywhere. Repeated rows and ids are documents of their own. Texts of any
length are merged whole. Only doc_id and text are read, so other columns may
have any name; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.tables import text_of
from tideline.llm.token_files import UnitEncoder, byte_alphabet
from tideline.llm.units import UnitCache, gather, worker_cache
from tideline.llm.words import packs, text_bytes
from tideline.session import materialize

LANE = 256
#: Bytes of text that are aligned at a time.
_PACK = 1 << 18
_CODEC = "zstd"
_SPACE = 0x20
_PIECE_SPACE = "▁"


@dataclass
class Tokens:
    """The bytes of every id of a vocabulary."""

    text: np.ndarray
    start: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, entries: list[bytes]) -> Tokens:
        size = np.array([len(e) for e in entries], np.int64)
        return cls(np.frombuffer(b"".join(entries), np.uint8), np.cumsum(size) - size, size)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        return self.text[gather(self.start[ids], self.size[ids])]

    def entries(self) -> list[bytes]:
        raw = self.text.tobytes()
        return [raw[a : a + n] for a, n in zip(self.start.tolist(), self.size.tolist(), strict=True)]


class ByteLevel:
    """A: byte-level BPE; strings of special tokens inside a text are plain text."""

    def __init__(self, path: str):
        self.encoder = UnitEncoder(path, added_as_text=True)
        vocabulary = self.encoder.tokenizer.get_vocab(with_added_tokens=True)
        back = {chr(c): b for b, c in byte_alphabet().items()}
        entries = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            entries[k] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.tokens = Tokens.of(entries)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = self.encoder(column)
        return np.delete(ids, np.cumsum(counts) - 1), counts - 1


class Pieces:
    """B: sentencepiece BPE, which writes a blank as a mark at the head of a piece.

    As no piece has that mark behind another character (checked), none reaches
    from a character into a blank that follows it, and texts can be encoded
    unit by unit, a unit being a run of blanks and what follows up to the next.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        if any(_PIECE_SPACE in name.lstrip(_PIECE_SPACE) for name in names):
            raise ValueError("a piece of the model reaches across a blank")
        self.tokens = Tokens.of(
            [
                bytes([int(name[3:5], 16)]) if self.model.is_byte(k) else name.replace(_PIECE_SPACE, " ").encode()
                for k, name in enumerate(names)
            ]
        )
        self.lead = len(self.model.encode("a"))
        self.cache = UnitCache(self._encode)

    def _encode(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # The model adds one blank itself, but none to an empty text.
        blank = [not u.strip(b" ") for u in units]
        texts = [("a" + u.decode()) if b else u[1:].decode() for u, b in zip(units, blank, strict=True)]
        coded = [ids[self.lead :] if b else ids for ids, b in zip(self.model.encode(texts, num_threads=1), blank, strict=True)]
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        return np.fromiter((i for ids in coded for i in ids), np.uint32, int(size.sum())), size

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that start with a blank, and their numbers."""
        opens = data == _SPACE
        opens[1:] &= data[:-1] != _SPACE
        opens[offsets[:-1]] = True
        first = np.flatnonzero(opens)
        ids, size = self.cache(data, first, np.append(first[1:], len(data)))
        before = np.concatenate([[0], np.cumsum(size)])
        return ids, np.diff(before[np.searchsorted(first, offsets)])


def _coders(a_path: str, b_path: str) -> tuple[ByteLevel, Pieces]:
    """The worker's tokenizers; what they have learnt serves its later tasks."""
    cache = worker_cache()
    key = ("alignment", a_path, b_path)
    if key not in cache:
        cache[key] = ByteLevel(a_path), Pieces(b_path)
    return cache[key]


def lockstep(a_end: np.ndarray, b_end: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of tokens that end together, in order; both ends ascend.

    The state vector has an entry for each stretch between neighbouring edges.
    """
    a, b = (np.searchsorted(end, edge[:-1], "right") for end in (a_end, b_end))
    a_stop, b_stop = (np.searchsorted(end, edge[1:], "right") for end in (a_end, b_end))
    links_a, links_b = [], []
    while True:
        live = np.flatnonzero((a < a_stop) & (b < b_stop))
        if len(live) < len(a):
            a, b, a_stop, b_stop = a[live], b[live], a_stop[live], b_stop[live]
        if not len(a):
            break
        gap = a_end[a] - b_end[b]
        same = gap == 0
        links_a.append(a[same])
        links_b.append(b[same])
        a = a + (gap <= 0)
        b = b + (gap >= 0)
    if not links_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    links_a, links_b = np.concatenate(links_a), np.concatenate(links_b)
    order = np.argsort(links_a, kind="stable")
    return links_a[order], links_b[order]


@dataclass
class Aligned:
    """Tokens and links of a pack's documents; first_* say where each document's begin."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_end: np.ndarray
    first_a: np.ndarray
    first_b: np.ndarray
    first_byte: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    first_link: np.ndarray

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents' groups as decimal text, and where each document's starts.

        A group's ids of A, ``|``, its ids of B, ``;``; ids are parted by commas.
        """
        n_a, n_b, links = len(self.a_ids), len(self.b_ids), len(self.link_a)
        # Each token's group is the first link at or after it.
        group_a = np.searchsorted(self.link_a, np.arange(n_a))
        group_b = np.searchsorted(self.link_b, np.arange(n_b))
        place_a = np.arange(n_a) + np.concatenate([[0], self.link_b + 1])[group_a]
        place_b = np.arange(n_b) + (self.link_a + 1)[group_b] if links else np.arange(n_b)
        ids = np.empty(n_a + n_b, np.int64)
        ids[place_a], ids[place_b] = self.a_ids, self.b_ids
        mark = np.full(n_a + n_b, ord(","), np.uint8)
        mark[place_a[self.link_a]] = ord("|")
        mark[place_b[self.link_b]] = ord(";")
        digits = _digits(int(ids.max(initial=0)) + 1)
        size = digits.size[ids]
        text = digits.spell(ids)
        end = np.cumsum(size)
        text[end - 1] = mark
        return text, np.concatenate([[0], end])[self.first_a + self.first_b]


def _digits(n: int) -> Tokens:
    """Decimal numbers below n, each with room for a mark behind it."""
    cache = worker_cache()
    known = cache.get("digits")
    if known is None or len(known.size) < n:
        cache["digits"] = known = Tokens.of([b"%d," % k for k in range(n)])
    return known


def _rebuilt(tokens: Tokens, ids: np.ndarray, counts: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents whose tokens' bytes are the document's."""
    size = np.concatenate([[0], np.cumsum(tokens.size[ids])])
    first = np.concatenate([[0], np.cumsum(counts)])
    good = np.diff(size[first]) == np.diff(offsets)
    rows = np.flatnonzero(good)
    n = np.diff(offsets)[rows]
    if len(rows):
        differ = tokens.spell(ids)[gather(size[first][rows], n)] != data[gather(offsets[rows], n)]
        good[rows] = ~np.logical_or.reduceat(differ, np.cumsum(n) - n)
    return good


def align(texts: pa.Array, a: ByteLevel, b: Pieces, lane: int = LANE) -> Aligned:
    """Align a pack of texts; null, empty and rewritten ones have no tokens."""
    spaced = pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts.fill_null(""), pa.scalar("", texts.type))
    if isinstance(spaced, pa.ChunkedArray):
        spaced = spaced.combine_chunks()
    data, offsets = text_bytes(spaced)
    a_ids, a_count = a(spaced)
    b_ids, b_count = b(data, offsets)
    size = np.diff(offsets)
    good = (size > 1) & _rebuilt(a.tokens, a_ids, a_count, data, offsets) & _rebuilt(b.tokens, b_ids, b_count, data, offsets)
    a_ids, b_ids = a_ids[np.repeat(good, a_count)], b_ids[np.repeat(good, b_count)]
    a_count, b_count, size = a_count * good, b_count * good, size * good
    first_a, first_b, first_byte = (np.concatenate([[0], np.cumsum(x)]) for x in (a_count, b_count, size))
    # All documents in a row: the ends of one document's tokens go on from the last one's.
    a_end, b_end = np.cumsum(a.tokens.size[a_ids]), np.cumsum(b.tokens.size[b_ids])
    stretches = -(-size // lane)
    begin = np.repeat(first_byte[:-1], stretches) + lane * gather(np.zeros(len(size), np.int64), stretches)
    link_a, link_b = lockstep(a_end, b_end, np.append(begin, first_byte[-1]))
    first_link = np.searchsorted(link_a, first_a)
    return Aligned(a_ids, b_ids, a_end, first_a, first_b, first_byte, link_a, link_b, first_link)


def _packed(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str):
    coders = _coders(a_path, b_path)
    for batch in batches:
        texts = batch.column("text")
        for lo, hi in packs(text_bytes(texts)[1], _PACK):
            yield batch.column("doc_id").slice(lo, hi - lo), align(texts.slice(lo, hi - lo), *coders), coders


def _lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(first, pa.int64()), pa.array(values, kind)).cast(pa.list_(kind))


def align_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, ids of both tokenizers, and of each link the byte where it ends and its two places.

    Bytes count in the text with a blank before it; links end the groups.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, _ in _packed(batches, a_path, b_path):
            links = np.diff(x.first_link)
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    _lists(x.a_ids.astype(np.int32), x.first_a, pa.int32()),
                    _lists(x.b_ids.astype(np.int32), x.first_b, pa.int32()),
                    _lists(x.a_end[x.link_a] - np.repeat(x.first_byte[:-1], links), x.first_link, pa.int64()),
                    _lists(x.link_a - np.repeat(x.first_a[:-1], links), x.first_link, pa.int64()),
                    _lists(x.link_b - np.repeat(x.first_b[:-1], links), x.first_link, pa.int64()),
                ],
                names=["doc_id", "a_ids", "b_ids", "ends", "a_places", "b_places"],
            )

    return docs.select("doc_id", text_of("text").alias("text")).mapInArrow(
        run, f"doc_id {kind}, a_ids array<int>, b_ids array<int>, ends array<long>, a_places array<long>, b_places array<long>"
    )


def _links(a_path: str, b_path: str, doc_type: pa.DataType):
    """A pack's documents with their counts and digests, and its links as id pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, (_, b) in _packed(batches, a_path, b_path):
            text, first = x.groups()
            view = memoryview(text)
            digests = [
                hashlib.sha256(view[s : e - 1]).hexdigest() if e > s else ""
                for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)
            ]
            pair = x.a_ids[x.link_a].astype(np.uint64) * np.uint64(len(b.tokens.size)) + x.b_ids[x.link_b]
            narrow = np.array(int(pair.max(initial=0)) < 1 << 32)
            raw = pair.astype(np.uint32 if narrow else np.uint64).tobytes()
            one = lambda values, kind: pa.array([values], pa.list_(kind))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids.to_pylist()], pa.list_(doc_type)),
                    one(np.diff(x.first_a), pa.int64()),
                    one(np.diff(x.first_b), pa.int64()),
                    one(np.diff(x.first_link), pa.int64()),
                    one(digests, pa.string()),
                    pa.array([len(raw)], pa.int64()),
                    pa.array([pa.compress(raw, codec=_CODEC, asbytes=True)], pa.binary()),
                ],
                names=["doc_ids", "n_a", "n_b", "n_links", "digests", "n_bytes", "pairs"],
            )

    return run


def _pairs(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for k in range(batch.num_rows):
        links = batch.column("links")[k].as_py()
        n = batch.column("n_bytes")[k].as_py()
        if not n:
            yield k, np.zeros(0, np.uint64)
            continue
        raw = pa.decompress(batch.column("pairs")[k].as_buffer(), decompressed_size=n, codec=_CODEC)
        yield k, np.frombuffer(raw, np.uint32 if n == 4 * links else np.uint64).astype(np.uint64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each id pair over a partition's packs."""
    known, total = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        for _, pair in _pairs(batch):
            pair, n = np.unique(pair, return_counts=True)
            merged, index = np.unique(np.concatenate([known, pair]), return_inverse=True)
            total = np.bincount(index, weights=np.concatenate([total, n]), minlength=len(merged)).astype(np.int64)
            known = merged
    yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(total)], names=["pair", "n"])


def pair_bound(a: Tokens, b: Tokens) -> int:
    """The most id pairs that can end together: one of the two is a suffix of the other."""

    def suffixes(ones: list[bytes], others: list[bytes]) -> int:
        number: dict[bytes, int] = {}
        for entry in others:
            number[entry] = number.get(entry, 0) + 1
        return sum(number.get(entry[k:], 0) for entry in ones for k in range(len(entry)))

    mine, theirs = a.entries(), b.entries()
    return suffixes(mine, theirs) + suffixes(theirs, mine)


def alignment_statistics(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    kind = docs.schema["doc_id"].dataType
    kept = materialize(
        docs.select("doc_id", text_of("text").alias("text")).mapInArrow(
            _links(a_path, b_path, to_arrow_type(kind)),
            f"doc_ids array<{kind.simpleString()}>, n_a array<long>, n_b array<long>, n_links array<long>, "
            "digests array<string>, n_bytes long, pairs binary",
        ),
        "alignment",
    ).withColumn("links", F.aggregate("n_links", F.lit(0).cast("long"), lambda t, x: t + x))
    a, b = ByteLevel(a_path), Pieces(b_path)
    most = pair_bound(a.tokens, b.tokens)
    counted = (
        kept.select("links", "n_bytes", "pairs").mapInArrow(_count, "pair long, n long")
        .groupBy("pair").agg(F.sum("n").alias("n")).limit(most + 1).toArrow()
    )
    if counted.num_rows > most:
        raise ValueError(f"more than {most} id pairs end together; the vocabularies do not match their tokenizers")
    pair = counted.column("pair").to_numpy().view(np.uint64)
    order = np.argsort(pair)
    pair, n = pair[order], counted.column("n").to_numpy()[order]
    b_id = (pair % np.uint64(len(b.tokens.size))).astype(np.int64)
    highest = np.zeros(len(b.tokens.size), np.int64)
    np.maximum.at(highest, b_id, n)
    shared = spark.sparkContext.broadcast((pair, n, n == highest[b_id]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = shared.value
        for batch in batches:
            for k, own in _pairs(batch):
                at = np.searchsorted(known, own)
                links = batch.column("n_links")[k].values
                first = np.concatenate([[0], np.cumsum(links.to_numpy())])
                sums = np.concatenate([[0], np.cumsum(count[at])])
                bests = np.concatenate([[0], np.cumsum(best[at])])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_ids")[k].values,
                        batch.column("n_a")[k].values,
                        batch.column("n_b")[k].values,
                        links,
                        links,
                        pa.array(np.diff(bests[first])),
                        pa.array(np.diff(sums[first])),
                        batch.column("digests")[k].values,
                    ],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
                )

    return kept.mapInArrow(
        run,
        f"doc_id {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, "
        "count_sum long, groups_sha256 string",
    )
