"""Token ids of documents in Huffman-coded files, written and read back.

Documents are tokenised in ascending doc_id order, range by range, into blocks
of whole documents in the shared folder. All ids are counted there, and from
the counts, a table of at most the vocabulary's size, a canonical
length-limited Huffman code is made. Then each block's ids are written as
codes, with the bit offset of every 256th id and each document's id and
length. A block needs only the code lengths to be read, so readers take blocks
in any order and on any machine, and a block's ids are decoded by table, all
runs between offsets at once.

The file format is a folder with two Parquet tables: ``codebook`` (token,
length) and ``blocks`` (shard, block, first_token, n_tokens, doc_ids,
doc_tokens, checkpoints, payload). Blocks are written by Spark's own commit
protocol, so a lost executor leaves no half-written file.

Defined results: null text counts as empty and has only the end id; null ids
come first; rows of one id are ordered by their text's hash, then as read. An
empty table gives no blocks. Text longer than a block is a block of its own.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.huffman import Codebook, code_lengths, decode, encode
from tideline.llm.tables import text_of
from tideline.llm.units import KEPT, UnitCache, worker_cache
from tideline.llm.words import packs, text_bytes
from tideline.session import scratch_path

BLOCK_IDS = 1 << 19
END_ID = 0
_SPACE = 0x20
#: First bytes of the UTF-8 forms of blanks beyond ASCII (and of much else).
_MAYBE_BLANK = (0xC2, 0xE1, 0xE2, 0xE3)


def _byte_classes() -> dict[str, np.ndarray]:
    """Classes of bytes that tell safe cuts and simple units."""
    byte = np.arange(256)
    blank = (byte == _SPACE) | ((byte >= 0x09) & (byte <= 0x0D)) | ((byte >= 0x1C) & (byte <= 0x1F))
    letter = ((byte | 0x20) >= 0x61) & ((byte | 0x20) <= 0x7A) & (byte < 0x80)
    digit = (byte >= 0x30) & (byte <= 0x39)
    return {
        "visible": ~blank & ~np.isin(byte, _MAYBE_BLANK),
        "letter": letter,
        "mark": (byte > _SPACE) & (byte < 0x7F) & ~letter & ~digit & (byte != 0x27),
        # Letters of ASCII and, after 0xC3, of Latin-1.
        "word": letter | (byte == 0xC3) | ((byte >= 0x80) & (byte < 0xC0)),
    }


def byte_alphabet() -> dict[int, int]:
    """The characters that stand for bytes in a byte-level vocabulary.

    Bytes that Latin-1 prints stand for themselves, the others for the
    characters from 256 on, in order.
    """
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printed]
    return {b: b for b in printed} | {b: 256 + k for k, b in enumerate(others)}


def unit_encoder(path: str) -> UnitEncoder:
    """The worker's encoder; what it has learnt serves its later tasks."""
    cache = worker_cache()
    if path not in cache:
        cache[path] = UnitEncoder(path, kept=2 * KEPT)
    return cache[path]


class UnitEncoder:
    """Ids of whole texts, from the ids of the units they are made of.

    A byte-level BPE first cuts a text into words with their leading blank,
    runs of marks and runs of white space, and never joins bytes across these
    cuts. Some of the cuts do not depend on anything around them: before a
    blank that something visible follows, between an ASCII letter and a mark,
    and around a single line end between visible bytes. Texts are cut there by
    array operations, and the tokenizer encodes each distinct unit once
    (``UnitCache``). A unit that is one word goes straight to its model;
    others are joined by line ends and encoded many at a time, or one by one
    if they hold other white space. A text that holds one of the tokenizer's
    own added tokens is encoded whole.
    """

    def __init__(self, path: str, *, added_as_text: bool = False, kept: int = KEPT):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = added_as_text
        added = [
            t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()
            if not (added_as_text and t.special)
        ]
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None
        self.classes = _byte_classes()
        alphabet = byte_alphabet()
        self.letters = np.array([alphabet[b] for b in range(256)], "<u4")
        self.letters[0x0A] = 0x0A
        self.line_end = self._ids("\n")
        self.cache = UnitCache(self._encode, kept=kept)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _kinds(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Which units are one word of letters, and which hold no blank but a leading space."""
        size = np.fromiter(map(len, units), np.int64, len(units))
        data = np.frombuffer(b"".join(units), np.uint8)
        hi = np.cumsum(size)
        lo = hi - size
        body = np.minimum(lo + (data[lo] == _SPACE), hi)
        other = ~self.classes["word"][data]
        other[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
        strange = np.concatenate([[0], np.cumsum(other)])
        blank = np.concatenate([[0], np.cumsum(~self.classes["visible"][data] & (data != 0xC3))])
        return (strange[hi] == strange[body]) & (hi > body), blank[hi] == blank[body]

    def _encode(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units and their numbers."""
        words, joins = self._kinds(units)
        size = np.zeros(len(units), np.int64)
        pieces: list = [None] * len(units)
        if words.any():
            # Words hold no line end, so one pass gives all of them their characters.
            own = list(itertools.compress(units, words))
            spelled = self.letters[np.frombuffer(b"\n".join(own), np.uint8)].tobytes().decode("utf-32-le").split("\n")
            tokenize = self.tokenizer.model.tokenize
            found = [[t.id for t in tokenize(word)] for word in spelled]
            for i, ids in zip(np.flatnonzero(words).tolist(), found, strict=True):
                pieces[i] = ids
            size[words] = np.fromiter(map(len, found), np.int64, len(found))
        together = np.flatnonzero(joins & ~words)
        texts = [
            b"\n".join(units[i] for i in together[k : k + 256]).decode() for k in range(0, len(together), 256)
        ]
        coded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        cut = self.line_end[0]
        for k, ids in enumerate(coded):
            ids = np.array(ids, np.uint32)
            which = together[256 * k : 256 * k + 256]
            edge = np.concatenate([[-1], np.flatnonzero(ids == cut), [len(ids)]])
            size[which] = np.diff(edge) - 1
            keep = ids[ids != cut]
            at = np.concatenate([[0], np.cumsum(size[which])])
            for j, i in enumerate(which):
                pieces[i] = keep[at[j] : at[j + 1]]
        for i in np.flatnonzero(~joins & ~words):
            pieces[i] = self._ids(units[i].decode())
            size[i] = len(pieces[i])
        return np.fromiter(itertools.chain.from_iterable(pieces), np.uint32, int(size.sum())), size

    def _units(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where units start."""
        cut = np.zeros(len(data) + 1, np.bool_)
        if len(data) > 1:
            here, after = data[1:], np.append(data[2:], np.uint8(_SPACE))
            visible = self.classes["visible"][after]
            cut[1:-1] = (here == _SPACE) & visible
            cut[1:-1] |= self.classes["letter"][data[:-1]] & self.classes["mark"][here]
            line = (here == 0x0A) & visible & self.classes["visible"][data[:-1]] & (data[:-1] < 0x80)
            cut[1:-1] |= line
            cut[2:] |= line
        cut[offsets] = True
        cut[len(data)] = False
        return np.flatnonzero(cut)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, each text's followed by the end id, and their numbers."""
        data, offsets = text_bytes(column)
        first = self._units(data, offsets)
        ids, size = self.cache(data, first, np.append(first[1:], len(data)))
        before = np.concatenate([[0], np.cumsum(size)])
        edge = before[np.searchsorted(first, offsets)]
        whole = {}
        if self.added is not None:
            for hit in self.added.finditer(data):
                k = int(np.searchsorted(offsets, hit.start(), "right")) - 1
                whole[k] = None
        if whole:
            pieces = [
                np.array(self._ids(column[k].as_py()), np.uint32) if k in whole else ids[edge[k] : edge[k + 1]]
                for k in range(len(column))
            ]
            ids = np.concatenate(pieces)
            edge = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        return np.insert(ids, edge[1:], END_ID), np.diff(edge) + 1


def _tokenise(path: str, doc_type: pa.DataType, width: str):
    """Blocks of whole documents with their plain ids, in the order of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = unit_encoder(path)
        shard = TaskContext.get().partitionId()
        held, docs, sizes = [], [], []
        block, first, waiting = 0, 0, 0

        def flush():
            nonlocal block, first, waiting
            ids = np.concatenate(held)
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([block], pa.int32()),
                    pa.array([first], pa.int64()),
                    pa.array([len(ids)], pa.int64()),
                    pa.array([pa.concat_arrays(docs).to_pylist()], pa.list_(doc_type)),
                    pa.array([np.concatenate(sizes)], pa.list_(pa.int64())),
                    pa.array([ids.astype(width).tobytes()], pa.binary()),
                ],
                names=["shard", "block", "first_token", "n_tokens", "doc_ids", "doc_tokens", "ids"],
            )
            block, first, waiting = block + 1, first + len(ids), 0
            held.clear(), docs.clear(), sizes.clear()
            return row

        for batch in batches:
            texts = batch.column("text")
            for lo, hi in packs(text_bytes(texts)[1]):
                ids, counts = coder(texts.slice(lo, hi - lo))
                held.append(ids)
                docs.append(batch.column("doc_id").slice(lo, hi - lo))
                sizes.append(counts)
                waiting += len(ids)
                if waiting >= BLOCK_IDS:
                    yield flush()
        if docs:
            yield flush()

    return run


def _count(width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                seen = np.bincount(np.frombuffer(batch.column(0)[k].as_buffer(), width))
                if len(seen) > len(total):
                    seen, total = total, seen.astype(np.int64)
                total[: len(seen)] += seen
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(total[ids])], names=["token", "n"])

    return run


def _code(width: str, lengths):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(lengths.value)
        for batch in batches:
            coded = [encode(np.frombuffer(x.as_buffer(), width), book) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array([marks for _, marks in coded], pa.list_(pa.int64())),
                    pa.array([payload for payload, _ in coded], pa.binary()),
                ],
                names=[*batch.schema.names[:-1], "checkpoints", "payload"],
            )

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str) -> None:
    """Tokenise the documents and write the two tables of the format."""
    from pyspark.sql.pandas.types import to_arrow_type
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    width = "<u2" if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["doc_id", "__text", "__row"]
    text = text_of("text")
    ordered = (
        docs.select(
            "doc_id", text.alias("text"), F.xxhash64(text).alias("__text"),
            F.monotonically_increasing_id().alias("__row"),
        )
        .repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .select("doc_id", "text")
    )
    head = (
        "shard int, block int, first_token long, n_tokens long, "
        f"doc_ids array<{kind.simpleString()}>, doc_tokens array<long>"
    )
    plain_folder = scratch_path(spark, "plain-tokens")
    ordered.mapInArrow(
        _tokenise(tokenizer_path, to_arrow_type(kind), width), f"{head}, ids binary"
    ).write.option("compression", "zstd").parquet(plain_folder)
    plain = spark.read.parquet(plain_folder)
    counts = (
        plain.select("ids").mapInArrow(_count(width), "token int, n long").groupBy("token").agg(F.sum("n"))
    ).collect()  # at most one row for each entry of the vocabulary
    total = np.zeros(max((r[0] for r in counts), default=0) + 1, np.int64)
    for token, n in counts:
        total[token] = n
    lengths = code_lengths(total)
    used = np.flatnonzero(lengths)
    table = pa.table({"token": used.astype(np.int32), "length": lengths[used].astype(np.int32)})
    spark.createDataFrame(table.to_pandas(), "token int, length int").coalesce(1).write.parquet(f"{folder}/codebook")
    plain.mapInArrow(
        _code(width, spark.sparkContext.broadcast(lengths)), f"{head}, checkpoints array<long>, payload binary"
    ).write.option("compression", "none").parquet(f"{folder}/blocks")


def _lengths(spark: SparkSession, folder: str) -> np.ndarray:
    rows = spark.read.parquet(f"{folder}/codebook").collect()  # at most one row for each entry of the vocabulary
    lengths = np.zeros(max((r["token"] for r in rows), default=0) + 1, np.int64)
    for token, length in rows:
        lengths[token] = length
    return lengths


def _blocks(batch: pa.RecordBatch, table, bits: int):
    for k in range(batch.num_rows):
        marks = batch.column("checkpoints")[k].values.to_numpy()
        n = batch.column("n_tokens")[k].as_py()
        ids = decode(batch.column("payload")[k].as_buffer(), n, marks, table, bits)
        yield k, ids, batch.column("doc_tokens")[k].values.to_numpy(), batch.column("doc_ids")[k].values


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start and the ids themselves, one row per document."""
    return _read(spark, folder, "ids array<int>", lambda ids: pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())))


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, number of ids and CRC-32 of them as little-endian 32-bit words."""
    return _read(
        spark, folder, "ids_crc32 long",
        lambda ids: pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()),
    )


def _read(spark: SparkSession, folder: str, column: str, make) -> DataFrame:
    book = Codebook(_lengths(spark, folder))
    shared = spark.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bits = shared.value.decoding_table(), shared.value.bits
        for batch in batches:
            for k, ids, sizes, doc_ids in _blocks(batch, table, bits):
                end = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids,
                        pa.array(np.full(len(sizes), batch.column("shard")[k].as_py(), np.int32)),
                        pa.array(batch.column("first_token")[k].as_py() + end - sizes),
                        pa.array(sizes),
                        make(np.split(ids, end[:-1])) if len(sizes) else make([]),
                    ],
                    names=["doc_id", "shard", "local_start", "n_tokens", column.split()[0]],
                )

    blocks = spark.read.parquet(f"{folder}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    local = blocks.mapInArrow(run, f"doc_id {kind}, shard int, local_start long, n_tokens long, {column}")
    # One row per shard: a few bytes for each partition of the writing job.
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
        .select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    )
    return local.join(F.broadcast(offsets), "shard").select(
        "doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", column.split()[0]
    )


def token_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the documents to files below the shared folder, and digest what the files give back."""
    folder = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer_path, folder)
    return read_digests(docs.sparkSession, folder)
