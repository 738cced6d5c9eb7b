"""Small tables with every odd case, and plain Python versions of the operators."""

from __future__ import annotations

import random
import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that results use, too.
        T.StructField("n_words", T.StringType()),
        T.StructField("label", T.DoubleType()),
        T.StructField("score", T.StringType()),
        T.StructField("shard", T.StringType()),
        T.StructField("host", T.StringType()),
    ]
)


def words(text):
    return WORD.findall(text or "")


def documents(seed: int = 3, n: int = 60):
    """Random texts over a small vocabulary with copies, near copies, passages and odd rows."""
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdéßXYZ,.") for _ in range(draw.randint(1, 7))) for _ in range(400)]

    def body(k):
        return [draw.choice(vocabulary) for _ in range(k)]

    passage, base = body(60), body(150)
    texts = [None, "", "   \n\t ", "one", "a b c d", "x" * 250, "-" * 130 + "\n" + "-" * 130, "ab " * 90]
    texts += [" ".join(base)] * 5
    for _ in range(6):
        near = list(base)
        for _ in range(draw.randint(1, 5)):
            near[draw.randrange(len(near))] = draw.choice(vocabulary)
        texts.append(" ".join(near))
    while len(texts) < n:
        own = body(draw.randint(1, 160))
        if draw.random() < 0.4:
            own += passage[draw.randint(0, 20) :]
        text = ""
        for w in own:
            text += w + draw.choice([" ", " ", " ", "\n", "  ", "\t"])
        texts.append(text)
    texts.append(" ".join(body(9000)))
    sources = ["a", "b", "c", None, "é"]
    rows = []
    for k, text in enumerate(texts):
        source = "a" if draw.random() < 0.4 else draw.choice(sources)
        rows.append((k, text, "en", source, len(text) if text is not None and k % 7 else None, "x", 0.5, "y", "z", "h"))
    rows += [(None, "lost words without an id " * 3, None, None, None, None, None, None, None, None)] * 2
    rows += [rows[20], rows[20], (rows[21][0], "same id other text " * 12, *rows[21][2:])]
    draw.shuffle(rows)
    return rows


def frame(spark, rows, parts: int = 3):
    return spark.createDataFrame(rows, DOCS).repartition(parts)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
