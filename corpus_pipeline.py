"""The corpus pipeline: five stages from raw documents to token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's documents. All but the last
return the columns of documents: doc_id, text, lang, source, n_chars.

Null or empty texts fail the quality rules. Rows of one id are documents of
their own; of near duplicates one row stays, of several of the least id the
one with the least text hash. Texts of any length go through whole. Columns
beyond those of documents are dropped, so they may have any name. An empty
table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.fence import fenced
from tideline.llm.decontaminate import find_contamination
from tideline.llm.line_rules import clean_documents
from tideline.llm.mixing import mix_sources
from tideline.llm.ngram_join import near_duplicates
from tideline.llm.tables import bind, table, text_of, word_list
from tideline.llm.token_files import token_digests
from tideline.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(df: DataFrame) -> DataFrame:
    """The documents' columns, n_chars following the text."""
    return df.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules keep, without the lines that fail."""
    report = clean_documents(docs.select(*COLUMNS))
    # The verdict is a fenced column: a filter on it would work the whole report out once more.
    judged = fenced(report, {"stays": F.col("kept"), "text": F.col("clean_text")}, ["doc_id", "lang", "source"])
    return _with_text(judged.where("stays"))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the group's least id.

    Documents without words are groups of their own.
    """
    found = near_duplicates(docs.select("doc_id", "text"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("least")
    stays = (
        found.where("label IS NOT NULL").groupBy("label").agg(least).select("least.doc_id", "least.text_key")
        .union(found.where("label IS NULL").select("doc_id", "text_key"))
    )
    own = docs.select(*COLUMNS, F.xxhash64(text_of("text")).alias("text_key"))
    chosen = own.join(
        stays.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")),
        own["doc_id"].eqNullSafe(F.col("__id")) & (own["text_key"] == F.col("__key")),
        "left_semi",
    )
    # Rows that agree in id and text are one document.
    return chosen.dropDuplicates(["doc_id", "text_key"]).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark window hits."""
    benchmark = table(spark, sf_dir, "benchmark", "item_id", "text")
    return find_contamination(docs.select(*COLUMNS), benchmark).where("NOT contaminated").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it whole, and once the words it takes beyond that.

    Those words are runs of the document's words, joined by blanks: the text of
    such a row is pieced together from blocks that the mix drew.
    """
    taken = mix_sources(docs.select("doc_id", "source", "text")).where("taken > 0")
    parts = taken.groupBy("doc_id", "source", "text_key").agg(
        F.flatten(
            F.collect_list(
                F.concat(
                    F.array_repeat(F.lit(None).cast("array<struct<start:bigint,end:bigint>>"), F.col("passes").cast("int")),
                    F.when(
                        F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"]) > 0,
                        F.array("spans"),
                    ).otherwise(F.array().cast("array<array<struct<start:bigint,end:bigint>>>")),
                )
            )
        ).alias("parts")
    )
    own = docs.select(*COLUMNS, F.xxhash64(text_of("text")).alias("text_key")).dropDuplicates(
        ["doc_id", "source", "text_key"]
    )
    joined = own.join(
        parts.select(
            F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("text_key").alias("__key"), "parts"
        ),
        own["doc_id"].eqNullSafe(F.col("__id"))
        & own["source"].eqNullSafe(F.col("__source"))
        & (own["text_key"] == F.col("__key")),
    ).select(*COLUMNS, F.explode("parts").alias("spans"))
    # The words are split once a row and not once a span.
    part = bind(
        word_list(text_of("text")),
        lambda words: F.array_join(
            F.flatten(
                F.transform(
                    "spans", lambda s: F.slice(words, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
                )
            ),
            " ",
        ),
    )
    return _with_text(
        joined.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(part).alias("text"), "lang", "source")
    )


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixed documents, and what they give back for every document."""
    import public_tokenizers

    return token_digests(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_join", ngram_join),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("tokens", tokens),
]

#: The last stage's ids are beyond SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
