"""The operators of this folder over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import oracles
from tideline.llm.alignment import alignment_statistics
from tideline.llm.byte_shards import byte_shards
from tideline.llm.collocations import mine_collocations
from tideline.llm.decontaminate import find_contamination
from tideline.llm.factorization import score_quality, train_quality
from tideline.llm.line_rules import clean_documents
from tideline.llm.mixing import mix_sources
from tideline.llm.ngram_join import near_duplicates
from tideline.llm.registry import ORACLES, QUERIES, query
from tideline.llm.simhash import near_fingerprints
from tideline.llm.suffix_dedup import remove_repeated_bytes
from tideline.llm.tables import table
from tideline.llm.token_files import token_digests
from tideline.llm.url_rules import Rule, judge_urls
from tideline.llm.window_dedup import remove_repeated_windows

__all__ = ["ORACLES", "QUERIES"]

URL_RULES = [
    Rule("block", "net"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
]


@query("op1_quality_machine")
def quality_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt outside the held-out fold."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "n_chars")
    machine = train_quality(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return score_quality(docs, machine).select("doc_id", "held_out", "score", "predicted")


@query("op2_suffix_dedup", oracles.SUFFIX_DEDUP)
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document outside 100-byte strings that start earlier."""
    return remove_repeated_bytes(table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


@query("op3_window_dedup", oracles.WINDOW_DEDUP)
def window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document outside repeated 35-word windows."""
    return remove_repeated_windows(table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


@query("op4_line_rules", oracles.LINE_RULES)
def line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, symbols and repeats of every document, and the verdict of the line rules."""
    return clean_documents(table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_lines", "n_words_left",
    )


@query("op5_mix_sources")
def mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mix_sources(table(spark, sf_dir, "documents", "doc_id", "source", "text")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


@query("op6_byte_shards", oracles.BYTE_SHARDS)
def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous shards of nearly equal bytes."""
    return byte_shards(table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op7_decontaminate", oracles.DECONTAMINATE)
def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that benchmark windows hit, and the items that hit."""
    found = find_contamination(
        table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    )
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


@query("op8_token_files")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the written token files give back for every document."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return token_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query("op9_url_rules", oracles.URL_RULES)
def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule that decides each page's url."""
    return judge_urls(table(spark, sf_dir, "pages", "page_id", "url"), URL_RULES)


@query("op10_ngram_join", oracles.NGRAM_JOIN)
def ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and near-duplicate component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "n_shingles", "component_id"
    )


@query("op11_collocations", oracles.COLLOCATIONS)
def collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of every language."""
    return mine_collocations(table(spark, sf_dir, "documents", "text", "lang"))


@query("op12_simhash")
def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document, and its component of fingerprints within two bits."""
    return near_fingerprints(table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "fingerprint", "component_id"
    )


@query("op13_token_alignment")
def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens in every document."""
    import public_tokenizers

    return alignment_statistics(
        table(spark, sf_dir, "documents", "doc_id", "text"),
        public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"),
    )
