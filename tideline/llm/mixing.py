"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks.

Sizes are words. Sources in code point order (null last) weigh 1, 2, 3,
repeating, and share all words; a target stops at ``max_repeats`` times its
source's words and the rest is shared again by weight. The words to take are
counted in blocks of ``block_words`` and given to sources by highest
quotients. Each source's documents are dealt to shards of about ``shard_rows``
rows by a seeded hash. A quota of more blocks than a source has becomes whole
passes over it; the remaining blocks are apportioned to its shards, again by
highest quotients, and within a shard that many blocks are drawn with a seed.

A hot source is only more shards. Rows that agree in source, id and text are
counted before they are grouped and told apart again afterwards. What is
collected is one small row for each source.

Defined results: null text has no words and nothing is taken of it; null
sources form one source; null and repeated ids are ordinary values; rows that
agree in everything share what is taken of them evenly, the earlier ones at
most one word more. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.apportion import sainte_lague
from tideline.llm.tables import text_of, word_list
from tideline.session import materialize

WEIGHTS = (1, 2, 3)


def source_targets(sizes: DataFrame, max_repeats: int = 3) -> DataFrame:
    """Weight and target of each source; ``sizes`` has source, source_size, source_rows.

    Filling up by weight: with sources in the order of cap / weight, a source
    is capped while the level that the others would reach lies above its own.
    """
    everywhere = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_level = Window.orderBy("level", F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("place") - 1) % len(WEIGHTS) + 1).cast("int"))
    ranked = (
        sizes.withColumn("place", F.row_number().over(by_name))
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * max_repeats)
        .withColumn("level", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everywhere))
        .withColumn(
            "capped_before", F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        )
        .withColumn("weight_left", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("reach", (F.col("total") - F.col("capped_before")) / F.col("weight_left"))
        .withColumn("capped", F.col("reach") > F.col("level"))
    )
    share = F.min(F.when(~F.col("capped"), F.struct("level", "place", "reach"))).over(everywhere)["reach"]
    target = F.when(F.col("capped"), F.col("cap")).otherwise(share * F.col("weight"))
    return ranked.select(
        "place", "source", "source_size", "source_rows", "weight", target.cast("double").alias("target")
    )


def _shard_quotas(shards: pd.DataFrame) -> pd.DataFrame:
    """Blocks of the last, partial pass that each shard of one source gives."""
    shards = shards.sort_values("shard")
    blocks = shards["blocks"].to_numpy()
    quota = int(shards["quota"].iloc[0])
    passes, rest = divmod(quota, int(blocks.sum())) if blocks.sum() else (0, 0)
    return pd.DataFrame(
        {
            "place": shards["place"].to_numpy(),
            "shard": shards["shard"].to_numpy(),
            "passes": passes,
            "drawn": np.minimum(sainte_lague(blocks, rest), blocks),
        }
    )


def _draw(block_words: int, seed: int):
    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        """Lay one shard's documents end to end, draw blocks, cut them back to documents."""
        rows = rows.sort_values(["order", "doc_id", "size"], kind="stable", na_position="first")
        length = (rows["size"] * rows["copies"]).to_numpy()
        end = np.cumsum(length)
        start = end - length
        total = int(end[-1])
        blocks = -(-total // block_words)
        passes, drawn = int(rows["passes"].iloc[0]), int(rows["drawn"].iloc[0])
        name = f"{seed}/{rows['place'].iloc[0]}/{rows['shard'].iloc[0]}"
        chosen = np.zeros(blocks + 1, np.bool_)
        chosen[np.random.default_rng(zlib.crc32(name.encode())).permutation(blocks)[:drawn]] = True
        edge = np.minimum(np.arange(blocks + 2) * block_words, total)
        width = np.where(chosen, np.diff(edge), 0)
        before = np.concatenate([[0], np.cumsum(width)])

        def taken_until(at: np.ndarray) -> np.ndarray:
            block = at // block_words
            return before[block] + np.where(chosen[block], at - block * block_words, 0)

        # Ranges of words, where a row stands for one document.
        cuts = np.flatnonzero(np.diff(np.concatenate([[False], chosen, [False]]).astype(np.int8)))
        opens, closes = edge[cuts[::2]], edge[np.minimum(cuts[1::2], blocks + 1)]
        spans = []
        for s, e, copies in zip(start, end, rows["copies"], strict=True):
            lo, hi = np.searchsorted(closes, s, "right"), np.searchsorted(opens, e, "left")
            spans.append(
                [(int(max(a, s) - s), int(min(b, e) - s)) for a, b in zip(opens[lo:hi], closes[lo:hi], strict=True)]
                if copies == 1
                else None
            )
        return pd.DataFrame(
            {
                "place": rows["place"],
                "doc_id": rows["doc_id"],
                "size": rows["size"],
                "text_key": rows["text_key"],
                "copies": rows["copies"],
                "passes": passes,
                "extra": taken_until(end) - taken_until(start),
                "spans": spans,
            }
        )

    return draw


def mix_sources(
    docs: DataFrame,
    *,
    max_repeats: int = 3,
    block_words: int | None = None,
    shard_rows: int = 8192,
    seed: int = 20,
) -> DataFrame:
    """One row per document: its source's size and target, and what the mix takes of it.

    ``passes`` whole repeats and, of one more pass, the word ranges ``spans``
    (start, end) make up ``taken`` words. ``text_key`` tells texts of one id
    apart. ``block_words`` defaults to a ten-thousandth of all words, between
    1 and 32.
    """
    spark = docs.sparkSession
    text = text_of("text")
    rows = materialize(
        docs.select(
            "doc_id", "source",
            F.size(word_list(text)).cast("long").alias("size"),
            F.xxhash64(text).alias("text_key"),
        )
        .groupBy("doc_id", "source", "size", "text_key")
        .agg(F.count("*").alias("copies")),
        "mix-rows",
    )
    sizes = rows.groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("source_rows")
    )
    sources = materialize(source_targets(sizes, max_repeats), "mix-sources")
    known = sources.orderBy("place").toPandas()
    total = int(known["source_size"].sum())
    block = block_words or min(32, max(1, total // 10_000))
    quotas = sainte_lague(known["target"].to_numpy(), round(total / block))
    quota_of = spark.createDataFrame(
        pd.DataFrame({"place": known["place"].astype("int32"), "quota": quotas}), "place int, quota long"
    )
    order = F.xxhash64(F.lit(seed), "doc_id", "text_key")
    dealt = rows.join(
        F.broadcast(sources) if len(known) <= 10_000 else sources, rows["source"].eqNullSafe(sources["source"])
    ).select(
        "place", "doc_id", "size", "text_key", "copies", order.alias("order"),
        F.pmod(F.xxhash64(order), F.ceil(F.col("source_rows") / shard_rows)).alias("shard"),
    )
    blocks = dealt.groupBy("place", "shard").agg(
        F.ceil(F.sum(F.col("size") * F.col("copies")) / block).cast("long").alias("blocks")
    )
    capped = blocks.join(quota_of, "place").join(
        blocks.groupBy("place").agg((F.sum("blocks") * max_repeats).alias("most")), "place"
    )
    drawn = capped.withColumn("quota", F.least("quota", "most")).groupBy("place").applyInPandas(
        _shard_quotas, "place int, shard long, passes long, drawn long"
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    taken = dealt.join(drawn, ["place", "shard"]).groupBy("place", "shard").applyInPandas(
        _draw(block, seed),
        f"place int, doc_id {kind}, size long, text_key long, copies long, passes long, extra long, "
        "spans array<struct<start:long,end:long>>",
    )
    each = taken.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    # Copies share what is taken of them; each takes it from its start.
    extra = F.expr("extra div copies + int(copy <= extra % copies)")
    start = F.lit(0).cast("long").alias("start")
    shared = F.array(F.struct(start, F.col("more").alias("end")))
    return each.withColumn("more", extra).join(
        F.broadcast(sources) if len(known) <= 10_000 else sources, "place"
    ).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("passes") * F.col("size") + F.col("more")).alias("taken"),
        "passes",
        F.coalesce("spans", F.when(F.col("more") > 0, shared).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))).alias("spans"),
        "text_key", "copy",
    )
