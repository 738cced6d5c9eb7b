"""Split, fold and bootstrap queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import vocabulary as V
from tideline.operators import splits as S
from tideline.plans.registry import query
from tideline.plans.tables import PROFILE_SQL, md5_sql, profile, round_sql, table


def _split_sql(source: str, key: str, seed: str, by: str = "") -> str:
    """CTEs ``ranked`` and ``split``: the exact cut by a plain ranking window."""
    lead = f"{by}, " if by else ""
    whole = f"PARTITION BY {by}" if by else ""
    return f"""
hashed AS (SELECT *, {md5_sql(seed, f'{key}::VARCHAR')} AS h FROM {source}),
counts AS (SELECT {lead}label, count(*) AS n FROM hashed GROUP BY ALL),
spread AS (SELECT *, sum(n) OVER ({whole}) AS rows_all,
  ceil({round_sql('0.2 * sum(n) OVER (' + whole + ')', 6)})::BIGINT AS test FROM counts),
shares AS (SELECT *, (test * n) // rows_all AS low, (test * n) % rows_all AS rest FROM spread),
quotas AS (SELECT {lead}label, low + CASE WHEN
    row_number() OVER ({whole} ORDER BY rest DESC, label) <= test - sum(low) OVER ({whole})
    THEN 1 ELSE 0 END AS quota FROM shares),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {lead}label ORDER BY h, {key}) AS r FROM hashed),
split AS (SELECT ranked.*, CASE WHEN r <= quota THEN 'test' ELSE 'train' END AS part
  FROM ranked JOIN quotas USING ({lead}label))"""


def _fold_sql(source: str, key: str, seed: str, k: int = V.FOLDS) -> str:
    return f"""
fold_hash AS (SELECT *, {md5_sql(seed, "'fold'", f'{key}::VARCHAR')} AS fh FROM {source}),
folded AS (SELECT *, ((row_number() OVER (ORDER BY label, fh, {key}) - 1) % {k})::INTEGER AS fold
  FROM fold_hash)"""


def labelled_orders(spark, sf_dir):
    """Orders with a binary label: whether the order is still open."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_orderstatus") == "O").cast("int").alias("label")
    )


ORDERS_SQL = "lab AS (SELECT o_orderkey, (o_orderstatus = 'O')::INTEGER AS label FROM orders)"


def labelled_documents(spark, sf_dir):
    """Documents that carry a toxicity label: a rare positive class."""
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", "lang")
        .join(table(spark, sf_dir, "labels"), "doc_id")
        .select("doc_id", "lang", F.col("toxic").alias("label"))
    )


DOCS_SQL = "lab AS (SELECT doc_id, lang, toxic AS label FROM documents JOIN labels USING (doc_id))"


@query(
    "stratified_split",
    f"WITH {ORDERS_SQL}, {_split_sql('lab', 'o_orderkey', '42')} SELECT o_orderkey, label, part FROM split",
)
def stratified_split(spark, sf_dir):
    return S.stratified_split(labelled_orders(spark, sf_dir), key="o_orderkey", label="label", seed=42)


@query(
    "stratified_split_rare",
    f"WITH {DOCS_SQL}, {_split_sql('lab', 'doc_id', '43')} SELECT doc_id, label, part FROM split",
)
def stratified_split_rare(spark, sf_dir):
    split = S.stratified_split(
        labelled_documents(spark, sf_dir), key="doc_id", label="label", seed=43
    )
    return split.select("doc_id", "label", "part")


@query(
    "stratified_folds",
    f"WITH {ORDERS_SQL}, {_fold_sql('lab', 'o_orderkey', '42')} SELECT o_orderkey, label, fold FROM folded",
)
def stratified_folds(spark, sf_dir):
    return S.stratified_folds(labelled_orders(spark, sf_dir), key="o_orderkey", label="label", seed=42)


_RATE = "sum(label)::DOUBLE / count(*)"


def _audit_sql(ctes: str, source: str, group: str) -> str:
    return f"""WITH {ctes}, rate AS (SELECT avg(label) AS whole FROM {source})
    SELECT {group}::VARCHAR AS member, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives,
      {round_sql(_RATE, 6)} AS label_rate,
      abs({_RATE} - (SELECT whole FROM rate)) <= 0.02 AS within_tolerance
    FROM {source} GROUP BY {group}"""


@query(
    "split_audit",
    _audit_sql(f"{PROFILE_SQL}, {_split_sql('profile', 'customerID', '42')}", "split", "part"),
)
def split_audit(spark, sf_dir):
    split = S.stratified_split(profile(spark, sf_dir), key=V.ROW_KEY, label="label", seed=42)
    return S.split_audit(split, group="part", label="label")


@query(
    "fold_audit",
    _audit_sql(f"{PROFILE_SQL}, {_fold_sql('profile', 'customerID', '42')}", "folded", "fold"),
)
def fold_audit(spark, sf_dir):
    folded = S.stratified_folds(profile(spark, sf_dir), key=V.ROW_KEY, label="label", seed=42)
    return S.split_audit(folded, group="fold", label="label")


@query(
    "split_overlap",
    f"""WITH {ORDERS_SQL}, {_split_sql('lab', 'o_orderkey', '44')},
    both_parts AS (SELECT o_orderkey FROM split WHERE part = 'train'
      INTERSECT SELECT o_orderkey FROM split WHERE part = 'test')
    SELECT count(*) AS shared_keys FROM both_parts""",
)
def split_overlap(spark, sf_dir):
    split = S.stratified_split(labelled_orders(spark, sf_dir), key="o_orderkey", label="label", seed=44)
    return S.overlap(split, key="o_orderkey").agg(F.count("*").alias("shared_keys"))


_SEEDS_SQL = f"seeded AS (SELECT o_orderkey, label, unnest([{', '.join(map(str, V.SEEDS))}])::INTEGER AS seed FROM lab)"


@query(
    "multi_seed_split",
    f"""WITH {ORDERS_SQL}, {_SEEDS_SQL}, {_split_sql('seeded', 'o_orderkey', 'seed::VARCHAR', by='seed')}
    SELECT seed, o_orderkey, label, part FROM split""",
)
def multi_seed_split(spark, sf_dir):
    copies = S.multi_seed(labelled_orders(spark, sf_dir))
    return S.stratified_split(
        copies, key="o_orderkey", label="label", seed=F.col("seed"), by=["seed"]
    )


@query(
    "bootstrap_sample",
    f"""WITH {ORDERS_SQL}, placed AS (
      SELECT *, row_number() OVER (ORDER BY {md5_sql("'42'", "'order'", "o_orderkey::VARCHAR")}, o_orderkey) - 1 AS position FROM lab),
    draws AS (SELECT position AS draw,
      {md5_sql("'42'", "'draw'", "position::VARCHAR")} % (SELECT count(*) FROM lab) AS position FROM placed)
    SELECT position, draw, o_orderkey, label, true AS synthetic FROM draws JOIN placed USING (position)""",
)
def bootstrap_sample(spark, sf_dir):
    return S.bootstrap_sample(labelled_orders(spark, sf_dir), key="o_orderkey", seed=42)
