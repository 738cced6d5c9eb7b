"""Cleaning, data-quality and profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import vocabulary as V
from tideline.functions.numeric import hash60
from tideline.operators import cleaning as C
from tideline.operators import profiling as P
from tideline.plans.registry import query
from tideline.plans.tables import (
    PROFILE_SQL,
    RAW_SQL,
    TRIM_SQL,
    md5_sql,
    profile,
    raw_profile,
    round_sql,
    table,
)
from tideline.session import scratch_path
from tideline.sources.checks import WriteChecks
from tideline.sources.profiles import read_profiles, row_count, write_clean

_COLUMNS = ", ".join([*V.PROFILE_COLUMNS, V.RATIO])
_CLEAN_SQL = f"WITH {PROFILE_SQL} SELECT {_COLUMNS} FROM profile"
NUMBERS = [*V.NUMERIC_FEATURES, V.RATIO]
TWIN_KEYS = list(V.FEATURES)


@query("clean_profile", _CLEAN_SQL)
def clean_profile(spark, sf_dir):
    return C.clean(C.trim_headers(raw_profile(spark, sf_dir)), check=False)


@query("csv_scan", _CLEAN_SQL)
def csv_scan(spark, sf_dir):
    """The raw table written as CSV, read back as text and cleaned."""
    path = write_clean(raw_profile(spark, sf_dir), scratch_path(spark, "profiles-csv"), kind="csv")
    return C.clean(read_profiles(spark, path), check=False)


@query("write_clean", _CLEAN_SQL)
def write_clean_query(spark, sf_dir):
    """The cleaned table written as Parquet and read back."""
    cleaned = C.clean(C.trim_headers(raw_profile(spark, sf_dir)))
    return spark.read.parquet(write_clean(cleaned, scratch_path(spark, "profiles-clean")))


@query("checked_write", _CLEAN_SQL)
def checked_write(spark, sf_dir):
    """Shape and blank-row rule checked by the job that writes the cleaned table."""
    checks = WriteChecks()
    expected = (table(spark, sf_dir, "customer").count(), len(V.PROFILE_COLUMNS))
    raw = read_profiles(spark, df=raw_profile(spark, sf_dir), shape=expected, checks=checks)
    path = scratch_path(spark, "profiles-checked")
    return spark.read.parquet(write_clean(C.clean(raw, checks=checks), path, checks=checks))


@query(
    "header_trim",
    f"WITH {RAW_SQL} SELECT Senior_Citizen, count(*) AS n FROM raw_profile GROUP BY 1",
)
def header_trim(spark, sf_dir):
    return (
        C.trim_headers(raw_profile(spark, sf_dir))
        .groupBy("Senior_Citizen")
        .agg(F.count("*").alias("n"))
    )


@query(
    "shape_check",
    f"WITH {RAW_SQL} SELECT count(*) AS row_count, {len(V.PROFILE_COLUMNS) - 1} AS column_count FROM raw_profile",
)
def shape_check(spark, sf_dir):
    raw = raw_profile(spark, sf_dir)
    expected = (table(spark, sf_dir, "customer").count(), len(V.PROFILE_COLUMNS))
    return row_count(read_profiles(spark, df=raw, shape=expected, keep_key=False))


@query(
    "trim_strings",
    "WITH " + RAW_SQL + ", t AS (SELECT "
    + TRIM_SQL.format(c="Contract") + " AS Contract, "
    + TRIM_SQL.format(c="Payment_Method") + " AS Payment_Method FROM raw_profile) "
    "SELECT Contract, Payment_Method, count(*) AS n FROM t GROUP BY ALL",
)
def trim_strings(spark, sf_dir):
    trimmed = C.trim_strings(C.trim_headers(raw_profile(spark, sf_dir)))
    return trimmed.groupBy("Contract", "Payment_Method").agg(F.count("*").alias("n"))


@query(
    "count_blank",
    f"""WITH {RAW_SQL} SELECT gender,
      CAST(count(*) FILTER (WHERE {TRIM_SQL.format(c='Total_Charges')} = '') AS BIGINT) AS "blank_Total_Charges",
      CAST(count(*) FILTER (WHERE {TRIM_SQL.format(c='Contract')} = '') AS BIGINT) AS "blank_Contract"
    FROM raw_profile GROUP BY gender""",
)
def count_blank(spark, sf_dir):
    return C.count_blank(raw_profile(spark, sf_dir), ["Total_Charges", "Contract"], ["gender"])


@query(
    "rule_violations",
    f"""WITH {RAW_SQL}, planted AS (
      SELECT Internet_Service, tenure,
        CASE WHEN tenure % 7 = 3 THEN ' ' || chr(9) WHEN tenure % 11 = 5 THEN NULL
             ELSE Total_Charges END AS t FROM raw_profile)
    SELECT Internet_Service,
      count(*) FILTER (WHERE t IS NULL OR {TRIM_SQL.format(c='t')} = '') AS blanks,
      count(*) FILTER (WHERE (t IS NULL OR {TRIM_SQL.format(c='t')} = '') AND tenure <> 0) AS violations
    FROM planted GROUP BY Internet_Service""",
)
def rule_violations(spark, sf_dir):
    planted = raw_profile(spark, sf_dir).withColumn(
        "Total_Charges",
        F.when(F.col("tenure") % 7 == 3, " \t")
        .when(F.col("tenure") % 11 != 5, F.col("Total_Charges")),
    )
    return C.rule_violations(
        planted, "Total_Charges", F.col("tenure") == 0, ["Internet_Service"]
    )


@query(
    "ratio_feature",
    f"""SELECT o_orderkey,
      CASE WHEN o_orderkey % 13 > 0 THEN {round_sql('o_totalprice / (o_orderkey % 13)', 4)} END AS avg_monthly
    FROM orders""",
)
def ratio_feature(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("periods", F.col("o_orderkey") % 13)
    return C.ratio_feature(orders, "o_totalprice", "periods").select("o_orderkey", V.RATIO)


def _menu_sql() -> str:
    parts = []
    for feature, menu in V.MENUS.items():
        value = (
            f"CASE WHEN {feature} = 1 THEN 'Yes' ELSE 'No' END" if feature == V.FLAG else feature
        )
        options = ", ".join(f"'{m}'" for m in menu)
        parts.append(
            f"SELECT customerID, '{feature}' AS feature, {value} AS value FROM raw_profile "
            f"WHERE {value} NOT IN ({options})"
        )
    return f"WITH {RAW_SQL} " + " UNION ALL ".join(parts)


@query("menu_violations", _menu_sql())
def menu_violations(spark, sf_dir):
    raw = C.flag_to_bool(C.trim_headers(raw_profile(spark, sf_dir)))
    return C.menu_violations(raw, V.ROW_KEY)


@query(
    "binarize_label",
    f"WITH {PROFILE_SQL} SELECT label, Churn, count(*) AS n FROM profile GROUP BY ALL",
)
def binarize_label(spark, sf_dir):
    return profile(spark, sf_dir).groupBy("label", "Churn").agg(F.count("*").alias("n"))


def external(spark, sf_dir):
    """Parts as a foreign table: other names, some features missing, own label."""
    age = F.col("p_size")
    sold = F.pmod(hash60(F.lit("ext"), F.col("p_partkey")), F.lit(100)) < F.when(
        age < 20, 60
    ).otherwise(25)
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ext_id"),
        age.alias("ext_age"),
        F.col("p_retailprice").alias("ext_bill"),
        F.when(F.col("p_type") == "ECONOMY", "Month-to-month").otherwise("One year").alias("ext_plan"),
        F.col("p_brand").alias("ext_brand"),
        F.when(sold, "Yes").otherwise("No").alias("ext_left"),
    )


EXTERNAL_MAPPING = {
    "ext_age": "tenure",
    "ext_bill": "Monthly_Charges",
    "ext_plan": "Contract",
    "ext_left": "Churn",
}
EXTERNAL_SQL = f"""external AS (
  SELECT p_partkey AS ext_id, p_size AS ext_age, p_retailprice AS ext_bill,
    CASE WHEN p_type = 'ECONOMY' THEN 'Month-to-month' ELSE 'One year' END AS ext_plan,
    CASE WHEN {md5_sql("'ext'", "p_partkey::VARCHAR")} % 100 < CASE WHEN p_size < 20 THEN 60 ELSE 25 END
      THEN 'Yes' ELSE 'No' END AS ext_left
  FROM part)"""


@query(
    "map_schema",
    f"""WITH {EXTERNAL_SQL} SELECT ext_age AS tenure, ext_bill AS Monthly_Charges,
      ext_plan AS Contract, ext_left AS Churn FROM external""",
)
def map_schema(spark, sf_dir):
    mapped, _ = C.map_schema(external(spark, sf_dir), EXTERNAL_MAPPING, V.FEATURES)
    return mapped


# --- profiling ------------------------------------------------------------------


def _union(parts: list[str]) -> str:
    return f"WITH {PROFILE_SQL} " + " UNION ALL ".join(parts)


@query(
    "null_profile",
    _union(
        [
            f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM profile"
            for c in [*V.PROFILE_COLUMNS, V.RATIO, "label"]
        ]
    ),
)
def null_profile(spark, sf_dir):
    return P.null_profile(profile(spark, sf_dir))


@query(
    "feature_twins",
    f"""WITH {PROFILE_SQL}, v AS (
      SELECT count(*) AS n, sum(label) AS pos FROM profile GROUP BY {', '.join(TWIN_KEYS)})
    SELECT CAST(sum(n) AS BIGINT) AS row_count, count(*) AS unique_vectors,
      CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS rows_with_twin,
      count(*) FILTER (WHERE n > 1 AND pos > 0 AND pos < n) AS mixed_label_groups,
      {round_sql('(sum(pos) FILTER (WHERE n > 1))::DOUBLE / (sum(n) FILTER (WHERE n > 1))::DOUBLE', 6)}
        AS twin_label_rate
    FROM v""",
)
def feature_twins(spark, sf_dir):
    return P.feature_twins(profile(spark, sf_dir), TWIN_KEYS, "label")


@query(
    "duplicate_keys",
    "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1",
)
def duplicate_keys(spark, sf_dir):
    return P.duplicate_keys(table(spark, sf_dir, "lineitem"), "l_orderkey")


_PAIRS = [
    (a, b)
    for i, a in enumerate([*NUMBERS, "label"])
    for b in [*NUMBERS, "label"][i + 1 :]
]


@query(
    "correlations",
    _union(
        [
            f"SELECT '{a}' AS left_column, '{b}' AS right_column, {round_sql(f'corr({a}::DOUBLE, {b}::DOUBLE)', 6)} AS pearson FROM profile"
            for a, b in _PAIRS
        ]
    ),
)
def correlations(spark, sf_dir):
    return P.correlations(profile(spark, sf_dir), [*NUMBERS, "label"])


@query(
    "churn_rate_by",
    _union(
        [
            f"SELECT '{c}' AS feature, {c}::VARCHAR AS value, count(*) AS n, "
            f"{round_sql('avg(label)', 6)} AS label_rate FROM profile GROUP BY {c}"
            for c in V.CATEGORICAL_FEATURES
        ]
    ),
)
def churn_rate_by(spark, sf_dir):
    return P.churn_rate_by(profile(spark, sf_dir), V.CATEGORICAL_FEATURES, "label")


@query(
    "churn_rate_cube",
    f"""WITH {PROFILE_SQL} SELECT Contract, Internet_Service, Payment_Method,
      grouping_id(Contract, Internet_Service, Payment_Method)::BIGINT AS level, count(*) AS n,
      CAST(sum(label) AS BIGINT) AS positives, {round_sql('avg(label)', 6)} AS label_rate
    FROM profile GROUP BY CUBE (Contract, Internet_Service, Payment_Method)""",
)
def churn_rate_cube(spark, sf_dir):
    return P.churn_rate_cube(
        profile(spark, sf_dir), ["Contract", "Internet_Service", "Payment_Method"], "label"
    )


@query(
    "numeric_by_label",
    _union(
        [
            f"SELECT label, '{c}' AS feature, {round_sql(f'avg({c}::DOUBLE)', 4)} AS mean, "
            f"{round_sql(f'quantile_cont({c}::DOUBLE, 0.5)', 4)} AS median FROM profile GROUP BY label"
            for c in NUMBERS
        ]
    ),
)
def numeric_by_label(spark, sf_dir):
    return P.numeric_by_label(profile(spark, sf_dir), NUMBERS, "label")


_MODES = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {c}::VARCHAR AS value, count(*) AS n FROM profile WHERE {c} IS NOT NULL GROUP BY {c}"
    for c in V.CATEGORICAL_FEATURES
)
BASELINE_SQL = f"""{PROFILE_SQL},
mode_counts AS ({_MODES}),
modal AS (SELECT feature, value FROM mode_counts
  QUALIFY row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) = 1),
means AS (SELECT {', '.join(f"{round_sql(f'avg({c}::DOUBLE)', 6)} AS {c}" for c in V.NUMERIC_FEATURES)} FROM profile),
baseline AS (
  SELECT m.*, {', '.join(
    f"(SELECT value FROM modal WHERE feature = '{c}')::{'BOOLEAN' if c == V.FLAG else 'VARCHAR'} AS {c}"
    for c in V.CATEGORICAL_FEATURES)},
    CASE WHEN m.tenure > 0 THEN {round_sql('m.Total_Charges / m.tenure', 4)} END AS avg_monthly
  FROM means m)"""


@query("baseline_profile", f"WITH {BASELINE_SQL} SELECT * FROM baseline")
def baseline_profile(spark, sf_dir):
    return P.baseline_profile(profile(spark, sf_dir))
