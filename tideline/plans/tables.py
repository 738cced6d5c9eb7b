"""Views that give the driver's tables the shape the operators work on.

Each view is a lazy plan over the Parquet tables; nothing is generated that
does not come from their rows. The SQL text beside each one states the same
view for the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import vocabulary as V
from tideline.functions.numeric import hash60, micros, round_dp
from tideline.operators.cleaning import binarize_label, clean, trim_headers

CUT_DATE = "2000-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def md5_sql(*parts: str) -> str:
    """SQL twin of ``hash60``."""
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 15))::BIGINT"


def round_sql(x: str, d: int) -> str:
    """SQL twin of ``round_dp``."""
    return f"(round(({x}) * {10**d}.0::DOUBLE) / {10**d}.0::DOUBLE)"


# --- raw subscriber profile ---------------------------------------------------

# Which hex digit of the key's hash decides which attribute, and the number of
# the sixteen digit values that mean the first of its two or three choices.
_ADD_ONS = (
    "Online_Security",
    "Online_Backup",
    "Device_Protection",
    "Tech_Support",
    "Streaming_TV",
    "Streaming_Movies",
)
_PAYMENT = {
    "AUTOMOBILE": "Electronic check",
    "BUILDING": "Mailed check",
    "FURNITURE": "Bank transfer (automatic)",
    "HOUSEHOLD": "Credit card (automatic)",
    "MACHINERY": "Electronic check",
}


def raw_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 21-column raw table, one row per customer, blemishes included.

    Billing comes from finished orders before the cut date: months since the
    first one, and their total, blank where there is none. The categorical
    attributes and the label follow from hashes of the customer key.
    """
    billing = (
        table(spark, sf_dir, "orders")
        .where((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") < F.lit(CUT_DATE).cast("timestamp_ntz")))
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(
            F.min("o_orderdate").alias("first_order"),
            F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"),
        )
    )
    base = (
        table(spark, sf_dir, "customer")
        .join(billing, "c_custkey", "left")
        .withColumns(
            {
                "h": hash60(F.lit("profile"), F.col("c_custkey")),
                "months": F.coalesce(
                    F.expr(f"datediff(date'{CUT_DATE}', cast(first_order as date)) div 30"),
                    F.lit(0),
                ).cast("int"),
            }
        )
    )

    def digit(i: int) -> Column:
        return F.shiftright("h", 4 * i).bitwiseAND(F.lit(15))

    def yes(i: int, n: int) -> Column:
        return F.when(digit(i) < n, "Yes").otherwise("No")

    online = F.when(digit(6) < 5, "DSL").when(digit(6) < 12, "Fiber optic").otherwise("No")
    contract = (
        F.when(digit(13) < 9, "Month-to-month").when(digit(13) < 12, "One year").otherwise("Two year")
    )
    payment = F.create_map(*[F.lit(x) for kv in _PAYMENT.items() for x in kv])[F.col("c_mktsegment")]
    add_ons = {
        name: F.when(digit(6) >= 12, "No internet service").otherwise(yes(7 + i, 7))
        for i, name in enumerate(_ADD_ONS)
    }
    chance = (
        F.when(digit(13) < 9, 46).when(digit(13) < 12, 9).otherwise(2)
        + F.when(digit(6) < 5, 0).when(digit(6) < 12, 16).otherwise(-8)
        + F.when(F.col("months") < 12, 18).when(F.col("months") < 30, 4).otherwise(-14)
        + F.when(digit(1) < 3, 8).otherwise(0)
        + F.when(digit(14) < 10, 5).otherwise(-5)
    )
    churn = F.when(
        F.pmod(hash60(F.lit("label"), F.col("c_custkey")), F.lit(100)) < chance, "Yes"
    ).otherwise("No")
    columns = {
        "customerID": F.format_string(
            "%04d-%s",
            F.expr("c_custkey div 100000"),
            F.translate(F.lpad((F.col("c_custkey") % 100000).cast("string"), 5, "0"), "0123456789", "ABCDEFGHIJ"),
        ),
        "gender": F.when(digit(0) < 8, "Female").otherwise("Male"),
        "Senior_Citizen ": F.when(digit(1) < 3, 1).otherwise(0),
        "Is_Married": yes(2, 8),
        "Dependents": yes(3, 5),
        "tenure": F.col("months"),
        "Phone_Service": yes(4, 14),
        "Dual": F.when(digit(4) >= 14, "No phone service").otherwise(yes(5, 7)),
        "Internet_Service": online,
        **add_ons,
        # blemishes: a tab behind some contracts, a space before some payments
        "Contract": F.when(digit(13) == 0, F.concat(contract, F.lit("\t"))).otherwise(contract),
        "Paperless_Billing": yes(14, 10),
        "Payment_Method": F.when(digit(2) == 0, F.concat(F.lit(" "), payment)).otherwise(payment),
        "Monthly_Charges": round_dp(F.lit(18.25) + F.abs("c_acctbal") / F.lit(100.0), 2),
        "Total_Charges": F.coalesce(F.col("total").cast("string"), F.lit(" ")),
        "Churn": churn,
    }
    return base.select(*[c.alias(n) for n, c in columns.items()])


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned profile, with the 0/1 label beside it."""
    raw = trim_headers(raw_profile(spark, sf_dir))
    return binarize_label(clean(raw, check=False))


def _digit_sql(i: int) -> str:
    return f"((h >> {4 * i}) & 15)"


def _yes_sql(i: int, n: int) -> str:
    return f"CASE WHEN {_digit_sql(i)} < {n} THEN 'Yes' ELSE 'No' END"


def _raw_sql() -> str:
    d = _digit_sql
    contract = (
        f"CASE WHEN {d(13)} < 9 THEN 'Month-to-month' WHEN {d(13)} < 12 THEN 'One year' ELSE 'Two year' END"
    )
    payment = "CASE c_mktsegment " + " ".join(
        f"WHEN '{k}' THEN '{v}'" for k, v in _PAYMENT.items()
    ) + " END"
    add_ons = ",\n".join(
        f"CASE WHEN {d(6)} >= 12 THEN 'No internet service' ELSE {_yes_sql(7 + i, 7)} END AS {name}"
        for i, name in enumerate(_ADD_ONS)
    )
    return f"""
billing AS (
  SELECT o_custkey, min(o_orderdate) AS first_order,
         sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total
  FROM orders
  WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '{CUT_DATE} 00:00:00'
  GROUP BY o_custkey),
base AS (
  SELECT c.*, b.total, {md5_sql("'profile'", "c_custkey::VARCHAR")} AS h,
         coalesce(date_diff('day', first_order::DATE, DATE '{CUT_DATE}') // 30, 0)::INTEGER AS months
  FROM customer c LEFT JOIN billing b ON c_custkey = o_custkey),
raw_profile AS (
  SELECT printf('%04d', c_custkey // 100000) || '-' ||
         translate(lpad((c_custkey % 100000)::VARCHAR, 5, '0'), '0123456789', 'ABCDEFGHIJ') AS customerID,
  CASE WHEN {d(0)} < 8 THEN 'Female' ELSE 'Male' END AS gender,
  CASE WHEN {d(1)} < 3 THEN 1 ELSE 0 END AS Senior_Citizen,
  {_yes_sql(2, 8)} AS Is_Married, {_yes_sql(3, 5)} AS Dependents, months AS tenure,
  {_yes_sql(4, 14)} AS Phone_Service,
  CASE WHEN {d(4)} >= 14 THEN 'No phone service' ELSE {_yes_sql(5, 7)} END AS Dual,
  CASE WHEN {d(6)} < 5 THEN 'DSL' WHEN {d(6)} < 12 THEN 'Fiber optic' ELSE 'No' END AS Internet_Service,
  {add_ons},
  CASE WHEN {d(13)} = 0 THEN {contract} || chr(9) ELSE {contract} END AS Contract,
  {_yes_sql(14, 10)} AS Paperless_Billing,
  CASE WHEN {d(2)} = 0 THEN ' ' || {payment} ELSE {payment} END AS Payment_Method,
  {round_sql("18.25::DOUBLE + abs(c_acctbal) / 100.0::DOUBLE", 2)} AS Monthly_Charges,
  coalesce(total::VARCHAR, ' ') AS Total_Charges,
  CASE WHEN {md5_sql("'label'", "c_custkey::VARCHAR")} % 100 <
      (CASE WHEN {d(13)} < 9 THEN 46 WHEN {d(13)} < 12 THEN 9 ELSE 2 END
     + CASE WHEN {d(6)} < 5 THEN 0 WHEN {d(6)} < 12 THEN 16 ELSE -8 END
     + CASE WHEN months < 12 THEN 18 WHEN months < 30 THEN 4 ELSE -14 END
     + CASE WHEN {d(1)} < 3 THEN 8 ELSE 0 END
     + CASE WHEN {d(14)} < 10 THEN 5 ELSE -5 END)
    THEN 'Yes' ELSE 'No' END AS Churn
  FROM base)"""


TRIM_SQL = r"regexp_replace({c}, '^[\s\pZ]+|[\s\pZ]+$', '', 'g')"


def _clean_sql() -> str:
    columns = []
    for c in V.PROFILE_COLUMNS:
        trimmed = TRIM_SQL.format(c=c)
        if c == V.FLAG:
            columns.append(f"{c}::INTEGER::BOOLEAN AS {c}")
        elif c == "Total_Charges":
            columns.append(
                f"CASE WHEN {trimmed} <> '' THEN CAST({trimmed} AS DOUBLE) "
                f"WHEN tenure = 0 THEN 0.0::DOUBLE END AS {c}"
            )
        elif c in V.NUMERIC_FEATURES:
            columns.append(c)
        else:
            columns.append(f"{trimmed} AS {c}")
    return f"""
cleaned AS (SELECT {', '.join(columns)} FROM raw_profile),
profile AS (
  SELECT *, CASE WHEN tenure > 0 THEN {round_sql("Total_Charges / tenure", 4)} END AS avg_monthly,
         (Churn = 'Yes')::INTEGER AS label
  FROM cleaned)"""


RAW_SQL = _raw_sql().strip()
PROFILE_SQL = f"{RAW_SQL},{_clean_sql()}"


# --- scored rows --------------------------------------------------------------


def scored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scored cases: label = returned, score in [0, 1] with ties.

    The score mixes the cents of the price with the label, so the curves have
    a shape; segments are the shipping status.
    """
    cents = F.round(F.col("l_extendedprice") * 100.0, 0).cast("long") % 1000
    label = (F.col("l_returnflag") == "R").cast("int")
    raw = (cents + F.col("l_linenumber") * 20 + label * 420).cast("double") / F.lit(1600.0)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("segment"),
        (F.col("l_orderkey") % 5).cast("int").alias("fold"),
        label.alias("label"),
        round_dp(raw, 4).alias("score"),
    )


SCORED_SQL = f"""
scored AS (
  SELECT l_linestatus AS segment, (l_orderkey % 5)::INTEGER AS fold,
         (l_returnflag = 'R')::INTEGER AS label,
         {round_sql('''((round(l_extendedprice * 100.0::DOUBLE)::BIGINT % 1000) + l_linenumber * 20
           + (l_returnflag = 'R')::INTEGER * 420)::DOUBLE / 1600.0::DOUBLE''', 4)} AS score
  FROM lineitem)"""


# --- calls, turns and requests --------------------------------------------------


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls: key, time in microseconds, and a tie-breaking id."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"),
        micros(F.col("ts")).alias("ts_us"),
        "event_id",
    )


# JSON candidates and user texts by the number of the event, %K from its props,
# %V from its value. The list covers every verdict of the request checks.
CANDIDATES = (
    '{"target_features":["Contract"],"filters":{"Contract":"month-to-month"},"out_of_scope":false}',
    '{"target_features":[],"filters":{},"out_of_scope":true}',
    '{"predicted_churn":0.42}',
    '{"target_features":["tenure"],"filters":{"tenure":"%K"},"out_of_scope":false}',
    '{"target_features":["tenure"],"filters":{"tenure":%K},"out_of_scope":false}',
    '{"filters":{"Monthly_Charges":"about %V a month","Contract":"on a two-year contract"},"out_of_scope":false}',
    '{"target_features":["tenure"],"filters":{"tenure":"weeks"},"out_of_scope":false}',
    '{"target_features":["Internet_Service"],"filters":{"Internet_Service":"a fiber-optic customer","Tech_Support":"I am not subscribed"},"out_of_scope":false}',
    '["Contract"]',
    'tenure %K',
    '{"target_features":["Online_Security","Loyalty"],"filters":{},"out_of_scope":false}',
    '{"filters":{"Payment_Method":"credit card automatic payment","Dual":"no phone service","Senior_Citizen":"yes"},"out_of_scope":false}',
    '{"target_features":["Payment_Method"],"filters":{"Payment_Method":"Mailed check"},"how_certain":3,"out_of_scope":false}',
    '{"target_features":["Online_Backup"],"filters":{"Online_Backup":"No internet service"}}',
    '{"target_features":["Total_Charges"],"filters":{"Total_Charges":"0"},"out_of_scope":false}',
    '{"filters":{"Loyalty":"gold"},"out_of_scope":false}',
    '{"filters":["tenure"],"out_of_scope":false}',
    '{"target_features":["gender"],"filters":{"gender":"m","Is_Married":"yes and no"},"out_of_scope":"yes"}',
    '{"filters":{"gender":"Female","Paperless_Billing":"yes!","Streaming_TV":"no thanks"},"out_of_scope":false}',
)
USER_TEXTS = (
    "will a month-to-month customer churn?",
    "with us for about %K months",
    "pays $%V a month, reach me at user%K@example.com",
    "a customer without numbers",
    "id %K0%K1ABCDE stayed 1,2%K days, call 0805553434",
    "version 1.2.3 of tenure %K and %V",
)


def _pick(templates: tuple, index: Column, k: Column, v: Column) -> Column:
    chosen = F.element_at(F.array(*[F.lit(t) for t in templates]), (index + 1).cast("int"))
    return F.replace(F.replace(chosen, F.lit("%K"), k), F.lit("%V"), v)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as chat turns: a user text and up to three JSON candidates each."""
    k = F.get_json_object("props", "$.k")
    v = F.col("value").cast("decimal(18,2)").cast("string")
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"),
        e.alias("turn"),
        micros(F.col("ts")).alias("ts_us"),
        _pick(USER_TEXTS, F.expr("(event_id div 3) % 6"), k, v).alias("user_text"),
        _pick(CANDIDATES, e % len(CANDIDATES), k, v).alias("candidate_1"),
        F.when(e % 2 == 0, _pick(CANDIDATES, (e + 5) % len(CANDIDATES), k, v)).alias("candidate_2"),
        F.when(e % 3 == 0, _pick(CANDIDATES, (e + 11) % len(CANDIDATES), k, v)).alias(
            "candidate_repair"
        ),
    )


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _pick_sql(templates: tuple, index: str) -> str:
    options = ", ".join(_quote(t) for t in templates)
    return f"replace(replace(([{options}])[({index}) + 1], '%K', k), '%V', v)"


_N = len(CANDIDATES)
TURNS_SQL = f"""
turn_values AS (
  SELECT *, json_extract_string(props, '$.k') AS k,
         CAST(value AS DECIMAL(18,2))::VARCHAR AS v FROM events),
turns AS (
  SELECT user_id AS session_id, event_id AS turn, epoch_us(ts) AS ts_us,
         {_pick_sql(USER_TEXTS, '(event_id // 3) % 6')} AS user_text,
         {_pick_sql(CANDIDATES, f'event_id % {_N}')} AS candidate_1,
         CASE WHEN event_id % 2 = 0 THEN {_pick_sql(CANDIDATES, f'(event_id + 5) % {_N}')} END AS candidate_2,
         CASE WHEN event_id % 3 = 0 THEN {_pick_sql(CANDIDATES, f'(event_id + 11) % {_N}')} END AS candidate_repair
  FROM turn_values)"""
