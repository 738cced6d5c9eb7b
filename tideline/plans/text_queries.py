"""Text, request and redaction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import redaction as R
from tideline.functions import text as T
from tideline.functions import vocabulary as V
from tideline.functions.requests import accepted, check_requests, slot_ok
from tideline.operators import evaluation as E
from tideline.plans.registry import query
from tideline.plans.tables import TURNS_SQL, round_sql, table, turns

# --- SQL twins ------------------------------------------------------------------


def normalize_sql(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _has(n: str, phrase: str) -> str:
    return f"contains(' ' || {n} || ' ', ' {phrase} ')"


def yes_no_sql(n: str) -> str:
    words = f"string_split({n}, ' ')"
    yes = f"list_has_any({words}, {_list(V.YES_WORDS)})"
    no = f"list_has_any({words}, {_list(V.NO_WORDS)})"
    return f"(CASE WHEN {yes} AND NOT {no} THEN 'Yes' WHEN {no} AND NOT {yes} THEN 'No' END)"


def category_sql(feature: str, n: str) -> str:
    parts = []
    for name, wordings in V.WORDINGS.items():
        parts += [f"WHEN {feature} = '{name}' AND {n} = '{p}' THEN '{c}'" for p, c in wordings]
        parts += [
            f"WHEN {feature} = '{name}' AND {_has(n, p)} THEN '{c}'"
            for p, c in sorted(wordings, key=lambda w: -len(w[0].split()))
        ]
    return f"(CASE {' '.join(parts)} END)"


def flag_sql(feature: str, n: str) -> str:
    phrases = " ".join(
        f"WHEN {_has(n, p)} THEN '{c}'" for p, c in (V.NO_INTERNET, V.NO_PHONE, V.NOT_SUBSCRIBED)
    )
    return (
        f"(CASE WHEN {feature} = '{V.FLAG}' THEN {yes_no_sql(n)} "
        f"WHEN {feature} IN {_in(V.SERVICE_FLAGS)} THEN CASE {phrases} ELSE {yes_no_sql(n)} END END)"
    )


def number_sql(value: str) -> str:
    return rf"nullif(regexp_extract({value}, '[0-9]+(?:\.[0-9]+)?'), '')"


def canon_sql(feature: str, value: str) -> str:
    n = normalize_sql(value)
    return (
        f"(CASE WHEN {feature} IN {_in(V.WORDINGS)} THEN {category_sql(feature, n)} "
        f"WHEN {feature} IN {_in((V.FLAG, *V.SERVICE_FLAGS))} THEN {flag_sql(feature, n)} "
        f"WHEN {feature} IN {_in(V.NUMERIC_FEATURES)} THEN {number_sql(value)} "
        f"ELSE trim({value}) END)"
    )


def grounded_sql(value: str, text: str) -> str:
    runs = rf"regexp_extract_all({text}, '[0-9]+(?:[.,][0-9]+)*')"
    return (
        f"coalesce(len([run for run in {runs} if try_cast(replace(run, ',', '') AS DOUBLE) "
        f"= try_cast(replace({value}, ',', '') AS DOUBLE)]) > 0, false)"
    )


_PHONE_SQL = r"(^|[^\pL\pM\p{Nd}\p{Pc}-])\+?\p{Nd}[\p{Nd}\s\pZ().-]{7,}\p{Nd}"


def redact_sql(t: str, ids: str = R.CUSTOMER_ID) -> str:
    out = f"regexp_replace({t}, '{R.EMAIL}', '{R.MARK_EMAIL}', 'g')"
    out = f"regexp_replace({out}, '{ids}', '{R.MARK_CUSTOMER_ID}', 'g')"
    return rf"regexp_replace({out}, '{_PHONE_SQL}', '\1{R.MARK_PHONE}', 'g')"


def reason_sql(c: str) -> str:
    """CASE with the request verdict of JSON column ``c``."""
    keys = f"json_keys({c})"
    names = _in(V.FEATURES)
    fkeys = f"json_keys({c}, '$.filters')"
    return f"""(CASE WHEN {c} IS NULL OR NOT json_valid({c}) THEN 'not_json'
      WHEN json_type({c}) <> 'OBJECT' THEN 'not_object'
      WHEN len([k for k in {keys} if k NOT IN {_in(V.REQUEST_KEYS)}]) > 0 THEN 'unknown_key'
      WHEN list_contains({keys}, 'target_features') AND json_type({c}, '$.target_features') <> 'ARRAY' THEN 'bad_target'
      WHEN list_contains({keys}, 'target_features') AND len([x for x in json_extract({c}, '$.target_features[*]')
        if json_type(x) <> 'VARCHAR' OR (x->>'$') NOT IN {names}]) > 0 THEN 'bad_target'
      WHEN list_contains({keys}, 'filters') AND json_type({c}, '$.filters') <> 'OBJECT' THEN 'bad_filters'
      WHEN list_contains({keys}, 'filters') AND len([k for k in {fkeys} if k NOT IN {names}]) > 0 THEN 'bad_filter_name'
      WHEN list_contains({keys}, 'filters') AND len([x for x in json_extract({c}, '$.filters.*')
        if json_type(x) <> 'VARCHAR']) > 0 THEN 'bad_filter_value'
      WHEN list_contains({keys}, 'out_of_scope') AND json_type({c}, '$.out_of_scope') <> 'BOOLEAN' THEN 'bad_flag'
      ELSE '' END)"""


def envelope_sql(c: str) -> str:
    return f"""(CASE WHEN {c} IS NULL OR NOT json_valid({c}) THEN 'not_json'
      WHEN json_type({c}) <> 'OBJECT' THEN 'not_object'
      WHEN len([k for k in json_keys({c}) if k NOT IN {_in(V.REQUEST_KEYS)}]) > 0 THEN 'unknown_key'
      WHEN coalesce(json_type({c}, '$.out_of_scope'), 'NULL') <> 'BOOLEAN' THEN 'bad_flag'
      ELSE '' END)"""


# --- wordings ---------------------------------------------------------------------

# Raw wordings tried against every feature; %K comes from the event.
VALUES = (
    "Fiber-optic", "fiber_optic", "FIBER  OPTIC", "fibre optic", "DSL", "month-to-month",
    "on a Month-to-month contract", "credit card (automatic)", "bank transfer automatic",
    "yes!", "No internet service", "a fiber-optic customer", "credit card automatic payment",
    "I am not subscribed", "no thanks", "no phone service", "about %K months", "$%K.50 a month",
    "yes and no", "", "m", "Female", "e-check", "two year", "1,2%K", "y", "maybe",
)


def wordings(spark, sf_dir, features=V.FEATURES):
    """Every event as a (feature, raw value) pair, walking through the combinations."""
    k = F.get_json_object("props", "$.k")
    feature = F.element_at(
        F.array(*[F.lit(f) for f in features]), (F.col("event_id") % len(features) + 1).cast("int")
    )
    value = F.element_at(
        F.array(*[F.lit(v) for v in VALUES]),
        (F.expr(f"event_id div {len(features)}") % len(VALUES) + 1).cast("int"),
    )
    return table(spark, sf_dir, "events").select(
        "event_id", feature.alias("feature"), F.replace(value, F.lit("%K"), k).alias("value")
    )


def wordings_sql(features=V.FEATURES) -> str:
    n = len(features)
    return f"""wordings AS (SELECT event_id, ({_list(features)})[event_id % {n} + 1] AS feature,
  replace(({_list(VALUES)})[(event_id // {n}) % {len(VALUES)} + 1], '%K', json_extract_string(props, '$.k')) AS value
  FROM events)"""


WORDINGS_SQL = wordings_sql()
DICTIONARY_FEATURES = tuple(V.WORDINGS)
FLAG_FEATURES = (V.FLAG, *V.SERVICE_FLAGS)


@query("normalize_text", f"SELECT doc_id, {normalize_sql('text')} AS normalized FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.normalize_text(F.col("text")).alias("normalized")
    )


@query(
    "canon_category",
    f"WITH {wordings_sql(DICTIONARY_FEATURES)} SELECT event_id, feature, "
    f"{category_sql('feature', normalize_sql('value'))} AS canonical FROM wordings",
)
def canon_category(spark, sf_dir):
    rows = wordings(spark, sf_dir, DICTIONARY_FEATURES)
    folded = rows.withColumn("needle", T.normalize_text(F.col("value")))
    return folded.select(
        "event_id",
        "feature",
        T.canon_category(F.col("feature"), F.col("needle")).alias("canonical"),
    )


@query(
    "contains_phrase",
    f"""WITH n AS (SELECT conv_id, turn, {normalize_sql('text')} AS t FROM conversations)
    SELECT conv_id, turn, {_has('t', 'the')} AS has_the, {_has('t', 'of the')} AS has_of_the FROM n""",
)
def contains_phrase(spark, sf_dir):
    n = T.normalize_text(F.col("text"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        T.contains_phrase(n, "the").alias("has_the"),
        T.contains_phrase(n, "of the").alias("has_of_the"),
    )


@query(
    "yes_no",
    f"WITH {WORDINGS_SQL} SELECT event_id, {yes_no_sql(normalize_sql('value'))} AS answer FROM wordings",
)
def yes_no(spark, sf_dir):
    folded = wordings(spark, sf_dir).withColumn("needle", T.normalize_text(F.col("value")))
    return folded.select("event_id", T.yes_no(F.col("needle")).alias("answer"))


@query(
    "canon_service_flag",
    f"WITH {wordings_sql(FLAG_FEATURES)} SELECT event_id, feature, "
    f"{flag_sql('feature', normalize_sql('value'))} AS canonical FROM wordings",
)
def canon_service_flag(spark, sf_dir):
    rows = wordings(spark, sf_dir, FLAG_FEATURES)
    folded = rows.withColumn("needle", T.normalize_text(F.col("value")))
    return folded.select(
        "event_id",
        "feature",
        T.canon_service_flag(F.col("feature"), F.col("needle")).alias("canonical"),
    )


@query(
    "extract_number",
    f"SELECT doc_id, {number_sql('text')} AS first_number FROM documents",
)
def extract_number(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.extract_number(F.col("text")).alias("first_number")
    )


@query(
    "canon_value",
    f"WITH {WORDINGS_SQL} SELECT event_id, feature, {canon_sql('feature', 'value')} AS canonical FROM wordings",
)
def canon_value(spark, sf_dir):
    return T.canonicalize(wordings(spark, sf_dir)).select("event_id", "feature", "canonical")


@query(
    "grounded_number",
    f"""WITH {TURNS_SQL}, v AS (SELECT turn, user_text, number FROM turns,
      (SELECT unnest(['24', '40.50', '0', '1.2.3', '1,205', 'weeks']) AS number))
    SELECT turn, number, {grounded_sql('number', 'user_text')} AS grounded FROM v""",
)
def grounded_number(spark, sf_dir):
    numbers = F.array(*[F.lit(x) for x in ("24", "40.50", "0", "1.2.3", "1,205", "weeks")])
    tried = turns(spark, sf_dir).select("turn", "user_text", F.explode(numbers).alias("number"))
    return tried.select(
        "turn", "number", T.grounded_number(F.col("number"), F.col("user_text")).alias("grounded")
    )


# --- requests -----------------------------------------------------------------------


@query(
    "validate_request",
    f"""WITH {TURNS_SQL}, r AS (SELECT turn, candidate_1 AS c, {reason_sql('candidate_1')} AS reason FROM turns)
    SELECT turn, reason, CASE WHEN reason = '' THEN 'ok' ELSE 'invalid' END AS status,
      CASE WHEN reason = '' THEN array_to_string([x->>'$' for x in json_extract(c, '$.target_features[*]')], ',') END AS targets,
      CASE WHEN reason = '' THEN array_to_string(coalesce([k || '=' || (c->'$.filters'->>k) for k in json_keys(c, '$.filters')], []), ',') END AS filters,
      CASE WHEN reason = '' THEN coalesce(CAST(c->>'$.out_of_scope' AS BOOLEAN), false) END AS out_of_scope
    FROM r""",
)
def validate_request(spark, sf_dir):
    judged = check_requests(turns(spark, sf_dir).select("turn", "candidate_1"), "candidate_1")
    stated = F.transform(
        F.map_entries("filters"), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return judged.select(
        "turn",
        "reason",
        "status",
        F.array_join("targets", ",").alias("targets"),
        F.array_join(stated, ",").alias("filters"),
        "out_of_scope",
    )


@query(
    "validate_envelope",
    f"WITH {TURNS_SQL} SELECT turn, {envelope_sql('candidate_1')} AS envelope FROM turns",
)
def validate_envelope(spark, sf_dir):
    judged = check_requests(turns(spark, sf_dir).select("turn", "candidate_1"), "candidate_1")
    return judged.select("turn", "envelope")


def _slot_sql(feature: str, value: str) -> str:
    menus = " ".join(f"WHEN {feature} = '{f}' THEN {value} IN {_in(m)}" for f, m in V.MENUS.items())
    return (
        f"coalesce(CASE WHEN {feature} IN {_in(V.NUMERIC_FEATURES)} "
        f"THEN regexp_matches({value}, '{V.NUMBER_SLOT}') {menus} ELSE false END, false)"
    )


@query(
    "slot_pattern",
    f"WITH {WORDINGS_SQL} SELECT event_id, feature, {_slot_sql('feature', 'value')} AS raw_fits, "
    f"{_slot_sql('feature', canon_sql('feature', 'value'))} AS canonical_fits FROM wordings",
)
def slot_pattern(spark, sf_dir):
    feature, value = F.col("feature"), F.col("value")
    read = T.canonicalize(wordings(spark, sf_dir))
    return read.select(
        "event_id",
        "feature",
        slot_ok(feature, value).alias("raw_fits"),
        slot_ok(feature, F.col("canonical")).alias("canonical_fits"),
    )


@query(
    "schema_validity_rate",
    f"""WITH {TURNS_SQL}, r AS (SELECT (turn % 7)::BIGINT AS batch,
      {reason_sql('candidate_1')} = '' AND {envelope_sql('candidate_1')} = '' AS valid FROM turns)
    SELECT batch, count(*) AS candidates, count(*) FILTER (WHERE valid) AS valid,
      {round_sql('avg(valid::INTEGER)', 6)} AS validity FROM r GROUP BY batch""",
)
def schema_validity_rate(spark, sf_dir):
    judged = check_requests(turns(spark, sf_dir).select("turn", "candidate_1"), "candidate_1")
    return E.validity_rate(
        judged.withColumn("batch", F.col("turn") % 7), accepted(), ["batch"]
    )


def evaluation_cases(spark, sf_dir):
    """Events as extraction cases: expected and predicted slots, and the flag."""
    e = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("long")
    names = F.array(*[F.lit(f) for f in V.FEATURES])

    def name(i):
        return F.element_at(names, (i % len(V.FEATURES) + 1).cast("int"))

    empty = F.array().cast("array<string>")
    return table(spark, sf_dir, "events").select(
        "event_type",
        F.when(e % 7 == 0, F.array(F.lit("Loyalty"))).otherwise(F.array(name(e), name(e * 3 + 1))).alias("expected"),
        F.when(e % 14 == 0, empty).otherwise(F.array(name(e), name(e + k % 3), F.lit("Dual"))).alias("predicted"),
        (e % 14 == 0).alias("out_of_scope"),
    )


_NAME = f"({_list(V.FEATURES)})[({{i}}) % {len(V.FEATURES)} + 1]"


@query(
    "slot_accuracy",
    f"""WITH c AS (SELECT event_type, event_id % 14 = 0 AS oos,
      CASE WHEN event_id % 7 = 0 THEN [] ELSE list_distinct([{_NAME.format(i='event_id')}, {_NAME.format(i='event_id * 3 + 1')}]) END AS expected,
      CASE WHEN event_id % 14 = 0 THEN [] ELSE [{_NAME.format(i='event_id')},
        {_NAME.format(i="event_id + json_extract_string(props, '$.k')::BIGINT % 3")}, 'Dual'] END AS predicted FROM events),
    h AS (SELECT *, len(expected) AS slots, len(list_intersect(expected, predicted)) AS hits FROM c),
    g AS (SELECT event_type, count(*) AS cases, sum(slots)::BIGINT AS slots, sum(hits)::BIGINT AS hits,
      count(*) FILTER (WHERE CASE WHEN slots = 0 THEN oos AND len(predicted) = 0 ELSE hits = slots END) AS correct_cases
      FROM h GROUP BY event_type)
    SELECT *, {round_sql('hits::DOUBLE / greatest(slots, 1)', 4)} AS slot_accuracy,
      {round_sql('correct_cases::DOUBLE / cases', 4)} AS case_accuracy FROM g""",
)
def slot_accuracy(spark, sf_dir):
    return E.slot_accuracy(evaluation_cases(spark, sf_dir), ["event_type"])


# --- redaction ------------------------------------------------------------------------


def planted_documents(spark, sf_dir):
    """Documents, some with a customer id appended, plain or hyphenated."""
    d = F.col("doc_id")
    digits = F.lpad((d % 10000).cast("string"), 4, "0")
    suffix = (
        F.when(d % 10 == 3, F.concat(F.lit(" id "), digits, F.lit("VHVEG")))
        .when(d % 10 == 6, F.concat(F.lit(" id "), digits, F.lit("-VHVEG")))
        .otherwise("")
    )
    return table(spark, sf_dir, "documents").withColumn("text", F.concat("text", suffix))


_PLANTED = """planted AS (SELECT doc_id, lang, source, text || CASE
  WHEN doc_id % 10 = 3 THEN ' id ' || lpad((doc_id % 10000)::VARCHAR, 4, '0') || 'VHVEG'
  WHEN doc_id % 10 = 6 THEN ' id ' || lpad((doc_id % 10000)::VARCHAR, 4, '0') || '-VHVEG' ELSE '' END AS text
  FROM documents)"""


@query(
    "redact_documents",
    f"""WITH {_PLANTED} SELECT doc_id, {redact_sql('text')} AS redacted,
      md5({redact_sql('text', R.CUSTOMER_ID_HYPHEN)}) AS loose_digest FROM planted""",
)
def redact_documents(spark, sf_dir):
    text = F.col("text")
    return planted_documents(spark, sf_dir).select(
        "doc_id",
        R.redact(text).alias("redacted"),
        F.md5(R.redact(text, strict=False)).alias("loose_digest"),
    )


@query(
    "redact_map",
    f"""WITH v AS (SELECT conv_id, turn, {redact_sql("'user' || conv_id || '@example.com'")} AS k1,
      {redact_sql("'call 080555' || lpad((conv_id % 10000)::VARCHAR, 4, '0')")} AS v1, {redact_sql('text')} AS v2 FROM conversations)
    SELECT conv_id, turn, '[EMAIL]' = k1 AS key_scrubbed, v1 AS phone_value, v2 AS text_value FROM v""",
)
def redact_map(spark, sf_dir):
    facts = F.create_map(
        F.concat(F.lit("user"), F.col("conv_id"), F.lit("@example.com")),
        F.concat(F.lit("call 080555"), F.lpad((F.col("conv_id") % 10000).cast("string"), 4, "0")),
        F.lit("text"),
        F.col("text"),
    )
    return (
        table(spark, sf_dir, "conversations")
        .withColumn("facts", R.redact_map(facts))
        .select(
            "conv_id",
            "turn",
            F.map_contains_key("facts", R.MARK_EMAIL).alias("key_scrubbed"),
            F.col("facts")[R.MARK_EMAIL].alias("phone_value"),
            F.col("facts")["text"].alias("text_value"),
        )
    )


_NO_EMAIL = f"regexp_replace(text, '{R.EMAIL}', '{R.MARK_EMAIL}', 'g')"
_NO_IDS = f"regexp_replace(no_email, '{R.CUSTOMER_ID}', '{R.MARK_CUSTOMER_ID}', 'g')"


@query(
    "pii_report",
    f"""WITH {_PLANTED}, a AS (SELECT *, {_NO_EMAIL} AS no_email FROM planted),
    b AS (SELECT *, {_NO_IDS} AS no_ids FROM a)
    SELECT source, lang, count(*) AS documents,
      CAST(sum(len(regexp_extract_all(text, '{R.EMAIL}'))) AS BIGINT) AS emails,
      CAST(sum(len(regexp_extract_all(no_email, '{R.CUSTOMER_ID}'))) AS BIGINT) AS customer_ids,
      CAST(sum(len(regexp_extract_all(no_ids, '{_PHONE_SQL}'))) AS BIGINT) AS phones
    FROM b GROUP BY source, lang""",
)
def pii_report(spark, sf_dir):
    kinds = R.pii_counts(F.col("text"))
    return (
        planted_documents(spark, sf_dir)
        .groupBy("source", "lang")
        .agg(F.count("*").alias("documents"), *[F.sum(c).alias(n) for n, c in kinds.items()])
    )


@query(
    "url_path_only",
    r"""SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages""",
)
def url_path_only(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", R.url_path_only(F.col("url")).alias("path")
    )


@query(
    "key_digest",
    """SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN 'token:' || substr(sha256('secret-' || user_id), 1, 16)
      WHEN event_id % 2 = 0 THEN 'addr:10.0.0.' || (user_id % 256) ELSE 'addr:unknown' END AS caller FROM events""",
)
def key_digest(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    token = F.when(e % 5 != 0, F.concat(F.lit("secret-"), u))
    host = F.when(e % 2 == 0, F.concat(F.lit("10.0.0."), u % 256))
    return table(spark, sf_dir, "events").select(
        "event_id", R.key_digest(token, host).alias("caller")
    )
