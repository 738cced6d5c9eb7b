"""Session, budget and turn queries (batch forms)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import redaction as R
from tideline.functions import vocabulary as V
from tideline.functions.numeric import micros, round_dp
from tideline.operators import budgets as B
from tideline.operators import sessions as S
from tideline.operators.calibration import interpolate
from tideline.operators.profiling import baseline_profile
from tideline.operators.turns import answer_turns, process_turns, read_turns
from tideline.plans.metrics import KNOTS, _interpolate_sql
from tideline.plans.quality import BASELINE_SQL
from tideline.plans.registry import query
from tideline.plans.scoring_queries import (
    MODEL,
    THRESHOLD,
    answer_sql,
    contributions_sql,
    drivers_sql,
    margin_sql,
)
from tideline.plans.tables import TURNS_SQL, calls, profile, round_sql, table, turns
from tideline.plans.text_queries import (
    canon_sql,
    envelope_sql,
    grounded_sql,
    reason_sql,
    redact_sql,
)

MAX_CALLS, WINDOW_US = 3, 48 * 3600 * 1_000_000
KINDS = ("click", "error", "purchase", "signup", "view")
ORDER = ("ts_us", "event_id")


def fact_events(spark, sf_dir):
    """Events as facts: the type is the feature, the number in props its value."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"),
        micros(F.col("ts")).alias("ts_us"),
        "event_id",
        "event_type",
        F.get_json_object("props", "$.k").alias("k"),
    )


def _facts():
    return {kind: F.when(F.col("event_type") == kind, F.col("k")) for kind in KINDS}


_EVENTS_SQL = """f AS (SELECT user_id AS session_id, epoch_us(ts) AS ts_us, event_id, event_type,
  json_extract_string(props, '$.k') AS k FROM events)"""


def _last_sql(partition: str) -> str:
    return ", ".join(
        f"last_value(CASE WHEN event_type = '{kind}' THEN k END IGNORE NULLS) OVER w AS {kind}"
        for kind in KINDS
    )


@query(
    "session_profile",
    f"""WITH {_EVENTS_SQL} SELECT session_id, event_id, {_last_sql('session_id')} FROM f
    WINDOW w AS (PARTITION BY session_id ORDER BY ts_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def session_profile(spark, sf_dir):
    rows = S.session_profile(
        fact_events(spark, sf_dir), session=["session_id"], order=ORDER, facts=_facts()
    )
    return rows.select("session_id", "event_id", *KINDS)


@query(
    "session_final",
    f"WITH {_EVENTS_SQL} SELECT session_id, "
    + ", ".join(
        f"max_by(k, (ts_us, event_id)) FILTER (WHERE event_type = '{kind}') AS {kind}" for kind in KINDS
    )
    + " FROM f GROUP BY session_id",
)
def session_final(spark, sf_dir):
    return S.final_profile(
        fact_events(spark, sf_dir), session=["session_id"], order=ORDER, facts=_facts()
    )


@query(
    "session_epochs",
    f"""WITH {_EVENTS_SQL}, e AS (SELECT *, CAST(sum(CASE WHEN event_type = 'error' AND event_id % 10 < 5 THEN 1 ELSE 0 END)
      OVER (PARTITION BY session_id ORDER BY ts_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS epoch FROM f)
    SELECT session_id, event_id, epoch, {_last_sql('session_id, epoch')} FROM e
    WINDOW w AS (PARTITION BY session_id, epoch ORDER BY ts_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def session_epochs(spark, sf_dir):
    reset = (F.col("event_type") == "error") & (F.col("event_id") % 10 < 5)
    epochs = S.session_epochs(
        fact_events(spark, sf_dir), session=["session_id"], order=ORDER, reset=reset
    )
    rows = S.session_profile(epochs, session=["session_id", "epoch"], order=ORDER, facts=_facts())
    return rows.select("session_id", "event_id", "epoch", *KINDS)


# --- budgets -------------------------------------------------------------------------

# The log of a key as a list: hits inside the window, and one row per call.
BUDGET_SQL = f"""
ordered AS (SELECT user_id AS key, epoch_us(ts) AS ts_us, event_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
log AS (
  SELECT key, i, event_id, ts_us, [ts_us] AS hits, true AS admitted FROM ordered WHERE i = 1
  UNION ALL
  SELECT key, i, event_id, ts_us,
    CASE WHEN len(kept) < {MAX_CALLS} THEN list_append(kept, ts_us) ELSE kept END, len(kept) < {MAX_CALLS}
  FROM (SELECT o.key, o.i, o.event_id, o.ts_us, [h for h in l.hits if o.ts_us - h <= {WINDOW_US}] AS kept
        FROM log l JOIN ordered o ON o.key = l.key AND o.i = l.i + 1))"""


def _budget(spark, sf_dir):
    return B.call_budget(calls(spark, sf_dir), max_calls=MAX_CALLS, window_us=WINDOW_US)


@query(
    "call_budget",
    f"WITH RECURSIVE {BUDGET_SQL} SELECT key, ts_us, event_id, admitted FROM log",
)
def call_budget(spark, sf_dir):
    return _budget(spark, sf_dir)


@query(
    "budget_report",
    f"""WITH RECURSIVE {BUDGET_SQL} SELECT key, ts_us, event_id, 'rate_limited' AS code,
      {WINDOW_US // 1_000_000}::BIGINT AS retry_after FROM log WHERE NOT admitted""",
)
def budget_report(spark, sf_dir):
    return B.budget_report(_budget(spark, sf_dir), WINDOW_US)


@query(
    "budget_by_key",
    f"""WITH RECURSIVE {BUDGET_SQL} SELECT key, count(*) FILTER (WHERE admitted) AS admitted,
      count(*) FILTER (WHERE NOT admitted) AS refused FROM log GROUP BY key""",
)
def budget_by_key(spark, sf_dir):
    return B.budget_by_key(_budget(spark, sf_dir))


# --- turns ---------------------------------------------------------------------------


def _judge_sql() -> str:
    parts = []
    for i in ("1", "2", "repair"):
        c = f"candidate_{i}"
        parts.append(
            f"({reason_sql(c)} = '' AND {envelope_sql(c)} = '') AS ok_{i}, "
            f"CASE WHEN json_valid({c}) AND json_type({c}) = 'OBJECT' THEN ({c}->>'$.out_of_scope') = 'true' END AS oos_{i}"
        )
    return ", ".join(parts)


def _entries_sql(c: str) -> str:
    value = f"({c}->'$.filters'->>x)"
    return (
        f"coalesce([{{'key': x, 'value': {canon_sql('x', value)}}} for x in json_keys({c}, '$.filters')], [])"
    )


READ_SQL = f"""{TURNS_SQL},
judged AS (SELECT *, {_judge_sql()} FROM turns),
chosen AS (SELECT *, CASE WHEN ok_1 THEN candidate_1 WHEN ok_2 THEN candidate_2 END AS c,
  CASE WHEN ok_1 THEN oos_1 WHEN ok_2 THEN oos_2 END AS refused,
  CASE WHEN ok_repair AND NOT oos_repair THEN candidate_repair END AS rc FROM judged),
entries AS (SELECT *, {_entries_sql('c')} AS first_e, {_entries_sql('rc')} AS second_e FROM chosen),
settled AS (SELECT *, CASE WHEN len([e for e in first_e if e.value IS NULL]) > 0 AND rc IS NOT NULL
  THEN second_e ELSE first_e END AS e FROM entries),
verdict AS (SELECT *, [x.key for x in e if x.value IS NULL] AS bad,
  CASE WHEN c IS NULL THEN 'invalid' WHEN refused THEN 'out_of_scope'
    WHEN len([x for x in e if x.value IS NULL]) > 0 THEN 'unmapped' ELSE 'ok' END AS status FROM settled),
read AS (SELECT session_id, turn, ts_us, user_text, status,
  CASE WHEN status = 'unmapped' THEN bad[1] END AS bad_feature,
  CASE WHEN status = 'ok' THEN [x for x in e if x.key NOT IN ('tenure', 'Monthly_Charges', 'Total_Charges')
    OR {grounded_sql('x.value', 'user_text')}] END AS facts FROM verdict)"""
PROCESSED_SQL = f"""{READ_SQL},
wide AS (SELECT session_id, turn, ts_us, status, bad_feature, {', '.join(
    f"[x.value for x in facts if x.key = '{f}'][1] AS s_{f}" for f in V.FEATURES)} FROM read),
carried AS (SELECT session_id, turn, ts_us, status, bad_feature, {', '.join(
    f"last_value(s_{f} IGNORE NULLS) OVER w AS p_{f}" for f in V.FEATURES)} FROM wide
  WINDOW w AS (PARTITION BY session_id ORDER BY ts_us, turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
processed AS (SELECT *, array_to_string(list_sort([x for x in [{', '.join(
    f"'{f}=' || p_{f}" for f in V.FEATURES)}] if x IS NOT NULL]), ', ') AS profile FROM carried)"""


@query(
    "read_turns",
    f"""WITH {READ_SQL} SELECT turn, status, bad_feature,
      array_to_string(list_sort([x.key || '=' || x.value for x in facts]), ', ') AS facts FROM read""",
)
def read_turns_query(spark, sf_dir):
    read = read_turns(turns(spark, sf_dir))
    facts = F.when(F.col("status") == "ok", S.facts_text(F.col("facts")))
    return read.select("turn", "status", "bad_feature", facts.alias("facts"))


@query(
    "process_turns",
    f"WITH {PROCESSED_SQL} SELECT session_id, turn, status, bad_feature, profile FROM processed",
)
def process_turns_query(spark, sf_dir):
    rows = process_turns(turns(spark, sf_dir))
    return rows.select(
        "session_id", "turn", "status", "bad_feature", S.facts_text(F.col("profile")).alias("profile")
    )


def _what_if_sql() -> str:
    columns = []
    for f in V.FEATURES:
        if f in V.NUMERIC_FEATURES:
            columns.append(f"coalesce(p_{f}::DOUBLE, b.{f}) AS {f}")
        elif f == V.FLAG:
            columns.append(f"coalesce(p_{f} = 'Yes', b.{f}) AS {f}")
        else:
            columns.append(f"coalesce(p_{f}, b.{f}) AS {f}")
    return f"""rows_w AS (SELECT p.session_id, p.turn, p.status, p.bad_feature, p.profile, {', '.join(columns)}
  FROM processed p, baseline b),
scored_w AS (SELECT *, CASE WHEN tenure > 0 THEN {round_sql('Total_Charges / tenure', 4)} END AS avg_monthly FROM rows_w),
margin_w AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-{margin_sql()})) AS p, {contributions_sql()} AS contrib FROM scored_w)"""


@query(
    "answer_turns",
    f"""WITH {PROCESSED_SQL}, {BASELINE_SQL}, {_what_if_sql()}, d AS (SELECT *, {_interpolate_sql('p')} AS calibrated, {drivers_sql('contrib')} AS drivers FROM margin_w)
    SELECT session_id, turn, CASE status WHEN 'ok' THEN {answer_sql('calibrated', 'profile', 'drivers', 'p')}
      WHEN 'invalid' THEN '{V.REPLY_INVALID.replace("'", "''")}'
      WHEN 'out_of_scope' THEN '{V.REPLY_OUT_OF_SCOPE.replace("'", "''")}'
      ELSE replace('{V.REPLY_UNMAPPED.replace("'", "''")}', '%s', bad_feature) END AS reply,
      CASE WHEN status = 'ok' THEN {round_sql('calibrated', 4)} END AS churn_probability,
      CASE WHEN status = 'ok' THEN CASE WHEN p >= {THRESHOLD} THEN 'Churner' ELSE 'Not churner' END END AS churn_label,
      CASE WHEN status = 'ok' THEN array_to_string([x.feature || '=' || {round_sql('x.c', 4)}::VARCHAR for x in drivers], ', ') END AS drivers
    FROM d""",
)
def answer_turns_query(spark, sf_dir):
    people = profile(spark, sf_dir)
    replies = answer_turns(
        process_turns(turns(spark, sf_dir)),
        baseline_profile(people),
        MODEL,
        threshold=THRESHOLD,
        types=dict(people.dtypes),
        calibrate=lambda score: interpolate(score, KNOTS),
    )
    payload = F.col("payload")
    return replies.select(
        "session_id",
        "turn",
        "reply",
        round_dp(payload["churn_probability"], 4).alias("churn_probability"),
        payload["churn_label"].alias("churn_label"),
        F.array_join(
            F.transform(
                payload["drivers"],
                lambda d: F.concat(d["feature"], F.lit("="), d["contribution"].cast("string")),
            ),
            ", ",
        ).alias("drivers"),
    )


@query(
    "session_log",
    f"""WITH {PROCESSED_SQL} SELECT session_id, turn, {redact_sql('user_text')} AS message, {redact_sql('profile')} AS profile
    FROM processed JOIN (SELECT session_id, turn, user_text FROM turns) USING (session_id, turn)""",
)
def session_log(spark, sf_dir):
    """What may be logged of a turn: message and profile, both scrubbed."""
    rows = process_turns(turns(spark, sf_dir))
    return rows.select(
        "session_id",
        "turn",
        R.redact(F.col("user_text")).alias("message"),
        S.facts_text(R.redact_map(F.col("profile"))).alias("profile"),
    )
