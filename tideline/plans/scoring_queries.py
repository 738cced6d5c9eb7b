"""Scoring queries with a fixed linear model."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import vocabulary as V
from tideline.functions.numeric import round_dp
from tideline.operators import curves as U
from tideline.operators import evaluation as E
from tideline.operators import scoring as G
from tideline.operators import splits as S
from tideline.operators.calibration import interpolate
from tideline.operators.profiling import baseline_profile
from tideline.plans.metrics import AUC_SQL, KNOTS, _interpolate_sql, cuts_sql, metrics_sql
from tideline.plans.partitions import _split_sql
from tideline.plans.quality import BASELINE_SQL, EXTERNAL_SQL, external, EXTERNAL_MAPPING
from tideline.plans.registry import query
from tideline.plans.tables import PROFILE_SQL, profile, round_sql
from tideline.operators.cleaning import binarize_label, map_schema

# Fixed coefficients: (weight, fill, mean, std) and (weight, background share).
MODEL = G.LinearModel(
    intercept=-1.2,
    numeric={
        "tenure": (-0.55, 20.0, 20.0, 18.0),
        "Monthly_Charges": (0.15, 64.0, 64.0, 30.0),
        "Total_Charges": (-0.2, 400000.0, 400000.0, 350000.0),
        "avg_monthly": (0.05, 18000.0, 18000.0, 15000.0),
    },
    categorical={
        "Contract": {"Month-to-month": (0.9, 0.55), "One year": (-0.4, 0.2), "Two year": (-1.1, 0.25)},
        "Internet_Service": {"Fiber optic": (0.6, 0.45), "DSL": (-0.1, 0.3), "No": (-0.5, 0.25)},
        "Senior_Citizen": {"true": (0.35, 0.2)},
        "Paperless_Billing": {"Yes": (0.2, 0.6), "No": (-0.2, 0.4)},
        "Tech_Support": {"No": (0.25, 0.4), "Yes": (-0.25, 0.35)},
    },
)
THRESHOLD = 0.35


# --- SQL twins ---------------------------------------------------------------------


def _terms_sql() -> dict[str, str]:
    out = {}
    for c, (weight, fill, mean, std) in MODEL.numeric.items():
        out[c] = f"{weight}::DOUBLE * ((coalesce({c}::DOUBLE, {fill}::DOUBLE) - {mean}::DOUBLE) / {std}::DOUBLE)"
    for c, values in MODEL.categorical.items():
        cases = " ".join(f"WHEN {c}::VARCHAR = '{v}' THEN {w}::DOUBLE" for v, (w, _) in values.items())
        out[c] = f"CASE {cases} ELSE 0.0::DOUBLE END"
    return out


def margin_sql() -> str:
    sql = f"{MODEL.intercept}::DOUBLE"
    for term in _terms_sql().values():
        sql = f"({sql} + {term})"
    return sql


def contributions_sql() -> str:
    expected = MODEL.expected()
    parts = [
        f"{{'place': {i}, 'feature': '{c}', 'c': ({t}) - {expected[c]!r}::DOUBLE}}"
        for i, (c, t) in enumerate(_terms_sql().items())
    ]
    return f"[{', '.join(parts)}]"


def drivers_sql(contributions: str) -> str:
    return f"list_sort([{{'size': -abs(x.c), 'place': x.place, 'feature': x.feature, 'c': x.c}} for x in {contributions}])[1:3]"


def fixed4_sql(x: str) -> str:
    return f"printf('%.4f', {round_sql(x, 4)})"


def short4_sql(x: str) -> str:
    return rf"regexp_replace({fixed4_sql(x)}, '(\.\d+?)0+$', '\1')"


def answer_sql(p: str, profile_text: str, drivers: str, judged: str | None = None) -> str:
    """The answer shows ``p``; its label is of ``judged``, or of ``p`` too."""
    reasons = f"array_to_string([d.feature || ' weight ' || {short4_sql('d.c')} for d in {drivers}], '; ')"
    return (
        f"('Estimated churn probability ' || {fixed4_sql(p)} || ' — ' || "
        f"CASE WHEN {judged or p} >= {THRESHOLD} THEN 'Churner' ELSE 'Not churner' END || ' at threshold ' || "
        f"{fixed4_sql(f'{THRESHOLD}::DOUBLE')} || '. Profile used: ' || "
        f"CASE WHEN {profile_text} <> '' THEN {profile_text} ELSE '{V.REPLY_BASELINE}' END || "
        f"'. Top drivers: ' || {reasons} || '.')"
    )


_P = f"1.0::DOUBLE / (1.0::DOUBLE + exp(-{margin_sql()}))"
SCORED_PROFILE = f"{PROFILE_SQL}, model_scores AS (SELECT *, {_P} AS score, {contributions_sql()} AS contrib FROM profile)"


# --- queries -------------------------------------------------------------------------


@query(
    "linear_score",
    f"WITH {SCORED_PROFILE} SELECT customerID, {round_sql('score', 6)} AS score FROM model_scores",
)
def linear_score(spark, sf_dir):
    scored = G.score(profile(spark, sf_dir), MODEL)
    return scored.select(V.ROW_KEY, round_dp(F.col("score"), 6).alias("score"))


@query(
    "score_calibrated",
    f"WITH {SCORED_PROFILE} SELECT customerID, {round_sql('score', 6)} AS raw, {round_sql(_interpolate_sql('score'), 6)} AS calibrated FROM model_scores",
)
def score_calibrated(spark, sf_dir):
    scored = G.score(profile(spark, sf_dir), MODEL)
    return scored.select(
        V.ROW_KEY,
        round_dp(F.col("score"), 6).alias("raw"),
        round_dp(interpolate(F.col("score"), KNOTS), 6).alias("calibrated"),
    )


@query(
    "label_at_threshold",
    f"""WITH {SCORED_PROFILE} SELECT
      CASE WHEN score >= {THRESHOLD} THEN 'Churner' ELSE 'Not churner' END AS on_raw,
      CASE WHEN {_interpolate_sql('score')} >= {THRESHOLD} THEN 'Churner' ELSE 'Not churner' END AS on_calibrated,
      Churn, count(*) AS n FROM model_scores GROUP BY ALL""",
)
def label_at_threshold(spark, sf_dir):
    scored = G.score(profile(spark, sf_dir), MODEL)
    limit = F.lit(THRESHOLD)
    return (
        scored.select(
            G.label_at_threshold(F.col("score"), limit).alias("on_raw"),
            G.label_at_threshold(interpolate(F.col("score"), KNOTS), limit).alias("on_calibrated"),
            V.LABEL,
        )
        .groupBy("on_raw", "on_calibrated", V.LABEL)
        .agg(F.count("*").alias("n"))
    )


@query(
    "top_drivers",
    f"""WITH {SCORED_PROFILE}, d AS (SELECT customerID, {drivers_sql('contrib')} AS drivers FROM model_scores),
    u AS (SELECT customerID, unnest(range(1, 4)) AS place, drivers FROM d)
    SELECT customerID, place::INTEGER AS place, drivers[place].feature AS feature, {round_sql('drivers[place].c', 6)} AS contribution FROM u""",
)
def top_drivers(spark, sf_dir):
    rows = profile(spark, sf_dir).select(
        V.ROW_KEY, F.posexplode(G.top_drivers(MODEL.contributions()))
    )
    return rows.select(
        V.ROW_KEY,
        (F.col("pos") + 1).alias("place"),
        F.col("col.feature").alias("feature"),
        round_dp(F.col("col.contribution"), 6).alias("contribution"),
    )


def _long_names(c: str) -> list[tuple[str, str]]:
    """(prepared name, value expression) pairs of one raw feature."""
    return [(f"cat__{c}_{v}", f"CASE WHEN {c}::VARCHAR = '{v}' THEN {w}::DOUBLE ELSE 0.0::DOUBLE END - {w * share!r}::DOUBLE")
            for v, (w, share) in MODEL.categorical[c].items()]


_LONG = " UNION ALL ".join(
    f"SELECT customerID, '{c}' AS feature, {value} AS contribution FROM profile"
    for c in MODEL.categorical
    for _, value in _long_names(c)
)


@query(
    "fold_to_raw",
    f"""WITH {PROFILE_SQL}, long AS ({_LONG})
    SELECT customerID, feature, {round_sql('sum(contribution)', 6)} AS contribution FROM long GROUP BY customerID, feature""",
)
def fold_to_raw(spark, sf_dir):
    """Contributions of single prepared columns summed per raw column."""
    cells = []
    for c, values in MODEL.categorical.items():
        for v, (w, share) in values.items():
            hot = F.when(F.col(c).cast("string") == v, F.lit(w)).otherwise(F.lit(0.0))
            cells.append(
                F.struct(F.lit(f"cat__{c}_{v}").alias("name"), (hot - F.lit(w * share)).alias("contribution"))
            )
    long = profile(spark, sf_dir).select(V.ROW_KEY, F.inline(F.array(*cells)))
    folded = G.fold_to_raw(long, V.ROW_KEY, V.FEATURES)
    return folded.withColumn("contribution", round_dp(F.col("contribution"), 6))


def scenarios(spark, sf_dir):
    """One what-if scenario per customer: some of their own facts on the baseline."""
    return profile(spark, sf_dir).select(
        V.ROW_KEY,
        F.map_filter(
            F.create_map(
                F.lit("Contract"), F.col("Contract"),
                F.lit("Senior_Citizen"), F.when(F.col("Senior_Citizen"), "Yes").otherwise("No"),
                F.lit("tenure"), F.when(F.col("tenure") % 3 > 0, F.col("tenure").cast("string")),
                F.lit("Internet_Service"), F.when(F.col("tenure") % 2 == 0, F.col("Internet_Service")),
            ),
            lambda _, v: v.isNotNull(),
        ).alias("facts"),
    )


_OVERRIDES = {
    "Contract": "s.Contract",
    "Senior_Citizen": "s.Senior_Citizen",
    "tenure": "CASE WHEN s.tenure % 3 > 0 THEN s.tenure::DOUBLE ELSE b.tenure END",
    "Internet_Service": "CASE WHEN s.tenure % 2 = 0 THEN s.Internet_Service ELSE b.Internet_Service END",
}
WHAT_IF_SQL = f"""{PROFILE_SQL}, {BASELINE_SQL.split(PROFILE_SQL + ',', 1)[1]},
scenario_rows AS (SELECT s.customerID, {', '.join(f"{_OVERRIDES.get(f, 'b.' + f)} AS {f}" for f in V.FEATURES)}
  FROM profile s, baseline b),
scenario_full AS (SELECT *, CASE WHEN tenure > 0 THEN {round_sql('Total_Charges / tenure', 4)} END AS avg_monthly FROM scenario_rows)"""


@query(
    "what_if",
    f"""WITH {WHAT_IF_SQL} SELECT customerID, Contract, Senior_Citizen, tenure, Internet_Service, Payment_Method,
      avg_monthly, {round_sql(_P, 6)} AS score FROM scenario_full""",
)
def what_if(spark, sf_dir):
    people = profile(spark, sf_dir)
    rows = G.what_if(
        scenarios(spark, sf_dir), "facts", baseline_profile(people), dict(people.dtypes)
    )
    return G.score(rows, MODEL).select(
        V.ROW_KEY,
        "Contract",
        "Senior_Citizen",
        "tenure",
        "Internet_Service",
        "Payment_Method",
        V.RATIO,
        round_dp(F.col("score"), 6).alias("score"),
    )


@query(
    "compose_answer",
    f"""WITH {SCORED_PROFILE}, d AS (SELECT *, {drivers_sql('contrib')} AS drivers,
      CASE WHEN tenure > 6 THEN 'Contract=' || Contract || ', tenure=' || tenure ELSE '' END AS stated FROM model_scores)
    SELECT customerID, {answer_sql('score', 'stated', 'drivers')} AS reply FROM d""",
)
def compose_answer(spark, sf_dir):
    facts = F.when(
        F.col("tenure") > 6,
        F.create_map(
            F.lit("tenure"), F.col("tenure").cast("string"), F.lit("Contract"), F.col("Contract")
        ),
    ).otherwise(F.create_map().cast("map<string,string>"))
    limit = F.lit(THRESHOLD)
    rows = G.score(profile(spark, sf_dir), MODEL)
    return rows.select(
        V.ROW_KEY,
        G.compose_answer(
            F.col("score"),
            G.label_at_threshold(F.col("score"), limit),
            limit,
            facts,
            G.top_drivers(MODEL.contributions()),
        ).alias("reply"),
    )


SCENARIOS = {"as_is": {}, "longer_tenure": {"tenure": 1.2}, "dearer": {"Monthly_Charges": 1.1, "Total_Charges": 1.1}}


def _noise_sql() -> str:
    parts = []
    for name, factors in SCENARIOS.items():
        replaced = ", ".join(f"{c}::DOUBLE * {float(factors.get(c, 1.0))}::DOUBLE AS {c}" for c in MODEL.numeric)
        parts.append(f"SELECT '{name}' AS scenario, label, * REPLACE ({replaced}) FROM sampled")
    return " UNION ALL ".join(f"(SELECT scenario, label, {_P} AS score FROM ({p}))" for p in parts)


@query(
    "sensitivity_report",
    f"""WITH {PROFILE_SQL}, placed AS (
      SELECT *, row_number() OVER (ORDER BY ('0x' || substr(md5('7:order:' || customerID), 1, 15))::BIGINT, customerID) - 1 AS position FROM profile),
    draws AS (SELECT ('0x' || substr(md5('7:draw:' || position), 1, 15))::BIGINT % (SELECT count(*) FROM profile) AS position FROM placed),
    sampled AS (SELECT placed.* EXCLUDE (position) FROM draws JOIN placed USING (position)),
    noisy AS ({_noise_sql()})
    SELECT scenario, count(*) AS n, {round_sql('avg(score)', 6)} AS mean_score, {round_sql('avg(label)', 6)} AS label_rate, true AS synthetic
    FROM noisy GROUP BY scenario""",
)
def sensitivity_report(spark, sf_dir):
    sample = S.bootstrap_sample(profile(spark, sf_dir), key=V.ROW_KEY, seed=7)
    return G.sensitivity_report(sample, MODEL, SCENARIOS)


# --- per-seed metrics ------------------------------------------------------------------

_SEEDS = ", ".join(map(str, V.SEEDS))
_PER_SEED = f"""{SCORED_PROFILE},
seeded AS (SELECT customerID, label, score, unnest([{_SEEDS}])::INTEGER AS seed FROM model_scores),
{_split_sql('seeded', 'customerID', 'seed::VARCHAR', by='seed')},
test_rows AS (SELECT seed, label, {round_sql('score', 6)} AS score FROM split WHERE part = 'test'),
{cuts_sql('test_rows', 'seed')},
per_seed AS (SELECT seed, {metrics_sql()} FROM cuts GROUP BY seed)"""


def per_seed_metrics(spark, sf_dir):
    scored = G.score(profile(spark, sf_dir), MODEL).select(
        V.ROW_KEY, "label", round_dp(F.col("score"), 6).alias("score")
    )
    split = S.stratified_split(
        S.multi_seed(scored), key=V.ROW_KEY, label="label", seed=F.col("seed"), by=["seed"]
    )
    return U.curve_metrics(split.where("part = 'test'"), "score", "label", ["seed"])


_NAMES = ("roc_auc", "pr_area", "f1", "accuracy")


@query(
    "seed_summary",
    f"""WITH {_PER_SEED} SELECT string_agg(seed::VARCHAR, ',' ORDER BY seed) AS seeds,
      {', '.join(f"{round_sql(f'avg({m})', 4)} AS {m}_mean, {round_sql(f'stddev_pop({m})', 4)} AS {m}_std" for m in _NAMES)}
    FROM per_seed""",
)
def seed_summary(spark, sf_dir):
    return E.seed_summary(per_seed_metrics(spark, sf_dir), _NAMES)


@query(
    "band_gate",
    f"""WITH {_PER_SEED} SELECT seed, roc_auc, CASE WHEN roc_auc < 0.7 THEN 'below_band'
      WHEN roc_auc > 0.77 THEN 'needs_leakage_audit' ELSE 'ok' END AS verdict, roc_auc > 0.77 AS needs_leakage_audit
    FROM per_seed""",
)
def band_gate(spark, sf_dir):
    per_seed = per_seed_metrics(spark, sf_dir).select("seed", "roc_auc")
    return E.band_gate(per_seed, "roc_auc", (0.7, 0.77))


def external_profile(spark, sf_dir):
    """The foreign table in canonical columns, missing ones as nulls."""
    mapped, unmapped = map_schema(external(spark, sf_dir), EXTERNAL_MAPPING, MODEL.features)
    types = {"Senior_Citizen": "boolean", **{c: "double" for c in MODEL.numeric}}
    padded = mapped.withColumns(
        {c: F.lit(None).cast(types.get(c, "string")) for c in unmapped}
    )
    return binarize_label(padded), unmapped


_EXT_P = _P
for _missing in ("Total_Charges", "avg_monthly", "Internet_Service", "Senior_Citizen", "Paperless_Billing", "Tech_Support"):
    _EXT_P = _EXT_P.replace(f"{_missing}::", "NULL::")


@query(
    "external_auc",
    f"""WITH {EXTERNAL_SQL}, ext AS (SELECT (Churn = 'Yes')::INTEGER AS label, {round_sql(_EXT_P, 6)} AS score FROM
      (SELECT ext_age AS tenure, ext_bill AS Monthly_Charges, ext_plan AS Contract, ext_left AS Churn FROM external)),
    {cuts_sql('ext')}
    SELECT {round_sql(AUC_SQL, 4)} AS external_auc, 0.75::DOUBLE AS benchmark_auc,
      {round_sql(f'{round_sql(AUC_SQL, 6)} - 0.75::DOUBLE', 4)} AS auc_delta FROM cuts""",
)
def external_auc(spark, sf_dir):
    """Frozen linear model on the foreign table, against a benchmark."""
    rows, _ = external_profile(spark, sf_dir)
    scored = G.score(rows, MODEL).select("label", round_dp(F.col("score"), 6).alias("score"))
    auc = U.curve_metrics(scored, "score", "label").select("roc_auc")
    return auc.select(
        round_dp(F.col("roc_auc"), 4).alias("external_auc"),
        F.lit(0.75).alias("benchmark_auc"),
        round_dp(F.col("roc_auc") - F.lit(0.75), 4).alias("auc_delta"),
    )
