"""Curve, calibration, preparation and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import vocabulary as V
from tideline.functions.numeric import round_dp
from tideline.operators import calibration as K
from tideline.operators import curves as U
from tideline.operators import evaluation as E
from tideline.operators import prepare as D
from tideline.operators.quantiles import nearest_rank
from tideline.operators.splits import stratified_folds
from tideline.plans.partitions import _fold_sql
from tideline.plans.registry import query
from tideline.plans.tables import (
    PROFILE_SQL,
    SCORED_SQL,
    profile,
    round_sql,
    scored_lines,
    table,
)
from tideline.session import materialize

_TP, _FP = "(pos_before + pos)", "(neg_before + neg)"


def cuts_sql(source: str, groups: str = "", where: str = "") -> str:
    """CTE ``cuts``: distinct scores with running counts, highest first."""
    lead = f"{groups}, " if groups else ""
    part = f"PARTITION BY {groups}" if groups else ""
    over = f"OVER ({part} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
distinct_scores AS (SELECT {lead}score, sum(label)::BIGINT AS pos, (count(*) - sum(label))::BIGINT AS neg
  FROM {source} {where} GROUP BY ALL),
cuts AS (SELECT *, coalesce(sum(pos) {over}, 0)::BIGINT AS pos_before,
  coalesce(sum(neg) {over}, 0)::BIGINT AS neg_before FROM distinct_scores)"""


AUC_SQL = "(sum(neg::DOUBLE * (pos_before + pos::DOUBLE / 2)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE))"
PR_SQL = f"""(sum(pos * ({_TP}::DOUBLE / ({_TP} + {_FP})
   + CASE WHEN pos_before + neg_before > 0 THEN pos_before::DOUBLE / (pos_before + neg_before) ELSE 1.0 END) / 2)
   / sum(pos)::DOUBLE)"""
PREVALENCE_SQL = "(sum(pos)::DOUBLE / sum(pos + neg)::DOUBLE)"


def metrics_sql(t: float = 0.5) -> str:
    tp = f"coalesce(sum(pos) FILTER (WHERE score >= {t}), 0)"
    fp = f"coalesce(sum(neg) FILTER (WHERE score >= {t}), 0)"
    return f"""CAST(sum(pos + neg) AS BIGINT) AS n,
  {round_sql(AUC_SQL, 6)} AS roc_auc, {round_sql(PR_SQL, 6)} AS pr_area,
  {round_sql(f'{PR_SQL} - {PREVALENCE_SQL}', 6)} AS pr_area_shifted,
  {round_sql(f'(2 * {tp})::DOUBLE / ({tp} + {fp} + sum(pos))::DOUBLE', 6)} AS f1,
  {round_sql(f'({tp} + sum(neg) - {fp})::DOUBLE / sum(pos + neg)::DOUBLE', 6)} AS accuracy"""


@query(
    "roc_auc",
    f"WITH {SCORED_SQL}, {cuts_sql('scored')} SELECT CAST(sum(pos + neg) AS BIGINT) AS n, {round_sql(AUC_SQL, 6)} AS roc_auc FROM cuts",
)
def roc_auc(spark, sf_dir):
    return U.curve_metrics(scored_lines(spark, sf_dir), "score", "label").select("n", "roc_auc")


@query(
    "pr_area",
    f"""WITH {SCORED_SQL}, {cuts_sql('scored', 'segment')} SELECT segment, {round_sql(PR_SQL, 6)} AS pr_area,
      {round_sql(f'{PR_SQL} - {PREVALENCE_SQL}', 6)} AS pr_area_shifted FROM cuts GROUP BY segment""",
)
def pr_area(spark, sf_dir):
    return U.curve_metrics(scored_lines(spark, sf_dir), "score", "label", ["segment"]).select(
        "segment", "pr_area", "pr_area_shifted"
    )


@query(
    "toxic_auc",
    f"""WITH scored AS (SELECT lang, toxic AS label, n_chars::DOUBLE / 1000.0::DOUBLE AS score
      FROM documents JOIN labels USING (doc_id)), {cuts_sql('scored')}
    SELECT {metrics_sql(1.0)} FROM cuts""",
)
def toxic_auc(spark, sf_dir):
    """Does the length of a document predict its toxicity label?"""
    scored = (
        table(spark, sf_dir, "documents")
        .select("doc_id", (F.col("n_chars").cast("double") / 1000.0).alias("score"))
        .join(table(spark, sf_dir, "labels"), "doc_id")
    )
    return U.curve_metrics(scored, "score", "toxic", threshold=1.0)


_CURVE = f"""curve AS (SELECT *, {_TP} AS tp, {_FP} AS fp,
    {_TP}::DOUBLE / ({_TP} + {_FP}) AS p, {_TP}::DOUBLE / greatest(total, 1) AS r FROM cuts JOIN totals USING (segment)),
curve_f AS (SELECT *, CASE WHEN p + r > 0 THEN 2.0::DOUBLE * p * r / (p + r) ELSE 0.0::DOUBLE END AS f FROM curve)"""
_TOTALS = "totals AS (SELECT segment, sum(label)::BIGINT AS total FROM scored GROUP BY segment)"
_CURVES = f"{SCORED_SQL}, {cuts_sql('scored', 'segment')}, {_TOTALS}, {_CURVE}"
_WHOLE = SCORED_SQL.replace("l_linestatus AS segment", "'all' AS segment")


@query(
    "pr_f1_curve",
    f"""WITH {_CURVES} SELECT segment, score, tp, fp, {round_sql('p', 6)} AS precision,
      {round_sql('r', 6)} AS recall, {round_sql('f', 6)} AS f1 FROM curve_f""",
)
def pr_f1_curve(spark, sf_dir):
    curve = U.pr_f1_curve(scored_lines(spark, sf_dir), "score", "label", ["segment"])
    return curve.withColumns({c: round_dp(F.col(c), 6) for c in ("precision", "recall", "f1")})


def _best_sql(floor: float) -> str:
    return f"""SELECT segment, score AS threshold, {round_sql('f', 6)} AS f1,
      {round_sql('p', 6)} AS precision, {round_sql('r', 6)} AS recall
    FROM curve_f WHERE p >= {floor} AND r > 0
    QUALIFY row_number() OVER (PARTITION BY segment ORDER BY f * 1000000 + p DESC, score DESC) = 1"""


def _rounded(points):
    return points.withColumns({c: round_dp(F.col(c), 6) for c in ("f1", "precision", "recall")})


@query(
    "operating_point",
    f"WITH {_WHOLE}, {cuts_sql('scored', 'segment')}, {_TOTALS}, {_CURVE}, best AS ({_best_sql(V.PRECISION_FLOOR)}) "
    "SELECT threshold, f1, precision, recall FROM best",
)
def operating_point(spark, sf_dir):
    return _rounded(U.operating_points(scored_lines(spark, sf_dir), "score", "label"))


@query("operating_point_by_segment", f"WITH {_CURVES} {_best_sql(0.7)}")
def operating_point_by_segment(spark, sf_dir):
    return _rounded(
        U.operating_points(
            scored_lines(spark, sf_dir), "score", "label", ["segment"], precision_floor=0.7
        )
    )


# Fixed knots of a calibration curve.
KNOTS = ((0.1, 0.02), (0.3, 0.2), (0.45, 0.2), (0.6, 0.55), (0.85, 0.9))


def _interpolate_sql(x: str) -> str:
    (x0, y0), *rest = KNOTS
    parts = [f"WHEN {x} <= {x0!r}::DOUBLE THEN {y0!r}::DOUBLE"]
    for x1, y1 in rest:
        parts.append(
            f"WHEN {x} <= {x1!r}::DOUBLE THEN {y0!r}::DOUBLE + ({x} - {x0!r}::DOUBLE) * {(y1 - y0) / (x1 - x0)!r}::DOUBLE"
        )
        x0, y0 = x1, y1
    return f"CASE {' '.join(parts)} ELSE {y0!r}::DOUBLE END"


@query(
    "apply_isotonic",
    f"""WITH {SCORED_SQL} SELECT score, {round_sql(_interpolate_sql('score'), 6)} AS calibrated,
      count(*) AS n FROM scored GROUP BY score""",
)
def apply_isotonic(spark, sf_dir):
    return (
        scored_lines(spark, sf_dir)
        .groupBy("score")
        .agg(F.count("*").alias("n"))
        .withColumn("calibrated", round_dp(K.interpolate(F.col("score"), KNOTS), 6))
    )


@query(
    "brier",
    f"""WITH {SCORED_SQL}, c AS (SELECT *, {_interpolate_sql('score')} AS calibrated FROM scored)
    SELECT segment, {round_sql('avg(pow(score - label, 2))', 6)} AS brier_score,
      {round_sql('avg(pow(calibrated - label, 2))', 6)} AS brier_calibrated
    FROM c GROUP BY segment""",
)
def brier(spark, sf_dir):
    both = scored_lines(spark, sf_dir).withColumn(
        "calibrated", K.interpolate(F.col("score"), KNOTS)
    )
    return U.brier(both, ["score", "calibrated"], "label", ["segment"])


def _isotonic_sql(rows: str) -> str:
    """``fitted``: the isotonic value at every score of ``rows``, by the max-min formula over all runs of scores."""
    return f"""ones AS (SELECT score, count(*) AS w, sum(label)::BIGINT AS s FROM {rows} GROUP BY score),
    run AS (SELECT *, sum(w) OVER (ORDER BY score) AS cw, sum(s) OVER (ORDER BY score) AS cs FROM ones),
    pairs AS (SELECT a.score AS lo, b.score AS hi,
      (b.cs - a.cs + a.s)::DOUBLE / (b.cw - a.cw + a.w)::DOUBLE AS mean FROM run a JOIN run b ON a.score <= b.score),
    lowest AS (SELECT lo, hi, min(mean) OVER (PARTITION BY lo ORDER BY hi ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m FROM pairs),
    fitted AS (SELECT hi AS score, max(m) AS y FROM lowest GROUP BY hi)"""


@query(
    "isotonic_fit",
    f"""WITH {SCORED_SQL}, {_isotonic_sql('scored')}
    SELECT score, {round_sql('y', 6)} AS calibrated FROM fitted""",
)
def isotonic_fit(spark, sf_dir):
    """Monotone fit on the raw scores, read back at every score."""
    scored = scored_lines(spark, sf_dir)
    fitted = K.apply_knots(scored.select("score").distinct(), K.fit_isotonic(scored, "score", "label"), "score", "calibrated")
    return fitted.withColumn("calibrated", round_dp(F.col("calibrated"), 6))


@query(
    "isotonic_apply",
    f"""WITH {SCORED_SQL}, train AS (SELECT * FROM scored WHERE fold = 0), {_isotonic_sql('train')},
    asked AS (SELECT score, count(*) AS n FROM scored GROUP BY score),
    below AS (SELECT a.score, a.n, f.score AS x0, f.y AS y0 FROM asked a ASOF LEFT JOIN fitted f ON a.score >= f.score),
    both_sides AS (SELECT b.*, f.score AS x1, f.y AS y1 FROM below b ASOF LEFT JOIN fitted f ON b.score <= f.score)
    SELECT score, n, {round_sql("""CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x0 = score THEN y0
      ELSE y0 + (y1 - y0) * ((score - x0) / (x1 - x0)) END""", 6)} AS calibrated FROM both_sides""",
)
def isotonic_apply(spark, sf_dir):
    """Knots fitted on one fold, applied to the scores of all folds."""
    scored = scored_lines(spark, sf_dir)
    blocks = K.fit_isotonic(scored.where("fold = 0"), "score", "label")
    asked = scored.groupBy("score").agg(F.count("*").alias("n"))
    return K.apply_knots(asked, blocks, "score", "calibrated").select(
        "score", "n", round_dp(F.col("calibrated"), 6).alias("calibrated")
    )


_C = {
    "tp": "score >= 0.45 AND label = 1",
    "fp": "score >= 0.45 AND label = 0",
    "fn": "score < 0.45 AND label = 1",
    "tn": "score < 0.45 AND label = 0",
}


@query(
    "threshold_metrics",
    f"""WITH {SCORED_SQL}, c AS (SELECT fold, segment, grouping_id(fold, segment)::BIGINT AS level,
      {', '.join(f'count(*) FILTER (WHERE {w}) AS {n}' for n, w in _C.items())}
      FROM scored GROUP BY CUBE (fold, segment))
    SELECT *, {round_sql('(tp + tn)::DOUBLE / (tp + fp + fn + tn)', 6)} AS accuracy,
      {round_sql('coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0)', 6)} AS precision,
      {round_sql('coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0)', 6)} AS recall,
      {round_sql('coalesce((2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0), 0)', 6)} AS f1
    FROM c""",
)
def threshold_metrics(spark, sf_dir):
    return U.threshold_metrics(
        scored_lines(spark, sf_dir), "score", "label", F.lit(0.45), ["fold", "segment"]
    )


# --- selection over candidates and folds ---------------------------------------

CANDIDATE_ORDER = ("logistic", "levelwise", "forest")


def candidate_scores(spark, sf_dir):
    """Scores of three stand-in candidates per fold, in long form."""
    score = F.col("score")
    by_model = F.array(
        F.struct(F.lit("logistic").alias("model"), score.alias("score")),
        F.struct(F.lit("levelwise").alias("model"), round_dp(score * score, 3).alias("score")),
        F.struct(F.lit("forest").alias("model"), round_dp(F.lit(1.0) - score, 2).alias("score")),
    )
    return scored_lines(spark, sf_dir).select("fold", "label", F.inline(by_model))


_LONG_SQL = f"""{SCORED_SQL}, long AS (
  SELECT 'logistic' AS model, fold, label, score FROM scored
  UNION ALL SELECT 'levelwise', fold, label, {round_sql('score * score', 3)} FROM scored
  UNION ALL SELECT 'forest', fold, label, {round_sql('1.0::DOUBLE - score', 2)} FROM scored)"""
_FOLD_METRICS = f"""{_LONG_SQL}, {cuts_sql('long', 'model, fold')},
fold_metrics AS (SELECT model, fold, {metrics_sql()} FROM cuts GROUP BY model, fold)"""
_NAMES = ("roc_auc", "pr_area", "f1", "accuracy")


@query("fold_pr_score", f"WITH {_FOLD_METRICS} SELECT * FROM fold_metrics")
def fold_pr_score(spark, sf_dir):
    return U.curve_metrics(candidate_scores(spark, sf_dir), "score", "label", ["model", "fold"])


@query(
    "select_candidate",
    f"""WITH {_FOLD_METRICS}, means AS (SELECT model, count(*) AS folds, avg(pr_area) AS raw_pr,
      {', '.join(f"{round_sql(f'avg({m})', 4)} AS mean_{m}, {round_sql(f'stddev_pop({m})', 4)} AS std_{m}" for m in _NAMES)}
      FROM fold_metrics GROUP BY model)
    SELECT * EXCLUDE (raw_pr), row_number() OVER (ORDER BY raw_pr DESC,
      list_position({list(CANDIDATE_ORDER)}, model)) = 1 AS selected FROM means""",
)
def select_candidate(spark, sf_dir):
    summary = E.fold_summary(fold_pr_score(spark, sf_dir), ["model"], _NAMES)
    chosen = E.select_candidate(summary, "model", CANDIDATE_ORDER)
    return chosen.withColumns(
        {f"{s}_{m}": round_dp(F.col(f"{s}_{m}"), 4) for s in ("mean", "std") for m in _NAMES}
    )


# --- preparation ------------------------------------------------------------------

NUMBERS = [*V.NUMERIC_FEATURES, V.RATIO]


def _stats_sql(source: str, groups: str = "") -> str:
    lead = f"{groups}, " if groups else ""
    tail = f"GROUP BY {groups}" if groups else ""
    on = f"JOIN med USING ({lead}feature)"
    long = " UNION ALL ".join(
        f"SELECT {lead}'{c}' AS feature, {c}::DOUBLE AS value FROM {source}" for c in NUMBERS
    )
    return f"""
long_values AS ({long}),
med AS (SELECT {lead}feature, quantile_cont(value, 0.5) AS median FROM long_values GROUP BY {lead}feature),
filled AS (SELECT {lead}feature, value, median, coalesce(value, median) AS x FROM long_values {on}),
stats AS (SELECT {lead}feature, count(*) AS n, count(*) - count(value) AS nulls, any_value(median) AS median,
  avg(x) AS mean, stddev_pop(x) AS std FROM filled GROUP BY {lead}feature)"""


def _stats_out(groups: str = "") -> str:
    lead = f"{groups}, " if groups else ""
    return f"""SELECT {lead}feature, n, nulls, {round_sql('median', 4)} AS median,
      {round_sql('mean', 4)} AS mean, {round_sql('std', 4)} AS std FROM stats"""


def _rounded_stats(stats):
    return stats.withColumns({c: round_dp(F.col(c), 4) for c in ("median", "mean", "std")})


@query("numeric_stats", f"WITH {PROFILE_SQL}, {_stats_sql('profile')} {_stats_out()}")
def numeric_stats(spark, sf_dir):
    return _rounded_stats(D.fit_numeric(profile(spark, sf_dir), NUMBERS))


@query(
    "median_impute",
    f"""WITH {PROFILE_SQL} SELECT customerID,
      coalesce(avg_monthly, (SELECT quantile_cont(avg_monthly, 0.5) FROM profile)) AS avg_monthly
    FROM profile""",
)
def median_impute(spark, sf_dir):
    rows = profile(spark, sf_dir)
    row = D.stats_row(D.fit_numeric(rows, [V.RATIO]))
    return rows.select(
        V.ROW_KEY, D.median_impute(F.col(V.RATIO), row[V.RATIO]["median"]).alias(V.RATIO)
    )


@query(
    "standard_scale",
    f"""WITH {PROFILE_SQL}, {_stats_sql('profile')} SELECT customerID, {', '.join(
      round_sql(f"(coalesce({c}::DOUBLE, (SELECT median FROM stats WHERE feature = '{c}')) - (SELECT mean FROM stats WHERE feature = '{c}')) / (SELECT std FROM stats WHERE feature = '{c}')", 5)
      + f' AS {c}_scaled' for c in NUMBERS)} FROM profile""",
)
def standard_scale(spark, sf_dir):
    rows = profile(spark, sf_dir)
    scaled = D.scale_columns(rows, NUMBERS, D.fit_numeric(rows, NUMBERS))
    return scaled.select(
        V.ROW_KEY, *[round_dp(F.col(f"{c}_scaled"), 5).alias(f"{c}_scaled") for c in NUMBERS]
    )


_HOT = ["Contract", "Internet_Service", "Payment_Method"]


@query(
    "one_hot",
    f"WITH {PROFILE_SQL}, " + "seen AS (" + " UNION ".join(
        f"SELECT '{c}' AS feature, {c} AS category FROM profile WHERE tenure > 12 AND Contract <> 'Two year'" for c in _HOT
    ) + "), cells AS (" + " UNION ALL ".join(
        f"SELECT customerID, '{c}' AS feature, {c} AS value FROM profile" for c in _HOT
    ) + """) SELECT customerID, feature, category, (value = category)::INTEGER AS hot
      FROM cells JOIN seen USING (feature)""",
)
def one_hot(spark, sf_dir):
    """Fitted without two-year contracts, so those are unseen in the full table."""
    rows = profile(spark, sf_dir)
    train = rows.where((F.col("tenure") > 12) & (F.col("Contract") != "Two year"))
    return D.one_hot_long(rows, V.ROW_KEY, _HOT, D.fit_categories(train, _HOT))


_FOLDED = f"{PROFILE_SQL}, {_fold_sql('profile', 'customerID', '42')}"
_COPIES = "copies AS (SELECT f.*, k.trains FROM folded f JOIN (SELECT unnest(range(5))::INTEGER AS trains) k ON k.trains <> f.fold)"


def folded_profile(spark, sf_dir):
    """Profile with folds, written once: every statistic below reads it again."""
    folded = stratified_folds(profile(spark, sf_dir), key=V.ROW_KEY, label="label", seed=42)
    return materialize(folded, "profile-folds")


@query("fold_stats", f"WITH {_FOLDED}, {_COPIES}, {_stats_sql('copies', 'trains')} {_stats_out('trains')}")
def fold_stats(spark, sf_dir):
    """Numeric statistics of every fold's training rows, in one aggregation."""
    copies = D.train_copies(folded_profile(spark, sf_dir))
    return _rounded_stats(D.fit_numeric(copies, NUMBERS, ["trains"]))


# To three decimals: sums of cents over 1,200 rows have means that tie at the fifth, and the order of adding decides those.
@query(
    "fold_stats_by_counts",
    f"WITH {_FOLDED}, {_COPIES}, {_stats_sql('copies', 'trains')} SELECT trains, feature, n, nulls, "
    + ", ".join(f"{round_sql(c, 3)} AS {c}" for c in ("median", "mean", "std")) + " FROM stats",
)
def fold_stats_by_counts(spark, sf_dir):
    """The same from one count of the rows by fold and value cell, without copies."""
    stats = D.fit_fold_numeric(folded_profile(spark, sf_dir), NUMBERS)
    return stats.withColumns({c: round_dp(F.col(c), 3) for c in ("median", "mean", "std")})


@query(
    "fold_categories",
    f"WITH {_FOLDED}, {_COPIES} " + " UNION ALL ".join(
        f"SELECT trains, '{c}' AS feature, {c} AS value, count(*) AS n FROM copies GROUP BY trains, {c}" for c in _HOT
    ),
)
def fold_categories(spark, sf_dir):
    return D.fit_fold_categories(folded_profile(spark, sf_dir), _HOT)


@query(
    "imbalance_weights",
    f"""WITH {_FOLDED}, {_COPIES}, c AS (SELECT trains, count(*) FILTER (WHERE label = 1) AS positives,
      count(*) FILTER (WHERE label = 0) AS negatives FROM copies GROUP BY trains)
    SELECT *, negatives::DOUBLE / positives AS scale_pos_weight,
      (positives + negatives)::DOUBLE / (2 * positives) AS balanced_positive,
      (positives + negatives)::DOUBLE / (2 * negatives) AS balanced_negative,
      'fold-train labels only' AS fitted_on FROM c""",
)
def imbalance_weights(spark, sf_dir):
    return D.imbalance_weights(D.train_copies(folded_profile(spark, sf_dir)), "label", ["trains"])


# --- latency ------------------------------------------------------------------------


@query(
    "percentile_nearest_rank",
    """WITH s AS (SELECT event_type, value,
      row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i,
      count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, n AS samples,
      max(value) FILTER (WHERE i = least(round_even(0.5::DOUBLE * (n - 1), 0)::BIGINT, n - 1)) AS p50,
      max(value) FILTER (WHERE i = least(round_even(0.95::DOUBLE * (n - 1), 0)::BIGINT, n - 1)) AS p95,
      max(value) FILTER (WHERE i = least(round_even(0.99::DOUBLE * (n - 1), 0)::BIGINT, n - 1)) AS p99
    FROM s GROUP BY event_type, n""",
)
def percentile_nearest_rank(spark, sf_dir):
    return nearest_rank(
        table(spark, sf_dir, "events"), "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, ["event_type"]
    )


@query(
    "latency_report",
    f"""WITH samples AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'first_token' ELSE 'e2e' END AS metric,
      value / 20.0::DOUBLE AS seconds FROM events),
    s AS (SELECT metric, seconds, row_number() OVER (PARTITION BY metric ORDER BY seconds) - 1 AS i,
      count(*) OVER (PARTITION BY metric) AS n FROM samples),
    p AS (SELECT metric, n AS samples,
      max(seconds) FILTER (WHERE i = least(round_even(0.5::DOUBLE * (n - 1), 0)::BIGINT, n - 1)) AS a,
      max(seconds) FILTER (WHERE i = least(round_even(0.95::DOUBLE * (n - 1), 0)::BIGINT, n - 1)) AS b,
      CASE metric WHEN 'e2e' THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS budget FROM s GROUP BY metric, n)
    SELECT metric, samples, {round_sql('a', 4)} AS p50, {round_sql('b', 4)} AS p95, budget,
      b <= budget AS within_budget FROM p""",
)
def latency_report(spark, sf_dir):
    samples = table(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 3 == 0, "first_token").otherwise("e2e").alias("metric"),
        (F.col("value") / F.lit(20.0)).alias("seconds"),
    )
    return E.latency_report(samples, "metric", "seconds")
