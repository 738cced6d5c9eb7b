"""Queries that fit models: checked by invariants, so most have no SQL."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import functions as F

from tideline.functions import vocabulary as V
from tideline.functions.numeric import round_dp
from tideline.operators import training as M
from tideline.operators.calibration import apply_knots
from tideline.operators.curves import curve_metrics
from tideline.operators.evaluation import seed_summary
from tideline.operators.explain import tree_drivers
from tideline.operators.prefix import attach_totals
from tideline.operators.prepare import Preparer, feature_groups
from tideline.operators.scoring import LinearModel, top_drivers
from tideline.operators.splits import stratified_folds, stratified_split
from tideline.plans.partitions import _fold_sql, _split_sql
from tideline.plans.quality import EXTERNAL_MAPPING, external
from tideline.plans.registry import query
from tideline.plans.tables import PROFILE_SQL, profile
from tideline.session import materialize, scratch_path
from tideline.sources.ledger import Ledger
from tideline.sources.registry import Bundle, load_default_bundle, save_bundle
from tideline.sources.reports import read_report, write_report

DEFAULTS = {
    "logistic": {"C": 1.0},
    "levelwise": {"n_estimators": 10, "max_depth": 3},
    "leafwise": {"n_estimators": 10, "num_leaves": 31, "learning_rate": 0.3},
    "forest": {"n_estimators": 20, "max_depth": 5},
}
# These queries are of Spark's level-wise booster, which is no candidate of the protocol.
LEARNERS = {"levelwise": "gbt"}


def _split(spark, sf_dir):
    """The profile with its seeded split, stored once for the fits that follow."""
    split = stratified_split(profile(spark, sf_dir), key=V.ROW_KEY, label="label", seed=42)
    return materialize(split, "profile-split", partition_by="part")


def _folded(spark, sf_dir):
    """Training rows of the split with its folds, stored once."""
    split = stratified_split(profile(spark, sf_dir), key=V.ROW_KEY, label="label", seed=42)
    train = stratified_folds(
        split.where("part = 'train'"), key=V.ROW_KEY, label="label", seed=42, folds=V.FOLDS
    )
    return materialize(train.drop("part"), "profile-folds")


def _fit_scores(model: str):
    def plan(spark, sf_dir):
        split = _split(spark, sf_dir)
        numeric, categorical = feature_groups(split, exclude=("part",))
        train = split.where("part = 'train'")
        trial = M.Trial(LEARNERS.get(model, model), 0, DEFAULTS[model])
        fitted, _ = M.fit_final(train, trial, numeric, categorical, 42)
        bundle = Bundle(fitted, 0.5, None, [*numeric, *categorical], {"numeric": numeric})
        scored = bundle.score(split.where("part = 'test'"))
        return scored.select(V.ROW_KEY, "label", round_dp(F.col("score"), 6).alias("score"))

    return plan


for _model in DEFAULTS:
    query(f"fit_{_model}_scores")(_fit_scores(_model))


_TEST_SQL = f"""WITH {PROFILE_SQL}, {_split_sql('profile', 'customerID', '42')},
    test AS (SELECT count(*) AS n, count(*) FILTER (WHERE label = 1) AS positives FROM split WHERE part = 'test')"""


@query(
    "model_facts",
    f"""{_TEST_SQL} SELECT model, n, positives, true AS one_each, true AS in_range, true AS better_than_chance,
      true AS parts_sum_to_margin FROM test, (SELECT unnest(['logistic', 'levelwise', 'leafwise']) AS model)""",
)
def model_facts(spark, sf_dir):
    """What must hold of every candidate on the test part: one score a row, in range, better than chance, explained."""
    split = _split(spark, sf_dir)
    numeric, categorical = feature_groups(split, exclude=("part",))
    out = None
    for model in M.MODELS:
        fitted, prep = M.fit_final(split.where("part = 'train'"), M.Trial(model, 0, DEFAULTS[model]), numeric, categorical, 42)
        bundle = Bundle(fitted, 0.5, None, [*numeric, *categorical], {"numeric": numeric})
        test = split.where("part = 'test'")
        scored = bundle.score(test).select(V.ROW_KEY, "label", "score")
        if model == "logistic":
            linear = linear_model(fitted, prep)
            margins = test.select(V.ROW_KEY, linear.margin().alias("margin"))
        else:
            rows = fitted.transform(test)
            margins = tree_drivers(rows, V.ROW_KEY, fitted.stages[-1], prep.raw_names()).select(V.ROW_KEY, "margin")
        told = F.abs(F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("margin"))) - F.col("score")) < 1e-6
        checked = materialize(scored.join(margins, V.ROW_KEY, "left").withColumn("told", told), "model-facts")
        facts = checked.agg(
            F.count("*").alias("n"),
            F.count_if(F.col("label") == 1).alias("positives"),
            (F.count_distinct(V.ROW_KEY) == F.count("score")).alias("one_each"),
            F.every(F.col("score").between(0.0, 1.0)).alias("in_range"),
            F.every(F.coalesce("told", F.lit(False))).alias("parts_sum_to_margin"),
        )
        own = attach_totals(
            facts, curve_metrics(checked, "score", "label").select((F.col("roc_auc") > 0.55).alias("better_than_chance")), []
        ).select(
            F.lit(model).alias("model"), "n", "positives", "one_each", "in_range", "better_than_chance", "parts_sum_to_margin"
        )
        out = own if out is None else out.unionByName(own)
    return out


@query("search_params")
def search_params(spark, sf_dir):
    """All 20 trials of every candidate over the full ranges, on all folds: the best of each, winner flagged."""
    train = _folded(spark, sf_dir)
    numeric, categorical = feature_groups(train, exclude=("fold",))
    scores = M.search_params(
        train, M.draw_trials(), key=V.ROW_KEY, numeric=numeric, categorical=categorical, seed=42, folds=V.FOLDS
    )
    return M.compare_trials(scores)


# Which fold scores which training row can be checked in SQL; the scores cannot.
@query(
    "oof_keys",
    f"""WITH {PROFILE_SQL}, {_split_sql('profile', 'customerID', '42')},
    train_rows AS (SELECT customerID, label FROM split WHERE part = 'train'),
    {_fold_sql('train_rows', 'customerID', '42', V.FOLDS)}
    SELECT customerID, label, fold, 1::BIGINT AS scores FROM folded""",
)
def oof_keys(spark, sf_dir):
    """One out-of-fold score per training row and model: keys, folds and counts."""
    train = _folded(spark, sf_dir)
    numeric, categorical = feature_groups(train, exclude=("fold",))
    scores = M.search_params(
        train, [M.Trial("logistic", 0, {"C": 1.0})], key=V.ROW_KEY,
        numeric=numeric, categorical=categorical, seed=42, folds=V.FOLDS,
    )
    return scores.groupBy(V.ROW_KEY, "label", "fold").agg(F.count("score").alias("scores"))


def _people(spark, sf_dir):
    """The profile, stored once: the splits of every seed read it several times."""
    return materialize(profile(spark, sf_dir), "profile")


def _train(people, seed: int, models=M.MODELS, **settings) -> Bundle:
    """All 20 trials of every candidate over the full ranges; the floor is what the made-up profile can reach."""
    return M.train_protocol(
        people, seed=seed, n_splits=V.FOLDS, models=models, auc_band=None, precision_floor=0.4, **settings
    )


def _bundles(spark, people, models=M.MODELS) -> dict[int, Bundle]:
    """The protocol of every seed; the seeds run side by side."""
    train = inheritable_thread_target(spark)(lambda seed: _train(people, seed, models))
    with ThreadPoolExecutor(len(V.SEEDS)) as pool:
        return dict(zip(V.SEEDS, pool.map(train, V.SEEDS), strict=True))


@query(
    "protocol_facts",
    f"""{_TEST_SQL}, train AS (SELECT count(*) AS n FROM split WHERE part = 'train')
    SELECT s AS seed, 20::BIGINT * train.n AS oof_rows, 1::BIGINT AS looks, true AS refused, true AS calibrated_no_worse,
      true AS floor_held, 1::BIGINT AS winners
    FROM train, (SELECT unnest([42]) AS s)""",
)
def protocol_facts(spark, sf_dir):
    """What must hold of the whole protocol, with all trials of the logistic candidate and its ledger."""
    ledger = Ledger(spark, scratch_path(spark, "ledger"))
    scores = scratch_path(spark, "search")
    settings = dict(ledger=ledger, run="facts", search_path=scores)
    people = _people(spark, sf_dir)
    bundle = _train(people, 42, ("logistic",), **settings)
    try:
        _train(people, 42, ("logistic",), **settings)
        refused = False
    except RuntimeError:
        refused = True
    point = bundle.metadata["operating_point"]
    counts = attach_totals(
        spark.read.parquet(f"{scores}/*").agg(F.count("score").alias("oof_rows")),
        ledger.table().agg(F.count("*").alias("looks")), [],
    )
    return counts.select(
        F.lit(42).alias("seed"), "oof_rows", "looks", F.lit(refused).alias("refused"),
        F.lit(bundle.metrics["brier_oof"] <= bundle.metrics["brier_oof_raw"]).alias("calibrated_no_worse"),
        F.lit(point["precision"] >= 0.4).alias("floor_held"),
        F.lit(len({c["model"] for c in bundle.comparison})).cast("long").alias("winners"),
    )


@query("train_protocol")
def train_protocol(spark, sf_dir):
    """The whole protocol for every seed: metrics per seed with the band verdict."""
    bundles = _bundles(spark, _people(spark, sf_dir))
    return M.gate(M.metrics_table(spark, bundles), (0.5, 0.95))


@query("train_summary")
def train_summary(spark, sf_dir):
    """Mean and deviation over seeds of the protocol, logistic candidate only; the seeds run side by side."""
    table = M.metrics_table(spark, _bundles(spark, _people(spark, sf_dir), ("logistic",)))
    return seed_summary(table, [c for c in table.columns if c != "seed"])


@query("bundle_roundtrip")
def bundle_roundtrip(spark, sf_dir):
    """Save, load the default, score again, compare with the recorded test AUC."""
    people = _people(spark, sf_dir)
    bundle = _train(people, 42, ("logistic",))
    registry = scratch_path(spark, "registry")
    path = save_bundle(spark, bundle, registry, 42)
    auc, same = M.reproduce_check(spark, path, people)
    report = spark.createDataFrame([(auc, same)], "auc double, reproduced boolean")
    reports = write_report(report, scratch_path(spark, "reports"), "reproduce", "seed42")
    body = F.from_json("body", "auc double, reproduced boolean")
    checked = read_report(spark, reports, "reproduce").select(body.alias("b")).select("b.*")
    scored = load_default_bundle(spark, registry).score_calibrated(people)
    means = scored.agg(
        F.count("*").alias("n"),
        round_dp(F.avg("score"), 6).alias("mean_score"),
        round_dp(F.avg("calibrated"), 6).alias("mean_calibrated"),
    )
    return attach_totals(means, checked, [])


@query("external_validation")
def external_validation(spark, sf_dir):
    bundle = _train(_people(spark, sf_dir), 42, ("logistic",))
    report = M.external_validation(
        bundle, external(spark, sf_dir), EXTERNAL_MAPPING,
        key="ext_id", label="parts", seed=42, benchmark_auc=bundle.metrics["test_auc"],
    )
    return report.withColumn("unmapped_features", F.array_join("unmapped_features", ","))


@query("tree_drivers")
def tree_drivers_query(spark, sf_dir):
    """Top three reasons per test row of a boosted model."""
    split = _split(spark, sf_dir)
    numeric, categorical = feature_groups(split, exclude=("part",))
    trial = M.Trial(LEARNERS["levelwise"], 0, DEFAULTS["levelwise"])
    fitted, prep = M.fit_final(split.where("part = 'train'"), trial, numeric, categorical, 42)
    rows = fitted.transform(split.where("part = 'test'"))
    booster = next(s for s in fitted.stages if isinstance(s, GBTClassificationModel))
    reasons = tree_drivers(rows, V.ROW_KEY, booster, prep.raw_names())
    return reasons.select(V.ROW_KEY, "margin", F.posexplode("drivers").alias("place", "d")).select(
        V.ROW_KEY,
        round_dp(F.col("margin"), 6).alias("margin"),
        (F.col("place") + 1).alias("place"),
        F.col("d.feature").alias("feature"),
        round_dp(F.col("d.contribution"), 6).alias("contribution"),
    )


def linear_model_of(bundle: Bundle) -> LinearModel:
    """A fitted logistic bundle as plain coefficients on raw columns."""
    return linear_model(bundle.model, M.preparer_of(bundle))


def linear_model(model: PipelineModel, prep: Preparer) -> LinearModel:
    """A fitted logistic pipeline as plain coefficients on raw columns."""
    fitted = model.stages[-1]
    weights = dict(zip(prep.feature_names(), fitted.coefficients.toArray().tolist()))
    shares = dict(zip(prep.feature_names(), prep.background()))
    return LinearModel(
        intercept=float(fitted.intercept),
        numeric={
            c: (weights[f"num__{c}"], median, mean, std if std > 0 else 1.0)
            for c, (median, mean, std) in prep.numeric.items()
        },
        categorical={
            c: {v: (weights[f"cat__{c}_{v}"], shares[f"cat__{c}_{v}"]) for v, _ in seen}
            for c, seen in prep.categories.items()
        },
    )


def flagship(spark, sf_dir):
    """Profile, clean, split, prepare, fit, calibrate, label, and say why."""
    people = _people(spark, sf_dir)
    bundle = _train(people, 42, ("logistic",))
    model = linear_model_of(bundle)
    people = people.withColumn("score", model.probability())
    rated = apply_knots(people, bundle.calibrator, "score", "calibrated")
    drivers = top_drivers(model.contributions())
    return rated.select(
        V.ROW_KEY,
        round_dp(F.col("score"), 6).alias("score"),
        round_dp(F.col("calibrated"), 6).alias("calibrated"),
        F.when(F.col("score") >= bundle.threshold, V.LABELS[0]).otherwise(V.LABELS[1]).alias("label"),
        F.array_join(F.transform(drivers, lambda d: d["feature"]), ",").alias("drivers"),
    )


query("churn_report")(flagship)
