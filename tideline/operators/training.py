"""The training protocol: search, select, calibrate, one look at the test part."""

from __future__ import annotations

import json
import math
import random
import uuid
import zlib
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import vocabulary as V
from tideline.functions.numeric import round_dp
from tideline.operators.boosting import LeafwiseBooster, LevelwiseBooster, score_held
from tideline.operators.calibration import apply_knots, fit_isotonic
from tideline.operators.cleaning import map_schema
from tideline.operators.curves import brier, cell_levels, curve_metrics, select_operating_point, threshold_metrics
from tideline.operators.evaluation import band_gate, fold_summary, select_candidate
from tideline.operators.logistic import search_logistic
from tideline.operators.prepare import Preparer, feature_groups, fit_fold_preparers, fit_preparers
from tideline.operators.splits import stratified_folds, stratified_split
from tideline.session import materialize, scratch_path, shared_folder
from tideline.sources.files import file_system
from tideline.sources.ledger import Ledger
from tideline.sources.registry import Bundle, load_bundle

MODELS = ("logistic", "levelwise", "leafwise")

# Search ranges as (low, high, scale).
RANGES = {
    "logistic": {"C": (1e-3, 100.0, "log")},
    "levelwise": {
        "n_estimators": (100, 600, "int"),
        "max_depth": (3, 10, "int"),
        "learning_rate": (0.01, 0.3, "log"),
        "subsample": (0.6, 1.0, "linear"),
        "colsample": (0.6, 1.0, "linear"),
        "penalty": (1e-3, 10.0, "log"),
    },
    "leafwise": {
        "n_estimators": (100, 600, "int"),
        "num_leaves": (16, 255, "logint"),
        "learning_rate": (0.01, 0.3, "log"),
        "subsample": (0.6, 1.0, "linear"),
        "colsample": (0.6, 1.0, "linear"),
        "penalty": (1e-3, 10.0, "log"),
        "min_child_samples": (5, 100, "int"),
    },
}


@dataclass(frozen=True)
class Trial:
    model: str
    trial: int
    params: dict


def draw_trials(
    models: Sequence[str] = MODELS,
    n_trials: int = 20,
    seed: int = 42,
    limits: Mapping[str, Mapping[str, tuple]] | None = None,
) -> list[Trial]:
    """Seeded independent draws, so any number of trials can run side by side."""
    out = []
    for model in models:
        ranges = {**RANGES[model], **(limits or {}).get(model, {})}
        for trial in range(n_trials):
            rng = random.Random(f"{seed}:{model}:{trial}")
            params = {}
            for name, (low, high, scale) in ranges.items():
                if scale == "int":
                    params[name] = rng.randint(low, high)
                elif scale == "linear":
                    params[name] = rng.uniform(low, high)
                else:
                    value = math.exp(rng.uniform(math.log(low), math.log(high)))
                    params[name] = round(value) if scale == "logint" else value
            out.append(Trial(model, trial, params))
    return out


def make_estimator(model: str, params: Mapping, prep: Preparer, seed: int):
    """An unfitted estimator; the weights in column ``weight`` belong to it.

    The logistic penalty is per unit of weight: 1 / (C * total weight).
    """
    common = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight"}
    if model == "logistic":
        n = prep.positives + prep.negatives
        return LogisticRegression(
            maxIter=1000, tol=1e-4, standardization=False, regParam=1.0 / (params.get("C", 1.0) * n), **common
        )
    if model == "levelwise":
        return LevelwiseBooster(seed=seed, **params)
    if model == "leafwise":
        return LeafwiseBooster(seed=seed, **params)
    if model == "gbt":  # no candidate of the protocol
        return GBTClassifier(
            maxIter=params.get("n_estimators", 100),
            maxDepth=params.get("max_depth", 6),
            stepSize=params.get("learning_rate", 0.3),
            subsamplingRate=params.get("subsample", 1.0),
            featureSubsetStrategy=str(params.get("colsample", 1.0)),
            seed=seed,
            **common,
        )
    if model == "forest":  # no candidate of the protocol
        return RandomForestClassifier(
            numTrees=params.get("n_estimators", 100), maxDepth=params.get("max_depth", 5),
            minInstancesPerNode=params.get("min_child_samples", 20), seed=seed, **common,
        )
    raise ValueError(f"unknown model {model!r}")


def weighted(df: DataFrame, model: str, prep: Preparer) -> DataFrame:
    """Class weights of the training rows: balanced for the logistic model,
    negatives per positive on the positives for the tree models."""
    if model == "logistic":
        n = prep.positives + prep.negatives
        up, down = n / (2 * max(prep.positives, 1)), n / (2 * max(prep.negatives, 1))
    else:
        up, down = prep.scale_pos_weight, 1.0
    return df.withColumn("weight", F.when(F.col("label") == 1, F.lit(up)).otherwise(F.lit(down)))


def _scored(df: DataFrame) -> DataFrame:
    return df.withColumn("score", vector_to_array("probability")[1])


def _unit(trials: Sequence[Trial], fold: int | None, seed: int) -> str:
    """The folder of a unit of work: its model, its fold, and a digest of all that it depends on."""
    told = json.dumps([[t.model, t.trial, t.params] for t in trials] + [fold, seed], sort_keys=True)
    return f"{trials[0].model}-{'all' if fold is None else fold}-{zlib.crc32(told.encode()):08x}"


def search_params(
    train: DataFrame,
    trials: Sequence[Trial],
    *,
    key: str,
    numeric: Sequence[str],
    categorical: Sequence[str],
    seed: int,
    folds: int = V.FOLDS,
    parallelism: int = 3,
    path: str | None = None,
) -> DataFrame:
    """Out-of-fold scores of every trial: (model, trial, fold, key, label, score).

    Preparation is fitted once per fold on the fold's training rows, for all
    folds in one aggregation. Logistic trials are fitted for all folds in the
    same passes over the rows; the trials of a tree candidate grow side by side
    for each fold, and ``parallelism`` candidates at a time. No tree reaches the
    driver. The scores are a table in the shared folder. A unit of work whose
    scores are complete there is not done again, so a job that is started anew
    with the same ``path`` goes on where the last one ended.
    """
    spark = train.sparkSession
    path = path or scratch_path(spark, "search-scores")
    preps = fit_fold_preparers(train, numeric, categorical, folds=folds)

    def missing(unit: str) -> bool:
        where, fs = file_system(spark, f"{path}/{unit}/_SUCCESS")
        return not fs.exists(where)

    def keep(scores: DataFrame, unit: str) -> None:
        columns = ["model", "trial", "fold", key, "label", "score"]
        scores.select(*columns).write.mode("overwrite").parquet(f"{path}/{unit}")

    by_model = {m: [t for t in trials if t.model == m] for m in dict.fromkeys(t.model for t in trials)}
    logistic = by_model.pop("logistic", [])
    if logistic and missing(unit := _unit(logistic, None, seed)):
        strengths = {t.trial: t.params.get("C", 1.0) for t in logistic}
        scores = search_logistic(train, preps, strengths, key=key, numeric=numeric, categorical=categorical)
        keep(scores.withColumn("model", F.lit("logistic")), unit)

    for fold, prep in sorted(preps.items()):
        todo = [group for group in by_model.values() if missing(_unit(group, fold, seed))]
        if not todo:
            continue
        ready = (
            PipelineModel(stages=prep.stages())
            .transform(train)
            .select(key, "label", "fold", "features")
            .persist(StorageLevel.MEMORY_AND_DISK)
        )

        def fit(group: Sequence[Trial], ready=ready, prep=prep, fold=fold) -> None:
            rows = weighted(ready, group[0].model, prep).withColumn("held", F.col("fold") == fold)
            scores = score_held(rows, [make_estimator(t.model, t.params, prep, seed) for t in group], key)
            number = F.array(*(F.lit(t.trial) for t in group))
            scores = scores.withColumns(
                {"trial": F.get(number, F.col("model")), "model": F.lit(group[0].model), "fold": F.lit(fold)}
            )
            keep(scores, _unit(group, fold, seed))

        with ThreadPoolExecutor(parallelism) as pool:
            list(pool.map(inheritable_thread_target(spark)(fit), todo))
        ready.unpersist()
    units = [] if not logistic else [_unit(logistic, None, seed)]
    for fold in preps:
        units += [_unit(group, fold, seed) for group in by_model.values()]
    schema = f"model string, trial int, fold int, {key} {dict(train.dtypes)[key]}, label int, score double"
    return spark.read.schema(schema).parquet(*(f"{path}/{unit}" for unit in units))


def _without_summary(model, spark: SparkSession):
    """The model as a saved one loads.

    A model fresh from its fit may hold a training summary, and that the
    session. Tasks take the model along when it scores, but a session in which
    anything was observed cannot be sent.
    """
    if not getattr(model, "hasSummary", False):
        return model
    path = scratch_path(spark, "fitted")
    model.write().save(path)
    return type(model).load(path)


def compare_trials(scores: DataFrame) -> DataFrame:
    """Best trial per model with mean and deviation of its fold metrics, winner flagged."""
    groups = ["model", "trial", "fold"]
    levels = cell_levels(scores, "score", groups)
    per_fold = curve_metrics(scores, "score", "label", groups, digits=12, levels=levels)
    summary = fold_summary(per_fold, ["model", "trial"], ("pr_area", "roc_auc", "f1", "accuracy"))
    return select_candidate(summary, "model", MODELS)


def fit_final(
    train: DataFrame, trial: Trial, numeric: Sequence[str], categorical: Sequence[str], seed: int
) -> tuple[PipelineModel, Preparer]:
    """Preparation and estimator fitted on all training rows, as one pipeline."""
    whole = train.withColumn("_all", F.lit(0))
    prep = fit_preparers(whole, numeric, categorical, group="_all")[0]
    stages = prep.stages()
    ready = PipelineModel(stages=stages).transform(train).select("label", "features")
    ready = weighted(ready, trial.model, prep).persist(StorageLevel.MEMORY_AND_DISK)
    fitted = _without_summary(make_estimator(trial.model, trial.params, prep, seed).fit(ready), train.sparkSession)
    ready.unpersist()
    return PipelineModel(stages=[*stages, fitted]), prep


def train_protocol(
    frame: DataFrame,
    *,
    seed: int,
    key: str = V.ROW_KEY,
    n_splits: int = V.FOLDS,
    n_trials: int = 20,
    models: Sequence[str] = MODELS,
    limits: Mapping[str, Mapping[str, tuple]] | None = None,
    auc_band: tuple[float, float] | None = V.AUC_BAND,
    precision_floor: float = V.PRECISION_FLOOR,
    parallelism: int = 3,
    run: str | None = None,
    ledger: Ledger | None = None,
    search_path: str | None = None,
) -> Bundle:
    """The whole protocol for one seed; ``frame`` has a 0/1 column ``label``.

    The test part is looked at once: the look is entered in the ledger, by
    default the one below the shared folder, and a run of the same name and
    seed is refused there, in whatever session it is. Without a name the run
    gets one of its own. With ``search_path`` an interrupted search goes on.

    Only one-row metrics, the fitted models and the preparation statistics
    reach the driver.
    """
    ledger = ledger or Ledger(frame.sparkSession, f"{shared_folder(frame.sparkSession)}/ledger")
    run = run or f"run-{uuid.uuid4().hex}"
    ledger.refuse(run, seed)
    numeric, categorical = feature_groups(frame, exclude=(key,))
    split = stratified_split(frame, key=key, label="label", seed=seed)
    folded = stratified_folds(
        split.where("part = 'train'"), key=key, label="label", seed=seed, folds=n_splits
    )
    held_out = split.where("part = 'test'").withColumn("fold", F.lit(None).cast("int"))
    # written once: every fit reads this table, none repeats the split
    parts = materialize(folded.unionByName(held_out), "split", partition_by="part")
    train, test = parts.where("part = 'train'"), parts.where("part = 'test'")

    trials = draw_trials(models, n_trials, seed, limits)
    scores = search_params(
        train,
        trials,
        key=key,
        numeric=numeric,
        categorical=categorical,
        seed=seed,
        folds=n_splits,
        parallelism=parallelism,
        path=search_path,
    )
    table = compare_trials(scores).collect()  # one row per model
    params = {(t.model, t.trial): t.params for t in trials}
    comparison = [
        {
            "model": r["model"],
            "trial": r["trial"],
            "mean_fold_pr_area": round(r["mean_pr_area"], 4),
            "params": params[r["model"], r["trial"]],
            **{c: round(r[c], 4) for c in r.asDict() if c.startswith(("mean_", "std_"))},
        }
        for r in table
    ]
    best = next(r for r in table if r["selected"])
    chosen = Trial(best["model"], best["trial"], params[best["model"], best["trial"]])

    # the search already scored every training row by the model that left it out;
    # written once, as what follows reads it many times, and not the other trials
    oof = materialize(scores.where((F.col("model") == chosen.model) & (F.col("trial") == chosen.trial)), "oof")
    point = select_operating_point(oof, "score", "label", precision_floor=precision_floor)
    calibrator = fit_isotonic(oof, "score", "label")
    both = apply_knots(oof, calibrator, "score", "calibrated")
    oof_curve = curve_metrics(oof, "score", "label").first()
    oof_brier = brier(both, ["score", "calibrated"], "label").first()

    model, prep = fit_final(train, chosen, numeric, categorical, seed)
    ledger.touch(run, seed)
    tested = _scored(model.transform(test)).select("label", "score")
    test_curve = curve_metrics(tested, "score", "label", digits=12).first()
    at = threshold_metrics(
        tested.withColumn("part", F.lit("test")), "score", "label", F.lit(point["threshold"]), ["part"]
    ).where("part = 'test'").first()
    if auc_band is not None and test_curve["roc_auc"] < auc_band[0]:
        raise ValueError(
            f"seed {seed}: test AUC {test_curve['roc_auc']:.4f} below lower bound {auc_band[0]}"
        )
    return Bundle(
        model=model,
        threshold=point["threshold"],
        calibrator=calibrator,
        features=[*numeric, *categorical],
        metadata={
            "seed": seed,
            "selected_model": chosen.model,
            "best_params": chosen.params,
            "auc_band": list(auc_band) if auc_band else None,
            "numeric": list(numeric),
            "preparation": {
                "numeric": prep.numeric,
                "categories": prep.categories,
                "positives": prep.positives,
                "negatives": prep.negatives,
            },
            "imbalance": {
                "row_weights": "equal totals for both labels (logistic), scale_pos_weight (trees)",
                "scale_pos_weight": prep.scale_pos_weight,
                "positives": prep.positives,
                "negatives": prep.negatives,
                "counted_on": "training part",
            },
            "operating_point": point.asDict(),
            "n_splits": n_splits,
            "n_trials": n_trials,
        },
        metrics={
            "test_auc": round(test_curve["roc_auc"], 4),
            "test_pr_area": round(test_curve["pr_area"], 4),
            "test_f1": at["f1"],
            "test_accuracy": at["accuracy"],
            "test_precision": at["precision"],
            "test_recall": at["recall"],
            "oof_roc_auc": round(oof_curve["roc_auc"], 4),
            "oof_pr_area": round(oof_curve["pr_area"], 4),
            "brier_oof_raw": oof_brier["brier_score"],
            "brier_oof": oof_brier["brier_calibrated"],
        },
        comparison=comparison,
    )


def preparer_of(bundle: Bundle) -> Preparer:
    """The preparation a bundle was fitted with."""
    stored = bundle.metadata["preparation"]
    return Preparer(
        numeric={c: tuple(v) for c, v in stored["numeric"].items()},
        categories={c: [tuple(v) for v in seen] for c, seen in stored["categories"].items()},
        positives=stored["positives"],
        negatives=stored["negatives"],
    )


def metrics_table(spark: SparkSession, bundles: Mapping[int, Bundle]) -> DataFrame:
    """One row per seed with every metric."""
    names = sorted({m for b in bundles.values() for m in b.metrics})
    rows = [(seed, *[float(b.metrics[m]) for m in names]) for seed, b in bundles.items()]
    return spark.createDataFrame(rows, "seed int, " + ", ".join(f"{m} double" for m in names))


def gate(per_seed: DataFrame, band: tuple[float, float] = V.AUC_BAND) -> DataFrame:
    """Audit flag per seed, with the same band that the protocol enforces."""
    return band_gate(per_seed, "test_auc", band)


def evaluate_against(bundle: Bundle, frame: DataFrame, *, seed: int, key: str = V.ROW_KEY) -> float:
    """AUC of a bundle on the rebuilt seeded test part."""
    test = stratified_split(frame, key=key, label="label", seed=seed).where("part = 'test'")
    scored = bundle.score(test).select("label", "score")
    return curve_metrics(scored, "score", "label", digits=12).first()["roc_auc"]


def reproduce_check(
    spark: SparkSession, path: str, frame: DataFrame, *, key: str = V.ROW_KEY
) -> tuple[float, bool]:
    """Reload a bundle and see whether it meets its recorded test AUC."""
    bundle = load_bundle(spark, path)
    auc = evaluate_against(bundle, frame, seed=bundle.metadata["seed"], key=key)
    return auc, abs(auc - bundle.metrics["test_auc"]) <= V.AUC_TOLERANCE


def external_validation(
    bundle: Bundle,
    external: DataFrame,
    mapping: Mapping[str, str],
    *,
    key: str,
    label: str,
    seed: int,
    benchmark_auc: float,
) -> DataFrame:
    """Frozen bundle on the seeded test part of a foreign table: one report row.

    Nothing is fitted. Features without a source are imputed and reported.
    """
    mapped, unmapped = map_schema(
        external.withColumn("_key", F.col(key)), {**mapping, "_key": "_key"}, [*bundle.features, "_key"]
    )
    labelled = mapped.withColumn(
        "label", F.coalesce(F.col(V.LABEL) == V.POSITIVE, F.lit(False)).cast("int")
    )
    test = stratified_split(labelled, key="_key", label="label", seed=seed).where("part = 'test'")
    auc = curve_metrics(bundle.score(test).select("label", "score"), "score", "label")
    return auc.select(
        F.lit("external_zero_shot_validation").alias("kind"),
        F.lit(label).alias("label"),
        round_dp(F.col("roc_auc"), 4).alias("external_auc"),
        F.lit(round(benchmark_auc, 4)).alias("benchmark_auc"),
        round_dp(F.col("roc_auc") - F.lit(benchmark_auc), 4).alias("auc_delta"),
        F.lit(
            "scored by the frozen bundle; the delta says how far its training population differs from this one"
        ).alias("note"),
        F.array(*[F.lit(c) for c in unmapped]).cast("array<string>").alias("unmapped_features"),
    )
