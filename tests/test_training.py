import math
import random
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tideline.operators import logistic as L
from tideline.operators import prepare as D
from tideline.operators import training as M
from tideline.operators.boosting import LeafwiseModel
from tideline.operators.explain import tree_drivers
from tideline.operators.scoring import LinearModel, raw_feature, top_drivers
from tideline.plans import QUERIES
from tideline.plans.learning import linear_model_of
from tideline.sources.ledger import Ledger
from tideline.sources.registry import Bundle, load_bundle, load_default_bundle, save_bundle
from tideline.sources.reports import read_report, write_report

QUICK = {
    "levelwise": {"n_estimators": (4, 6, "int"), "max_depth": (2, 3, "int")},
    "leafwise": {"n_estimators": (3, 5, "int"), "num_leaves": (4, 8, "logint")},
}


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(11)
    rows = []
    for i in range(280):
        tenure, plan = rng.randrange(1, 72), rng.choice(["Month-to-month", "Two year"])
        bill = rng.uniform(20, 119) if i % 9 else None
        z = 0.05 * (30 - tenure) + (1.2 if plan == "Month-to-month" else -0.8)
        rows.append((f"c{i}", tenure, bill, plan, rng.random() < 0.3, int(rng.random() < 1 / (1 + math.exp(-z)))))
    schema = "customerID string, tenure int, Monthly_Charges double, Contract string, Senior_Citizen boolean, label int"
    return spark.createDataFrame(rows, schema).persist()


@pytest.fixture(scope="module")
def bundle(people):
    return M.train_protocol(
        people, seed=42, n_splits=3, n_trials=1, limits=QUICK, auc_band=None, precision_floor=0.4
    )


def test_groups_come_from_the_types(people):
    assert D.feature_groups(people) == (["tenure", "Monthly_Charges", "Senior_Citizen"], ["Contract"])


def test_numeric_statistics_equal_numpy(people):
    rows = people.collect()
    stats = {r.feature: r for r in D.fit_numeric(people, ["tenure", "Monthly_Charges"]).collect()}
    bills = np.array([r["Monthly_Charges"] for r in rows], dtype=float)
    filled = np.where(np.isnan(bills), np.nanmedian(bills), bills)
    got = stats["Monthly_Charges"]
    assert got["nulls"] == np.isnan(bills).sum()
    assert (got["median"], got["mean"], got["std"]) == pytest.approx(
        (np.nanmedian(bills), filled.mean(), filled.std())
    )


def test_each_fold_is_fitted_on_the_other_folds(people):
    folded = people.withColumn("fold", (F.hash("customerID") % 2 == 0).cast("int"))
    stats = D.fit_numeric(D.train_copies(folded, folds=2), ["tenure"], ["trains"]).collect()
    for r in stats:
        mean = folded.where(F.col("fold") != r.trains).agg(F.avg("tenure")).first()[0]
        assert r["mean"] == pytest.approx(mean)


def test_fold_statistics_equal_those_of_copied_rows(spark):
    rng = random.Random(8)
    draw = lambda: rng.choice([None, float(rng.randrange(9)), rng.gauss(0, 100), 1e-12 * rng.random()])
    rows = [(k, k % 4, draw(), draw() if k % 4 else None, None, rng.choice(["a", "b", None]), k % 2) for k in range(600)]
    rows += [(1000 + k, 1, 5.0, 5.0, None, "only here", 1) for k in range(301)]
    df = spark.createDataFrame(rows, "customerID long, fold int, x double, y double, z double, w string, label int")
    copies = D.train_copies(df, folds=5)
    columns = ["n", "nulls", "median", "mean", "std"]
    by = lambda stats: {(r["trains"], r["feature"]): [r[c] for c in columns] for r in stats.collect()}
    got, want = by(D.fit_fold_numeric(df, ["x", "y"])), by(D.fit_numeric(copies, ["x", "y"], ["trains"]))
    assert got.keys() == want.keys() and len(got) == 10
    for k, values in got.items():
        assert values == pytest.approx(want[k], rel=1e-9)
    nothing = D.fit_fold_numeric(df, ["z"]).collect()
    assert len(nothing) == 5 and all(r["nulls"] == r["n"] and r["median"] is None for r in nothing)
    words = D.fit_fold_categories(df, ["w"]).collect()
    assert sorted(map(tuple, words)) == sorted(
        map(tuple, D.fit_categories(copies, ["w"], ["trains"]).select("trains", "feature", "value", "n").collect())
    )
    assert D.fit_fold_preparers(df, ["x", "y"], ["w"])[3].positives == sum(r[6] for r in rows if r[1] != 3)


def test_preparation_columns_and_stages_agree(people):
    prep = D.fit_preparers(people.withColumn("g", F.lit(0)), *D.feature_groups(people), group="g")[0]
    from pyspark.ml import PipelineModel

    by_stage = PipelineModel(stages=prep.stages()).transform(people)
    assert by_stage.columns == [*people.columns, "features"]
    a = by_stage.select("customerID", vector_to_array("features").alias("x")).collect()
    b = people.select("customerID", F.array(*prep.columns().values()).alias("x")).collect()
    left, right = ({r[0]: r[1] for r in rows} for rows in (a, b))
    assert all(left[k] == pytest.approx(right[k]) for k in left)
    assert prep.raw_names() == ["tenure", "Monthly_Charges", "Senior_Citizen", "Contract", "Contract"]


def test_many_and_odd_categories_are_one_hot(spark):
    from pyspark.ml import PipelineModel

    odd = "it's `odd` \\ \"x\""
    df = spark.range(1300).select(
        F.when(F.col("id") == 0, F.lit(odd)).otherwise(F.col("id").cast("string")).alias("k"),
        F.lit(1).alias("label"), F.lit(0).alias("g"),
    )
    prep = D.fit_preparers(df, [], ["k"], group="g")[0]
    assert len(prep.feature_names()) == 1300
    new = spark.createDataFrame([(odd,), ("17",), ("never seen",), (None,)], "k string")
    rows = PipelineModel(stages=prep.stages()).transform(new).collect()
    hot = [{prep.feature_names()[i] for i in r["features"].indices} for r in rows]
    assert hot == [{f"cat__k_{odd}"}, {"cat__k_17"}, set(), set()]
    long = D.one_hot_long(new.where("k is not null"), "k", ["k"], D.fit_categories(df, ["k"]))
    assert long.where("hot = 1").count() == 2


def test_imbalance_weights(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "label int")
    row = D.imbalance_weights(df).first()
    assert (row.positives, row.negatives, row.scale_pos_weight) == (1, 3, 3.0)
    assert (row.balanced_positive, row.balanced_negative) == (2.0, 4 / 6)
    assert D.imbalance_weights(df.where("label = 0")).first().scale_pos_weight == 1.0


def test_trials_are_seeded_and_within_their_ranges():
    one, two = M.draw_trials(n_trials=5, seed=1), M.draw_trials(n_trials=5, seed=1)
    assert one == two != M.draw_trials(n_trials=5, seed=2)
    for trial in one:
        for name, (low, high, _) in M.RANGES[trial.model].items():
            assert low <= trial.params[name] <= high


def test_protocol_compares_three_models_and_keeps_its_records(bundle, people):
    assert sorted(c["model"] for c in bundle.comparison) == sorted(M.MODELS)
    assert len(bundle.comparison) == 3
    best = max(bundle.comparison, key=lambda c: c["mean_pr_area"])
    assert bundle.metadata["selected_model"] == best["model"]
    assert bundle.metrics["brier_oof"] <= bundle.metrics["brier_oof_raw"]
    assert 0.6 < bundle.metrics["test_auc"] <= 1.0
    assert bundle.metadata["operating_point"]["precision"] >= 0.4
    counts = bundle.metadata["imbalance"]
    assert counts["positives"] + counts["negatives"] == 224


def test_gate_and_ledger(spark, people, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.table().count() == 0
    args = dict(seed=1, n_splits=2, n_trials=1, models=("logistic",), precision_floor=0.3, run="a/b: c")
    with pytest.raises(ValueError, match="below lower bound"):
        M.train_protocol(people, auc_band=(0.999, 1.0), ledger=ledger, **args)
    # The look counts although the gate failed, and for every other session, too.
    other = Ledger(spark.newSession(), str(tmp_path / "ledger"))
    with pytest.raises(RuntimeError, match="already scored"):
        other.touch("a/b: c", 1)
    with pytest.raises(RuntimeError, match="already scored"):
        M.train_protocol(people, auc_band=None, ledger=other, **args)
    other.touch("a/b: c", 2)
    assert sorted((r["run"], r["seed"]) for r in ledger.table().collect()) == [("a/b: c", 1), ("a/b: c", 2)]
    with pytest.raises(ValueError, match="unattainable"):
        M.train_protocol(people, auc_band=None, **{**args, "precision_floor": 1.01})


def test_one_look_of_many_at_once(spark, tmp_path):
    def look(_):
        try:
            Ledger(spark, str(tmp_path / "ledger")).touch("run", 7)
        except RuntimeError:
            return 0
        return 1

    with ThreadPoolExecutor(8) as pool:
        passed = sum(pool.map(look, range(24)))
    assert passed + look(None) == 1


def test_logistic_models_of_all_folds_are_those_fitted_alone(spark, people):
    numeric, categorical = D.feature_groups(people)
    folded = people.withColumn("fold", F.pmod(F.hash("customerID"), F.lit(3))).cache()
    trials = [M.Trial("logistic", k, {"C": c}) for k, c in enumerate((0.01, 1.0, 100.0))]
    got = M.search_params(
        folded, trials, key="customerID", numeric=numeric, categorical=categorical, seed=1, folds=3
    ).collect()
    assert len(got) == 3 * folded.count()
    scores = {(r["trial"], r["customerID"]): r["score"] for r in got}
    for fold in range(3):
        own = folded.where(F.col("fold") != fold)
        for t in trials[::2]:
            model, _ = M.fit_final(own, t, numeric, categorical, 1)
            alone = M._scored(model.transform(folded.where(F.col("fold") == fold))).collect()
            for r in alone:
                assert scores[t.trial, r["customerID"]] == pytest.approx(r["score"], abs=2e-3)


def test_few_models_of_a_search_ask_for_curvature(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(3000):
        a, b, word = rng.normal(), 1e9 + rng.normal(), ("x", "y", None)[i % 3]
        label = int(rng.random() < 1 / (1 + math.exp(-a - 0.5 * (word == "x"))))
        rows.append((i, float(a) if i % 7 else None, float(b), word, label, i % 3))
    df = spark.createDataFrame(rows, "k long, a double, b double, w string, label int, fold int").repartition(2).cache()
    preps = D.fit_fold_preparers(df, ["a", "b"], ["w"], folds=3)
    design = L.Design.of(preps, ["a", "b"], ["w"])
    raw = df.select("label", "fold", design.raw().alias("raw"))
    held = raw.collect()
    x = np.array([r["raw"] for r in held])
    for fold in range(3):
        assert np.allclose(design.prepared(x, fold), design.shared(x) @ design.mapped(fold), rtol=0, atol=1e-6)
    passes = []
    monkeypatch.setattr(L, "_sums", lambda d, shared, f=L._sums: (passes.append([p[2] for p in shared.value]), f(d, shared))[1])
    specs = [(fold, 10.0 ** (k / 4 - 2)) for fold in range(3) for k in range(16)]
    betas = L.fit_models(raw, design, specs)
    # Newton steps for every model would be 48 curvatures each.
    assert sum(map(sum, passes)) < 48 < sum(map(len, passes))
    y, out_of = np.array([r["label"] for r in held]), np.array([r["fold"] for r in held])
    for (fold, c), beta in zip(specs, betas, strict=True):
        own = design.prepared(x[out_of != fold], fold)
        label, (down, up) = y[out_of != fold], design.folds[fold][4]
        p = 1 / (1 + np.exp(-own @ beta))
        gradient = own.T @ (np.where(label > 0, up, down) * (p - label)) + beta * np.r_[0, np.full(len(beta) - 1, 1 / c)]
        assert np.abs(gradient).max() < 1e-6


def test_search_goes_on_where_it_ended(spark, people, tmp_path, monkeypatch):
    numeric, categorical = D.feature_groups(people)
    folded = people.withColumn("fold", F.pmod(F.hash("customerID"), F.lit(2))).cache()
    trials = [M.Trial("logistic", 0, {"C": 1.0}), M.Trial("levelwise", 0, {"n_estimators": 2, "max_depth": 2})]
    args = dict(key="customerID", numeric=numeric, categorical=categorical, seed=1, folds=2, path=str(tmp_path / "scores"))
    made = M.make_estimator
    calls = []

    def fails_once(*a):
        calls.append(a)
        if len(calls) == 2:
            raise OSError("lost")
        return made(*a)

    monkeypatch.setattr(M, "make_estimator", fails_once)
    with pytest.raises(OSError, match="lost"):
        M.search_params(folded, trials, **args)
    monkeypatch.setattr(M, "search_logistic", None)  # its scores are complete
    scores = M.search_params(folded, trials, **args)
    assert len(calls) == 3  # only the fold that was lost
    n = folded.count()
    assert {(r["model"], r["n"]) for r in scores.groupBy("model").agg(F.count("*").alias("n")).collect()} == {
        ("logistic", n), ("levelwise", n)
    }
    # Other parameters are other work.
    more = M.search_params(folded, [M.Trial("levelwise", 0, {"n_estimators": 1, "max_depth": 2})], **args)
    assert len(calls) == 5 and more.count() == n


def test_saved_bundle_reproduces(spark, bundle, people, tmp_path):
    registry = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        load_default_bundle(spark, registry)
    save_bundle(spark, bundle, registry, 43)
    path = save_bundle(spark, bundle, registry, 42)
    auc, same = M.reproduce_check(spark, path, people)
    assert same and auc == pytest.approx(bundle.metrics["test_auc"], abs=1e-4)
    again = load_default_bundle(spark, registry)
    assert again.threshold == bundle.threshold and again.comparison == bundle.comparison
    spark.createDataFrame([("x", "something else")], "name string, kind string").write.json(f"{registry}/odd/meta")
    with pytest.raises(TypeError, match="holds no"):
        load_bundle(spark, f"{registry}/odd")


def test_unseen_categories_and_missing_columns_still_score(spark, bundle):
    rows = spark.createDataFrame([("x", 5, "NEVER-SEEN"), ("y", None, None)], "customerID string, tenure int, Contract string")
    scored = bundle.score_calibrated(rows).collect()
    assert len(scored) == 2 and all(0 <= r.score <= 1 and 0 <= r.calibrated <= 1 for r in scored)


def test_external_report_names_what_is_missing(spark, bundle):
    foreign = spark.range(60).select(
        "id", (F.col("id") % 40).cast("int").alias("age"), F.when(F.col("id") % 3 == 0, "Yes").otherwise("No").alias("gone")
    )
    args = dict(key="id", label="foreign", seed=42, benchmark_auc=0.8)
    row = M.external_validation(bundle, foreign, {"age": "tenure", "gone": "Churn"}, **args).first()
    assert row["unmapped_features"] == ["Monthly_Charges", "Senior_Citizen", "Contract"]
    assert row["auc_delta"] == pytest.approx(row["external_auc"] - 0.8, abs=1e-4)
    with pytest.raises(ValueError, match="Churn"):
        M.external_validation(bundle, foreign, {"age": "tenure"}, **args)


@pytest.mark.parametrize("kind", ["levelwise", "leafwise"])
def test_tree_parts_sum_to_the_margin(people, kind):
    numeric, categorical = D.feature_groups(people)
    params = {"n_estimators": 5} | ({"max_depth": 3} if kind == "levelwise" else {"num_leaves": 8, "min_child_samples": 2})
    fitted, prep = M.fit_final(people, M.Trial(kind, 0, params), numeric, categorical, 1)
    rows = fitted.transform(people)
    model = fitted.stages[-1]
    assert isinstance(model, (GBTClassificationModel, LeafwiseModel))
    reasons = tree_drivers(rows, "customerID", model, prep.raw_names(), k=4)
    p = vector_to_array("probability")[1]
    both = reasons.join(rows.select("customerID", p.alias("p")), "customerID").collect()
    for r in both:
        value = 1 / (1 + math.exp(-r.margin))
        assert value == pytest.approx(r.p, abs=1e-9)
        sizes = [abs(d.contribution) for d in r.drivers]
        assert len(sizes) == 4 and sizes == sorted(sizes, reverse=True)


def test_linear_parts_sum_to_the_margin(spark, people):
    numeric, categorical = D.feature_groups(people)
    numeric = [c for c in numeric if c != "Senior_Citizen"]
    logistic = M.train_protocol(
        people.drop("Senior_Citizen"), seed=42, n_splits=2, n_trials=1, models=("logistic",),
        auc_band=None, precision_floor=0.3,
    )
    model = linear_model_of(logistic)
    scored = logistic.score(people).withColumn("mine", model.probability())
    assert scored.where(F.abs(F.col("score") - F.col("mine")) > 1e-9).isEmpty()
    parts = sum(model.contributions().values(), F.lit(0.0))
    gap = people.select((model.margin() - parts).alias("base"))
    assert gap.agg(F.max("base") - F.min("base")).first()[0] < 1e-9


def test_a_feature_without_categories_adds_nothing(spark):
    model = LinearModel(0.5, {}, {"c": {}})
    df = spark.createDataFrame([("x",), (None,)], "c string")
    assert [r[0] for r in df.select(model.margin()).collect()] == [0.5, 0.5]
    assert df.select(top_drivers(model.contributions())).count() == 2


def test_ties_keep_the_declared_order(spark):
    model = LinearModel(0.0, {"b": (0.0, 0.0, 0.0, 1.0), "a": (1.0, 0.0, 0.0, 1.0), "c": (0.0, 0.0, 0.0, 1.0)})
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "a double, b double, c double")
    drivers = df.select(top_drivers(model.contributions())).first()[0]
    assert [d.feature for d in drivers] == ["a", "b", "c"]


def test_longest_prefix_names_the_raw_column(spark):
    df = spark.createDataFrame(
        [("num__tenure",), ("cat__Dual_No",), ("cat__Dual_Line_Yes",), ("cat__Other__x",), ("cat__Dualist_1",)], "n string"
    )
    names = [r[0] for r in df.select(raw_feature(F.col("n"), ["Dual", "Dual_Line", "tenure"])).collect()]
    assert names == ["tenure", "Dual", "Dual_Line", "Other__x", "Dualist_1"]


def test_reports_are_kept_apart_by_kind(spark, tmp_path):
    path = str(tmp_path / "reports")
    write_report(spark.createDataFrame([(1, None)], "a int, b string"), path, "training", "r1")
    write_report(spark.createDataFrame([(0.5,)], "p95 double"), path, "latency", "r1")
    write_report(spark.createDataFrame([(2, "x")], "a int, b string"), path, "training", "r2")
    assert sorted(r.body for r in read_report(spark, path, "training").collect()) == ['{"a":1,"b":null}', '{"a":2,"b":"x"}']
    assert read_report(spark, path, "latency").count() == 1


@pytest.mark.parametrize("model, params", [("logistic", {"C": 1.0}), ("forest", {"n_estimators": 2, "max_depth": 2})])
def test_models_score_after_something_was_observed(spark, people, model, params):
    """A session with an observation cannot be sent to tasks, so no model may hold it."""
    seen = Observation(f"before-{model}")
    people.observe(seen, F.count("*").alias("n")).collect()
    assert seen.get["n"] == 280
    numeric, categorical = D.feature_groups(people)
    fitted, _ = M.fit_final(people, M.Trial(model, 0, params), numeric, categorical, 42)
    scores = fitted.transform(people).select(vector_to_array("probability")[1].alias("p")).collect()
    assert len(scores) == 280 and len({r.p for r in scores}) > 2 and all(0 <= r.p <= 1 for r in scores)


class Asked(Exception):
    pass


def asked(*args, **kwargs):
    raise Asked(args, kwargs)


def test_search_params_draws_all_trials_from_the_full_ranges(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(M, "search_params", asked)
    with pytest.raises(Asked) as told:
        QUERIES["search_params"](spark, sf_dir)
    trials = told.value.args[0][1]
    assert [t.model for t in trials] == [m for m in M.MODELS for _ in range(20)]
    trees = [t.params["n_estimators"] for t in trials if t.model != "logistic"]
    assert min(trees) >= 100 and max(trees) > 500
    assert max(t.params["max_depth"] for t in trials if t.model == "levelwise") == 10
    assert max(t.params["num_leaves"] for t in trials if t.model == "leafwise") > 200


def test_train_protocol_runs_all_trials_of_every_candidate_and_seed(spark, sf_dir, people, monkeypatch):
    calls = []

    def protocol(frame, *, seed, **settings):
        calls.append((seed, settings))
        return Bundle(None, 0.5, None, [], {}, metrics={"test_auc": 0.8})

    whole = M.train_protocol
    monkeypatch.setattr(M, "train_protocol", protocol)
    assert QUERIES["train_protocol"](spark, sf_dir).count() == 3
    assert sorted(seed for seed, _ in calls) == [42, 43, 44]
    monkeypatch.setattr(M, "search_params", asked)
    for seed, settings in calls:
        with pytest.raises(Asked) as told:
            whole(people, seed=seed, **settings)
        (_, trials), more = told.value.args
        assert trials == M.draw_trials(seed=seed) and len(trials) == 60 and more["folds"] == 5
