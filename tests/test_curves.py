import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.operators import curves as U
from tideline.operators.calibration import _pool_by, apply_knots, fit_isotonic, interpolate, pool
from tideline.operators.evaluation import band_gate, latency_report, select_candidate, slot_accuracy
from tideline.operators.prefix import running, value_cells
from tideline.operators.quantiles import medians, nearest_rank

FEW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def frame(spark, pairs):
    return spark.createDataFrame([(float(s), int(y)) for s, y in pairs], "score double, label int")


def auc(pairs):
    pos = [s for s, y in pairs if y]
    neg = [s for s, y in pairs if not y]
    wins = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def curve(pairs):
    total = sum(y for _, y in pairs)
    out = []
    for cut in sorted({s for s, _ in pairs}, reverse=True):
        tp = sum(y for s, y in pairs if s >= cut)
        n = sum(1 for s, _ in pairs if s >= cut)
        p, r = tp / n, tp / max(total, 1)
        out.append((cut, p, r, 2 * p * r / (p + r) if p + r else 0.0))
    return out


def pr_area(pairs):
    points = [(0.0, 1.0)] + [(r, p) for _, p, r, _ in curve(pairs)]
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))


scores = st.lists(
    st.tuples(st.sampled_from([0.0, 0.1, 0.1000001, 0.25, 0.5, 0.9, 1.0, -3.5, 1e-9, 7e5]), st.integers(0, 1)),
    min_size=4,
    max_size=40,
).filter(lambda rows: 0 < sum(y for _, y in rows) < len(rows))


@FEW
@given(scores)
def test_areas_equal_brute_force(spark, pairs):
    row = U.curve_metrics(frame(spark, pairs), "score", "label", digits=9).first()
    assert row["roc_auc"] == pytest.approx(auc(pairs), abs=1e-8)
    assert row["pr_area"] == pytest.approx(pr_area(pairs), abs=1e-8)
    share = sum(y for _, y in pairs) / len(pairs)
    assert row["pr_area_shifted"] == pytest.approx(pr_area(pairs) - share, abs=1e-8)


@FEW
@given(scores, st.sampled_from([0.0, 0.3, 0.55, 0.9]))
def test_operating_point_equals_brute_force(spark, pairs, floor):
    fit = [c for c in curve(pairs) if c[1] >= floor and c[2] > 0]
    df = frame(spark, pairs)
    if not fit:
        with pytest.raises(ValueError, match="unattainable"):
            U.select_operating_point(df, "score", "label", precision_floor=floor)
        return
    best = max(fit, key=lambda c: (c[3] * 1_000_000 + c[1], c[0]))
    point = U.select_operating_point(df, "score", "label", precision_floor=floor)
    assert point["threshold"] == best[0]
    assert (point["precision"], point["recall"]) == (best[1], best[2])


def test_separable_scores_reach_f1_one(spark):
    pairs = [(0.99 - i / 100, 1) for i in range(7)] + [(0.4 - i / 100, 0) for i in range(5)]
    point = U.select_operating_point(frame(spark, pairs), "score", "label")
    assert point["f1"] == 1.0 and point["threshold"] == pytest.approx(0.93)


def test_groups_are_independent_and_null_scores_ignored(spark):
    rows = [("a", 0.9, 1), ("a", 0.1, 0), ("b", 0.2, 1), ("b", 0.8, 0), ("b", None, 1)]
    rows += [(None, 0.4, 1), (None, 0.4, 0)]
    df = spark.createDataFrame(rows, "g string, score double, label int")
    found = {r.g: (r.n, r.roc_auc) for r in U.curve_metrics(df, "score", "label", ["g"]).collect()}
    assert found == {"a": (2, 1.0), "b": (2, 0.0), None: (2, 0.5)}
    points = U.operating_points(df, "score", "label", ["g"], precision_floor=0.5).collect()
    assert {p.g: p.threshold for p in points} == {"a": 0.9, "b": 0.2, None: 0.4}


def test_one_score_for_a_third_of_the_rows(spark):
    rng = random.Random(5)
    pairs = [(0.5, rng.random() < 0.5) for _ in range(300)] + [
        (round(rng.random(), 3), rng.random() < 0.3) for _ in range(600)
    ]
    row = U.curve_metrics(frame(spark, pairs), "score", "label").first()
    assert row["roc_auc"] == pytest.approx(auc(pairs), abs=1e-6)


VALUES = [0.0, -0.0, 1.0, 1.0000001, 8.0, 7.999999999999999, 2.0**-40, 1e-310, -1.5, -1e300, 1e300, 3e-5]


def test_cells_never_decrease(spark):
    rng = random.Random(1)
    values = sorted(VALUES + [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 12) for _ in range(500)]
                    + [2.0**k for k in range(-60, 60)] + [math.nextafter(2.0**k, 0) for k in range(-60, 60)])
    df = spark.createDataFrame([(v,) for v in values], "v double")
    cells = df.select("v", *value_cells(F.col("v"))).collect()
    by_value = sorted(cells, key=lambda r: r[0])
    keys = [(r[1], r[2]) for r in by_value]
    assert keys == sorted(keys)


def test_running_sums_and_carried_values(spark):
    rng = random.Random(2)
    rows = [("g%d" % (i % 3 == 0), rng.choice([-1, 1]) * 2.0 ** rng.uniform(-20, 20) + i * 1e-7, i, rng.choice([None, f"v{i}"]))
            for i in range(400)]
    df = spark.createDataFrame(rows, "g string, v double, n long, s string")
    out = running(df, groups=["g"], cells=value_cells(F.col("v")), order=["v"], sums=["n"], lasts=["s"])
    for group in ("g0", "g1"):
        total, last = 0, None
        for r in sorted((r for r in out.collect() if r.g == group), key=lambda r: r.v):
            last = r.s if r.s is not None else last
            assert (r.n_before, r.s_carried) == (total, last)
            total += r.n
    assert out.columns == ["g", "v", "n", "s", "n_before", "s_carried"]


def test_nearest_rank_and_median(spark):
    rng = random.Random(3)
    values = [("a", rng.gauss(0, 50)) for _ in range(101)] + [("b", 4.0)] * 40 + [("b", 5.0)] * 41 + [("c", None)] + [(None, 7.0)]
    df = spark.createDataFrame(values, "g string, v double")
    found = {r.g: r for r in nearest_rank(df, "v", {"p": 0.95}, ["g"]).collect()}
    a = sorted(v for g, v in values if g == "a")
    assert found["a"].p == a[min(round(0.95 * 100), 100)] and found["b"].p == 5.0 and "c" not in found
    assert found[None].p == 7.0
    middle = {r.g: r["median"] for r in medians(df, ["v"], ["g"]).collect()}
    assert middle["a"] == a[50] and middle["b"] == 5.0


def test_half_index_rounds_to_even(spark):
    df = spark.createDataFrame([(float(i),) for i in range(6)], "v double")
    # 0.5 * 5 = 2.5 rounds to 2, 0.3 * 5 = 1.5 rounds to 2
    found = nearest_rank(df, "v", {"a": 0.5, "b": 0.3}).first()
    assert tuple(found)[1:] == (2.0, 2.0)


def test_latency_budgets(spark):
    df = spark.createDataFrame([("e2e", 4.0)] * 3 + [("first_token", 2.0)], "metric string, seconds double")
    found = {r.metric: (r.p95, r.within_budget) for r in latency_report(df, "metric", "seconds").collect()}
    assert found == {"e2e": (4.0, True), "first_token": (2.0, False)}


def test_calibration_is_monotone_and_no_worse(spark):
    rng = random.Random(4)
    rows = [(p, int(rng.random() < p**2)) for p in (rng.random() for _ in range(400))]
    df = frame(spark, rows)
    blocks = fit_isotonic(df, "score", "label")
    both = apply_knots(df, blocks, "score", "calibrated")
    ordered = [r.calibrated for r in both.orderBy("score").collect()]
    assert ordered == sorted(ordered)
    row = U.brier(both, ["score", "calibrated"], "label").first()
    assert row["brier_calibrated"] <= row["brier_score"]
    ends = apply_knots(frame(spark, [(-5, 0), (5, 0)]), blocks, "score", "c").orderBy("score").collect()
    assert ends[0].c == min(ordered) and ends[1].c == max(ordered)


def isotone(rows):
    """Score to fitted value, pooling one violator at a time."""
    kept = []
    for x in sorted({p for p, _ in rows}):
        now = [[x], [y for p, y in rows if p == x]]
        while kept and sum(kept[-1][1]) * len(now[1]) >= sum(now[1]) * len(kept[-1][1]):
            last = kept.pop()
            now = [last[0] + now[0], last[1] + now[1]]
        kept.append(now)
    return {x: sum(ys) / len(ys) for xs, ys in kept for x in xs}


@pytest.mark.parametrize("seed", range(3))
def test_isotonic_blocks_and_lines(spark, seed):
    rng = random.Random(seed)
    draws = [
        lambda: round(rng.random(), 4), lambda: rng.choice([0.5, 0.5, 0.25]) + rng.random() * 1e-7,
        lambda: rng.gauss(0, 1) * 10 ** rng.randint(-6, 6),
    ]
    points = [draws[seed]() for _ in range(500)]
    rows = [(p, int(rng.random() < 0.3 + 0.4 * (k / 500))) for k, p in enumerate(sorted(points))]
    # A falling stretch that pools across cells, ties, and rows that teach nothing.
    rows += [(p, 1) for p in points[:40]] + [(points[0], 0)] * 3
    want = isotone(rows)
    odd = [(None, 1), (float("nan"), 1), (0.5, None)]
    df = spark.createDataFrame(rows + odd, "score double, label int").repartition(5)
    blocks = fit_isotonic(df, "score", "label")
    found = blocks.orderBy("lo").collect()
    values = [b.calibrated for b in found]
    assert values == sorted(set(values)) and sum(b.weight for b in found) == len(rows)
    xs = sorted(want)
    asked = xs + [rng.uniform(xs[0], xs[-1]) for _ in range(200)] + [xs[0] - 1, xs[-1] + 1, None, float("nan")]
    got = apply_knots(spark.createDataFrame([(x, "kept") for x in asked], "score double, other string"), blocks, "score", "y")
    assert got.columns == ["score", "other", "y"]
    ys = np.array([want[x] for x in xs])
    for r in got.collect():
        if r.score is None or math.isnan(r.score):
            assert r.y is None
        else:
            assert r.y == pytest.approx(float(np.interp(r.score, xs, ys)), abs=1e-9)


def test_isotonic_of_nothing(spark):
    blocks = fit_isotonic(frame(spark, []), "score", "label")
    assert blocks.count() == 0
    assert [r.y for r in apply_knots(frame(spark, [(0.5, 1)]), blocks, "score", "y").collect()] == [None]


def test_cells_of_a_batch_are_pooled_at_once():
    rng = np.random.default_rng(5)
    n = 4000
    coarse, fine = np.sort(rng.integers(0, 40, n)), np.zeros(n, np.int64)
    fine[:2000] = np.arange(2000)  # cells of one row; the others hold some hundred
    w = rng.integers(1, 4, n).astype(float)
    s = np.floor(rng.random(n) * (w + 1))
    lo = np.arange(n, dtype=float)
    rows = pa.table({"coarse": coarse, "fine": fine, "lo": lo, "hi": lo, "w": w, "s": s}).to_batches(700)
    made = list(_pool_by(["coarse", "fine"])(iter(rows)))
    assert len(made) <= 2 * len(rows)  # one for each cell before
    want = []
    for c, f in dict.fromkeys(zip(coarse.tolist(), fine.tolist(), strict=True)):
        own = (coarse == c) & (fine == f)
        want += [(c, f, *b) for b in zip(*(v.tolist() for v in pool(lo[own], lo[own], w[own], s[own])), strict=True)]
    assert [tuple(r.values()) for r in pa.Table.from_batches(made).to_pylist()] == want


def test_one_level_of_cells_gives_the_same_curve(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(g, rng.choice([rng.random(), 0.5, -0.25, 0.0]) if g else None, rng.randrange(2)) for g in (0, 1, 2, None) for _ in range(200)]
    df = spark.createDataFrame(rows, "g int, score double, label int").cache()
    found = lambda levels: sorted(map(str, U.curve_metrics(df, "score", "label", ["g"], digits=12, levels=levels).collect()))
    assert found(1) == found(2)
    assert U.cell_levels(df, "score", ["g"]) == 1
    monkeypatch.setattr(U, "FEW_ROWS", 20)
    assert U.cell_levels(df, "score", ["g"]) == 2
    assert U.cell_levels(df.where("false"), "score", ["g"]) == 1


def test_pooling_takes_any_order_of_violators():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 50, 400):
        s = rng.integers(0, 2, n).astype(float) if n != 50 else np.arange(50, 0, -1.0)
        # Each pooled pair falls below the block before it, one at a time.
        s = s if n != 400 else 1 / np.arange(1, 401) ** 2 - np.arange(400) % 2
        x = np.arange(n, dtype=float)
        lo, hi, w, total = pool(x, x, np.ones(n), s)
        assert len(lo) == 0 or (np.diff(total / w) > 0).all()
        assert w.sum() == n and total.sum() == pytest.approx(s.sum())
        for a, b, v in zip(lo, hi, total / w, strict=True):
            best = max(min(s[i : j + 1].mean() for j in range(int(a), n)) for i in range(int(a) + 1))
            assert v == pytest.approx(best)


def test_interpolation_clips(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.5, 1.0, 9.0)], "x double")
    ys = [r[0] for r in df.select(interpolate(F.col("x"), [(0.0, 1.0), (1.0, 3.0)])).collect()]
    assert ys == [1.0, 1.0, 2.0, 3.0, 3.0]


def test_first_declared_candidate_wins_a_tie(spark):
    df = spark.createDataFrame([("b", 0, 0.5), ("a", 1, 0.5), ("a", 0, 0.4)], "model string, trial int, mean_pr_area double")
    rows = select_candidate(df, "model", ["a", "b"]).collect()
    assert {(r.model, r.trial): r.selected for r in rows} == {("a", 1): True, ("b", 0): False}


def test_band_gate_flags_and_refuses(spark):
    df = spark.createDataFrame([(42, 0.8), (43, 0.86), (44, 0.9)], "seed int, auc double")
    assert [r.verdict for r in band_gate(df, "auc", (0.84, 0.88)).orderBy("seed").collect()] == [
        "below_band", "ok", "needs_leakage_audit",
    ]
    with pytest.raises(Exception, match="below lower bound"):
        band_gate(df, "auc", (0.84, 0.88), enforce=True).collect()


def test_slot_accuracy_counts_slots_not_cases(spark):
    rows = [
        (["tenure", "Contract"], ["tenure", "Dual"], False),
        (["tenure"], ["tenure", "Dual"], False),
        (["Nonsense"], [], True),
        ([], ["tenure"], True),
    ]
    df = spark.createDataFrame(rows, "expected array<string>, predicted array<string>, out_of_scope boolean")
    row = slot_accuracy(df).first()
    assert (row.slots, row.hits, row.correct_cases) == (3, 2, 2)
    assert (row.slot_accuracy, row.case_accuracy) == (0.6667, 0.5)


def test_infinities_and_nan_have_their_own_places(spark):
    inf = float("inf")
    rows = [(inf, 1), (0.5, 1), (0.2, 0), (-inf, 0), (0.5, 0)]
    df = spark.createDataFrame(rows, "p double, y int")
    found = U.curve_metrics(df, "p", "y").first()
    assert found["roc_auc"] == pytest.approx((3 + 2.5) / 6)
    values = spark.createDataFrame([(v,) for v in (inf, 1.0, -inf, 2.0, float("nan"))], "v double")
    got = nearest_rank(values, "v", {"low": 0.0, "mid": 0.5, "high": 0.75, "top": 1.0}).first()
    assert (got["low"], got["mid"], got["high"]) == (-inf, 2.0, inf)
    assert got["top"] != got["top"]
