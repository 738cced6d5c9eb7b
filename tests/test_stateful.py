"""Sessions, budgets and turns against plain loops; hot keys; late data."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.operators import budgets as B
from tideline.operators import sessions as S
from tideline.operators.scoring import LinearModel
from tideline.operators.turns import answer_turns, process_turns, read_turns
from tideline.streaming import ordered
from tideline.streaming.folds import (
    BudgetFold,
    call_budget_stream,
    redact_stream,
    session_epochs_stream,
    session_profile_stream,
)
from tideline.streaming.run import Closing, Report, read_files, run_available

SECOND = 1_000_000
START = 1_700_000_000 * SECOND


def make_calls(n=600, keys=6, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = 0 if rng.random() < 0.34 else rng.randrange(1, keys)  # a third on one key
        rows.append((key, START + rng.randrange(0, 3000) * SECOND // rng.choice([1, 1, 2]), i))
    return rows


def admitted(rows, max_calls, window):
    hits, out = {}, {}
    for key, ts, event in sorted(rows):
        log = [h for h in hits.get(key, []) if ts - h <= window]
        out[event] = len(log) < max_calls
        hits[key] = log + [ts] if out[event] else log
    return out


def test_budget_equals_a_plain_loop(spark):
    rows = make_calls()
    df = spark.createDataFrame(rows, "key long, ts_us long, event_id long")
    out = B.call_budget(df, max_calls=3, window_us=90 * SECOND).collect()
    assert {r.event_id: r.admitted for r in out} == admitted(rows, 3, 90 * SECOND)
    assert len(out) == len(rows)


def test_age_equal_to_the_window_still_counts(spark):
    rows = [(1, 0, 1), (1, 60 * SECOND, 2), (1, 60 * SECOND + 1, 3), (2, 5, 4)]
    df = spark.createDataFrame(rows, "key long, ts_us long, event_id long")
    out = B.call_budget(df, max_calls=1, window_us=60 * SECOND)
    assert {r.event_id: r.admitted for r in out.collect()} == {1: True, 2: False, 3: True, 4: True}
    report = B.budget_report(out, 60 * SECOND).collect()
    assert [(r.event_id, r.code, r.retry_after) for r in report] == [(2, "rate_limited", 60)]


def facts_frame(spark, n=500, seed=3):
    rng = random.Random(seed)
    rows = [
        ("hot" if rng.random() < 0.34 else f"s{rng.randrange(5)}", rng.randrange(10**13), i,
         rng.choice([None, None, f"a{i}"]), rng.choice([None, f"b{i}"]), rng.random() < 0.05)
        for i in range(n)
    ]
    return rows, spark.createDataFrame(rows, "sid string, ts long, id long, a string, b string, reset boolean")


def test_session_profile_equals_a_plain_loop(spark):
    rows, df = facts_frame(spark)
    out = S.session_profile(
        df, session=["sid"], order=["ts", "id"], facts={"A": F.col("a"), "B": F.col("b")}
    )
    found = {r.id: (r.A, r.B) for r in out.collect()}
    state, expected = {}, {}
    for sid, _, i, a, b, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        old = state.get(sid, (None, None))
        state[sid] = (a if a is not None else old[0], b if b is not None else old[1])
        expected[i] = state[sid]
    assert found == expected
    final = S.final_profile(df, session=["sid"], order=["ts", "id"], facts={"A": F.col("a"), "B": F.col("b")})
    assert {r.sid: (r.A, r.B) for r in final.collect()} == state


def test_epochs_count_resets(spark):
    rows, df = facts_frame(spark, seed=4)
    out = S.session_epochs(df, session=["sid"], order=["ts", "id"], reset=F.col("reset"))
    seen, expected = {}, {}
    for sid, _, i, _, _, reset in sorted(rows, key=lambda r: (r[1], r[2])):
        seen[sid] = seen.get(sid, 0) + reset
        expected[i] = seen[sid]
    assert {r.id: r.epoch for r in out.collect()} == expected


OK = '{"filters":{"Contract":"month to month","tenure":"24"},"out_of_scope":false}'
BAD = '{"filters":{"tenure":"weeks","Contract":"eternal"},"out_of_scope":false}'
FIX = '{"filters":{"Dual":"yes"},"out_of_scope":false}'
OUT = '{"out_of_scope":true}'
TURNS = [
    # session, turn, text, candidates, expected status, bad feature, profile after the turn
    ("a", 1, "stayed 24 months", OK, None, None, "ok", None, "Contract=Month-to-month, tenure=24"),
    ("a", 2, "hm", "junk", None, None, "invalid", None, "Contract=Month-to-month, tenure=24"),
    ("a", 3, "weather?", OUT, OK, None, "out_of_scope", None, "Contract=Month-to-month, tenure=24"),
    ("a", 4, "weeks", BAD, None, None, "unmapped", "tenure", "Contract=Month-to-month, tenure=24"),
    ("a", 5, "weeks", BAD, None, FIX, "ok", None, "Contract=Month-to-month, Dual=Yes, tenure=24"),
    ("b", 1, "no number", OK, None, None, "ok", None, "Contract=Month-to-month"),
    ("b", 2, "second try", "[]", FIX, None, "ok", None, "Contract=Month-to-month, Dual=Yes"),
    ("c", 1, "weeks", BAD, None, OUT, "unmapped", "tenure", ""),
    ("c", 2, "weeks", BAD, None, "junk", "unmapped", "tenure", ""),
    ("c", 3, "nothing", None, None, None, "invalid", None, ""),
]


def turn_frame(spark):
    rows = [(s, t, t * SECOND, x, a, b, c) for s, t, x, a, b, c, *_ in TURNS]
    return spark.createDataFrame(
        rows, "session_id string, turn int, ts_us long, user_text string, candidate_1 string, candidate_2 string, candidate_repair string"
    )


def test_turns_are_judged_and_refused_ones_leave_no_trace(spark):
    rows = process_turns(turn_frame(spark)).withColumn("text", S.facts_text(F.col("profile"))).collect()
    found = {(r.session_id, r.turn): (r.status, r.bad_feature, r.text) for r in rows}
    assert found == {(t[0], t[1]): tuple(t[6:]) for t in TURNS}
    assert read_turns(turn_frame(spark)).where("status <> 'ok' and facts is not null").isEmpty()


def test_answers_quote_only_the_payload(spark):
    from tideline.functions import vocabulary as V

    base = {f: "No" for f in V.FEATURES} | {"tenure": 10.0, "Monthly_Charges": 50.0, "Total_Charges": 500.0, "Senior_Citizen": False}
    kinds = ", ".join(f"{f} {'double' if f in V.NUMERIC_FEATURES else 'boolean' if f == V.FLAG else 'string'}" for f in V.FEATURES)
    baseline = spark.createDataFrame([tuple(base[f] for f in V.FEATURES)], kinds)
    model = LinearModel(-1.0, {"tenure": (-0.5, 10.0, 10.0, 5.0)}, {"Contract": {"Month-to-month": (1.25, 0.2)}, "Dual": {"Yes": (0.1, 0.5)}})
    out = answer_turns(process_turns(turn_frame(spark)), baseline, model, threshold=0.4, types=dict(baseline.dtypes))
    rows = {(r.session_id, r.turn): r for r in out.collect()}
    first = rows["b", 1]
    assert first.reply == (
        "Estimated churn probability 0.5622 — Churner at threshold 0.4000. Profile used: "
        "Contract=Month-to-month. Top drivers: Contract weight 1.0; Dual weight -0.05; tenure weight 0.0."
    )
    assert first.payload.churn_probability == 0.5622 and first.payload.churn_label == "Churner"
    assert len(first.payload.drivers) == 3
    for key in (("a", 2), ("a", 3), ("a", 4), ("c", 1)):
        assert rows[key].payload is None
        assert not any(ch.isdigit() for ch in rows[key].reply)
    assert "valid value for tenure" in rows["a", 4].reply


def write_batches(spark, path, rows, schema, batches):
    for i, chosen in enumerate(batches):
        spark.createDataFrame([rows[j] for j in chosen], schema).coalesce(1).write.mode("append").parquet(f"{path}")


def test_stream_budget_does_not_depend_on_arrival(spark, tmp_path):
    rows = make_calls(n=300, keys=4, seed=7)
    stamped = [(k, t, e) for k, t, e in rows]
    order = sorted(range(300), key=lambda i: (rows[i][1] // (400 * SECOND), random.Random(i).random()))
    schema = "key long, ts_us long, event_id long"
    path = str(tmp_path / "calls")
    chunks = [order[i : i + 75] for i in range(0, 300, 75)]
    for chunk in chunks:
        spark.createDataFrame([stamped[j] for j in chunk], schema).withColumn(
            "ts", F.timestamp_micros("ts_us")
        ).coalesce(1).write.mode("append").parquet(path)
    stream = read_files(spark, path, "key long, ts timestamp, event_id long", files_per_batch=1)
    out = run_available(
        call_budget_stream(stream, max_calls=3, window_us=90 * SECOND, delay="1000 seconds"), "t"
    )
    limit = max(t for _, t, _ in rows) - 1000 * SECOND
    expected = {e: ok for e, ok in admitted(rows, 3, 90 * SECOND).items()}
    found = {r.event_id: r.admitted for r in out.collect()}
    assert found == {e: expected[e] for k, t, e in rows if t <= limit}


def test_stream_profile_clears_on_null(spark, tmp_path):
    path = str(tmp_path / "turns")
    spark.sql(
        "select 'k' as key, timestamp_seconds(1000 + id * 10) as ts, id as event_id, "
        "case when id = 2 then null else map('f' || (id % 2), 'v' || id) end as facts from range(5) "
        "union all select 'z', timestamp_seconds(100000), 99, map('x', 'y')"
    ).coalesce(1).write.parquet(path)
    stream = read_files(spark, path, "key string, ts timestamp, event_id long, facts map<string,string>")
    rows = run_available(session_profile_stream(stream, delay="10 seconds"), "t").orderBy("event_id").collect()
    assert [r.profile for r in rows] == [
        {"f0": "v0"}, {"f0": "v0", "f1": "v1"}, {}, {"f1": "v3"}, {"f1": "v3", "f0": "v4"},
    ]


def test_stream_messages_are_scrubbed(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.createDataFrame([("mail a@b.org",), ("fine",)], "text string").write.parquet(path)
    out = run_available(redact_stream(read_files(spark, path, "text string")), "t")
    assert sorted(r.text for r in out.collect()) == ["fine", "mail [EMAIL]"]


def test_budget_of_null_keys_busy_keys_and_pauses(spark):
    """A busy key without a pause, a null key, and pauses just at the window."""
    rows = [(None if k % 3 else 7, k * 10 * SECOND, k) for k in range(400)]
    rows += [(8, k * 60 * SECOND + (k % 2), 1000 + k) for k in range(50)]
    df = spark.createDataFrame(rows, "key long, ts_us long, event_id long").repartition(3)
    out = {r.event_id: r.admitted for r in B.call_budget(df, max_calls=2, window_us=60 * SECOND).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        want |= admitted([(0, t, e) for k, t, e in rows if k == key], 2, 60 * SECOND)
    assert out == want
    none = B.call_budget(df, max_calls=0, window_us=60 * SECOND)
    assert none.where("admitted").isEmpty() and none.count() == len(rows)


TTL = 50 * SECOND
TURN = "key string, ts timestamp, event_id long, feature string, stated string"


def make_turns(n=200, seed=11):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.34 else f"s{rng.randrange(4)}"
        feature = rng.choice([None, "f0", "f1", "f2"])  # no feature is a reset
        rows.append((key, START + rng.randrange(0, 2000) * SECOND, i, feature, rng.choice([None, f"v{i}"])))
    return rows


def epochs(rows):
    """The plain loop: (epoch, profile) by event."""
    alive, out = {}, {}
    for key, ts, event, feature, stated in sorted(rows, key=lambda r: (r[1], r[2])):
        epoch, profile, last = alive.get(key, (None, {}, None))
        if last is None or ts - last > TTL or feature is None:
            epoch, profile = event, {}
        if feature is not None and stated is not None:
            profile = {**profile, feature: stated}
        alive[key] = (epoch, profile, ts)
        out[event] = (epoch, profile)
    return out


def epoch_stream(spark, folder, closing=None, **options):
    stream = read_files(spark, folder, TURN, **options)
    if closing is not None:
        stream = closing.added_to(stream)
    facts = F.when(F.col("feature").isNotNull(), F.create_map("feature", "stated"))
    return session_epochs_stream(
        stream.select("key", "ts", "event_id", facts.alias("facts")), ttl_us=TTL, delay="400 seconds"
    )


def write_turns(spark, folder, rows):
    spark.createDataFrame(rows, "key string, us long, event_id long, feature string, stated string").select(
        "key", F.timestamp_micros("us").alias("ts"), "event_id", "feature", "stated"
    ).coalesce(1).write.mode("append").parquet(folder)


def test_stream_epochs_equal_a_plain_loop_and_leave_no_state(spark, tmp_path):
    rows, path = make_turns(), str(tmp_path / "turns")
    order = sorted(range(len(rows)), key=lambda i: (rows[i][1] // (300 * SECOND), random.Random(i).random()))
    for at in range(0, len(rows), 50):
        write_turns(spark, path, [rows[i] for i in order[at : at + 50]])
    closing, report = Closing(spark, spark.createDataFrame([], TURN).schema), Report()
    stream = epoch_stream(spark, path, closing, files_per_batch=1)
    found = run_available(stream, "epochs", closing=closing, report=report).collect()
    assert {r.event_id: (r.epoch, r.profile) for r in found} == epochs(rows)
    assert len(found) == len(rows)
    assert report.late_rows == 0
    # What is left belongs to the closing row: one held slot and its timer.
    only, nothing = Report(), str(tmp_path / "none")
    spark.createDataFrame([], TURN).write.parquet(nothing)
    closing = Closing(spark, spark.createDataFrame([], TURN).schema)
    run_available(epoch_stream(spark, nothing, closing), "none", closing=closing, report=only)
    assert report.state_rows == only.state_rows


def test_a_turn_at_the_end_of_the_time_to_live_goes_on(spark, tmp_path):
    path = str(tmp_path / "turns")
    at = [0, TTL, 2 * TTL + 1, 2 * TTL + 1]
    rows = [("k", START + t, i, "f0", f"v{i}" if i != 3 else None) for i, t in enumerate(at)]
    write_turns(spark, path, [*rows, ("z", START + 3600 * SECOND, 99, "f0", "x")])
    found = run_available(epoch_stream(spark, path), "t").orderBy("event_id").collect()
    assert [r.epoch for r in found] == [0, 0, 2, 2]
    assert [r.profile for r in found] == [{"f0": "v0"}, {"f0": "v1"}, {"f0": "v2"}, {"f0": "v2"}]


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    path = str(tmp_path / "calls")
    schema = "key long, ts timestamp, event_id long"

    def arrive(*calls):
        spark.createDataFrame(calls, "key long, s long, event_id long").select(
            "key", F.timestamp_seconds("s").alias("ts"), "event_id"
        ).coalesce(1).write.mode("append").parquet(path)

    arrive((1, 1000, 1), (2, 2000, 2))
    closing, report = Closing(spark, spark.createDataFrame([], schema).schema), Report()
    calls = closing.added_to(read_files(spark, path, schema))
    out = run_available(
        call_budget_stream(calls, max_calls=9, window_us=SECOND, delay="100 seconds"),
        "late",
        # The watermark stands at 1900: a row of that time is late, one after it is not.
        arrivals=[lambda: arrive((1, 1100, 3), (3, 1900, 4), (3, 1901, 5), (1, 2500, 6))],
        closing=closing,
        report=report,
    )
    assert sorted(r.event_id for r in out.collect()) == [1, 2, 5, 6]
    assert report.late_rows == 2


class CountingState:
    """A handle, its map, its value and its timers as plain objects, with the calls that touch them."""

    def __init__(self):
        self.map, self.value, self.timers, self.calls = {}, None, set(), 0

    def __getattr__(self, name):
        calls = {
            "getMapState": lambda *_: self, "getValueState": lambda *_: CountingState(),
            "containsKey": self.map.__contains__, "getValue": self.map.__getitem__,
            "updateValue": self.map.__setitem__, "removeKey": self.map.pop, "keys": lambda: list(self.map),
            "exists": lambda: self.value is not None, "get": lambda: self.value,
            "update": lambda v: setattr(self, "value", v), "registerTimer": self.timers.add,
        }

        def call(*args):
            self.calls += 1
            return calls[name](*args)

        return call

    def getCurrentWatermarkInMs(self):
        return self.watermark


@pytest.mark.parametrize("piece", [7, 4096])
def test_held_rows_touch_state_once_a_piece(monkeypatch, piece):
    """Rows hours apart, many of one time, in two batches; the watermark comes in steps."""
    monkeypatch.setattr(ordered, "PIECE_ROWS", piece, raising=False)
    rng = random.Random(4)
    rows = [(rng.choice([5 * SECOND, rng.randrange(10**6) * SECOND]), e, str(e)) for e in range(600)]
    state, fold = CountingState(), BudgetFold(3, 3600 * SECOND)
    fold.init(state)
    for half in (rows[:300], rows[300:]):
        assert not list(fold.handleInputRows(("k",), iter([pd.DataFrame(half, columns=["ts_us", "event_id", "body"])]), state))
    held = len(state.map)
    assert held <= 2 * (300 // piece + 1) and len(state.timers) == held and state.calls <= 5 * held + 5
    out = []
    for limit in (5, 400_000, 10**6):
        state.watermark = limit * 1000
        due = {t for t in state.timers if t < state.watermark}
        state.timers -= due
        for _ in due:
            out += [tuple(r) for f in fold.handleExpiredTimer(("k",), state, None) for r in f.itertuples(index=False)]
        assert len(out) == sum(t <= limit * SECOND for t, _, _ in rows)
    want = admitted([("k", t, e) for t, e, _ in rows], 3, 3600 * SECOND)
    assert {e: ok for _, _, e, ok in out} == want and not state.map and not state.timers
