"""From chat turns with JSON candidates to statuses, profiles and answers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import vocabulary as V
from tideline.functions.fence import fenced
from tideline.functions.numeric import round_dp
from tideline.functions.requests import accepted, check_requests
from tideline.functions.text import canon_value, grounded_number, normalize_text
from tideline.operators.scoring import (
    LinearModel,
    compose_answer,
    label_at_threshold,
    top_drivers,
    what_if,
)
from tideline.operators.sessions import facts_map, session_profile
from tideline.session import materialize


def _read_filters(df: DataFrame, filters: str, name: str) -> DataFrame:
    """Add the filters in written order as (key, canonical value) entries.

    Every wording is normalised once, before the cases that look at it.
    """
    folded = F.transform(
        F.map_entries(filters),
        lambda e: F.struct(
            e["key"].alias("key"),
            e["value"].alias("value"),
            normalize_text(e["value"]).alias("needle"),
        ),
    )
    canonical = F.transform(
        "_folded",
        lambda e: F.struct(
            e["key"].alias("key"), canon_value(e["key"], e["value"], e["needle"]).alias("value")
        ),
    )
    return df.withColumn("_folded", folded).withColumn(name, canonical).drop("_folded")


def _unread(entries: str) -> Column:
    return F.filter(entries, lambda e: e["value"].isNull())


def read_turns(turns: DataFrame) -> DataFrame:
    """Add ``status``, ``bad_feature`` and ``facts`` to every turn.

    The first valid of two candidates counts. An unreadable value calls on the
    repair candidate, whose facts replace all of the first one's, unless it is
    invalid or out of scope itself. Numbers the user never wrote are dropped.
    A refused turn states no facts. Narrow throughout: no turn looks at
    another one. Later candidates are parsed only where they are needed.
    """
    judged = check_requests(turns, "candidate_1", "_1_")
    judged = judged.withColumn(
        "_text_2", F.when(~F.coalesce(accepted("_1_"), F.lit(False)), F.col("candidate_2"))
    )
    judged = check_requests(judged, "_text_2", "_2_")
    first, second = accepted("_1_"), accepted("_2_")
    chosen = judged.select(
        *turns.columns,
        F.when(first, F.col("_1_filters")).when(second, F.col("_2_filters")).alias("_chosen"),
        F.when(first, F.col("_1_out_of_scope"))
        .when(second, F.col("_2_out_of_scope"))
        .alias("_refused"),
    )
    read = _read_filters(chosen, "_chosen", "_entries_1")
    read = read.withColumn(
        "_text_r", F.when(F.size(_unread("_entries_1")) > 0, F.col("candidate_repair"))
    )
    read = check_requests(read, "_text_r", "_r_")
    repairs = F.coalesce(accepted("_r_") & ~F.col("_r_out_of_scope"), F.lit(False))
    read = read.withColumn("_repair", F.when(repairs, F.col("_r_filters")))
    read = _read_filters(read, "_repair", "_entries_r")
    settled = read.withColumn("_entries", F.coalesce("_entries_r", "_entries_1"))
    bad = _unread("_entries")
    judged = settled.withColumn(
        "_status",
        F.when(F.col("_chosen").isNull(), "invalid")
        .when(F.col("_refused"), "out_of_scope")
        .when(F.size(bad) > 0, "unmapped")
        .otherwise("ok"),
    )
    kept = F.filter(
        "_entries",
        lambda e: ~e["key"].isin(*V.NUMERIC_FEATURES)
        | grounded_number(e["value"], F.col("user_text")),
    )
    status = F.col("_status")
    return fenced(
        judged,
        {
            "status": status,
            "bad_feature": F.when(status == "unmapped", bad[0]["key"]),
            "facts": F.when(status == "ok", F.map_from_entries(kept)),
        },
        keep=turns.columns,
    )


def process_turns(
    turns: DataFrame,
    *,
    session: Sequence[str] = ("session_id",),
    order: Sequence[str] = ("ts_us", "turn"),
) -> DataFrame:
    """Every turn with its verdict and the session profile after it.

    Requests are read where the turns are, once, and written down with their
    verdicts; what is shuffled by session afterwards is that table.
    """
    facts = {f: F.col("facts")[f] for f in V.FEATURES}
    read = materialize(read_turns(turns), "read-turns")
    stated = session_profile(read, session=session, order=order, facts=facts)
    return stated.withColumn("profile", facts_map(V.FEATURES)).drop(*V.FEATURES)


def answer_turns(
    processed: DataFrame,
    baseline: DataFrame,
    model: LinearModel,
    *,
    threshold: float,
    types: Mapping[str, str],
    calibrate: Callable[[Column], Column] | None = None,
    label_on_calibrated: bool = False,
) -> DataFrame:
    """Reply text and payload of every turn; refused turns have no payload.

    ``calibrate`` turns a score into the probability that is shown. The label
    compares the raw score with the threshold, or the calibrated one if asked.
    Contributions in the payload have four decimals.
    """
    rows = what_if(processed, "profile", baseline, types)
    scored = rows.withColumns(
        {"_score": model.probability(), "_drivers": top_drivers(model.contributions())}
    )
    raw = F.col("_score")
    p = raw if calibrate is None else calibrate(raw)
    label = label_at_threshold(p if label_on_calibrated else raw, F.lit(threshold))
    ok = F.col("status") == "ok"
    answer = compose_answer(p, label, F.lit(threshold), F.col("profile"), F.col("_drivers"))
    text = (
        F.when(ok, answer)
        .when(F.col("status") == "invalid", F.lit(V.REPLY_INVALID))
        .when(F.col("status") == "out_of_scope", F.lit(V.REPLY_OUT_OF_SCOPE))
        .otherwise(F.format_string(V.REPLY_UNMAPPED, F.col("bad_feature")))
    )
    payload = F.struct(
        round_dp(p, 4).alias("churn_probability"),
        label.alias("churn_label"),
        F.transform(
            "_drivers",
            lambda d: F.struct(
                d["feature"].alias("feature"), round_dp(d["contribution"], 4).alias("contribution")
            ),
        ).alias("drivers"),
    )
    return scored.select(
        *processed.columns, text.alias("reply"), F.when(ok, payload).alias("payload")
    )
