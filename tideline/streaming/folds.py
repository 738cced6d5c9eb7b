"""Stream forms of the call budget, the session profile and the log scrubber."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.redaction import redact
from tideline.operators.budgets import AdmittedRing
from tideline.streaming.ordered import OrderedFold, fold_stream


class BudgetFold(OrderedFold):
    """The carry is the log of admitted times, at most ``max_calls`` of them."""

    def __init__(self, max_calls: int, window_us: int):
        self._limits = (max_calls, window_us)

    def start(self):
        return []

    def step(self, carry, ts_us, event_id, body):
        ring = AdmittedRing(*self._limits, carry)
        admitted = ring.offer(ts_us)
        return ring.times(), admitted


class ProfileFold(OrderedFold):
    """The carry is the session's facts; a body of null starts a new epoch."""

    def start(self):
        return {}

    def step(self, carry, ts_us, event_id, body):
        facts = json.loads(body) if body is not None else None
        carry = {**carry, **facts} if facts is not None else {}
        return carry, json.dumps(carry, sort_keys=True)


class EpochFold(OrderedFold):
    """The carry is the running epoch: its first event, its facts, its last time.

    A body of null starts a new epoch, and so does a turn more than ``ttl_us``
    after the one before. An epoch is named by its first event, so nothing of a
    session that has expired needs to be kept.
    """

    def __init__(self, ttl_us: int):
        self._ttl = ttl_us

    def start(self):
        return None

    def step(self, carry, ts_us, event_id, body):
        if carry is None or body is None or ts_us - carry["last"] > self._ttl:
            carry = {"epoch": event_id, "facts": {}}
        stated = {k: v for k, v in json.loads(body).items() if v is not None} if body is not None else {}
        carry = {"epoch": carry["epoch"], "facts": {**carry["facts"], **stated}, "last": ts_us}
        return carry, json.dumps({"epoch": carry["epoch"], "profile": carry["facts"]}, sort_keys=True)

    def lapses(self, carry):
        return carry["last"] + self._ttl


def call_budget_stream(
    calls: DataFrame, *, max_calls: int, window_us: int, delay: str = "1 hour"
) -> DataFrame:
    """Stream of calls (key, ts, event_id) with ``admitted``."""
    rows = calls.select("key", "ts", "event_id", F.lit("").alias("body"))
    folded = fold_stream(rows, BudgetFold(max_calls, window_us), T.BooleanType(), delay=delay)
    return folded.withColumnRenamed("value", "admitted")


def session_profile_stream(turns: DataFrame, *, delay: str = "1 hour") -> DataFrame:
    """Stream of turns (key, ts, event_id, facts map) with the profile after each.

    A turn whose facts are null clears the session.
    """
    rows = turns.select("key", "ts", "event_id", F.to_json("facts").alias("body"))
    folded = fold_stream(rows, ProfileFold(), T.StringType(), delay=delay)
    return folded.select(
        "key", "ts_us", "event_id", F.from_json("value", "map<string,string>").alias("profile")
    )


def session_epochs_stream(turns: DataFrame, *, ttl_us: int, delay: str = "1 hour") -> DataFrame:
    """Stream of turns (key, ts, event_id, facts map) with epoch and profile after each.

    A turn whose facts are null resets the session; one that comes more than
    ``ttl_us`` after the turn before it finds the session expired. Both start an
    epoch, named by its first event, with no facts from before. The state of a
    session is dropped as soon as the watermark shows that it has expired, so
    state is bounded by the sessions that are alive. Features stated as null
    keep their value.
    """
    rows = turns.select("key", "ts", "event_id", F.to_json("facts").alias("body"))
    folded = fold_stream(rows, EpochFold(ttl_us), T.StringType(), delay=delay)
    value = F.from_json("value", "epoch long, profile map<string,string>")
    return folded.select("key", "ts_us", "event_id", value.alias("value")).select(
        "key", "ts_us", "event_id", "value.epoch", "value.profile"
    )


def redact_stream(messages: DataFrame, column: str = "text") -> DataFrame:
    """Every message scrubbed before it is stored; stateless."""
    return messages.withColumn(column, redact(F.col(column)))
