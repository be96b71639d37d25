"""The policy operators over streams: the same folds as in a batch, with their state kept between micro-batches."""

from __future__ import annotations

import json
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from pagemill.operators.policy import LIMITS, Admission, Breaker, Limits, micros


def _fold(events: DataFrame, key: str, schema: str, start, step, dump, load) -> DataFrame:
    """step(state, rows) for a key's new rows in order; state travels as JSON and holds no more than the window."""

    def run(k, frames, held):
        state = load(json.loads(held.get[0])) if held.exists else start()
        rows = pd.concat(list(frames)).sort_values(["us", "event_id"], kind="stable")
        out = step(k[0], state, rows)
        held.update((json.dumps(dump(state)),))
        yield out

    return events.withColumn("us", micros()).groupBy(key).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.NoTimeout)


def admissions(events: DataFrame, key: str, limits: Limits = LIMITS) -> DataFrame:
    def step(k, a: Admission, rows):
        out = [(k, e, *a.ask(us / 1e6)) for e, us in zip(rows["event_id"], rows["us"])]
        return pd.DataFrame(out, columns=[key, "event_id", "admitted", "wait"])

    kind = dict(events.dtypes)[key]
    schema = f"{key} {kind}, event_id bigint, admitted boolean, wait double"
    return _fold(events, key, schema, lambda: Admission(limits), step, lambda a: list(a.admitted), lambda x: Admission(limits, deque(x)))


def breaker_states(events: DataFrame, key: str, limits: Limits = LIMITS) -> DataFrame:
    """events need `failed`."""

    def step(k, b: Breaker, rows):
        out = []
        for e, us, bad in zip(rows["event_id"], rows["us"], rows["failed"]):
            out.append((k, e, b.ask(bool(bad), us / 1e6), b.state, b.failures))
        return pd.DataFrame(out, columns=[key, "event_id", "allowed", "state", "failures"])

    kind = dict(events.dtypes)[key]
    schema = f"{key} {kind}, event_id bigint, allowed boolean, state string, failures bigint"
    return _fold(events, key, schema, lambda: Breaker(limits), step, lambda b: b.held, lambda held: Breaker(limits, held))


def window_counts(events: DataFrame, key: str, window: str = "1 minute", slide: str = "10 seconds", late: str = "5 minutes") -> DataFrame:
    """Events of each key in sliding windows of event time; those later than the watermark are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window, slide), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
