"""Request policies over event streams: sliding windows, admission, circuit breakers, adaptive delays.

Windows are range frames over slices of time. What depends on its own earlier decisions (admission, breaker, schedule) is a fold over a key's
events in order: `sorted_fold` streams sorted partitions through it and holds a key's state and one batch, however many events
the key has; the streaming module keeps the same state between batches.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    requests_per_minute: int = 30
    burst: int = 0
    window: float = 60.0
    failures: int = 5
    recovery: float = 300.0
    tests: int = 3
    slow: float = 2.0
    slowdown: float = 1.5
    longest: float = 60.0
    remembered: int = 100


LIMITS = Limits()


def micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


#: A slice of time has so many windows; a window's worth of each goes with the next one too.
SLICE = 16


def window_counts(events: DataFrame, key: str, seconds: float = LIMITS.window) -> DataFrame:
    """Adds n_window: events of the key in the last seconds, the event's own and one exactly that old included. Keys are cut into slices
    of time, each with what the slice before it has in reach, so that a key with a third of all events is no single partition."""
    reach = int(seconds * 1_000_000)
    place = F.floor(F.col("us") / (SLICE * reach))
    near = F.when(F.col("us") + reach >= (place + 1) * (SLICE * reach), place + 1)
    sliced = events.withColumn("us", micros()).withColumn("own", place).withColumn("slice", F.explode(F.array_compact(F.array(place, near))))
    w = W.partitionBy(key, "slice").orderBy("us").rangeBetween(-reach, 0)
    return sliced.withColumn("n_window", F.count("*").over(w)).where("slice = own").drop("us", "own", "slice")


def adaptive_delay(events: DataFrame, key: str, value: str = "value", limits: Limits = LIMITS) -> DataFrame:
    """Adds avg_time of the key's last responses and the delay that follows from it."""
    w = W.partitionBy(key).orderBy("ts", "event_id").rowsBetween(-(limits.remembered - 1), 0)
    average = F.avg(value).over(w)
    return events.withColumn("avg_time", average).withColumn(
        "delay", F.when(F.col("avg_time") > limits.slow, F.least(F.col("avg_time") * limits.slowdown, F.lit(limits.longest))).otherwise(0.0)
    )


def key_stats(events: DataFrame, key: str, failed: Column, value: str = "value") -> DataFrame:
    return events.groupBy(key).agg(
        F.count("*").alias("total_requests"), F.count_if(~failed).alias("successful_requests"), F.count_if(failed).alias("failed_requests"), F.max("ts").alias("last_request")
    )


#: What events do to a key: in a state, on an event, if a guard holds, the next state and what becomes of the numbers. Rules are tried in their order; an
#: event without one changes nothing. `spare` asks are let through, the others are refused.
ASKED, GOOD, BAD = "asked", "good", "bad"
RULES = {
    ("CLOSED", ASKED): [("always", "CLOSED", "spare")],
    ("CLOSED", GOOD): [("always", "CLOSED", "forgive")],
    ("CLOSED", BAD): [("last straw", "OPEN", "blame"), ("always", "CLOSED", "blame")],
    ("OPEN", ASKED): [("rested", "HALF_OPEN", "probe")],
    ("OPEN", BAD): [("always", "OPEN", "blame")],
    ("HALF_OPEN", ASKED): [("untried", "HALF_OPEN", "spare")],
    ("HALF_OPEN", GOOD): [("last test", "CLOSED", "acquit"), ("always", "HALF_OPEN", "pass")],
    ("HALF_OPEN", BAD): [("always", "OPEN", "blame")],
}
GUARDS = {
    "always": lambda x, now, limits: True,
    "last straw": lambda x, now, limits: x["failures"] + 1 >= limits.failures,
    "rested": lambda x, now, limits: now - x["blamed_at"] >= limits.recovery,
    "untried": lambda x, now, limits: x["passed"] < limits.tests,
    "last test": lambda x, now, limits: x["passed"] + 1 >= limits.tests,
}
EFFECTS = {
    "spare": lambda x, now: {},
    "probe": lambda x, now: {"passed": 0},
    "forgive": lambda x, now: {"failures": max(0, x["failures"] - 1)},
    "blame": lambda x, now: {"failures": x["failures"] + 1, "blamed_at": now},
    "pass": lambda x, now: {"passed": x["passed"] + 1},
    "acquit": lambda x, now: {"passed": x["passed"] + 1, "failures": 0},
}


class Breaker:
    """A key's place in the table of RULES. `held` is all that is kept of it: state, failures, blamed_at, passed."""

    def __init__(self, limits: Limits = LIMITS, held: dict | None = None):
        self.limits = limits
        self.held = {"state": "CLOSED", "failures": 0, "blamed_at": 0.0, "passed": 0} | (held or {})

    @property
    def state(self) -> str:
        return self.held["state"]

    @property
    def failures(self) -> int:
        return self.held["failures"]

    def on(self, event: str, now: float) -> bool:
        """Applies the first rule that fits, and says whether there was one."""
        for guard, state, effect in RULES.get((self.state, event), ()):
            if GUARDS[guard](self.held, now, self.limits):
                self.held |= EFFECTS[effect](self.held, now) | {"state": state}
                return True
        return False

    def ask(self, failed: bool, now: float) -> bool:
        """Whether a request may go; if so, its outcome counts."""
        may = self.on(ASKED, now)
        if may:
            self.on(BAD if failed else GOOD, now)
        return may


@dataclass
class Admission:
    """A literal maximum of admitted requests in a window; only those count."""

    limits: Limits = LIMITS
    admitted: deque = field(default_factory=deque)

    def ask(self, now: float) -> tuple[bool, float]:
        while self.admitted and self.admitted[0] < now - self.limits.window:
            self.admitted.popleft()
        if len(self.admitted) >= self.limits.requests_per_minute + self.limits.burst:
            return False, self.limits.window - (now - self.admitted[0]) + 1.0
        self.admitted.append(now)
        return True, 0.0


def sorted_fold(events: DataFrame, key: str, columns: list[str], begin, made: dict[str, pa.DataType]) -> DataFrame:
    """key, event_id and `made` for every event. begin() gives what folds one key: a function of us and the columns that returns the
    values made. Events come sorted by key, ts and event_id; between batches only the function of the last key is kept."""
    kinds = {key: dict(events.dtypes)[key], "event_id": dict(events.dtypes)["event_id"]}
    names = [key, "event_id", *made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, step = object(), None
        for batch in batches:
            out = []
            keys, numbers, times, *rest = (batch[c].to_pylist() for c in [key, "event_id", "us", *columns])
            for k, us, *values in zip(keys, times, *rest):
                if step is None or k != last:
                    last, step = k, begin()
                out.append(step(us, *values))
            values = [pa.array(v, t) for v, t in zip(zip(*out), made.values())] if out else [pa.array([], t) for t in made.values()]
            yield pa.RecordBatch.from_arrays([batch[key], batch["event_id"], *values], names)

    rows = events.withColumn("us", micros()).select(key, "event_id", "us", *columns)
    rows = rows.repartition(F.col(key)).sortWithinPartitions(key, "us", "event_id")
    sql = {pa.bool_(): "boolean", pa.string(): "string", pa.int64(): "bigint", pa.float64(): "double"}
    return rows.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in kinds.items()), *(f"{n} {sql[t]}" for n, t in made.items())]))


def breaker_states(events: DataFrame, key: str, limits: Limits = LIMITS) -> DataFrame:
    """key, event_id, allowed, state and failures after each event; `failed` says how a request went. Refused requests have no outcome."""

    def begin():
        b = Breaker(limits)

        def step(us, failed):
            return b.ask(failed, us / 1e6), b.state, b.failures

        return step

    return sorted_fold(events, key, ["failed"], begin, {"allowed": pa.bool_(), "state": pa.string(), "failures": pa.int64()})


def admissions(events: DataFrame, key: str, limits: Limits = LIMITS) -> DataFrame:
    """key, event_id, admitted and the seconds to wait if not."""

    def begin():
        a = Admission(limits)
        return lambda us: a.ask(us / 1e6)

    return sorted_fold(events, key, [], begin, {"admitted": pa.bool_(), "wait": pa.float64()})


def schedule(events: DataFrame, key: str, minimum_delay: float = 1.0, polite: bool = False) -> DataFrame:
    """key, event_id, start (seconds) and waited: requests of an origin one after another, each no sooner than the one before allows.
    `retry_after` (seconds or null) of a 429 counts if longer; no jitter, so that results repeat."""
    delay = max(2 * minimum_delay, 1.0) if polite else minimum_delay

    def begin():
        ready = [0.0]

        def step(us, after):
            start = max(us / 1e6, ready[0])
            ready[0] = start + max(delay, 0.0 if after is None or after != after else float(after))
            return start, start - us / 1e6

        return step

    return sorted_fold(events, key, ["retry_after"], begin, {"start": pa.float64(), "waited": pa.float64()})
