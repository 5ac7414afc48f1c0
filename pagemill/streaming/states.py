"""State machines over calls: admission, alerts with a pause, a circuit breaker, and clients that fall silent.

Whether a call is admitted depends on those admitted before, so each is a fold over one client's calls in order of time. The fold is
written once, as a class whose state has the columns of STATE. ``fold`` runs it over a batch table, a key at a time; ``fold_stream`` runs
it on a stream by ``transformWithState``: the state is a typed value in RocksDB, and a timer of event time drops that of a client which has been silent for
as long as is asked. Streams take calls in order of time; what is late within the watermark counts where it comes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds of silence after which a client is forgotten.
IDLE = 3600.0
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RateLimiter:
    """At most 60 calls a minute, 500 an hour and 10 within a second; a call that is rejected leaves no trace."""

    STATE = "admitted array<double>"

    def __init__(self, state: dict | None = None, minute: int = 60, hour: int = 500, burst: int = 10):
        self.state = state or {"admitted": []}
        self.limits = ((60.0, minute), (3600.0, hour), (1.0, burst))

    def step(self, at: float, ok: bool, latency: float) -> str:
        held = self.state["admitted"] = [t for t in self.state["admitted"] if at - t < 3600.0]
        if any(sum(at - t < span for t in held) >= most for span, most in self.limits):
            return "rejected"
        held.append(at)
        return "admitted"


class Alerts:
    """Fires on the error rate or the p99 of the last calls; after it fired, the same alert is silent for a while."""

    STATE = "calls array<struct<bad boolean, latency double>>, fired map<string, double>"

    def __init__(self, state: dict | None = None, size: int = 100, error_rate: float = 0.1, p99: float = 30.0, pause: float = 300.0):
        self.state = state or {"calls": [], "fired": {}}
        self.size, self.error_rate, self.p99, self.pause = size, error_rate, p99, pause

    def step(self, at: float, ok: bool, latency: float) -> str:
        calls = self.state["calls"] = [*self.state["calls"], [not ok, latency]][-self.size :]
        times = sorted(c[1] for c in calls)
        due = {"error_rate": sum(c[0] for c in calls) / len(calls) > self.error_rate, "p99": times[min(int(len(times) * 0.99), len(times) - 1)] > self.p99}
        fired = [k for k, v in due.items() if v and at - self.state["fired"].get(k, float("-inf")) >= self.pause]
        self.state["fired"].update(dict.fromkeys(fired, at))
        return ",".join(fired)


class Breaker:
    """Closed until failures since it last closed add up, or are half of the last calls, however few; looked at when a call fails.

    Open for a while, and calls are refused; then half-open until enough calls succeed, or one fails. The last calls are kept when it closes.
    """

    STATE = "status string, failures int, good int, since double, window array<boolean>"

    def __init__(self, state: dict | None = None, failures: int = 5, rate: float = 0.5, window: int = 10, timeout: float = 30.0, successes: int = 3):
        self.state = state or {"status": "closed", "failures": 0, "good": 0, "since": 0.0, "window": []}
        self.failures, self.rate, self.window, self.timeout, self.successes = failures, rate, window, timeout, successes

    def step(self, at: float, ok: bool, latency: float) -> str:
        s = self.state
        if s["status"] == "open":
            if at - s["since"] < self.timeout:
                return "open"  # the call is refused
            s |= {"status": "half_open", "good": 0}
        s["window"] = [*s["window"], ok][-self.window :]
        if s["status"] == "half_open":
            s["good"] += ok
            if ok and s["good"] >= self.successes:
                s |= {"status": "closed", "failures": 0}
        s["failures"] += not ok
        if not ok and (s["status"] == "half_open" or s["failures"] >= self.failures or s["window"].count(False) / len(s["window"]) >= self.rate):
            s |= {"status": "open", "since": at}
        return s["status"]


class Tasks:
    """Progress of a task as its events come: percent within 0 and 100, finished states are final."""

    STATE = "status string, progress int"

    def __init__(self, state: dict | None = None):
        self.state = state or {"status": "pending", "progress": 0}

    def step(self, at: float, ok: bool, latency: float) -> str:
        s = self.state
        if s["status"] not in ("completed", "failed"):
            s["progress"] = min(100, max(0, int(latency)))
            s["status"] = "failed" if not ok else "completed" if s["progress"] == 100 else "processing"
        return s["status"]


class Backpressure:
    """A bounded number of calls in flight, some of them running and the others waiting in order; latency is how long a call runs.

    A call is rejected if the flight is full, and gives up if no place to run is free within ``patience``.
    """

    STATE = "flight array<struct<end double, runs boolean>>"

    def __init__(self, state: dict | None = None, flight: int = 50, running: int = 20, patience: float = 30.0):
        self.state = state or {"flight": []}  # when each call in flight ends, and whether it gets to run
        self.flight, self.running, self.patience = flight, running, patience

    def step(self, at: float, ok: bool, latency: float) -> str:
        held = self.state["flight"] = [x for x in self.state["flight"] if x[0] > at]
        if len(held) >= self.flight:
            return "rejected"
        ends = sorted(end for end, runs in held if runs)
        begins = at if len(ends) < self.running else ends[len(ends) - self.running]
        if begins - at > self.patience:
            held.append([at + self.patience, False])
            return "timeout"
        held.append([begins + latency, True])
        return "admitted"


OUT = "client long, event_id long, at double, outcome string"


def _outcomes(run, machine: Callable, calls: pd.DataFrame, idle: float | None, last: float | None = None) -> tuple[list[str], object]:
    """The outcome of each call, and the machine as the last one left it; after ``idle`` seconds without a call it begins anew."""
    out = []
    for at, ok, latency in zip(calls["at"].tolist(), calls.ok.tolist(), calls.latency.tolist()):
        if idle is not None and last is not None and at - last >= idle:
            run = machine()
        last = at if last is None else max(last, at)
        out.append(run.step(at, ok, latency))
    return out, run


def _one(rows: pd.DataFrame, machine: Callable, idle: float | None) -> pd.DataFrame:
    rows = rows.sort_values(["at", "event_id"])
    return pd.DataFrame({"client": rows.client, "event_id": rows.event_id, "at": rows["at"], "outcome": _outcomes(machine(), machine, rows, idle)[0]})


def fold(calls: DataFrame, machine: Callable, idle: float | None = None) -> DataFrame:
    """The outcome of each call. calls: client, event_id, at (seconds), ok, latency. One task holds one client's calls at a time."""
    return calls.select("client", "event_id", "at", "ok", "latency").groupBy("client").applyInPandas(partial(_one, machine=machine, idle=idle), OUT)


def plain(value):
    """A value out of a state store as lists, dicts and numbers."""
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, tuple | list) or hasattr(value, "tolist") else value


def _silent_after(handle: StatefulProcessorHandle, at: float, idle: float) -> None:
    """One timer: when this client will have been silent for long enough."""
    for timer in [*handle.listTimers()]:
        handle.deleteTimer(timer)
    handle.registerTimer(round((at + idle) * 1000))


class Folding(StatefulProcessor):
    """A machine on a stream: its state as one typed row, forgotten when the client falls silent."""

    def __init__(self, machine: Callable, idle: float | None):
        self.machine, self.idle = machine, idle
        self.names = [*machine().state]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept, self.last = handle.getValueState("kept", self.machine.STATE), handle.getValueState("last", "at double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat([*rows]).sort_values(["at", "event_id"])
        run = self.machine(dict(zip(self.names, map(plain, self.kept.get()))) if self.kept.exists() else None)
        last = self.last.get()[0] if self.last.exists() else None
        outcome, run = _outcomes(run, self.machine, calls, self.idle, last)
        self.kept.update(tuple(run.state[n] for n in self.names))
        if self.idle is not None:
            at = max(calls["at"].max(), calls["at"].max() if last is None else last)
            self.last.update((float(at),))
            _silent_after(self.handle, at, self.idle)
        yield pd.DataFrame({"client": calls.client, "event_id": calls.event_id, "at": calls["at"], "outcome": outcome})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


SILENT = "client long, last_seen double, evicted_at double"


class Silence(StatefulProcessor):
    """Reports a client when it has been silent for ``idle`` seconds, by the watermark or by the time of its next call."""

    def __init__(self, idle: float):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "at double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = sorted([*pd.concat([*rows])["at"].tolist(), *(self.last.get() if self.last.exists() else ())])
        gone = [a for a, b in zip(times, times[1:]) if b - a >= self.idle]
        self.last.update((float(times[-1]),))
        _silent_after(self.handle, times[-1], self.idle)
        yield pd.DataFrame({"client": [key[0]] * len(gone), "last_seen": gone, "evicted_at": [a + self.idle for a in gone]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (at,) = self.last.get()
        self.last.clear()
        yield pd.DataFrame({"client": [key[0]], "last_seen": [at], "evicted_at": [at + self.idle]})

    def close(self) -> None:
        pass


def _stored(spark: SparkSession) -> None:
    """Typed state needs RocksDB; the session's own choice of it stays."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(key):
        spark.conf.set(key, ROCKS)


def fold_stream(calls: DataFrame, machine: Callable, idle: float | None = None) -> DataFrame:
    """The same on a stream, append mode; within a batch calls are taken in order of time. With ``idle`` the calls have a watermark, and a client's
    state is removed when it passes that many seconds after its last call; a call that comes first begins anew all the same."""
    _stored(calls.sparkSession)
    return calls.groupBy("client").transformWithStateInPandas(Folding(machine, idle), OUT, "Append", "None" if idle is None else "EventTime")


def idle_clients(calls: DataFrame, idle: float = IDLE) -> DataFrame:
    """When clients are dropped for silence: after each of their calls that none follows within ``idle`` seconds."""
    following = F.lead("at").over(Window.partitionBy("client").orderBy("at", "event_id"))
    gone = calls.select("client", "at", following.alias("_next")).where(F.col("_next").isNull() | (F.col("_next") - F.col("at") >= idle))
    return gone.select("client", F.col("at").alias("last_seen"), (F.col("at") + idle).alias("evicted_at"))


def idle_clients_stream(calls: DataFrame, idle: float = IDLE) -> DataFrame:
    """The same on a stream with a watermark; the last silence of a client is reported when the watermark has passed it."""
    _stored(calls.sparkSession)
    return calls.groupBy("client").transformWithStateInPandas(Silence(idle), SILENT, "Append", "EventTime")


def stream_errors(events: DataFrame, delay: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Error share by event time, an addition for streams: tumbling windows behind a watermark."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", size)).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("event_type") == "error").cast("int")).alias("error_rate"))
