"""Jobs with keyed state in RocksDB: admission of trade events, alert transitions with hand-over and expiry.

Both take their steps with ``transformWithStateInPandas``; a restart goes on from the checkpoint.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator, MutableMapping
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.admission import Event, Gate, plain, verdict, with_intents


def on_disk(spark: SparkSession) -> None:
    """State in RocksDB with changelog checkpoints; these processors need it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


class Stored(MutableMapping):
    """A map state as a mapping of plain values. read and made turn a stored row into a value and back."""

    def __init__(self, state: Any, read: Callable = lambda v: v[0], made: Callable = lambda v: (v,)):
        self.state, self.read, self.made = state, read, made

    def __getitem__(self, key):
        if not self.state.containsKey((key,)):
            raise KeyError(key)
        return self.read(self.state.getValue((key,)))

    def __setitem__(self, key, value):
        self.state.updateValue((key,), self.made(value))

    def __delitem__(self, key):
        self.state.removeKey((key,))

    def __iter__(self):
        return (k[0] for k in self.state.keys())

    def __len__(self):
        return sum(1 for _ in self)


class Admission(StatefulProcessor):
    def __init__(self, types: dict[str, str]):
        self.types = types

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.purse = handle.getValueState("purse", "cash double, day date")
        self.lots = Stored(handle.getMapState("lots", f"code {self.types['code']}", "day date, settled long, today long"), tuple, tuple)
        self.filled = Stored(handle.getMapState("filled", f"intent_id {self.types['intent_id']}", "quantity long"))
        self.seen = Stored(handle.getMapState("seen", f"key {self.types['key']}", "content string"))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["occurred_on", "place", "fill_id"])  # one batch's events of one track
        cash, day = self.purse.get() if self.purse.exists() else (float(plain(batch["opening"].iloc[0]) or 0.0), None)
        gate = Gate(cash, day, self.lots, self.filled, self.seen)
        out = []
        for row in batch.itertuples(index=False):
            reason = gate.decide(Event.of(row))
            out.append((row.track, row.fill_id, row.key, verdict(reason), None if reason in ("replay", "conflict") else reason))
        self.purse.update((gate.cash, gate.day))
        yield pd.DataFrame(out, columns=["track", "fill_id", "key", "verdict", "reason"])

    def close(self) -> None:
        pass


def admission_stream(events: DataFrame, intents: DataFrame, skips: DataFrame, cash: DataFrame) -> DataFrame:
    """``operators.admission.admitted`` over a stream: a verdict for each event as it comes.

    Arguments as there; intents, skips and cash are tables, read with each batch, and events has ``place``, a number that
    orders a day's events, instead of seq. A batch's events of a track are taken by day, place and fill_id. An event of a day before the
    last accepted one of its track is refused as ``late``, as its cash and lots can't be known any more. A track's cash
    counts once, when its first event comes. Keys, lots and filled quantities stay in the state: an
    event can come again at any time.
    """
    on_disk(events.sparkSession)
    types = dict(events.dtypes)
    rows = with_intents(events, intents, skips).join(cash.select("track", F.col("cash").cast("double").alias("opening")), "track", "left")
    needed = [*dict.fromkeys(["track", "fill_id", "opening", "place", *Event.__dataclass_fields__])]
    schema = f"track {types['track']}, fill_id {types['fill_id']}, key {types['key']}, verdict string, reason string"
    return rows.select(*needed).groupBy("track").transformWithStateInPandas(Admission(types), schema, "append", "none")


class Alerts(StatefulProcessor):
    """The last phase of a key and the moment of it; a key that is open and silent for ``silence`` is closed."""

    def __init__(self, closed: str, silence: dt.timedelta | None):
        self.closed, self.silence = closed, silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "phase string, at timestamp, event_id long")

    def _await(self, phase: str, at: dt.datetime) -> None:
        if self.silence is None:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if phase != self.closed:
            self.handle.registerTimer(int((pd.Timestamp(at) + self.silence).timestamp() * 1000))

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        row = initialState.sort_values(["at", "event_id"]).iloc[-1]
        self.last.update((row["phase"], pd.Timestamp(row["at"]).to_pydatetime(), int(row["event_id"])))
        self._await(row["phase"], row["at"])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        phase, at, number = self.last.get() if self.last.exists() else (self.closed, None, None)
        out = []
        for r in pd.concat(list(rows)).sort_values(["at", "event_id"]).itertuples(index=False):
            if at is not None and (r.at, r.event_id) <= (pd.Timestamp(at), number):
                continue  # older than what the key's state says
            if r.phase != phase:
                out.append((key[0], r.event_id, r.phase))
            phase, at, number = r.phase, r.at, r.event_id
        if at is not None:
            self.last.update((phase, pd.Timestamp(at).to_pydatetime(), int(number)))
            self._await(phase, at)
        yield pd.DataFrame(out, columns=["key", "event_id", "phase"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        phase, at, number = self.last.get()
        if phase == self.closed:
            return
        self.last.update((self.closed, at, number))
        yield pd.DataFrame([(key[0], None, self.closed)], columns=["key", "event_id", "phase"]).astype({"event_id": "Int64"})

    def close(self) -> None:
        pass


def alert_stream(events: DataFrame, closed: str = "resolved", *, known: DataFrame | None = None, silence: dt.timedelta | None = None, delay: str = "0 seconds") -> DataFrame:
    """Phase changes of each alert key: (key, event_id, phase). A key can't begin closed.

    events: key, event_id, phase, at. A batch's events of a key are taken by (at, event_id). Across batches the
    same order holds: an event that is not after the last one taken changes nothing. known: key, phase, at, event_id, the last phases that a batch
    job has found (operators.ops.transitions over the past); the stream goes on from them. With ``silence``, an open key
    without an event for so long, by event time behind a watermark of ``delay``, is closed with a null event_id.
    """
    on_disk(events.sparkSession)
    first = None if known is None else known.select("key", "phase", "at", "event_id").groupBy("key")
    rows, mode = events.select("key", "event_id", "phase", "at"), "none"
    if silence is not None:
        rows, mode = rows.withWatermark("at", delay), "eventtime"
    key = dict(events.dtypes)["key"]
    return rows.groupBy("key").transformWithStateInPandas(Alerts(closed, silence), f"key {key}, event_id long, phase string", "append", mode, first)
