"""Admission of trade events in their order: every decision follows from what was accepted before it.

A track's state is its cash, its lots by code (settled, and bought on the current day), what each intent
has filled on the track, and the contents behind the keys it has accepted. A refused event changes
nothing, so its key may be tried again and its cash and quantity stay free. As cash connects all events
of a track, a track is the unit of work; it is read as a sorted stream, never held. ``admitted`` is the
batch form; ``streaming.jobs.admission_stream`` takes the same steps from keyed state.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, MutableMapping
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What an event says; equal contents under one key are one event sent again.
CONTENT = ["code", "side", "quantity", "price", "fees", "intent_id", "occurred_on"]

#: Columns that a decision needs beside the event's own: what is known of its intent.
KNOWN = ["wanted", "created_on", "expires_on", "skipped_on"]


@dataclass
class Gate:
    """One track. The mappings may be dictionaries or views of stored state.

    lots: code -> (day, settled before that day, bought on it); filled: intent -> quantity; seen: key -> contents of the accepted event.
    """

    cash: float
    day: dt.date | None = None
    lots: MutableMapping[Any, tuple] = field(default_factory=dict)
    filled: MutableMapping[Any, int] = field(default_factory=dict)
    seen: MutableMapping[Any, str] = field(default_factory=dict)

    def settled(self, code: Any, day: dt.date) -> tuple[int, int]:
        """What may be sold of a code on a day, and what was bought on that day."""
        last, settled, today = self.lots.get(code, (day, 0, 0))
        return (settled, today) if last == day else (settled + today, 0)

    def decide(self, e: Any, remember: bool = True) -> str | None:
        """The reason to refuse an event (replay and conflict among them), or None: then it has been taken in.

        remember: whether the key can come again; else it needn't be kept.
        """
        if e.wanted is None:
            return "unknown_intent"
        if e.occurred_on < e.created_on:
            return "before_intent"
        if e.occurred_on > e.expires_on:
            return "after_expiry"
        content = repr(tuple(getattr(e, c) for c in CONTENT))
        if (before := self.seen.get(e.key)) is not None:
            return "replay" if before == content else "conflict"
        if e.skipped_on is not None and e.skipped_on <= e.occurred_on:
            return "after_skip"
        if self.day is not None and e.occurred_on < self.day:
            return "late"
        filled = self.filled.get(e.intent_id, 0)
        if filled + e.quantity > e.wanted:
            return "over_intent"
        amount = (-e.quantity * e.price if e.side == "buy" else e.quantity * e.price) - e.fees
        if self.cash + amount < 0:
            return "short_cash"
        settled, today = self.settled(e.code, e.occurred_on)
        if e.side == "sell" and e.quantity > settled:
            return "t_plus_one"
        self.cash += amount
        self.day = e.occurred_on
        self.filled[e.intent_id] = filled + e.quantity
        self.lots[e.code] = (e.occurred_on, settled - e.quantity, today) if e.side == "sell" else (e.occurred_on, settled, today + e.quantity)
        if remember:
            self.seen[e.key] = content
        return None


def verdict(reason: str | None) -> str:
    return "accepted" if reason is None else reason if reason in ("replay", "conflict") else "rejected"


def with_intents(events: DataFrame, intents: DataFrame, skips: DataFrame) -> DataFrame:
    """``events`` with KNOWN. skips: intent_id, track, skipped_on; of several the earliest counts."""
    wanted = intents.select("intent_id", F.col("quantity").cast("long").alias("wanted"), "created_on", "expires_on")
    first = skips.groupBy("intent_id", "track").agg(F.min("skipped_on").alias("skipped_on"))
    return events.join(wanted, "intent_id", "left").join(first, ["intent_id", "track"], "left")


def plain(value: Any) -> Any:
    """None for what pandas has for a missing value."""
    return None if value is None or value is pd.NaT or value != value else value


@dataclass
class Event:
    """A row with Python's own values."""

    key: Any
    code: Any
    side: str
    quantity: int
    price: float
    fees: float
    intent_id: Any
    occurred_on: dt.date
    wanted: int | None
    created_on: dt.date | None
    expires_on: dt.date | None
    skipped_on: dt.date | None

    @classmethod
    def of(cls, row: Any) -> Event:
        made = cls(*(plain(getattr(row, c)) for c in cls.__dataclass_fields__))
        made.quantity, made.price, made.fees = int(made.quantity), float(made.price), float(made.fees)
        made.wanted = None if made.wanted is None else int(made.wanted)
        return made


#: What stands in a track's stream, in the order of a day: its opening cash, what is known of an intent, events.
_CASH, _KNOWN, _EVENT = range(3)

_RESULT = ["track", "fill_id", "key", "reason"]
_UNKNOWN = (None,) * 5

#: Events for which a task is made at least.
TASK_ROWS = 250_000


def _values(column: pa.Array) -> list:
    """Python's own values; numbers without nulls the quick way."""
    plain_numbers = column.null_count == 0 and (pa.types.is_integer(column.type) or pa.types.is_floating(column.type))
    return column.to_numpy(zero_copy_only=False).tolist() if plain_numbers else column.to_pylist()


def _notes(events: DataFrame, intents: DataFrame, skips: DataFrame, cash: DataFrame) -> DataFrame:
    """Rows that a track's stream needs beside its events: ``known`` of each intent on the first day the track uses it, and its cash.

    Only days by track and intent meet the intents here, not the events.
    """
    uses = events.groupBy("intent_id", "track").agg(F.min("occurred_on").alias("occurred_on"), F.max("occurred_on").alias("last"))
    first = skips.groupBy("intent_id", "track").agg(F.min("skipped_on").alias("skipped_on"))
    wanted = intents.select("intent_id", F.col("quantity").cast("long").alias("wanted"), "created_on", "expires_on")
    used = uses.join(first, ["intent_id", "track"], "left").join(wanted, "intent_id")
    days = [F.unix_date(c).alias(c) for c in ("created_on", "expires_on", "skipped_on", "last")]
    known = used.select("track", "intent_id", "occurred_on", F.lit(_KNOWN).alias("kind"), F.struct("wanted", *days).alias("known"), F.lit(0.0).alias("price"))
    opening = cash.filter("track IS NOT NULL").select("track", F.lit(_CASH).alias("kind"), F.coalesce(F.col("cash").cast("double"), F.lit(0.0)).alias("price"))
    none = {"quantity": F.lit(0).cast("long"), "fees": F.lit(0.0)}
    return known.unionByName(opening, allowMissingColumns=True).withColumns(none)


def admitted(events: DataFrame, intents: DataFrame, skips: DataFrame, cash: DataFrame, most_intents: int = 200_000) -> DataFrame:
    """track, fill_id, key, verdict and reason of every event.

    events: key, fill_id, track, code, side, quantity, price, fees, intent_id, occurred_on, seq (any type that has an
    order; it orders the events of a day, fill_id those of equal seq); intents: intent_id, quantity, created_on, expires_on;
    skips: intent_id, track, skipped_on; cash: track, cash, before the first event (0 where it has none).
    In this order: a known intent, its window, the key (replay of the accepted event, or conflict with it), no skip of
    the intent on the track before, no more than the intent on the track, cash not below 0, no sale of what was bought
    the same day. Keys belong to a track. A task remembers the keys that come again, lots by code, and of the intents that
    the track still uses what is known and filled; most_intents: how many more are kept before the others are forgotten.
    Events without a track are one track without cash.

    Events are shuffled once, by track, into tasks enough for their number (they are counted); what they need of
    intents, skips and cash comes as rows of the same stream, and keys that come again are counted within the tasks.
    """
    spark = events.sparkSession
    own = ["track", "fill_id", "key", "code", "side", "intent_id", "occurred_on", "seq", F.col("quantity").cast("long"), F.col("price").cast("double"), F.col("fees").cast("double")]
    stream = events.select(*own, F.lit(_EVENT).alias("kind")).unionByName(_notes(events, intents, skips, cash), allowMissingColumns=True)
    tasks = max(spark.sparkContext.defaultParallelism, -(-events.count() // TASK_ROWS))
    same = Window.partitionBy("key", "track", "kind", F.when(F.col("kind") != _EVENT, F.col("intent_id")))
    marked = stream.repartition(tasks, "track").withColumn("again", F.count("*").over(same) > 1)
    read = ["track", "key", "kind", "again", "code", "side", "quantity", "price", "fees", "intent_id"]
    ordered = marked.sortWithinPartitions("track", "occurred_on", "kind", "seq", "fill_id").select(*read, F.unix_date("occurred_on").alias("day"), "known", "fill_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        track, gate, known, swept = object(), Gate(0.0), {}, 0
        for batch in batches:
            kinds, reasons = batch.column("kind"), []
            notes = zip(*map(_values, batch.column("known").filter(pc.equal(kinds, _KNOWN)).flatten()))
            for of, key, kind, again, code, side, quantity, price, fees, intent, day in zip(*map(_values, batch.columns[:11])):
                if of != track:
                    track, gate, known, swept = of, Gate(0.0), {}, 0
                if kind == _EVENT:
                    e = Event(key, code, side, quantity, price, fees, intent, day, *known.get(intent, _UNKNOWN)[:4])
                    reasons.append(gate.decide(e, again))
                elif kind == _CASH:
                    gate.cash = price
                else:
                    if len(known) > swept + most_intents:  # the track has no more events of these
                        for x in [x for x, (*_, last) in known.items() if last < day]:
                            del known[x]
                            gate.filled.pop(x, None)
                        swept = len(known)
                    known[intent] = next(notes)
            only = pc.equal(kinds, _EVENT)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(only) for c in ("track", "fill_id", "key")), pa.array(reasons, pa.string())], _RESULT)

    schema = marked.select("track", "fill_id", "key").schema.add("reason", "string")
    made = ordered.mapInArrow(run, schema)
    decided = F.when(F.col("reason").isNull(), "accepted").when(F.col("reason").isin("replay", "conflict"), F.col("reason")).otherwise("rejected")
    return made.select("track", "fill_id", "key", decided.alias("verdict"), F.when(~F.col("reason").isin("replay", "conflict"), F.col("reason")).alias("reason"))

