"""Read models: ordered and limited lists, signal details, the dashboard, replay audits, operations status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import content_id
from ..schemas import KEYS
from . import ledger


def by_business_keys(df: DataFrame, dataset: str) -> DataFrame:
    """A data set in the order of its keys, for output."""
    return df.orderBy(*KEYS[dataset])


def listed(rows: DataFrame, order: list[str], *, time: str | None = None, as_of: Column | None = None, track: str | None = None, most: int | None = None, newest_first: bool = False) -> DataFrame:
    """Records in order, as known at a moment, of one track, the first few: whichever is asked for."""
    if as_of is not None:
        rows = rows.filter(F.col(time) <= as_of)
    if track is not None:
        rows = rows.filter(F.col("track") == track)
    rows = rows.orderBy(*[F.desc(c) if newest_first else F.asc(c) for c in order])
    return rows if most is None else rows.limit(most)


def signal_details(signals: DataFrame, prices: DataFrame, decisions: DataFrame, as_of: Column) -> DataFrame:
    """Signals known at a moment with their price history in order and their decision's trace.

    signals: signal_id, decision_id, code, created_at; prices: decision_id, code, trade_date, signal_close, execution_close.
    An inner join: a signal without a stored price has no detail. The array is bounded by the decision's history.
    """
    points = prices.groupBy("decision_id", "code").agg(F.sort_array(F.collect_list(F.struct("trade_date", "signal_close", "execution_close"))).alias("price_points"))
    return signals.filter(F.col("created_at") <= as_of).join(points, ["decision_id", "code"]).join(decisions, "decision_id")


def dashboard(fills: DataFrame, intents: DataFrame, skips: DataFrame, prices: DataFrame, as_of: str, tracks: list[str]) -> dict[str, DataFrame]:
    """Tracks, signals and reconciliation as of a day, from the events up to it.

    fills, as in ``ledger``; prices: code, price, priced_on; intents: intent_id, quantity, expires_on, created_on; skips:
    intent_id, track, skipped_on, reason. Signals have a row for each track.
    The first of ``tracks`` is what the others are reconciled with.
    """
    day = F.to_date(F.lit(as_of))
    seen = fills.filter(F.col("occurred_on") <= day)
    last = prices.filter(F.col("priced_on") <= day).groupBy("code").agg(F.max_by("price", "priced_on").alias("price"))
    held = ledger.positions(ledger.remaining_lots(seen), last, as_of)
    cash = ledger.cash_movements(seen).groupBy("track").agg(F.sum("amount").alias("cash"))
    views = ledger.track_views(held, cash)
    signals = ledger.signal_status(intents, fills, skips, as_of, tracks)
    first = views.filter(F.col("track") == tracks[0]).select(F.col("cash").alias("c"), F.col("equity").alias("e"), F.lit(True).alias("one"))
    differences = views.withColumn("one", F.lit(True)).join(first, "one").select("track", (F.col("cash") - F.col("c")).alias("cash_difference"), (F.col("equity") - F.col("e")).alias("equity_difference"))  # first is one row
    return {"tracks": views.join(differences, "track", "left"), "signals": signals, "reconciliation": ledger.reconciliation(held, tracks)}


def replay_audit(fills: DataFrame, prices: DataFrame, boundary: str) -> DataFrame:
    """Cash, equity and positions of each track when all events up to the boundary are replayed."""
    seen = fills.filter(F.col("occurred_on") <= F.to_date(F.lit(boundary)))
    held = ledger.positions(ledger.remaining_lots(seen), prices, boundary)
    return ledger.track_views(held, ledger.cash_movements(seen).groupBy("track").agg(F.sum("amount").alias("cash")))


def operations_status(health: DataFrame, alerts: DataFrame, observations: DataFrame, as_of: str, *, max_age_minutes: int = 15, review_days: int = 60) -> DataFrame:
    """One row: is the health gate open, active alerts, observed days, is a review due.

    health: the latest check of each provider (provider, state, critical, checked_at); alerts: the latest phase of
    each key; observations: one a trading day. The gate needs a critical check, all of them healthy and young.
    """
    now = F.to_timestamp(F.lit(as_of))
    old = F.unix_micros(now) - F.unix_micros(F.col("checked_at").cast("timestamp")) > max_age_minutes * 60_000_000
    bad = F.col("critical") & ((F.col("state") != "healthy") | old)
    parts = [
        health.select(F.col("critical").cast("int").alias("critical"), bad.cast("int").alias("bad"), F.lit(0).alias("alerts"), F.lit(0).alias("days")),
        alerts.filter("phase <> 'resolved'").select(F.lit(0).alias("critical"), F.lit(0).alias("bad"), F.lit(1).alias("alerts"), F.lit(0).alias("days")),
        observations.select("trading_date").distinct().select(F.lit(0).alias("critical"), F.lit(0).alias("bad"), F.lit(0).alias("alerts"), F.lit(1).alias("days")),
    ]
    sums = parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("critical", "bad", "alerts", "days")])
    return sums.select(((F.col("critical") > 0) & (F.col("bad") == 0)).alias("health_gate_ready"), F.col("alerts").alias("active_alerts"), F.col("days").alias("observed_days"), (F.col("days") >= review_days).alias("review_ready"))


def fetch_readiness(sessions: DataFrame, session_ends: DataFrame, incidents: DataFrame, recoveries: DataFrame, now: str, *, tolerance_seconds: int = 5) -> DataFrame:
    """What stands in the way of fetching: (problem, key): open sessions, incidents without a recovery, starts later than now."""
    open_ = sessions.join(session_ends.select("session_id").distinct(), "session_id", "left_anti").select(F.lit("unclosed_session").alias("problem"), F.col("session_id").cast("string").alias("key"))
    stopped = incidents.join(recoveries.select("incident_id").distinct(), "incident_id", "left_anti").select(F.lit("active_incident").alias("problem"), F.col("incident_id").cast("string").alias("key"))
    ahead = F.unix_micros(F.col("started_at").cast("timestamp")) > F.unix_micros(F.to_timestamp(F.lit(now))) + tolerance_seconds * 1_000_000
    return open_.unionByName(stopped).unionByName(sessions.filter(ahead).select(F.lit("clock_moved_back").alias("problem"), F.col("session_id").cast("string").alias("key")))


def trading_day_lookup(days: DataFrame, calendar: DataFrame) -> DataFrame:
    """Each day asked for with what the calendar says; ``rows`` must be 1, else the answer is null."""
    known = calendar.groupBy("calendar_date").agg(F.count("*").alias("rows"), F.bool_and("is_trading_day").alias("t"))
    out = days.join(known, "calendar_date", "left")
    return out.select("calendar_date", F.coalesce("rows", F.lit(0)).alias("rows"), F.when(F.col("rows") == 1, F.col("t")).alias("is_trading_day"))


def latest_trading_day(calendar: DataFrame, today: Column) -> DataFrame:
    return calendar.filter(F.col("is_trading_day") & (F.col("calendar_date") <= today)).agg(F.max("calendar_date").alias("latest"))


def decimal_text(value: Column, digits: int = 6) -> Column:
    """A number as audits write it: no exponent, no trailing zeros, no sign on zero."""
    plain = F.regexp_replace(value.cast(f"decimal(38,{digits})").cast("string"), r"(\.\d*?)0+$", "$1")
    trimmed = F.regexp_replace(plain, r"\.$", "")
    return F.when(trimmed == "-0", F.lit("0")).otherwise(trimmed)


def shadow_decisions(base: DataFrame, targets: DataFrame, versions: dict[str, str]) -> DataFrame:
    """Base decisions with their target replaced, under ids of their own.

    base: decision_id, snapshot_id; targets: decision_id, code, weight, outcome (one a decision). The id follows from the base's, the
    replaced target and the versions, so the same overlay of the same decision is the same shadow.
    """
    target = targets.groupBy("decision_id").agg(F.sort_array(F.collect_list(F.struct("code", F.round("weight", 8).alias("weight")))).alias("target"), F.max("outcome").alias("outcome"))  # at most the positions of one portfolio
    ident = {"base": F.col("decision_id"), "target": F.col("target"), "outcome": F.col("outcome"), **{k: F.lit(v) for k, v in versions.items()}}
    return base.join(target, "decision_id").withColumn("shadow_id", content_id(ident))
