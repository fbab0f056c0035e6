"""Projections of append-only trade events: cash, FIFO lots with next-day settlement, positions, signals, reconciliation, admission.

Events are ordered by (occurred_on, seq) within (track, code); seq stands for the order of arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import content_id

LOT = ["track", "code"]


def cash_movements(fills: DataFrame) -> DataFrame:
    """A trade movement for each fill and a fee movement where there are fees; ids follow from the fill's."""
    notional = F.col("quantity") * F.col("price")
    trade = F.struct(F.lit("trade").alias("kind"), F.when(F.col("side") == "buy", -notional).otherwise(notional).alias("amount"))
    fee = F.struct(F.lit("fee").alias("kind"), (-F.col("fees")).cast("double").alias("amount"))
    moves = fills.select("fill_id", "track", "occurred_on", "seq", F.explode(F.filter(F.array(trade, fee), lambda m: (m["kind"] == "trade") | (m["amount"] != 0))).alias("m"))
    return moves.select(content_id({"fill": F.col("fill_id"), "kind": F.col("m.kind")}).alias("movement_id"), "fill_id", "track", "occurred_on", "seq", F.col("m.kind").alias("kind"), F.col("m.amount").alias("amount"))


def running_cash(movements: DataFrame) -> DataFrame:
    """Daily cash of each track: days are summed first, so the running sum has one row a day."""
    day = movements.groupBy("track", "occurred_on").agg(F.sum("amount").alias("amount"))
    return day.withColumn("balance", F.sum("amount").over(W.partitionBy("track").orderBy("occurred_on").rowsBetween(W.unboundedPreceding, 0)))


def first_negative(fills: DataFrame, cash: DataFrame) -> DataFrame:
    """Of each track the first event after which its cash is below 0: track, fill_id, occurred_on, seq, balance. cash: track, cash.

    Days are summed first, so a window over a track has one row a day; then only the events of days are
    looked at, each day by itself, whose lowest point can lie below 0. A long series has as many tasks as days.
    """
    amount = F.when(F.col("side") == "buy", -F.col("quantity") * F.col("price")).otherwise(F.col("quantity") * F.col("price")) - F.col("fees")
    rows = fills.withColumn("_amount", amount)
    day = rows.groupBy("track", "occurred_on").agg(F.sum("_amount").alias("_moved"), F.sum(F.least("_amount", F.lit(0.0))).alias("_down"))
    before = F.coalesce(F.sum("_moved").over(W.partitionBy("track").orderBy("occurred_on").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    opened = day.join(cash.select("track", F.col("cash").cast("double").alias("_cash")), "track", "left").withColumn("_opened", F.coalesce("_cash", F.lit(0.0)) + before)
    doubtful = opened.filter(F.col("_opened") + F.col("_down") < 0).select("track", "occurred_on", "_opened")
    inside = W.partitionBy("track", "occurred_on").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    low = rows.join(doubtful, ["track", "occurred_on"]).withColumn("balance", F.col("_opened") + F.sum("_amount").over(inside)).filter("balance < 0")
    first = low.groupBy("track").agg(F.min_by(F.struct("fill_id", "occurred_on", "seq", "balance"), F.struct("occurred_on", "seq")).alias("x"))
    return first.select("track", "x.*")


def latest_moment(tables: list[tuple[DataFrame, str]]) -> DataFrame:
    """One row: the latest moment in any of the tables, each with its time column; null if there is none."""
    latest = [df.agg(F.max(F.col(c).cast("timestamp")).alias("latest")) for df, c in tables]
    out = latest[0]
    for one in latest[1:]:
        out = out.unionByName(one)
    return out.agg(F.max("latest").alias("latest"))


def cumulated(fills: DataFrame) -> DataFrame:
    """Adds lo and hi: the fill's interval in the cumulative quantity of its side."""
    w = W.partitionBy(*LOT, "side").orderBy("occurred_on", "seq").rowsBetween(W.unboundedPreceding, 0)
    return fills.withColumn("hi", F.sum("quantity").over(w)).withColumn("lo", F.col("hi") - F.col("quantity"))


def settlement_violations(fills: DataFrame) -> DataFrame:
    """Sells that exceed what was bought on earlier days: sells so far > buys of earlier days."""
    day = F.datediff("occurred_on", F.lit("1970-01-01").cast("date"))
    bought = F.sum(F.when(F.col("side") == "buy", F.col("quantity")).otherwise(0)).over(W.partitionBy(*LOT).orderBy(day).rangeBetween(W.unboundedPreceding, -1))
    sold = F.sum(F.when(F.col("side") == "sell", F.col("quantity")).otherwise(0)).over(W.partitionBy(*LOT).orderBy("occurred_on", "seq").rowsBetween(W.unboundedPreceding, 0))
    out = fills.withColumns({"settled": F.coalesce(bought, F.lit(0)), "sold": sold})
    return out.filter("side = 'sell' AND sold > settled").select("fill_id", *LOT, "occurred_on", "settled", "sold")


def remaining_lots(fills: DataFrame) -> DataFrame:
    """Buys with what FIFO sales have left of them. Sales take the start of the cumulative buys, so their total is all that matters."""
    sold = F.coalesce(F.sum(F.when(F.col("side") == "sell", F.col("quantity"))).over(W.partitionBy(*LOT)), F.lit(0))
    w = W.partitionBy(*LOT).orderBy("occurred_on", "seq").rowsBetween(W.unboundedPreceding, 0)
    bought = F.sum(F.when(F.col("side") == "buy", F.col("quantity")).otherwise(0)).over(w)
    rows = fills.withColumns({"sold": sold, "hi": bought}).filter("side = 'buy'")
    left = F.greatest(F.least(F.col("quantity"), F.col("hi") - F.col("sold")), F.lit(0))
    kept = rows.withColumn("quantity_left", left).filter("quantity_left > 0")
    return kept.withColumn("cost_left", (F.col("quantity") * F.col("price") + F.col("fees")) * F.col("quantity_left") / F.col("quantity")).select("fill_id", *LOT, "occurred_on", "quantity_left", "cost_left")


def matched_lots(fills: DataFrame) -> DataFrame:
    """(track, code, buy, sell, quantity): which sale took what of which buy.

    Both sides' intervals are cut at each other's starts in one sorted pass: between two neighbouring
    starts exactly one buy and one sell are current. No pairs are compared.
    """
    marks = cumulated(fills).select(*LOT, F.col("lo").alias("at"), "hi", "side", "fill_id")
    order = W.partitionBy(*LOT).orderBy("at", "side")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    side = lambda s: F.last(F.when(F.col("side") == s, F.struct("fill_id", "hi")), ignorenulls=True).over(upto)
    cut = marks.withColumns({"b": side("buy"), "s": side("sell"), "next": F.lead("at").over(order)})
    to = F.least(F.coalesce("next", F.col("b.hi")), F.col("b.hi"), F.col("s.hi"))
    return cut.withColumn("quantity", to - F.col("at")).filter("b IS NOT NULL AND s IS NOT NULL AND quantity > 0").select(*LOT, F.col("b.fill_id").alias("buy"), F.col("s.fill_id").alias("sell"), "quantity")


def positions(lots: DataFrame, prices: DataFrame, as_of: str) -> DataFrame:
    """quantity, what may be sold (lots of earlier days), average cost, price and value (null without a price)."""
    held = lots.groupBy(*LOT).agg(F.sum("quantity_left").alias("quantity"), F.sum(F.when(F.col("occurred_on") < F.to_date(F.lit(as_of)), F.col("quantity_left")).otherwise(0)).alias("sellable_quantity"), (F.sum("cost_left") / F.sum("quantity_left")).alias("average_cost"))
    return held.join(prices.select("code", F.col("price").alias("last_price")), "code", "left").withColumn("market_value", F.col("quantity") * F.col("last_price"))


def latest_decision_prices(prices: DataFrame, as_of: str) -> DataFrame:
    """Of each code the price stored with the latest decision up to a moment, of that decision the last day.

    prices: code, decided_at, trade_date, price. One aggregate; rows without a price don't count.
    """
    seen = prices.filter(F.col("price").isNotNull() & (F.col("decided_at") <= F.to_timestamp(F.lit(as_of))))
    return seen.groupBy("code").agg(F.max_by(F.struct("price", "trade_date", "decided_at"), F.struct("decided_at", "trade_date")).alias("p")).select("code", "p.*")


def track_views(held: DataFrame, cash: DataFrame) -> DataFrame:
    """cash, market value and equity of each track; the latter two are null if any position lacks a price."""
    value = held.groupBy("track").agg(F.when(F.bool_and(F.col("last_price").isNotNull()), F.sum("market_value")).alias("market_value"), F.count("*").alias("positions"))
    both = cash.join(value, "track", "full_outer")
    return both.select("track", F.coalesce("cash", F.lit(0.0)).alias("cash"), F.coalesce("positions", F.lit(0)).alias("positions"), F.when(F.col("positions").isNull(), 0.0).otherwise(F.col("market_value")).alias("market_value"), (F.coalesce("cash", F.lit(0.0)) + F.when(F.col("positions").isNull(), 0.0).otherwise(F.col("market_value"))).alias("equity"))


def reconciliation(held: DataFrame, tracks: list[str]) -> DataFrame:
    """For each code the quantity on every track and its difference to the first."""
    wide = held.groupBy("code").pivot("track", tracks).agg(F.sum("quantity"))
    filled = wide.select("code", *[F.coalesce(F.col(t), F.lit(0)).alias(t) for t in tracks])
    return filled.withColumns({f"{t}_minus_{tracks[0]}": F.col(t) - F.col(tracks[0]) for t in tracks[1:]})


def filled_as_of(fills: DataFrame, as_of: str) -> DataFrame:
    """(intent_id, track, filled): what was filled on each track up to a day."""
    return fills.filter(F.col("occurred_on") <= F.to_date(F.lit(as_of))).groupBy("intent_id", "track").agg(F.sum("quantity").alias("filled"))


def signal_status(intents: DataFrame, fills: DataFrame, skips: DataFrame, as_of: str, tracks: list[str]) -> DataFrame:
    """Each intent known on a day, on each track it may be executed on: filled and remaining quantity and status.

    In this order: skipped (on that track, up to the day), filled, expired, partial or active. intents:
    intent_id, quantity, created_on, expires_on; skips: intent_id, track, skipped_on, reason; the earliest skip counts.
    """
    day = F.to_date(F.lit(as_of))
    skipped = skips.filter(F.col("skipped_on") <= day).groupBy("intent_id", "track").agg(F.min_by("reason", F.struct("skipped_on", "reason")).alias("reason"))
    known = intents.filter(F.col("created_on") <= day).withColumn("track", F.explode(F.array(*map(F.lit, tracks))))
    out = known.join(filled_as_of(fills, as_of), ["intent_id", "track"], "left").join(skipped, ["intent_id", "track"], "left").withColumn("filled", F.coalesce("filled", F.lit(0)))
    status = F.when(F.col("reason").isNotNull(), "skipped").when(F.col("filled") >= F.col("quantity"), "filled").when(day >= F.col("expires_on"), "expired").when(F.col("filled") > 0, "partial").otherwise("active")
    return out.withColumn("status", status).withColumn("remaining", F.greatest(F.col("quantity") - F.col("filled"), F.lit(0)))


def admit(events: DataFrame, key: str, content: list[str], order: list[str]) -> DataFrame:
    """Each event's verdict: accepted (the first of its key), replay (same contents again), conflict (others)."""
    w = W.partitionBy(key).orderBy(*order)
    hashed = events.withColumn("_hash", content_id({c: F.col(c) for c in content}))
    first = F.first("_hash").over(w.rowsBetween(W.unboundedPreceding, 0))
    verdict = F.when(F.row_number().over(w) == 1, "accepted").when(F.col("_hash") == first, "replay").otherwise("conflict")
    return hashed.withColumn("verdict", verdict).drop("_hash")


def overfills(intents: DataFrame, fills: DataFrame) -> DataFrame:
    """Fills that take their intent beyond its quantity on their track, or come after the day it expires."""
    w = W.partitionBy("intent_id", "track").orderBy("occurred_on", "seq").rowsBetween(W.unboundedPreceding, 0)
    joined = fills.join(intents.select("intent_id", F.col("quantity").alias("wanted"), "expires_on"), "intent_id")
    reason = F.when(F.sum("quantity").over(w) > F.col("wanted"), "over_intent").when(F.col("occurred_on") > F.col("expires_on"), "after_expiry")
    return joined.withColumn("reason", reason).filter("reason IS NOT NULL").select("fill_id", "intent_id", "reason")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str, name: str) -> DataFrame:
    """Values of a foreign key that the parent lacks, with their number."""
    values = child.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("long").alias("value")).agg(F.count("*").alias("rows"))
    return values.join(parent.select(F.col(key).cast("long").alias("value")).distinct(), "value", "left_anti").select(F.lit(name).alias("foreign_key"), "value", "rows")


def order_intents(orders: DataFrame, decision: str = "decision_id") -> DataFrame:
    """Signals and intents of planned orders with ids that follow from the decision, each once."""
    ident = content_id({"decision": F.col(decision), "code": F.col("code"), "side": F.col("side")})
    made = orders.withColumn("signal_id", ident).withColumn("intent_id", content_id({"signal": ident, "kind": F.lit("intent")}))
    return made.dropDuplicates(["signal_id"])


def _checks(rows: DataFrame, key: str, checks: dict[str, object]) -> DataFrame:
    """(key, check) for every check that holds on a row."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]))
    return rows.select(key, F.explode(found).alias("check")).distinct()


def trace_violations(decisions: DataFrame, stages: DataFrame) -> DataFrame:
    """Decisions whose stored stages don't fit: (decision_id, check).

    decisions: decision_id, snapshot_id, as_of; stages: decision_id, stage_snapshot_id, prior_as_of. A stage
    belongs to its decision's snapshot, and the state it started from is earlier.
    """
    joined = stages.join(decisions, "decision_id", "left")
    return _checks(joined, "decision_id", {"unknown_decision": F.col("snapshot_id").isNull(), "other_snapshot": F.col("stage_snapshot_id") != F.col("snapshot_id"), "prior_not_earlier": F.col("prior_as_of") >= F.col("as_of")})


def proposals_outside_pool(proposals: DataFrame, pool: DataFrame) -> DataFrame:
    """Proposed codes that no strategy of their decision's pool names: (decision_id, code)."""
    return proposals.select("decision_id", "code").distinct().join(pool.select("decision_id", "code").distinct(), ["decision_id", "code"], "left_anti")


def observation_violations(observations: DataFrame, decisions: DataFrame) -> DataFrame:
    """Forward observations to refuse: (trading_date, check).

    observations: trading_date, base_id, shadow_id, returns (array), cost_rate; decisions: decision_id, snapshot_id,
    track, decision_date. Both decisions exist, share snapshot and day, stand on their tracks; returns are finite and
    not below -1, costs lie in [0, 1]. Different contents for one day conflict, equal ones are replays.
    """
    of = lambda p: decisions.select(F.col("decision_id").alias(f"{p}_id"), F.col("snapshot_id").alias(f"{p}_snapshot"), F.col("track").alias(f"{p}_track"), F.col("decision_date").alias(f"{p}_date"))
    content = content_id({c: F.col(c) for c in ("base_id", "shadow_id", "returns", "cost_rate")})
    days = observations.withColumn("_c", content).groupBy("trading_date").agg(F.countDistinct("_c").alias("contents"))
    joined = observations.join(of("base"), "base_id", "left").join(of("shadow"), "shadow_id", "left").join(days, "trading_date")
    return _checks(joined, "trading_date", {
        "conflict": F.col("contents") > 1, "unknown_decision": F.col("base_snapshot").isNull() | F.col("shadow_snapshot").isNull(), "other_snapshot": F.col("base_snapshot") != F.col("shadow_snapshot"),
        "track": (F.col("base_track") != "base") | (F.col("shadow_track") != "shadow"), "date": (F.col("base_date") != F.col("trading_date")) | (F.col("shadow_date") != F.col("trading_date")),
        "return": F.exists("returns", lambda r: r.isNull() | F.isnan(r) | (r < -1)), "cost": ~F.col("cost_rate").between(0, 1),
    })


def latest_allocation(states: DataFrame, before: str, schema: str = "active_strategy string, weights map<string,double>") -> DataFrame:
    """Of each track the last state before a moment, its stored JSON parsed. states: track, as_of, seq, payload."""
    last = states.filter(F.col("as_of") < F.to_timestamp(F.lit(before))).groupBy("track").agg(F.max_by(F.struct("as_of", "payload"), F.struct("as_of", "seq")).alias("s"))
    return last.select("track", "s.as_of", F.from_json("s.payload", schema).alias("state")).select("track", "as_of", "state.*")


def run_violations(runs: DataFrame) -> DataFrame:
    """Overlay runs whose record contradicts itself: (run_id, check).

    runs: run_id, base_snapshot, shadow_snapshot, requested_at, completed_at, deadline, status, outcome, weight_sum.
    """
    applied = F.col("outcome") == "applied"
    return _checks(runs, "run_id", {
        "other_snapshot": F.col("base_snapshot") != F.col("shadow_snapshot"), "completed_before_request": F.col("completed_at") < F.col("requested_at"), "applied_after_deadline": applied & (F.col("completed_at") >= F.col("deadline")),
        "applied_without_success": applied & (F.col("status") != "succeeded"), "weights": applied & (F.abs(F.col("weight_sum") - 1) > 1e-9),
    })


def stage_differences(base: DataFrame, shadow: DataFrame, stages: list[str], key: str = "run_id") -> DataFrame:
    """(key, stage) where a shadow run's stages before the overlay are not those of its base run; a run without base differs in all."""
    both = shadow.select(key, *[F.col(c).alias(f"_s_{c}") for c in stages]).join(base.select(key, *[F.col(c).alias(f"_b_{c}") for c in stages], F.lit(True).alias("_there")), key, "left")
    found = F.array_compact(F.array(*[F.when(F.col("_there").isNull() | ~F.col(f"_s_{c}").eqNullSafe(F.col(f"_b_{c}")), F.lit(c)) for c in stages]))
    return both.select(key, F.explode(found).alias("stage"))
