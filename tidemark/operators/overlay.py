"""Bounded overlays: proposals checked in bulk, blended targets, evidence rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import allocate, trading
from .allocate import CAP, POSITIONS

DRAFT_SCHEMA = "decision_id string, snapshot_id string, generated_at timestamp, valid_until timestamp, risk_scale string, strategy_weights array<struct<strategy:string,weight:string>>, evidence array<struct<evidence_id:string>>"
DRAFT_KEYS = ["decision_id", "snapshot_id", "generated_at", "valid_until", "risk_scale", "strategy_weights", "evidence"]


def parse_drafts(texts: DataFrame, column: str = "content") -> DataFrame:
    """Adds draft (struct) and errors: not JSON, missing or unknown keys, numbers that are not decimal texts."""
    keys = F.coalesce(F.json_object_keys(F.col(column)), F.array().cast("array<string>"))
    parsed = texts.withColumn("draft", F.from_json(column, DRAFT_SCHEMA, {"mode": "PERMISSIVE"})).withColumn("_keys", keys)
    known = F.array(*[F.lit(k) for k in DRAFT_KEYS])
    number = r"^-?\d+(\.\d+)?$"
    errors = F.array_compact(F.array(
        F.when(F.size("_keys") == 0, F.lit("not_an_object")), F.when(F.size(F.array_except(known, F.col("_keys"))) > 0, F.lit("missing_key")), F.when(F.size(F.array_except(F.col("_keys"), known)) > 0, F.lit("unknown_key")),
        F.when(~F.coalesce(F.col("draft.risk_scale").rlike(number), F.lit(False)), F.lit("risk_scale")),
        F.when(~F.coalesce(F.forall("draft.strategy_weights", lambda x: F.coalesce(x["weight"].rlike(number), F.lit(False))), F.lit(False)), F.lit("strategy_weights")),
    ))
    return parsed.withColumn("errors", errors).drop("_keys")


def proposal_rules(approved: list[str], max_change: float) -> dict[str, dict[str, Column]]:
    """What makes a draft unusable, by kind of rule. A condition that is null does not hold.

    window: the draft was made for this decision's time and is still good when its answer is there; identity: it
    speaks of this decision; mix: approved strategies, each once, that sum to one and move little; evidence: all of it known.
    """
    draft, done, start = (lambda f: F.col(f"draft.{f}")), F.col("completed_at"), F.col("as_of")
    names = F.transform("draft.strategy_weights", lambda x: x["strategy"])
    total = F.aggregate("draft.strategy_weights", F.lit(0.0), lambda a, x: a + x["weight"].cast("double"))
    given = lambda s: F.aggregate(F.filter("draft.strategy_weights", lambda x: x["strategy"] == s), F.lit(0.0), lambda a, x: a + x["weight"].cast("double"))
    moves = F.greatest(F.lit(0.0), *[F.abs(given(s) - F.coalesce(F.try_element_at(F.col("base_weights"), F.lit(s)), F.lit(0.0))) for s in approved])
    cited = F.transform("draft.evidence", lambda e: e["evidence_id"])
    not_within = lambda t, low, high: (t < low) | (t > high)
    return {
        "identity": {"decision": draft("decision_id") != F.col("base_decision_id"), "snapshot": draft("snapshot_id") != F.col("base_snapshot_id")},
        "window": {
            "asked": not_within(F.col("requested_at"), start, F.col("deadline")), "made": not_within(draft("generated_at"), F.when(F.col("cache_hit"), start).otherwise(F.greatest(start, F.col("requested_at"))), done),
            "answered": ~(done < F.least(F.col("deadline"), draft("valid_until"))), "validity": draft("valid_until") > F.col("deadline"),
        },
        "mix": {"repeated": F.size(F.array_distinct(names)) < F.size(names), "unknown": F.size(F.array_except(names, F.array(*map(F.lit, approved)))) > 0, "sum": F.abs(total - 1) > 1e-9, "change": moves > max_change + 1e-12},
        "evidence": {"unknown": F.size(F.array_except(cited, F.col("known_evidence"))) > 0},
    }


def proposal_errors(drafts: DataFrame, approved: list[str], max_change: float = 0.20) -> DataFrame:
    """Adds errors (array of kind.rule) to parsed drafts that stand beside their context; one bad draft is an error of its own row.

    drafts: draft, base_decision_id, base_snapshot_id, as_of, requested_at, completed_at, deadline, cache_hit,
    base_weights map<strategy, double>, known_evidence array<string>.
    """
    rules = proposal_rules(approved, max_change)
    broken = [F.when(F.coalesce(condition, F.lit(False)), F.lit(f"{kind}.{name}")) for kind, group in rules.items() for name, condition in group.items()]
    return drafts.withColumn("errors", F.array_compact(F.array(*broken)))


def overlay_outcomes(drafts: DataFrame, blended: DataFrame, base: DataFrame, moved: DataFrame, refused: DataFrame, keys: list[str], max_turnover: float = 0.10) -> DataFrame:
    """One row for each decision: outcome (unchanged, applied or fallback) and its reasons.

    drafts: keys, errors, unchanged (the base's mix at risk scale 1); refused: keys and code of targets that hard
    risk or order planning won't let through. A base target is kept unless everything holds.
    """
    gross = lambda t, name: t.groupBy(*keys).agg(F.sum("weight").alias(name))
    blocked = refused.groupBy(*keys).agg(F.count("*").alias("blocked"))
    rows = drafts.join(gross(blended, "gross"), keys, "left").join(gross(base, "base_gross"), keys, "left").join(moved.select(*keys, "turnover"), keys, "left").join(blocked, keys, "left")
    reasons = F.concat("errors", F.array_compact(F.array(
        F.when(F.coalesce("gross", F.lit(0.0)) > F.coalesce("base_gross", F.lit(0.0)) + 1e-12, F.lit("gross")), F.when(F.coalesce("turnover", F.lit(0.0)) > max_turnover, F.lit("turnover")), F.when(F.col("blocked") > 0, F.lit("blocked_orders")),
    )))
    outcome = F.when((F.size("errors") == 0) & F.col("unchanged"), "unchanged").when(F.size("reasons") == 0, "applied").otherwise("fallback")
    return rows.withColumn("reasons", reasons).withColumn("outcome", outcome).select(*keys, "outcome", "reasons")


def blend(weights: DataFrame, keys: list[str], risk_scale: float | str = 1.0, cap: float = CAP, most: int = POSITIONS) -> DataFrame:
    """Targets of several strategies times their share (mix) and a risk scale (a number or a column of weights): summed, capped, the largest few, cut to 8 digits."""
    risk_scale = F.col(risk_scale) if isinstance(risk_scale, str) else risk_scale
    summed = weights.groupBy(*keys, "code").agg(F.sum(F.col("weight") * F.col("mix") * risk_scale).alias("w"), F.min("rank").alias("rank")).filter(F.col("w") >= 1e-8)
    order = W.partitionBy(*keys).orderBy(F.desc(F.round("w", 12)), "code")
    kept = summed.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    return kept.withColumn("weight", F.floor(F.least(F.col("w"), F.lit(cap)) * 1e8 + 1e-6) / 1e8).drop("w", "place")


def accepted_targets(blended: DataFrame, base: DataFrame, moved: DataFrame, errors: DataFrame, keys: list[str], max_turnover: float = 0.10) -> DataFrame:
    """The overlay's target where it has no error, is not above the base's gross and turns over no more than allowed; else the base's."""
    gross = blended.groupBy(*keys).agg(F.sum("weight").alias("gross")).join(base.groupBy(*keys).agg(F.sum("weight").alias("base_gross")), keys)
    good = gross.filter(F.col("gross") <= F.col("base_gross") + 1e-12).join(moved.filter(F.col("turnover") <= max_turnover), keys, "left_semi").join(errors, keys, "left_anti").select(*keys)
    mine = blended.join(good, keys, "left_semi").select(*keys, "code", "weight", "rank", F.lit("overlay").alias("origin"))
    return mine.unionByName(base.join(good, keys, "left_anti").select(*keys, "code", "weight", "rank", F.lit("base").alias("origin")))


def evaluate(drafts: DataFrame, pool: DataFrame, base: DataFrame, positions: DataFrame, states: DataFrame, equities: DataFrame, approved: list[str], *, max_change: float = 0.20, max_turnover: float = 0.10) -> tuple[DataFrame, DataFrame]:
    """Outcomes and targets of a decision day's draft, from one plan: (trade_date, outcome, reasons) and (trade_date, code, weight, rank, origin).

    drafts: trade_date and what proposal_errors reads, one a day; pool: trade_date, strategy, code, weight, rank;
    base: the day's own target. Each draft's mix and risk scale make its target from the pool; that target's gross
    and turnover are held against the base's, and the hard risk rules judge its changes against positions, states
    and equities as in ``trading.hard_risk``. A base target is kept unless all of it holds, and when the draft is no change.
    """
    keys = ["trade_date"]
    judged = proposal_errors(drafts, approved, max_change)
    scale = F.col("draft.risk_scale").try_cast("double")
    given = lambda s: F.aggregate(F.filter("draft.strategy_weights", lambda x: x["strategy"] == s), F.lit(0.0), lambda a, x: a + x["weight"].try_cast("double"))
    same = scale == 1.0
    for s in approved:
        same = same & (F.abs(given(s) - F.coalesce(F.try_element_at(F.col("base_weights"), F.lit(s)), F.lit(0.0))) < 1e-12)
    shares = judged.select(*keys, scale.alias("scale"), F.explode("draft.strategy_weights").alias("x")).select(*keys, "scale", F.col("x.strategy").alias("strategy"), F.col("x.weight").try_cast("double").alias("mix"))
    blended = blend(pool.join(shares, [*keys, "strategy"]), keys, "scale")
    moved = allocate.turnover(base, blended, keys)
    refused = trading.hard_risk(blended, positions, states, equities).filter("reason IS NOT NULL")
    outcomes = overlay_outcomes(judged.select(*keys, "errors", F.coalesce(same, F.lit(False)).alias("unchanged")), blended, base, moved, refused, keys, max_turnover)
    mine = outcomes.filter("outcome = 'applied'").select(*keys)
    names = [*keys, "code", "weight", "rank"]
    targets = blended.join(mine, keys, "left_semi").select(*names, F.lit("overlay").alias("origin")).unionByName(base.join(mine, keys, "left_anti").select(*names, F.lit("base").alias("origin")))
    return outcomes, targets


def evidence_rows(labels: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Named values of a decision as rows."""
    return labels.select(*keys, *[F.col(n).cast("double").alias(n) for n in names]).unpivot(keys, names, "evidence", "value")
