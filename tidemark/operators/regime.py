"""Market regime of every decision date: features, scores, probabilities, emergency override."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.market import clamp
from .features import by_code

# Scales and centres of the terms, weights of the scores, thresholds of the override.
TREND_SCALE, VOLATILITY_CENTER, VOLATILITY_SCALE, TURNOVER_CENTER, TURNOVER_SCALE = 0.08, 0.20, 0.15, 1.0, 1.0
CONCENTRATION_CENTER, CONCENTRATION_SCALE, OPENING_SCALE, BREADTH_CENTER, BREADTH_SCALE = 0.20, 0.20, 0.015, 0.50, 0.25
TEMPERATURE, CONCENTRATION_SHARE, MINIMUM_UNIVERSE, MINIMUM_COVERAGE = 0.75, 0.10, 5, 0.80
EMERGENCY_VOLATILITY, EMERGENCY_TREND, EMERGENCY_BREADTH, EMERGENCY_OPENING = 0.45, -0.12, 0.20, -0.05
SCORE_WEIGHTS = {
    "risk_on": {"trend": 0.35, "breadth": 0.25, "opening": 0.15, "turnover": 0.10, "volatility": -0.10, "concentration": -0.05},
    "mean_reverting": {"flat_trend": 0.35, "flat_breadth": 0.20, "turnover": 0.20, "volatility": -0.15, "abs_opening": -0.10},
    "defensive": {"trend": -0.25, "breadth": -0.20, "volatility": 0.25, "concentration": 0.20, "opening": -0.10},
    "risk_off": {"trend": -0.35, "breadth": -0.20, "volatility": 0.25, "concentration": 0.10, "opening": -0.10},
}
LABELS = list(SCORE_WEIGHTS)


def regime_features(bars: DataFrame, lookback: int = 20, annual: int = 252) -> DataFrame:
    """One row for each day with enough covered codes (others are left out): six features and the coverage.

    bars: code, trade_date, signal_close, trade_status, amount, turnover. A code counts on a day if it is
    tradable then and has lookback + 1 priced bars. The market's returns are taken by position: the
    k-th last return of every code is averaged, whatever its date.
    """
    priced = bars.filter("trade_status AND signal_close IS NOT NULL AND amount IS NOT NULL AND turnover IS NOT NULL")
    one = priced.withColumn("r", F.col("signal_close") / F.lag("signal_close").over(by_code()) - 1)
    recent = by_code().rowsBetween(-(lookback - 1), 0)
    seen = one.withColumns({"trend": F.col("signal_close") / F.lag("signal_close", lookback).over(by_code()) - 1, "last": F.collect_list("r").over(recent)}).filter("trend IS NOT NULL")
    size = bars.groupBy("trade_date").agg(F.count("*").alias("universe_size"))
    by_amount = W.partitionBy("trade_date").orderBy(F.desc("amount"), "code")
    day = W.partitionBy("trade_date")
    ranked = seen.withColumns({"place": F.row_number().over(by_amount), "n": F.count("*").over(day)})
    top = F.col("place") <= F.greatest(F.lit(1), F.ceil(F.col("n") * CONCENTRATION_SHARE))
    sums = ranked.groupBy("trade_date").agg(
        F.avg("trend").alias("trend_return"), F.avg((F.col("trend") > 0).cast("double")).alias("breadth"), F.avg("turnover").alias("average_turnover"),
        (F.sum(F.when(top, F.col("amount"))) / F.sum("amount")).alias("concentration"), F.count("*").alias("covered"),
        F.array(*[F.avg(F.col("last")[k]) for k in range(lookback)]).alias("market"),
    )
    mean = F.aggregate("market", F.lit(0.0), lambda a, x: a + x) / lookback
    squares = F.aggregate("market", F.struct(F.lit(0.0).alias("s"), mean.alias("m")), lambda a, x: F.struct((a["s"] + (x - a["m"]) * (x - a["m"])).alias("s"), a["m"].alias("m")), lambda a: a["s"])
    out = sums.join(size, "trade_date").withColumn("annualized_volatility", F.sqrt(squares / (lookback - 1)) * F.sqrt(F.lit(float(annual))))
    out = out.withColumn("daily_coverage", F.col("covered") / F.col("universe_size"))
    kept = out.filter((F.col("universe_size") >= MINIMUM_UNIVERSE) & (F.col("daily_coverage") >= MINIMUM_COVERAGE))
    return kept.select("trade_date", "trend_return", "annualized_volatility", "breadth", "average_turnover", "concentration", F.lit(0.0).alias("opening_return"), "universe_size", "daily_coverage")


def regime_gates(bars: DataFrame, lookback: int = 20) -> DataFrame:
    """(trade_date, gate, value, least) for each day that has no features, and why: too few codes, or too few of them covered.

    bars as in regime_features; value is what the day has of what the gate asks at least.
    """
    priced = bars.filter("trade_status AND signal_close IS NOT NULL AND amount IS NOT NULL AND turnover IS NOT NULL")
    seen = priced.withColumn("before", F.lag("signal_close", lookback).over(by_code())).filter("before IS NOT NULL")
    covered = seen.groupBy("trade_date").agg(F.count("*").alias("covered"))
    days = bars.groupBy("trade_date").agg(F.count("*").alias("size")).join(covered, "trade_date", "left")
    share = F.coalesce("covered", F.lit(0)) / F.col("size")
    gate = lambda name, value, least: F.when(value < least, F.struct(F.lit(name).alias("gate"), value.cast("double").alias("value"), F.lit(float(least)).alias("least")))
    failed = F.array_compact(F.array(gate("universe_size", F.col("size"), MINIMUM_UNIVERSE), gate("daily_coverage", share, MINIMUM_COVERAGE)))
    return days.select("trade_date", F.explode(failed).alias("g")).select("trade_date", "g.*")


def with_opening(features: DataFrame, opening: DataFrame) -> DataFrame:
    """Replaces opening_return by the amount-weighted return of the checkpoint bars; days under the coverage are left out.

    opening: trade_date, code, open_price, close_price, amount, volume, trade_status.
    """
    usable = opening.filter("trade_status AND volume > 0 AND amount > 0")
    day = usable.groupBy("trade_date").agg((F.sum((F.col("close_price") / F.col("open_price") - 1) * F.col("amount")) / F.sum("amount")).alias("moved"), F.count("*").alias("opened"))
    joined = features.drop("opening_return").join(day, "trade_date")
    enough = F.col("opened") / F.round(F.col("universe_size") * F.col("daily_coverage")) >= MINIMUM_COVERAGE
    return joined.filter(enough).withColumnRenamed("moved", "opening_return").drop("opened")


def regime_labels(features: DataFrame) -> DataFrame:
    """Adds scores, probabilities (8 digits, the rest to risk_off), the label of the highest (ties: the later name), the override."""
    terms = {
        "trend": clamp(F.col("trend_return") / TREND_SCALE), "volatility": clamp((F.col("annualized_volatility") - VOLATILITY_CENTER) / VOLATILITY_SCALE),
        "breadth": clamp((F.col("breadth") - BREADTH_CENTER) / BREADTH_SCALE), "turnover": clamp((F.col("average_turnover") - TURNOVER_CENTER) / TURNOVER_SCALE),
        "concentration": clamp((F.col("concentration") - CONCENTRATION_CENTER) / CONCENTRATION_SCALE), "opening": clamp(F.col("opening_return") / OPENING_SCALE),
    }
    terms |= {"flat_trend": 1 - F.least(F.abs(terms["trend"]), F.lit(1.0)), "flat_breadth": 1 - F.least(F.abs(terms["breadth"]), F.lit(1.0)), "abs_opening": F.abs(terms["opening"])}

    def score(weights: dict[str, float]):
        total = F.lit(0.0)
        for name, w in weights.items():
            total = total + w * terms[name]
        return total

    scored = features.withColumns({f"score_{k}": score(w) for k, w in SCORE_WEIGHTS.items()})
    exps = scored.withColumns({f"_e_{k}": F.exp(F.col(f"score_{k}") / TEMPERATURE) for k in LABELS})
    total = sum((F.col(f"_e_{k}") for k in LABELS[1:]), F.col(f"_e_{LABELS[0]}"))
    first = {f"p_{k}": F.bround(F.col(f"_e_{k}") / total, 8) for k in LABELS[:-1]}
    shared = exps.withColumns(first).drop(*[f"_e_{k}" for k in LABELS])
    shared = shared.withColumn(f"p_{LABELS[-1]}", F.round(1 - sum((F.col(f"p_{k}") for k in LABELS[1:-1]), F.col(f"p_{LABELS[0]}")), 8))
    best = F.array_max(F.array(*[F.struct(F.col(f"p_{k}").alias("p"), F.lit(k).alias("label")) for k in LABELS]))["label"]
    reasons = F.array_compact(F.array(
        F.when(F.col("annualized_volatility") >= EMERGENCY_VOLATILITY, F.lit("volatility")),
        F.when((F.col("trend_return") <= EMERGENCY_TREND) & (F.col("breadth") <= EMERGENCY_BREADTH), F.lit("trend_and_breadth")),
        F.when(F.col("opening_return") <= EMERGENCY_OPENING, F.lit("opening_selloff")),
    ))
    judged = shared.withColumn("best", best).withColumn("reasons", reasons).withColumn("emergency", F.size("reasons") > 0)
    return judged.withColumn("selected", F.when(F.col("emergency"), F.lit("risk_off")).otherwise(F.col("best"))).drop("best")
