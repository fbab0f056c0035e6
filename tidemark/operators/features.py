"""Cross-sectional features and ranked strategy proposals, for every decision date at once.

All windows share one partitioning and order (code, trade_date), so one shuffle and one sort serve
them. Suspended days have no price; an n-observation return counts priced days only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def by_code():
    """The window that all series share."""
    return W.partitionBy("code").orderBy("trade_date")


def price_features(bars: DataFrame, momentum: int = 20, short: int = 5, annual: int = 252) -> DataFrame:
    """For each code and day, from the bars up to it: observations, momentum, volatility, short return, exclusion.

    A window of priced days within all days: prices are numbered, and the features of the last priced
    day are carried to days without a price, where the exclusion says why the code can't be used.
    """
    priced = F.col("trade_status") & F.col("signal_close").isNotNull()
    marked = bars.withColumn("p", F.when(priced, F.col("signal_close")))
    # priced days only, in a frame of their own
    only = marked.filter("p IS NOT NULL")
    ret = F.col("p") / F.lag("p", 1).over(by_code()) - 1
    only = only.withColumn("r", ret)
    recent = by_code().rowsBetween(-(momentum - 1), 0)
    made = only.withColumns({
        "observations": F.row_number().over(by_code()), "momentum": F.col("p") / F.lag("p", momentum).over(by_code()) - 1, "short_return": F.col("p") / F.lag("p", short).over(by_code()) - 1,
        "volatility": F.when(F.count("r").over(recent) == momentum, F.stddev_samp("r").over(recent) * F.sqrt(F.lit(float(annual)))),
    })
    excluded = (
        F.when(F.col("is_st"), "st_stock").when(F.col("observations") < momentum + 1, "insufficient_history").when(F.round("volatility", 12) == 0, "zero_volatility")
    )
    unpriced = marked.filter("p IS NULL").select("code", "trade_date", F.when(F.col("trade_status"), "missing_current_bar").otherwise("not_tradable").alias("exclusion"))
    done = made.select("code", "trade_date", "observations", "momentum", "short_return", "volatility", (F.col("momentum") / F.nullif(F.col("volatility"), F.lit(0.0))).alias("score"), excluded.alias("exclusion"))
    return done.unionByName(unpriced, allowMissingColumns=True)


def top_by(features: DataFrame, order: list[Column], most: int, keep: Column | None = None) -> DataFrame:
    """The first ``most`` codes of each day in an order, ties by code, with their rank."""
    usable = features.filter("exclusion IS NULL" if keep is None else F.col("exclusion").isNull() & keep)
    day = W.partitionBy("trade_date").orderBy(*order, "code")
    return usable.withColumn("rank", F.row_number().over(day)).filter(F.col("rank") <= most)


def momentum_candidates(features: DataFrame, most: int = 10) -> DataFrame:
    """Codes with positive momentum by momentum over volatility."""
    return top_by(features, [F.desc("score")], most, F.col("momentum") > 0)


def strategy_pool(features: DataFrame, most: int = 10) -> DataFrame:
    """Proposals of the three strategies that hold instruments (cash proposes none): strategy, day, code, rank, score, inverse volatility."""
    ratio = F.col("short_return") / F.col("volatility")
    parts = {
        "momentum": (top_by(features, [F.desc("score")], most, F.col("momentum") > 0), F.col("score")),
        "short_term_reversal": (top_by(features.withColumn("ratio", ratio), [F.asc("ratio")], most, F.col("short_return") < 0), -F.col("ratio")),
        "defensive_low_volatility": (top_by(features, [F.asc("volatility")], most), -F.col("volatility")),
    }
    out = None
    for name, (rows, score) in parts.items():
        one = rows.select("trade_date", F.lit(name).alias("strategy"), "code", "rank", score.alias("score"), (1 / F.col("volatility")).alias("inverse_volatility"))
        out = one if out is None else out.unionByName(one)
    return out


def history_window(bars: DataFrame, decisions: DataFrame, most: int) -> DataFrame:
    """For each decision (code, decision_date): its last ``most`` priced bars, and the current bar if that has no price.

    Priced bars are numbered and meet decisions by blocks of ``most`` numbers, so a decision meets at most
    two blocks whatever the code's history.
    """
    counted = bars.withColumn("k", F.count(F.when(F.col("trade_status"), 1)).over(by_code())).withColumn("_block", F.floor(F.col("k") / most))
    at = counted.select("code", F.col("trade_date").alias("decision_date"), F.col("k").alias("k_now")).join(decisions.select("code", "decision_date"), ["code", "decision_date"], "left_semi")
    at = at.withColumn("_block", F.explode(F.array(F.floor(F.col("k_now") / most), F.floor(F.col("k_now") / most) - 1)))
    joined = counted.join(at, ["code", "_block"]).filter((F.col("trade_date") <= F.col("decision_date")) & (F.col("k_now") - F.col("k") < most))
    return joined.filter(F.col("trade_status") | (F.col("trade_date") == F.col("decision_date"))).drop("k", "k_now", "_block").select("code", *[c for c in bars.columns if c != "code"], "decision_date")


def last_bars(bars: DataFrame, n: int, skip_suspended: bool = True, at: str | None = None) -> DataFrame:
    """The last n bars of each code up to a date."""
    seen = bars if at is None else bars.filter(F.col("trade_date") <= F.to_date(F.lit(at)))
    if skip_suspended:
        seen = seen.filter("trade_status")
    back = F.row_number().over(W.partitionBy("code").orderBy(F.desc("trade_date")))
    return seen.withColumn("back", back).filter(F.col("back") <= n)


def market_returns(bars: DataFrame) -> DataFrame:
    """Equal-weighted return of each day over all codes; a suspended code counts as 0."""
    change = F.when(F.col("trade_status"), F.col("signal_close") / F.lag("signal_close").over(by_code()) - 1).otherwise(F.lit(0.0))
    return bars.withColumn("r", change).groupBy("trade_date").agg(F.avg("r").alias("market_return"), F.count("r").alias("codes"))


def weight_changes(before: DataFrame, after: DataFrame, keys: list[str], least: float = 1e-8) -> DataFrame:
    """Weights that differ by more than ``least``, and by how much."""
    joined = before.select(*keys, F.col("weight").alias("old")).join(after.select(*keys, F.col("weight").alias("new")), keys, "full_outer")
    filled = joined.withColumn("old", F.coalesce("old", F.lit(0.0))).withColumn("new", F.coalesce("new", F.lit(0.0)))
    return filled.withColumn("change", F.col("new") - F.col("old")).filter(F.abs("change") > least)
