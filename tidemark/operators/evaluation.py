"""Walk-forward evaluation: performance, folds, parameter choice, bootstrap, deflated Sharpe ratio, attribution."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ANNUAL = 252
# Fixed value.
EULER_GAMMA = 0.5772156649015329


def drawdowns(series: DataFrame, keys: list[str], value: str = "net_return", order: str = "as_of") -> DataFrame:
    """Adds growth (from 1) and drawdown from the highest growth so far, which is at least 1."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    grown = series.withColumn("growth", F.exp(F.sum(F.log1p(value)).over(w)))
    return grown.withColumn("drawdown", 1 - F.col("growth") / F.greatest(F.lit(1.0), F.max("growth").over(w)))


def performance(series: DataFrame, keys: list[str], annual: int = ANNUAL) -> DataFrame:
    """The nine figures of each group of keys. series: keys, as_of, net_return, benchmark_return, cost_rate."""
    root = math.sqrt(annual)
    sums = drawdowns(series, keys).groupBy(*keys).agg(
        F.count("*").alias("observations"), F.sum(F.log1p("net_return")).alias("_log"), F.avg("net_return").alias("_mean"), F.coalesce(F.stddev_samp("net_return"), F.lit(0.0)).alias("_sd"),
        F.max("drawdown").alias("max_drawdown"), F.covar_samp("net_return", "benchmark_return").alias("_cov"), F.var_samp("benchmark_return").alias("_var"), F.avg("benchmark_return").alias("_bench"), F.avg("cost_rate").alias("average_cost_rate"),
    )
    beta = F.coalesce(F.when(F.col("_var") > 0, F.col("_cov") / F.col("_var")), F.lit(0.0))
    out = sums.withColumns({
        "cumulative_return": F.exp("_log") - 1, "annualized_return": F.exp(F.col("_log") * annual / F.col("observations")) - 1, "annualized_volatility": F.col("_sd") * root,
        "sharpe": F.coalesce(F.when(F.col("_sd") > 0, F.col("_mean") / F.col("_sd") * root), F.lit(0.0)), "beta": beta,
    })
    out = out.withColumn("annualized_alpha", (F.col("_mean") - F.col("beta") * F.col("_bench")) * annual)
    return out.select(*keys, "observations", "cumulative_return", "annualized_return", "annualized_volatility", "sharpe", "max_drawdown", "annualized_alpha", "beta", "average_cost_rate")


def numbered(series: DataFrame) -> DataFrame:
    """Adds idx (from 0) and n within each parameter."""
    p = W.partitionBy("parameter_id")
    return series.withColumn("idx", F.row_number().over(p.orderBy("as_of")) - 1).withColumn("n", F.count("*").over(p))


def in_folds(series: DataFrame, train: int, test: int) -> tuple[DataFrame, DataFrame]:
    """The rows of each fold's training and test part. Only complete folds.

    Fold k trains on [k test, k test + train) and tests on the next ``test`` rows; a row's folds follow
    from its number, so nothing is joined.
    """
    rows = numbered(series).withColumn("folds", F.floor((F.col("n") - train) / test))
    first = F.greatest(F.lit(0), F.ceil((F.col("idx") - train + 1) / test)).cast("int")
    last = F.least(F.floor(F.col("idx") / test), F.col("folds") - 1).cast("int")
    trained = rows.filter(last >= first).withColumn("fold", F.explode(F.sequence(first, last)))
    tested = rows.withColumn("fold", F.floor((F.col("idx") - train) / test).cast("int")).filter((F.col("idx") >= train) & (F.col("fold") < F.col("folds")))
    return trained.drop("folds"), tested.drop("folds")


def choose_parameters(trained: DataFrame) -> DataFrame:
    """For each fold the parameter with the best training Sharpe ratio, of equal ones the smallest id."""
    scores = performance(trained, ["fold", "parameter_id"]).select("fold", "parameter_id", "sharpe", "observations")
    best = W.partitionBy("fold").orderBy(F.desc(F.round("sharpe", 12)), "parameter_id")
    return scores.withColumn("place", F.row_number().over(best)).filter("place = 1").select("fold", F.col("parameter_id").alias("selected_parameter"), F.col("sharpe").alias("training_sharpe"))


def out_of_sample(tested: DataFrame, chosen: DataFrame) -> DataFrame:
    """The test rows of each fold's chosen parameter."""
    return tested.join(chosen, "fold").filter("parameter_id = selected_parameter").drop("selected_parameter", "training_sharpe")


def series_violations(series: DataFrame) -> DataFrame:
    """(check, as_of) where parameters disagree on the grid, benchmark or regime, or values are impossible."""
    many = series.agg(F.countDistinct("parameter_id").alias("parameters"))
    day = series.groupBy("as_of").agg(F.count("*").alias("rows"), F.countDistinct("parameter_id").alias("p"), F.countDistinct("benchmark_return").alias("b"), F.countDistinct("regime").alias("r"), F.min(F.least("gross_return", "benchmark_return")).alias("lo"), F.min("cost_rate").alias("c"))
    checks = F.array_compact(F.array(F.when(F.col("p") < F.col("parameters"), F.lit("grid")), F.when(F.col("rows") > F.col("p"), F.lit("repeated")), F.when(F.col("b") > 1, F.lit("benchmark")), F.when(F.col("r") > 1, F.lit("regime")), F.when(F.col("lo") <= -1, F.lit("below_minus_one")), F.when(F.col("c") < 0, F.lit("negative_cost"))))
    return day.crossJoin(F.broadcast(many)).select(F.explode(checks).alias("check"), "as_of")  # many is one row


def value_periods(values: DataFrame, costs: DataFrame, keys: list[str], initial: float) -> DataFrame:
    """Net and gross returns of a portfolio's values: net = v / previous - 1, cost rate = cost / previous, gross = net + cost rate."""
    before = F.lag("total_value", 1, initial).over(W.partitionBy(*keys).orderBy("as_of"))
    rows = values.join(costs, [*keys, "as_of"], "left").withColumn("_before", before)
    return rows.withColumns({"net_return": F.col("total_value") / F.col("_before") - 1, "cost_rate": F.coalesce("cost", F.lit(0.0)) / F.col("_before")}).withColumn("gross_return", F.col("net_return") + F.col("cost_rate")).drop("_before")


def evaluation_periods(values: DataFrame, trades: DataFrame, benchmark: DataFrame, regimes: DataFrame, keys: list[str], initial: float) -> DataFrame:
    """Periods with costs summed from the day's trades, the benchmark's return and the regime; ``missing`` names what a day lacks.

    trades: keys, traded_at, cost; benchmark: as_of, benchmark_return; regimes: as_of, regime.
    """
    costs = trades.groupBy(*keys, F.to_date("traded_at").alias("as_of")).agg(F.sum("cost").alias("cost"))
    rows = value_periods(values, costs, keys, initial).join(benchmark, "as_of", "left").join(regimes, "as_of", "left")
    lacking = F.array_compact(F.array(F.when(F.col("benchmark_return").isNull(), F.lit("benchmark")), F.when(F.col("regime").isNull(), F.lit("regime"))))
    return rows.withColumn("missing", lacking)


def block_starts(spark, samples: int, blocks: int, starts: int, seed: int) -> DataFrame:
    """(sample, block, start): where each block of each sample begins, from a hash, so any task can make its own."""
    cells = spark.range(samples).withColumnRenamed("id", "sample").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    number = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), "sample", "block").cast("binary")), 1, 8), 16, 10).cast("long")
    return cells.withColumn("start", (number % starts).cast("int"))


def bootstrap_means(series: DataFrame, value: str, *, samples: int, block_size: int, seed: int) -> DataFrame:
    """(sample, mean): block bootstrap of a numbered series (idx from 0)."""
    n = series.count()
    size = min(block_size, n)
    starts = block_starts(series.sparkSession, samples, -(-n // size), n - size + 1, seed)
    offsets = starts.withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).filter(F.col("block") * size + F.col("offset") < n)
    drawn = offsets.withColumn("idx", F.col("start") + F.col("offset")).join(series.select("idx", value), "idx")
    return drawn.groupBy("sample").agg(F.avg(value).alias("mean"))


def bootstrap_summary(means: DataFrame, samples: int, confidence: float = 0.95) -> DataFrame:
    """Bounds at the floor index of the sorted means, and the share above zero. One row a sample goes through."""
    tail = (1 - confidence) / 2
    at = lambda q: math.floor(q * (samples - 1) + 1e-9)
    place = means.withColumn("place", F.row_number().over(W.orderBy("mean", "sample")) - 1)
    return place.agg(F.max(F.when(F.col("place") == at(tail), F.col("mean"))).alias("confidence_lower"), F.max(F.when(F.col("place") == at(1 - tail), F.col("mean"))).alias("confidence_upper"), F.avg((F.col("mean") > 0).cast("double")).alias("probability_positive"))


def deflated_sharpe(series: DataFrame, keys: list[str], trials: int, value: str = "net_return") -> DataFrame:
    """observed, expected maximum of ``trials`` and the test statistic of each group."""
    normal = NormalDist()
    expected = (1 - EULER_GAMMA) * normal.inv_cdf(1 - 1 / trials) + EULER_GAMMA * normal.inv_cdf(1 - 1 / (trials * math.e)) if trials > 1 else 0.0
    one = series.groupBy(*keys).agg(F.count("*").alias("observations"), F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd"), F.skewness(value).alias("_skew"), (F.kurtosis(value) + 3).alias("_kurt"))
    one = one.withColumn("observed", F.coalesce(F.when(F.col("_sd") > 0, F.col("_mean") / F.col("_sd")), F.lit(0.0)))
    one = one.withColumn("expected_max", F.sqrt((1 + F.col("observed") * F.col("observed") / 2) / F.col("observations")) * expected)
    spread = 1 - F.col("_skew") * F.col("observed") + (F.col("_kurt") - 1) * F.col("observed") * F.col("observed") / 4
    statistic = F.when((F.col("observations") > 2) & (spread > 0), (F.col("observed") - F.col("expected_max")) * F.sqrt(F.col("observations") - 1) / F.sqrt(spread))
    return one.withColumn("statistic", statistic).select(*keys, "observations", "observed", "expected_max", "statistic")


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution function, to about 1e-15, by column expressions; null for null, NaN for NaN.

    Within 3 of 0 a series in odd powers over double factorials; beyond, the continued fraction of the tail.
    """
    x = x.cast("double")
    size = F.least(F.abs(x), F.lit(40.0))
    density = F.exp(-size * size / 2) / math.sqrt(2 * math.pi)
    downward = lambda n: F.sequence(F.lit(n), F.lit(1), F.lit(-1))
    near = density * size * F.aggregate(downward(50), F.lit(1.0), lambda t, k: 1 + size * size / (2 * k + 1) * t)
    tail = density / F.aggregate(downward(80), size, lambda t, k: size + k / t)
    above = F.when(size < 3, 0.5 - near).otherwise(tail)
    return F.when(F.isnan(x), x).when(x < 0, above).when(x >= 0, 1 - above)


def with_probability(deflated: DataFrame) -> DataFrame:
    """Adds the normal probability of the statistic, 0.5 without one."""
    return deflated.withColumn("probability", F.when(F.isnan("statistic"), 0.5).otherwise(F.coalesce(normal_cdf(F.col("statistic")), F.lit(0.5))))


def forward_review(observations: DataFrame, returns: list[str], cost: str, minimum_days: int = 60) -> DataFrame:
    """One row: compounded returns, days, mean cost; ready if there are enough days and none repeats."""
    sums = [(F.exp(F.sum(F.log1p(c))) - 1).alias(c) for c in returns]
    return observations.agg(F.count("*").alias("days"), F.countDistinct("trading_date").alias("distinct_days"), *sums, F.avg(cost).alias("average_cost_rate")).withColumn("ready", (F.col("days") >= minimum_days) & (F.col("days") == F.col("distinct_days")))


def attribution(review: DataFrame, effects: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds each effect as the difference of two compounded returns."""
    return review.withColumns({name: F.col(a) - F.col(b) for name, (a, b) in effects.items()})


def split_violations(splits: DataFrame) -> DataFrame:
    """(check) for research splits (name, first, last, content_sum): train before validation before test, no overlap, no equal contents."""
    order = F.when(F.col("name") == "train", 0).when(F.col("name") == "validation", 1).otherwise(2)
    following = W.orderBy(order)  # three rows
    checked = splits.withColumns({"next_first": F.lead("first").over(following), "same": F.count("*").over(W.partitionBy("content_sum"))})
    found = F.array_compact(F.array(F.when(F.col("last") >= F.col("next_first"), F.lit("overlap")), F.when(F.col("same") > 1, F.lit("equal_contents")), F.when(F.col("first") > F.col("last"), F.lit("empty"))))
    return checked.select("name", F.explode(found).alias("check"))
