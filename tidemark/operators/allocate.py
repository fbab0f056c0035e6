"""Target weights: capped inverse-volatility weights, and the fold that carries an allocation through time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CASH = "cash"
# The strategy a regime recommends.
STRATEGY_OF = {"risk_on": "momentum", "mean_reverting": "short_term_reversal", "defensive": "defensive_low_volatility", "risk_off": CASH}
GROSS, CAP, POSITIONS = 0.95, 0.20, 8


def capped_weights(intents: DataFrame, keys: list[str], gross: float = GROSS, cap: float = CAP, most: int = POSITIONS) -> DataFrame:
    """Weights in proportion to inverse_volatility, none over the cap, gross in all if the cap allows it; cut to 8 digits.

    Capping one item raises the others' shares, which may put the next over the cap. In descending order
    of inverse volatility, item k is over the cap given that all before it are capped iff
    (gross - k cap) inv / (what is left of inv) > cap; the capped items are the leading run of these.
    """
    top = W.partitionBy(*keys).orderBy("rank", "code")
    kept = intents.withColumn("_n", F.row_number().over(top)).filter(F.col("_n") <= most)
    order = W.partitionBy(*keys).orderBy(F.desc("inverse_volatility"), "code")
    group = W.partitionBy(*keys)
    rest = F.sum("inverse_volatility").over(order.rowsBetween(0, W.unboundedFollowing))
    placed = kept.withColumn("_k", F.row_number().over(order) - 1).withColumn("_rest", rest)
    over = (gross - F.col("_k") * cap) * F.col("inverse_volatility") / F.col("_rest") > cap
    run = F.min(over.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))
    capped = placed.withColumn("_capped", run == 1)
    many = F.count(F.when(F.col("_capped"), 1)).over(group)
    free = F.max(F.when(~F.col("_capped"), F.col("_rest"))).over(group)
    weight = F.when(F.col("_capped"), F.lit(cap)).otherwise((gross - F.col("_m") * cap) * F.col("inverse_volatility") / F.col("_free"))
    out = capped.withColumns({"_m": many, "_free": free}).withColumn("weight", F.floor(weight * 1e8 + 1e-6) / 1e8)
    return out.drop("_n", "_k", "_rest", "_capped", "_m", "_free")


def turnover(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Half of all weight changes, cash included, for each key. Frames: keys, code, weight; what is not invested is cash."""
    both = old.select(*keys, "code", F.col("weight").alias("a")).join(new.select(*keys, "code", F.col("weight").alias("b")), [*keys, "code"], "full_outer")
    a, b = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    return both.groupBy(*keys).agg(F.bround((F.sum(F.abs(a - b)) + F.abs(F.sum(a) - F.sum(b))) / 2, 8).alias("turnover"))


#: Weights are carried as whole units of one of so many, so that every step is exact.
UNITS = 100_000_000
_MAP = "map<string,bigint>"
#: Days that one row may hold; a decision a day for some centuries.
MOST_DAYS = 100_000


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), use)[0]


def _moved(pairs: Column) -> Column:
    """Twice the turnover between the weights a and b of each entry, cash included."""
    add = lambda x, of: F.aggregate(F.map_values(x), F.lit(0).cast("bigint"), lambda t, v: t + of(v))
    return add(pairs, lambda v: F.abs(v["b"] - v["a"])) + F.abs(add(pairs, lambda v: v["b"] - v["a"]))


def _paired(old: Column, new: Column) -> Column:
    zero = F.lit(0).cast("bigint")
    return F.map_zip_with(old, new, lambda c, a, b: F.struct(F.coalesce(a, zero).alias("a"), F.coalesce(b, zero).alias("b")))


def _active(state: Column, day: Column, hysteresis: Column, change: Column) -> Column:
    """The strategy of a day. A change takes a change point and, without emergency, an advantage in probability."""
    before, recommended = state["active"], day["recommended"]
    advantage = day["p"][recommended] - day["p"][before]
    switched = F.when(day["emergency"], F.lit(CASH)).when(advantage >= hysteresis, recommended).otherwise(before)
    return F.when(before.isNull() | (before == recommended), recommended).when(~change, before).otherwise(switched)


def _limited(old: Column, wanted: Column, most: Column, free: Column) -> Column:
    """(weights, moved): ``wanted``, or as much of the way to it as a turnover of ``most`` units allows; ``free``: no limit."""

    def blended(pairs: Column, full: Column) -> Column:
        way = 2 * (most - F.size(pairs) - 1)  # a unit for each code and the cash is kept back for rounding
        weights = F.map_filter(F.transform_values(pairs, lambda c, v: F.call_function("div", v["a"] * full + (v["b"] - v["a"]) * way, full)), lambda c, w: w > 0)
        return F.when(way <= 0, F.struct(old.alias("weights"), F.lit(0).cast("bigint").alias("moved"))).otherwise(_let(weights, lambda w: F.struct(w.alias("weights"), _moved(_paired(old, w)).alias("moved"))))

    def limited(pairs: Column) -> Column:
        return _let(_moved(pairs), lambda full: F.when(free | (full <= 2 * most), F.struct(wanted.alias("weights"), full.alias("moved"))).otherwise(blended(pairs, full)))

    return _let(_paired(old, wanted), limited)


def replay(regimes: DataFrame, desired: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Folds the allocation rule over all days, for every scenario (scenario, max_turnover, hysteresis, change_every).

    regimes: trade_date, selected, emergency, p_*; desired: trade_date, strategy, code, weight. The days stand
    once, in order, in one row (at most MOST_DAYS of them, a few weights each), which every scenario's row
    gets; the fold is one expression over it, without Python. The strategy changes on every
    change_every-th day only. Result: scenario, trade_date, active_strategy, weights (code to units of 1e-8), moved
    (twice the turnover in units). Weights are rounded to units beforehand; a step towards a target is cut to units.
    """
    units = lambda c: F.round(c * UNITS).cast("bigint")
    held = desired.groupBy("trade_date", "strategy").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("code", units(F.col("weight")))))).alias("w"))
    by_day = held.groupBy("trade_date").agg(F.map_from_entries(F.collect_list(F.struct("strategy", "w"))).alias("desired"))
    recommended = F.element_at(F.create_map(*[F.lit(x) for pair in STRATEGY_OF.items() for x in pair]), F.col("selected"))
    p = F.create_map(*[x for label, strategy in STRATEGY_OF.items() for x in (F.lit(strategy), F.col(f"p_{label}"))])
    nothing = F.create_map().cast(_MAP)
    day = F.struct("trade_date", recommended.alias("recommended"), "emergency", p.alias("p"), F.coalesce("desired", F.create_map().cast(f"map<string,{_MAP}>")).alias("desired"))
    every = F.array_sort(F.collect_list(day), lambda a, b: F.when(a["trade_date"] < b["trade_date"], -1).otherwise(1))
    days = regimes.join(by_day, "trade_date", "left").agg(every.alias("days"), F.assert_true(F.count("*") <= MOST_DAYS, F.lit(f"more than {MOST_DAYS} days")).alias("bounded")).filter("bounded IS NULL").select("days")
    start = F.struct(F.lit(None).cast("string").alias("active"), nothing.alias("weights"), F.lit(0).cast("bigint").alias("moved"))

    def step(state: Column, d: Column, n: Column) -> Column:
        def chosen(active: Column) -> Column:
            wanted = F.when(d["emergency"] | (active == CASH), nothing).otherwise(F.coalesce(d["desired"][active], nothing))
            made = _let(wanted, lambda w: _limited(state["weights"], w, F.col("most"), state["active"].isNull() | d["emergency"]))
            return _let(made, lambda m: F.struct(active.alias("active"), m["weights"].alias("weights"), m["moved"].alias("moved")))

        return _let(_active(state, d, F.col("hysteresis"), F.pmod(n, "change_every") == 0), chosen)

    steps = F.aggregate(
        F.sequence(F.lit(0), F.size("days") - 1), F.array(start),
        lambda done, n: F.array_append(done, _let(F.element_at(done, -1), lambda state: _let(F.get("days", n), lambda d: step(state, d, n)))),
    )
    # a set number of tasks: by their bytes the scenarios would be merged into one
    tasks = int(scenarios.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = scenarios.withColumn("most", units(F.col("max_turnover"))).repartition(tasks, "scenario").crossJoin(F.broadcast(days)).filter(F.size("days") > 0)
    rows = rows.select("scenario", F.posexplode(F.arrays_zip(F.transform("days", lambda d: d["trade_date"]).alias("trade_date"), F.slice(steps, 2, F.size("days")).alias("state"))).alias("n", "x"))
    return rows.select("scenario", "x.trade_date", F.col("x.state.active").alias("active_strategy"), F.col("x.state.weights").alias("weights"), F.col("x.state.moved").alias("moved"))


def replayed_weights(replayed: DataFrame) -> DataFrame:
    """scenario, trade_date, active_strategy, code, weight, turnover: a row for each code; a day in cash has one without."""
    rows = replayed.select("scenario", "trade_date", "active_strategy", F.explode_outer("weights").alias("code", "units"), (F.col("moved") / (2 * UNITS)).alias("turnover"))
    return rows.select("scenario", "trade_date", "active_strategy", "code", (F.coalesce("units", F.lit(0)) / UNITS).alias("weight"), "turnover")


def cash_violations(targets: DataFrame, cash: DataFrame, keys: list[str]) -> DataFrame:
    """Targets whose stated cash is not what their weights leave: (keys, cash, left)."""
    left = targets.groupBy(*keys).agg((1 - F.sum("weight")).alias("left"))
    return cash.join(left, keys, "left").withColumn("left", F.coalesce("left", F.lit(1.0))).filter(F.abs(F.col("cash") - F.col("left")) > 1e-9)


def target_violations(targets: DataFrame, keys: list[str], cap: float = CAP, gross: float = GROSS) -> DataFrame:
    """Targets that break a limit: (keys, check)."""
    sums = targets.groupBy(*keys).agg(F.sum("weight").alias("s"), F.max("weight").alias("hi"), F.min("weight").alias("lo"), F.count("code").alias("n"), F.countDistinct("code").alias("d"))
    checks = F.array_compact(F.array(F.when(F.col("lo") <= 0, F.lit("weight_not_positive")), F.when(F.col("hi") > cap + 1e-12, F.lit("over_cap")), F.when(F.col("s") > gross + 1e-12, F.lit("over_gross")), F.when(F.col("n") > F.col("d"), F.lit("repeated_code"))))
    return sums.select(*keys, F.explode(checks).alias("check"))
