"""Decision states, hard risk, and order plans, for all decision dates at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.market import at_limit, fees, limit_price, limit_ratio, lot_size, target_quantity
from .features import by_code

NO_RANK = 10_000


def decision_states(bars: DataFrame, opening: DataFrame | None = None) -> DataFrame:
    """For each code and day: the price to decide on, and the close before it.

    The day's bar counts; on days with only an opening bar its price does, with the latest earlier signal close.
    """
    earlier = F.last("signal_close", ignorenulls=True).over(by_code().rowsBetween(W.unboundedPreceding, -1))
    before = F.last("execution_close", ignorenulls=True).over(by_code().rowsBetween(W.unboundedPreceding, -1))
    states = bars
    if opening is not None:
        states = bars.join(opening.select("code", "trade_date", F.col("close_price").alias("_o")), ["code", "trade_date"], "full_outer").withColumn("execution_close", F.coalesce("execution_close", "_o")).drop("_o")
    return states.withColumns({"previous_close": before, "signal_close": F.coalesce("signal_close", earlier)})


def latest_price(bars: DataFrame, at: DataFrame) -> DataFrame:
    """For each (code, as_of) the last priced bar's close, and its day. One aggregate; bars meet only their own code's dates."""
    priced = bars.filter("execution_close IS NOT NULL").select("code", "trade_date", "execution_close")
    # as-of by a union and a running last value: no pairs are made
    marks = at.select("code", F.col("as_of").alias("trade_date"), F.lit(None).cast("double").alias("execution_close"), F.lit(1).alias("probe"))
    both = priced.withColumn("probe", F.lit(0)).unionByName(marks)
    run = W.partitionBy("code").orderBy("trade_date", "probe").rowsBetween(W.unboundedPreceding, 0)
    filled = both.withColumn("last", F.last(F.when(F.col("probe") == 0, F.struct("execution_close", "trade_date")), ignorenulls=True).over(run))
    return filled.filter("probe = 1").select("code", F.col("trade_date").alias("as_of"), F.col("last.execution_close").alias("price"), F.col("last.trade_date").alias("priced_on")).distinct()


def market_lookup(requests: DataFrame, bars: DataFrame) -> DataFrame:
    """Bars asked for by (code, trade_date); a missing row counts as suspended and not ST."""
    found = requests.join(bars, ["code", "trade_date"], "left")
    return found.withColumn("suspended", F.coalesce(~F.col("trade_status"), F.lit(True))).withColumn("is_st", F.coalesce("is_st", F.lit(False)))


def opening_auction(requests: DataFrame, bars: DataFrame) -> DataFrame:
    """What is known of a day's opening auction: the open as last price, the day's limits, nothing traded yet.

    requests: code, trade_date; bars: code, trade_date, open, previous_close. A request without a bar has no row.
    """
    limit = lambda upper: limit_price(F.col("previous_close"), limit_ratio(F.col("code")), upper)
    known = requests.select("code", "trade_date").join(bars.select("code", "trade_date", "open", "previous_close"), ["code", "trade_date"])
    nothing = F.lit(0.0)
    return known.select("code", "trade_date", "open", F.col("open").alias("last"), limit(True).alias("limit_up"), limit(False).alias("limit_down"), nothing.alias("volume"), nothing.alias("total_turnover"))


def equity(positions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, equity: cash and priced quantities. positions: keys, cash, quantity, price."""
    return positions.groupBy(*keys).agg((F.max("cash") + F.sum(F.col("quantity") * F.col("price"))).alias("equity"))


def current_weights(positions: DataFrame, equities: DataFrame, keys: list[str]) -> DataFrame:
    """Each position's share of its portfolio's equity; null without a price, an error row if equity is not positive."""
    rows = positions.join(equities, keys)
    return rows.withColumns({"weight": F.when(F.col("equity") > 0, F.col("quantity") * F.col("price") / F.col("equity")), "no_equity": F.col("equity") <= 0})


def available_range(bars: DataFrame) -> DataFrame:
    """For each code its first and last bar and their number."""
    return bars.groupBy("code").agg(F.min("trade_date").alias("first_bar"), F.max("trade_date").alias("last_bar"), F.count("*").alias("bars"))


def tradable_instruments(instruments: DataFrame, ids: list[str] | None = None, types: list[str] | None = None, last: str = "2099-12-31") -> DataFrame:
    """Shares (security_type 1), by id or type where asked; an open end of listing is ``last``."""
    rows = instruments.filter("security_type = '1'")
    if ids is not None:
        rows = rows.filter(F.col("code").isin(ids))
    if types is not None:
        rows = rows.filter(F.col("kind").isin(types))
    return rows.withColumn("de_listed_date", F.coalesce("out_date", F.to_date(F.lit(last))))


def hard_risk(targets: DataFrame, positions: DataFrame, states: DataFrame, equities: DataFrame) -> DataFrame:
    """Per (trade_date, code): requested and approved weight and why a change was refused.

    A blocked change keeps the current weight. targets: trade_date, code, weight, rank; positions:
    trade_date, code, quantity, sellable; equities: trade_date, equity.
    """
    keys = ["trade_date", "code"]
    both = targets.select(*keys, "weight", "rank").join(positions.select(*keys, "quantity", "sellable"), keys, "full_outer").join(equities, "trade_date")
    both = both.join(states.select(*keys, "execution_close", "previous_close", "trade_status", "volume", "is_st"), keys, "left")
    current = F.coalesce(F.coalesce("quantity", F.lit(0)) * F.col("execution_close") / F.col("equity"), F.lit(0.0))
    ratio = F.when(F.col("is_st"), F.lit(0.05).cast("decimal(4,2)")).otherwise(limit_ratio(F.col("code")))
    suspended = ~F.coalesce(F.col("trade_status") & (F.col("volume") > 0), F.lit(False))
    buy = F.when(suspended, "suspended").when(F.col("is_st"), "st_buy_blocked").when(at_limit(F.col("execution_close"), F.col("previous_close"), ratio, True), "limit_up")
    sell = F.when(suspended, "suspended").when(at_limit(F.col("execution_close"), F.col("previous_close"), ratio, False), "limit_down").when((F.col("quantity") > 0) & (F.col("sellable") == 0), "t_plus_one")
    out = both.withColumns({"requested_weight": F.coalesce("weight", F.lit(0.0)), "current_weight": current, "rank": F.coalesce("rank", F.lit(NO_RANK))})
    out = out.withColumn("reason", F.when(F.col("requested_weight") > F.col("current_weight"), buy).when(F.col("requested_weight") < F.col("current_weight"), sell))
    return out.withColumn("approved_weight", F.when(F.col("reason").isNull(), F.col("requested_weight")).otherwise(F.col("current_weight")))


def planned_sells(risk: DataFrame) -> DataFrame:
    """Sell orders: whole lots unless the position is closed, no more than is sellable, not at the lower limit."""
    ratio = limit_ratio(F.col("code"))
    made = risk.filter("reason IS NULL AND trade_status AND execution_close IS NOT NULL").withColumn("lot", lot_size(F.col("code")))
    made = made.withColumn("desired", target_quantity(F.col("equity"), F.col("approved_weight"), F.col("execution_close"), F.col("lot")))
    delta = F.coalesce("quantity", F.lit(0)) - F.col("desired")
    asked = F.least(delta, F.coalesce("sellable", F.lit(0)))
    quantity = F.when(F.col("desired") == 0, asked).otherwise(asked - asked % F.col("lot"))
    rows = made.withColumn("order_quantity", quantity).filter((F.col("order_quantity") > 0) & ~at_limit(F.col("execution_close"), F.col("previous_close"), ratio, False))
    notional = F.col("order_quantity") * F.col("execution_close").cast("decimal(20,6)")
    return rows.select("trade_date", "code", F.lit("sell").alias("side"), F.col("order_quantity").cast("long").alias("quantity"), F.col("execution_close").alias("price"), fees(notional, True).alias("fees"))


def cash_after_sells(sells: DataFrame, cash: DataFrame) -> DataFrame:
    """Running cash of each day over its sells in the order of codes; negative is a violation."""
    order = W.partitionBy("trade_date").orderBy("code").rowsBetween(W.unboundedPreceding, 0)
    gain = F.col("quantity") * F.col("price").cast("decimal(20,6)") - F.col("fees")
    return sells.join(cash, "trade_date").withColumn("cash_after", F.col("cash") + F.sum(gain).over(order))


def planned_buys(risk: DataFrame, cash: DataFrame, most: int = 8) -> DataFrame:
    """Buy orders of each day by (rank, code), each as many lots as the cash left then can pay with fees.

    The carry of cash from order to order is a fold over at most a few orders a day, in one expression.
    Fees are bounded, so from the lots the cash alone would buy only a few steps down are tried.
    """
    ratio = limit_ratio(F.col("code"))
    made = risk.filter("reason IS NULL AND trade_status AND execution_close IS NOT NULL").withColumn("lot", lot_size(F.col("code")))
    desired = target_quantity(F.col("equity"), F.col("approved_weight"), F.col("execution_close"), F.col("lot"))
    delta = desired - F.coalesce("quantity", F.lit(0))
    asked = made.withColumn("asked", (delta - delta % F.col("lot")).cast("long")).filter((F.col("asked") > 0) & ~at_limit(F.col("execution_close"), F.col("previous_close"), ratio, True))
    order = F.struct("rank", "code", "asked", "lot", F.col("execution_close").cast("decimal(12,2)").alias("price"))
    # ranked first: of a day's orders no more than ``most`` are ever held together
    first = asked.withColumn("_n", F.row_number().over(W.partitionBy("trade_date").orderBy("rank", "code"))).filter(F.col("_n") <= most)
    days = first.groupBy("trade_date").agg(F.sort_array(F.collect_list(order)).alias("orders")).join(cash, "trade_date")
    kind = "struct<cash:decimal(24,2),out:array<struct<code:string,quantity:bigint,price:decimal(12,2),fees:decimal(20,2)>>>"

    def step(state, o):
        fit = F.least(o["asked"], F.floor(state["cash"] / (o["price"] * o["lot"])).cast("long") * o["lot"])
        cost = lambda q: q * o["price"] + fees(q * o["price"], False)
        tries = F.filter(F.transform(F.sequence(F.lit(0), F.lit(3) + F.ceil(F.lit(10) / (o["price"] * o["lot"])).cast("int")), lambda i: fit - i * o["lot"]), lambda q: (q > 0) & (cost(q) <= state["cash"]))
        quantity = F.coalesce(F.get(tries, F.lit(0)), F.lit(0)).cast("long")
        bought = F.struct(o["code"].alias("code"), quantity.alias("quantity"), o["price"].alias("price"), fees(quantity * o["price"], False).alias("fees"))
        paid = F.when(quantity > 0, cost(quantity)).otherwise(F.lit(0))
        return F.struct((state["cash"] - paid).alias("cash"), F.when(quantity > 0, F.concat(state["out"], F.array(bought))).otherwise(state["out"]).alias("out")).cast(kind)

    start = F.struct(F.col("cash").alias("cash"), F.expr("cast(array() as array<struct<code:string,quantity:bigint,price:decimal(12,2),fees:decimal(20,2)>>)").alias("out")).cast(kind)
    done = days.withColumn("r", F.aggregate("orders", start, step))
    return done.select("trade_date", F.posexplode("r.out").alias("place", "o"), F.col("r.cash").alias("cash_after")).select("trade_date", "place", F.lit("buy").alias("side"), "o.code", "o.quantity", "o.price", "o.fees", "cash_after")


def stale_states(states: DataFrame, as_of: str = "as_of", days: int = 4) -> DataFrame:
    """States older than a number of days at their decision."""
    return states.filter(F.col(as_of) - F.col("available_at") > F.make_dt_interval(F.lit(days)))


def pair_tracks(signal: DataFrame, execution: DataFrame) -> DataFrame:
    """The two price tracks side by side, and whether they agree: ``pairing`` is paired, only_signal, only_execution, volume, status or st."""
    keys = ["code", "trade_date"]
    side = lambda t, p: t.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in ("close", "volume", "trade_status", "is_st")], F.lit(True).alias(f"{p}_there"))
    both = side(signal, "s").join(side(execution, "e"), keys, "full_outer")
    pairing = (
        F.when(F.col("s_there").isNull(), "only_execution").when(F.col("e_there").isNull(), "only_signal").when(F.col("s_volume") != F.col("e_volume"), "volume")
        .when(F.col("s_trade_status") != F.col("e_trade_status"), "status").when(F.col("s_is_st") != F.col("e_is_st"), "st").otherwise("paired")
    )
    return both.select(*keys, F.col("s_close").alias("signal_close"), F.col("e_close").alias("execution_close"), F.col("s_volume").alias("volume"), F.col("s_trade_status").alias("trade_status"), F.col("s_is_st").alias("is_st"), pairing.alias("pairing"))


def pair_available_at(signal: DataFrame, execution: DataFrame) -> DataFrame:
    """When a paired bar could be seen: the later of its two rows."""
    keys = ["code", "trade_date"]
    return signal.select(*keys, F.col("available_at").alias("_s")).join(execution.select(*keys, F.col("available_at").alias("_e")), keys).select(*keys, F.greatest("_s", "_e").alias("available_at"))
