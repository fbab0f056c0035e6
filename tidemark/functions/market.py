"""Scalar rules of the market as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Board rules by code prefix.
STAR_BOARD, GROWTH_BOARDS, BEIJING = "sh.688", ["sz.300", "sz.301"], "bj."
# Fee rates.
COMMISSION_RATE, MINIMUM_COMMISSION, TRANSFER_RATE, STAMP_RATE = 0.0003, 5, 0.00001, 0.0005


def lot_size(code: Column) -> Column:
    return F.when(code.startswith(STAR_BOARD), 200).otherwise(100)


def limit_ratio(code: Column) -> Column:
    """The share a price may move in a day, for instruments without special treatment."""
    wide = code.startswith(STAR_BOARD)
    for prefix in GROWTH_BOARDS:
        wide = wide | code.startswith(prefix)
    return F.when(wide, F.lit(0.20)).when(code.startswith(BEIJING), F.lit(0.30)).otherwise(F.lit(0.10)).cast("decimal(4,2)")


def limit_price(previous_close: Column, ratio: Column, upper: bool) -> Column:
    """The day's highest or lowest price, in cents, halves up."""
    factor = (1 + ratio if upper else 1 - ratio).cast("decimal(4,2)")
    return F.round(previous_close.cast("decimal(20,6)") * factor, 2)


def at_limit(price: Column, previous_close: Column, ratio: Column, upper: bool) -> Column:
    """A missing price counts as at the limit: it can't be traded."""
    bound = limit_price(previous_close, ratio, upper)
    return F.coalesce(price >= bound if upper else price <= bound, F.lit(True))


def fees(notional: Column, sell: Column | bool) -> Column:
    """Commission with its minimum, transfer fee, and stamp duty on sales; in cents, halves up."""
    amount = notional.cast("decimal(28,6)")
    commission = F.greatest(amount * F.lit(COMMISSION_RATE).cast("decimal(6,5)"), F.lit(MINIMUM_COMMISSION).cast("decimal(4,2)"))
    stamp = F.when(sell if isinstance(sell, Column) else F.lit(sell), amount * F.lit(STAMP_RATE).cast("decimal(6,5)")).otherwise(F.lit(0))
    return F.round(commission + amount * F.lit(TRANSFER_RATE).cast("decimal(6,5)") + stamp, 2).cast("decimal(20,2)")


def target_quantity(equity: Column, weight: Column, price: Column, lot: Column) -> Column:
    """Whole lots that a weight of the equity buys."""
    shares = F.floor(equity * weight / price).cast("long")
    return shares - shares % lot


def to_exchange_code(code: Column) -> Column:
    """sh.600000 -> 600000.XSHG, sz.000001 -> 000001.XSHE; null for other markets."""
    market = F.create_map(F.lit("sh"), F.lit("XSHG"), F.lit("sz"), F.lit("XSHE"))
    parts = F.split(code, r"\.")
    return F.concat(F.get(parts, F.lit(1)), F.lit("."), F.try_element_at(market, F.get(parts, F.lit(0))))


def from_exchange_code(code: Column) -> Column:
    market = F.create_map(F.lit("XSHG"), F.lit("sh"), F.lit("XSHE"), F.lit("sz"))
    parts = F.split(code, r"\.")
    return F.concat(F.try_element_at(market, F.get(parts, F.lit(1))), F.lit("."), F.get(parts, F.lit(0)))


def split_ratio(stock: Column, capitalization: Column) -> Column:
    return 1 + F.coalesce(stock, F.lit(0)) + F.coalesce(capitalization, F.lit(0))


def dividend_terms(announced: Column, recorded: Column, ex: Column, paid: Column, cash: Column) -> dict[str, Column]:
    """A cash dividend's dates, each with its fallback, and the cash of a share; the closure follows the record day."""
    record = F.coalesce(recorded, ex)
    return {"announced_on": F.coalesce(announced, record), "book_closed_on": record, "ex_on": F.coalesce(ex, record), "payable_on": F.coalesce(paid, ex, record), "cash_per_share": F.coalesce(cash, F.lit(0.0))}


def clamp(value: Column, bound: float = 2.0) -> Column:
    return F.least(F.greatest(value, F.lit(-bound)), F.lit(bound))


def local_wall_time(ts: Column, zone: str = "Asia/Shanghai") -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), "HH:mm:ss")


def available_at(day: Column, wall: str, zone: str = "Asia/Shanghai") -> Column:
    """The UTC moment at which a row of a local day can be seen first."""
    return F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", F.date_format(day, "yyyy-MM-dd"), F.lit(wall))), zone)


def valid_code(code: Column) -> Column:
    return F.coalesce(code.rlike(r"^(?:sh|sz)\.\d{6}$"), F.lit(False))


def token_estimate(text: Column) -> Column:
    """A quarter of the bytes, upwards."""
    return F.ceil(F.octet_length(text) / 4)


def token_cost(tokens_in: Column, tokens_out: Column, per_million_in: float, per_million_out: float) -> Column:
    return (tokens_in * per_million_in + tokens_out * per_million_out) / 1_000_000
