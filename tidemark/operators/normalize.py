"""Raw string rows to typed rows, with a reason for every row that is refused.

Raw rows: path, row_index, operation, query (map), row (map), source, received_at, payload_sha256. A normaliser
adds the typed columns of its data set, available_at and ``errors``; ``split`` parts accepted from refused rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import content_id
from ..functions.market import available_at, valid_code
from ..schemas import AMOUNT, KEYS, PRICE, RATIO, SCHEMAS

# The index an operation lists, and the data set of each operation.
INDEX_OF = {"hs300_stocks": "sh.000300", "zz500_stocks": "sh.000905"}
DATASET_OF = {
    "instruments": "instruments", "trade_calendar": "trade_calendar", "historical_universe": "historical_universe", "daily_bars": "daily_bars", "daily_history_astock": "daily_bars",
    "adjustment_factors": "adjustment_factors", "daily_adjust_factors": "adjustment_factors", "five_minute_bars": "five_minute_bars", "hs300_stocks": "index_memberships", "zz500_stocks": "index_memberships", "dividends": "corporate_actions",
}


class _Fields:
    """Parses the fields of a raw row and collects what is wrong with them.

    Texts and parsed values are columns of two projections of their own, so that the many conditions
    that refer to them do not repeat their expressions.
    """

    def __init__(self) -> None:
        self.errors: list[Column] = []
        self.texts: dict[str, Column] = {}
        self.parsed: dict[str, Column] = {}

    def text(self, name: str, required: bool = True) -> Column:
        trimmed = F.trim(F.coalesce(F.try_element_at(F.col("row"), F.lit(name)), F.lit("")))
        self.texts[f"_t_{name}"] = trimmed
        value = F.col(f"_t_{name}")
        if required:
            self.fail(value == "", f"{name}: blank")
        self.parsed[f"_n_{name}"] = F.nullif(value, F.lit(""))
        return F.col(f"_n_{name}")

    def fail(self, condition: Column, reason: str) -> None:
        self.errors.append(F.when(F.coalesce(condition, F.lit(False)), F.lit(reason)))

    def cast(self, name: str, kind: str, required: bool = True) -> Column:
        raw = self.text(name, required)
        self.parsed[f"_c_{name}"] = F.col(f"_t_{name}").try_cast(kind)
        value = F.col(f"_c_{name}")
        self.fail(raw.isNotNull() & value.isNull(), f"{name}: not a {kind.split('(')[0]}")
        return value

    def decimal(self, name: str, kind: str, required: bool = False) -> Column:
        """Half-even to the type's digits; what does not fit is an error."""
        wide = self.cast(name, "decimal(38,12)", required)
        self.parsed[f"_d_{name}"] = F.bround(F.col(f"_t_{name}").try_cast("decimal(38,12)"), int(kind.rstrip(")").split(",")[1])).try_cast(kind)
        value = F.col(f"_d_{name}")
        self.fail(wide.isNotNull() & value.isNull(), f"{name}: out of range")
        return value

    def flag(self, name: str) -> Column:
        raw = self.text(name)
        self.fail(raw.isNotNull() & ~raw.isin("0", "1"), f"{name}: not 0 or 1")
        return raw == "1"

    def code(self, name: str = "code") -> Column:
        value = F.lower(self.text(name))
        self.fail(value.isNotNull() & ~valid_code(value), f"{name}: not an instrument code")
        asked = F.lower(F.try_element_at(F.col("query"), F.lit("code")))
        self.fail(value != asked, f"{name}: not the one asked for")
        return value

    def asked_date(self, day: Column) -> None:
        """The day must be the one of the query, or lie in its range."""
        of = lambda k: F.try_element_at(F.col("query"), F.lit(k)).try_cast("date")
        self.fail((day != of("day")) | (day < of("start_date")) | (day > of("end_date")), "date: not the one asked for")

    def adjustment_flag(self) -> Column:
        """The flag asked for; a forward-adjusted series may carry unadjusted rows at its start."""
        found, asked = self.text("adjustflag"), F.try_element_at(F.col("query"), F.lit("adjustflag"))
        self.fail(~found.isin("1", "2", "3") | ~asked.isin("1", "2", "3"), "adjustflag: unknown")
        self.fail((found != asked) & ~((asked == "2") & (found == "3")), "adjustflag: not the one asked for")
        return F.coalesce(asked, found)

    def ohlc(self, trading: Column) -> dict[str, Column]:
        prices = {k: self.decimal(k, PRICE) for k in ("open", "high", "low", "close")}
        o, h, lo, c = prices.values()
        there = o.isNotNull() & h.isNotNull() & lo.isNotNull() & c.isNotNull()
        self.fail(trading & (~there | (F.least(o, h, lo, c) <= 0)), "ohlc: a trading bar needs positive prices")
        self.fail(there & ((h < F.greatest(o, lo, c)) | (lo > F.least(o, h, c))), "ohlc: inconsistent")
        return prices

    def done(self, raw: DataFrame, columns: dict[str, Column], available: Column) -> DataFrame:
        typed = raw.withColumns(self.texts).withColumns(self.parsed).withColumns({**{f"_v_{k}": v for k, v in columns.items()}, "available_at": available, "errors": F.array_distinct(F.array_compact(F.array(*self.errors))), "_row": F.monotonically_increasing_id()})
        kept = [c for c in raw.columns if c not in columns]
        return typed.select(*kept, *[F.col(f"_v_{k}").alias(k) for k in columns], "available_at", "errors", "_row")


def instruments(raw: DataFrame) -> DataFrame:
    f = _Fields()
    columns = {"code": f.code(), "name": f.text("code_name"), "ipo_date": f.cast("ipoDate", "date"), "out_date": f.cast("outDate", "date", False), "security_type": f.text("type"), "status": f.text("status")}
    return f.done(raw, columns, F.col("received_at"))


def trade_calendar(raw: DataFrame) -> DataFrame:
    f = _Fields()
    day = f.cast("calendar_date", "date")
    f.asked_date(day)
    return f.done(raw, {"calendar_date": day, "is_trading_day": f.flag("is_trading_day")}, available_at(day, "00:00:00"))


def historical_universe(raw: DataFrame) -> DataFrame:
    f = _Fields()
    day = F.try_element_at(F.col("query"), F.lit("day")).try_cast("date")
    f.fail(day.isNull(), "day: not in the query")
    return f.done(raw, {"snapshot_date": day, "code": f.code(), "name": f.text("code_name"), "trade_status": f.flag("tradeStatus")}, available_at(day, "09:00:00"))


def index_memberships(raw: DataFrame) -> DataFrame:
    f = _Fields()
    day, updated = F.try_element_at(F.col("query"), F.lit("date")).try_cast("date"), f.cast("updateDate", "date")
    f.fail(day.isNull(), "date: not in the query")
    f.fail(updated > day, "updateDate: after the snapshot")
    index = F.try_element_at(F.create_map(*[F.lit(x) for pair in INDEX_OF.items() for x in pair]), F.col("operation"))
    return f.done(raw, {"snapshot_date": day, "index_code": index, "member_code": f.code(), "member_name": f.text("code_name")}, available_at(day, "09:00:00"))


def daily_bars(raw: DataFrame) -> DataFrame:
    f = _Fields()
    day = f.cast("date", "date")
    f.asked_date(day)
    trading = f.flag("tradestatus")
    given = f.cast("volume", "bigint", False)
    f.fail(trading & given.isNull(), "volume: blank on a trading day")
    volume = F.when(F.coalesce(~trading, F.lit(False)), F.coalesce(given, F.lit(0))).otherwise(given)
    amount = f.decimal("amount", AMOUNT)
    f.fail((volume < 0) | (amount < 0), "volume or amount: negative")
    columns = {
        "trade_date": day, "code": f.code(), "adjustment_flag": f.adjustment_flag(), **f.ohlc(trading), "previous_close": f.decimal("preclose", PRICE), "volume": volume, "amount": amount,
        "turnover": f.decimal("turn", RATIO), "trade_status": trading, "pct_change": f.decimal("pctChg", RATIO), "is_st": f.flag("isST"),
    }
    return f.done(raw, columns, available_at(day, "15:00:00"))


def adjustment_factors(raw: DataFrame) -> DataFrame:
    f = _Fields()
    day = f.cast("dividOperateDate", "date")
    f.asked_date(day)
    columns = {"code": f.code(), "effective_date": day, "forward_factor": f.decimal("foreAdjustFactor", RATIO, True), "backward_factor": f.decimal("backAdjustFactor", RATIO, True), "adjustment_factor": f.decimal("adjustFactor", RATIO, True)}
    return f.done(raw, columns, available_at(day, "09:25:00"))


def dividends(raw: DataFrame) -> DataFrame:
    f = _Fields()
    announced, ex = f.cast("dividPlanAnnounceDate", "date"), f.cast("dividOperateDate", "date")
    f.fail(announced > ex, "dividPlanAnnounceDate: after the ex date")
    code = f.code()
    zero = lambda name: F.coalesce(f.decimal(name, RATIO), F.lit(0).cast(RATIO))
    cash, stock, capital = zero("dividCashPsBeforeTax"), zero("dividStocksPs"), zero("dividReserveToStockPs")
    ident = content_id({"code": code, "announcement_date": announced, "ex_date": ex, "cash": cash, "stock": stock, "capitalization": capital})
    columns = {
        "action_id": ident, "code": code, "announcement_date": announced, "record_date": f.cast("dividRegistDate", "date", False), "ex_date": ex, "pay_date": f.cast("dividPayDate", "date", False),
        "cash_before_tax_per_share": cash, "stock_dividend_ratio": stock, "capitalization_ratio": capital,
    }
    return f.done(raw, columns, available_at(F.date_add(announced, 1), "00:00:00"))


def five_minute_bars(raw: DataFrame) -> DataFrame:
    f = _Fields()
    day, compact = f.cast("date", "date"), f.text("time")
    local = F.try_to_timestamp(F.substring(compact, 1, 14), F.lit("yyyyMMddHHmmss"))
    f.fail(compact.isNotNull() & local.isNull(), "time: not a time")
    f.fail(F.to_date(local) != day, "time: on another day")
    f.asked_date(day)
    stamp = F.to_utc_timestamp(local, "Asia/Shanghai")
    volume, amount = f.cast("volume", "bigint"), f.decimal("amount", AMOUNT, True)
    f.fail((volume < 0) | (amount < 0), "volume or amount: negative")
    return f.done(raw, {"timestamp": stamp, "code": f.code(), "adjustment_flag": f.adjustment_flag(), "trade_date": day, **f.ohlc(F.lit(True)), "volume": volume, "amount": amount}, stamp)


NORMALIZERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "instruments": instruments, "trade_calendar": trade_calendar, "historical_universe": historical_universe, "index_memberships": index_memberships, "daily_bars": daily_bars,
    "adjustment_factors": adjustment_factors, "corporate_actions": dividends, "five_minute_bars": five_minute_bars,
}


def normalize(raw: DataFrame, dataset: str) -> DataFrame:
    """The rows of one data set's operations, typed and with provenance."""
    operations = [op for op, d in DATASET_OF.items() if d == dataset]
    typed = NORMALIZERS[dataset](raw.filter(F.col("operation").isin(operations)))
    return typed.withColumns({"source_received_at": F.col("received_at"), "source_payload_sha256": F.col("payload_sha256"), "raw_artifact": F.col("path")})


def unknown_operations(raw: DataFrame) -> DataFrame:
    return raw.filter(~F.col("operation").isin(list(DATASET_OF))).select("path", "row_index", "operation", F.array(F.lit("unsupported operation")).alias("errors"))


def split(normalized: DataFrame, dataset: str) -> tuple[DataFrame, DataFrame]:
    """(accepted rows with the data set's schema, refused rows with their reasons)."""
    names = SCHEMAS[dataset].names
    # reading _row keeps the filter above the parsing: pushed down, its conditions would repeat all of that
    parsed = F.col("_row") >= 0
    good = normalized.filter(parsed & (F.size("errors") == 0)).select(*[F.col(n).cast(SCHEMAS[dataset][n].dataType).alias(n) for n in names])
    return good, normalized.filter(parsed & (F.size("errors") > 0)).select("path", "row_index", "operation", "source_payload_sha256", "errors")


def keys_of(dataset: str) -> list[str]:
    return KEYS[dataset]
