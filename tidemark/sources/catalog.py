"""Reading the data sets: strict schemas, as-of visibility, pushed-down filters, key checks."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import KEYS, SCHEMAS


class ContractError(ValueError):
    """Data that break a contract: wrong schema, repeated keys, rows from the future."""


def load(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    """A data set as stored, with its declared schema. A file with other columns is an error."""
    stored = spark.read.parquet(f"{root}/{dataset}").schema
    wanted = [(f.name, f.dataType) for f in SCHEMAS[dataset]]
    if [(f.name, f.dataType) for f in stored if f.name != "dataset"] != wanted:
        raise ContractError(f"{dataset}: stored schema {stored.simpleString()} is not the declared one")
    return spark.read.schema(SCHEMAS[dataset]).parquet(f"{root}/{dataset}")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys found more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def require_empty(violations: DataFrame, what: str) -> None:
    """Raises if there is a violation; looks at one row only."""
    if found := violations.limit(1).collect():
        raise ContractError(f"{what}: {found[0].asDict()}")


def condition(equal: dict[str, Any] | None = None, contained_in: dict[str, Iterable[Any]] | None = None, ranges: dict[str, tuple[Any, Any]] | None = None) -> Column:
    """One predicate on raw columns. An empty set holds nothing; a range includes its ends, None leaves it open."""
    out = F.lit(True)
    for name, value in (equal or {}).items():
        out = out & (F.col(name) == F.lit(value))
    for name, values in (contained_in or {}).items():
        values = list(values)
        out = out & (F.col(name).isin(values) if values else F.lit(False))
    for name, (low, high) in (ranges or {}).items():
        if low is not None:
            out = out & (F.col(name) >= F.lit(low))
        if high is not None:
            out = out & (F.col(name) <= F.lit(high))
    return out


def scan(df: DataFrame, *, as_of: datetime | None = None, columns: Iterable[str] | None = None, available: str = "available_at", **filters) -> DataFrame:
    """What could be seen at ``as_of``, filtered and projected. Unknown columns are an error of the plan.

    Without as_of everything is seen. Keys are checked by duplicate_keys on the result.
    """
    seen = df if as_of is None else df.filter(F.col(available) <= F.lit(as_of))
    kept = seen.filter(condition(**filters))
    return kept if columns is None else kept.select(*columns)


def read(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    """The whole data set; repeated business keys are an error."""
    df = load(spark, root, dataset)
    require_empty(duplicate_keys(df, KEYS[dataset]), f"{dataset}: repeated key")
    return df


def bar_series(bars: DataFrame, codes: Iterable[str], start: date, end: date, as_of: datetime, flags: Iterable[str] = ("3",), zone: str = "Asia/Shanghai") -> DataFrame:
    """Bars of the codes and flags from start to end as seen at as_of, series lying together in date order."""
    local = as_of.astimezone(__import__("zoneinfo").ZoneInfo(zone)).date() if as_of.tzinfo else as_of.date()
    if end > local:
        raise ContractError(f"{end} lies after the as-of date {local}")
    seen = scan(bars, as_of=as_of, contained_in={"code": codes, "adjustment_flag": flags}, ranges={"trade_date": (start, end)})
    return seen.repartition("code", "adjustment_flag").sortWithinPartitions("code", "adjustment_flag", "trade_date")


def daily_bars(bars: DataFrame, codes: Iterable[str], start: date, end: date, as_of: datetime, flag: str = "3") -> DataFrame:
    """Daily bars of one adjustment, as seen at as_of."""
    return bar_series(bars, codes, start, end, as_of, [flag])


def five_minute_bars(bars: DataFrame, codes: Iterable[str], start: date, end: date, as_of: datetime, flag: str = "3") -> DataFrame:
    """Five-minute bars of one adjustment, each series in the order of time."""
    seen = bar_series(bars, codes, start, end, as_of, [flag])
    return seen.sortWithinPartitions("code", "adjustment_flag", "timestamp")


def rows_as_of(df: DataFrame, as_of: datetime) -> DataFrame:
    """Everything a data set held that could be seen at as_of."""
    return scan(df, as_of=as_of)
