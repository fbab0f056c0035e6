"""Planning of data requests: generators, gaps, validation and identities."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import content_id

# The query keys of each operation (required, optional).
QUERY_KEYS = {
    "instruments": ([], ["code"]), "trade_calendar": (["start_date", "end_date"], []), "historical_universe": (["day"], []), "daily_bars": (["code", "start_date", "end_date", "frequency", "adjustflag"], []),
    "five_minute_bars": (["code", "start_date", "end_date", "frequency", "adjustflag"], []), "hs300_stocks": (["date"], []), "zz500_stocks": (["date"], []), "adjustment_factors": (["code", "start_date", "end_date"], []), "dividends": (["code", "year", "yearType"], []),
}
FLAGS = ["2", "3"]
DAYS_OF_FIVE_MINUTES = 31


def request_id(operation: Column, query: Column) -> Column:
    """The same for the same operation and query, whatever the order of its keys."""
    return content_id({"operation": operation, "query": F.to_json(F.array_sort(F.map_entries(query)))})


def member_requests(members: DataFrame, start: date, end: date, snapshot: date | None = None) -> DataFrame:
    """Daily bars of both tracks for every member of the latest snapshot, or of one named."""
    day = members.agg(F.max("snapshot_date").alias("day")) if snapshot is None else members.sparkSession.range(1).select(F.lit(snapshot).alias("day"))
    codes = members.join(F.broadcast(day), F.col("snapshot_date") == F.col("day")).select(F.col("member_code").alias("code")).distinct()  # day is one row
    return with_flags(codes, start, end)


def with_flags(codes: DataFrame, start: date, end: date) -> DataFrame:
    query = F.create_map(F.lit("code"), F.col("code"), F.lit("start_date"), F.lit(str(start)), F.lit("end_date"), F.lit(str(end)), F.lit("frequency"), F.lit("d"), F.lit("adjustflag"), F.col("flag"))
    return codes.withColumn("flag", F.explode(F.array(*[F.lit(x) for x in FLAGS]))).select(F.lit("daily_bars").alias("operation"), query.alias("query"), "code", "flag")


def history_requests(members: DataFrame, complete: DataFrame, start: date, end: date) -> DataFrame:
    """Daily bars for every code that ever was a member, provided every snapshot is complete (else nothing)."""
    broken = complete.filter("NOT complete").limit(1).select(F.lit(1).alias("broken"))
    codes = members.select(F.col("member_code").alias("code")).distinct().join(broken, F.lit(True), "left_anti")
    return with_flags(codes, start, end)


def daily_requests(calendar: DataFrame, benchmark: str, operations: list[str] = ["historical_universe", "hs300_stocks", "zz500_stocks"]) -> DataFrame:  # noqa: B006
    """Three operations for each trading day, and the benchmark's bars over all of them."""
    days = calendar.filter("is_trading_day").select("calendar_date")
    each = days.withColumn("operation", F.explode(F.array(*[F.lit(x) for x in operations])))
    key = F.when(F.col("operation") == "historical_universe", F.lit("day")).otherwise(F.lit("date"))
    daily = each.select("operation", F.create_map(key, F.col("calendar_date").cast("string")).alias("query"))
    span = days.agg(F.min("calendar_date").cast("string").alias("a"), F.max("calendar_date").cast("string").alias("b")).filter("a IS NOT NULL")
    one = span.select(F.lit("daily_bars").alias("operation"), F.create_map(F.lit("code"), F.lit(benchmark), F.lit("start_date"), F.col("a"), F.lit("end_date"), F.col("b"), F.lit("frequency"), F.lit("d"), F.lit("adjustflag"), F.lit("3")).alias("query"))
    return daily.unionByName(one)


def gap_plan(active: DataFrame, stored: DataFrame) -> DataFrame:
    """For each code and flag the range of days to fetch: (code, flag) with first and last missing day and their number.

    active: code, trade_date (days a code should have); stored: code, trade_date, adjustment_flag.
    """
    wanted = active.select("code", "trade_date").distinct().withColumn("adjustment_flag", F.explode(F.array(*[F.lit(x) for x in FLAGS])))
    gaps = wanted.join(stored.select("code", "trade_date", "adjustment_flag").distinct(), ["code", "trade_date", "adjustment_flag"], "left_anti")
    return gaps.groupBy("code", "adjustment_flag").agg(F.min("trade_date").alias("first"), F.max("trade_date").alias("last"), F.count("*").alias("days"))


def validate(lines: DataFrame) -> DataFrame:
    """Adds operation, query and errors to lines of JSON requests (column value)."""
    parsed = lines.withColumn("_keys", F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))).withColumn("_r", F.from_json("value", "operation string, query map<string,string>"))
    rows = parsed.withColumns({"operation": F.col("_r.operation"), "query": F.coalesce(F.col("_r.query"), F.create_map().cast("map<string,string>"))})
    of = lambda i: F.create_map(*[x for op, keys in QUERY_KEYS.items() for x in (F.lit(op), F.array(*[F.lit(k) for k in (keys[0] if i == 0 else keys[0] + keys[1])]).cast("array<string>"))])
    rows = rows.withColumns({"_need": F.try_element_at(of(0), F.col("operation")), "_may": F.try_element_at(of(1), F.col("operation"))})
    value = lambda k: F.try_element_at(F.col("query"), F.lit(k))
    day = lambda k: value(k).try_cast("date")
    bad_day = F.lit(False)
    for k in ("start_date", "end_date", "day", "date"):
        bad_day = bad_day | (value(k).isNotNull() & (day(k).isNull() | ~value(k).rlike(r"^\d{4}-\d{2}-\d{2}$")))
    c = lambda condition, name: F.when(F.coalesce(condition, F.lit(False)), F.lit(name))
    errors = F.array_compact(F.array(
        c(~F.array_sort(F.col("_keys")).eqNullSafe(F.array(F.lit("operation"), F.lit("query"))), "fields"), c(F.col("_need").isNull(), "unknown_operation"),
        c(F.size(F.array_except("_need", F.map_keys("query"))) > 0, "missing_key"), c(F.size(F.array_except(F.map_keys("query"), "_may")) > 0, "unknown_key"), c(bad_day, "date"),
        c(day("start_date") > day("end_date"), "range"), c(~value("code").rlike(r"^(?:sh|sz)\.\d{6}$"), "code"), c(~value("adjustflag").isin("1", "2", "3"), "adjustflag"), c(~value("year").rlike(r"^\d{4}$"), "year"),
        c((F.col("operation") == "five_minute_bars") & (value("frequency") != "5"), "frequency"), c((F.col("operation") == "daily_bars") & (value("frequency") != "d"), "frequency"),
        c((F.col("operation") == "five_minute_bars") & (F.datediff(day("end_date"), day("start_date")) >= DAYS_OF_FIVE_MINUTES), "too_long"),
    ))
    return rows.withColumn("errors", F.array_distinct(errors)).drop("_keys", "_r", "_need", "_may")
