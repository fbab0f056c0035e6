"""Data quality and coverage as anti-joins, counts and key checks."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Key pairs of expected that actual lacks. Distinct, so hot keys meet the join once."""
    return expected.select(*keys).distinct().join(actual.select(*keys).distinct(), keys, "left_anti")


def calendar_gaps(calendar: DataFrame, start: date, end: date) -> DataFrame:
    """Days from start to end that the calendar does not know."""
    days = calendar.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("calendar_date"))
    return days.join(calendar.select("calendar_date"), "calendar_date", "left_anti")


def listing_split(pairs: DataFrame, instruments: DataFrame) -> DataFrame:
    """Member days with whether the instrument was listed: [ipo_date, out_date). Unknown instruments fall out."""
    joined = pairs.join(instruments.select("code", "ipo_date", "out_date"), "code")
    listed = (F.col("trade_date") >= F.col("ipo_date")) & (F.col("out_date").isNull() | (F.col("trade_date") < F.col("out_date")))
    return joined.select("trade_date", "code", F.coalesce(listed, F.lit(False)).alias("listed"))


def symmetric_difference(a: DataFrame, b: DataFrame, keys: list[str], names: tuple[str, str]) -> DataFrame:
    """Pairs of only one side, with its name."""
    return missing(a, b, keys).withColumn("only_in", F.lit(names[0])).unionByName(missing(b, a, keys).withColumn("only_in", F.lit(names[1])))


def status_mismatches(universe: DataFrame, signal: DataFrame, execution: DataFrame) -> DataFrame:
    """Days on which the three trade states disagree; a pair that one side lacks does not count."""
    named = [t.select("trade_date", "code", F.col("trade_status").alias(n)) for t, n in ((universe, "u"), (signal, "s"), (execution, "e"))]
    joined = named[0].join(named[1], ["trade_date", "code"]).join(named[2], ["trade_date", "code"])
    return joined.filter("u <> s OR u <> e").select("trade_date", "code", "u", "s", "e")


def member_counts(members: DataFrame, days: DataFrame, expected: DataFrame) -> DataFrame:
    """Distinct members of each index and day against the expected number.

    expected: index_code, valid_date (null: any day without a row of its own), expected.
    """
    counted = members.groupBy("snapshot_date", "index_code").agg(F.countDistinct("member_code").alias("members"))
    usual = expected.filter("valid_date IS NULL").select("index_code", F.col("expected").alias("usual"))
    special = expected.filter("valid_date IS NOT NULL").select("index_code", F.col("valid_date").alias("snapshot_date"), F.col("expected").alias("special"))
    wanted = days.crossJoin(usual).join(special, ["snapshot_date", "index_code"], "left")
    out = wanted.join(counted, ["snapshot_date", "index_code"], "left")
    return out.select("snapshot_date", "index_code", F.coalesce("members", F.lit(0)).alias("members"), F.coalesce("special", "usual").alias("expected")).withColumn("complete", F.col("members") == F.col("expected"))


def duplicate_member_pairs(members: DataFrame) -> DataFrame:
    """For each day, member rows beyond its distinct members (a member of two indexes counts)."""
    return members.groupBy("snapshot_date").agg((F.count("*") - F.countDistinct("member_code")).alias("duplicates"))


def late_rows(df: DataFrame, day: str, available: str = "available_at", after: str = "INTERVAL '07:05' HOUR TO MINUTE") -> Column:
    """Rows that could be seen only later than a time of their day (UTC)."""
    return F.count_if(F.col(available) > F.expr(f"cast({day} as timestamp) + {after}"))


def valid_ohlc(o: str = "open", h: str = "high", low: str = "low", c: str = "close") -> Column:
    """Positive and consistent prices. Nulls are invalid."""
    some = [F.col(x) for x in (o, h, low, c)]
    ok = (some[1] >= F.greatest(some[0], some[2], some[3])) & (some[2] <= F.least(some[0], some[1], some[3]))
    for x in some:
        ok = ok & x.isNotNull() & (x > 0)
    return F.coalesce(ok, F.lit(False))


def dataset_summary(df: DataFrame, name: str, keys: list[str], provenance: list[str]) -> DataFrame:
    """One row: data set, rows, repeated keys (rows beyond the first of a key), rows lacking provenance."""
    lacking = F.lit(False)
    for c in provenance:
        lacking = lacking | F.col(c).isNull()
    by_key = df.withColumn("_lacking", lacking).groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("_lacking").alias("l"))
    return by_key.agg(F.lit(name).alias("dataset"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_keys"), F.coalesce(F.sum("l"), F.lit(0)).alias("without_provenance"))


def quality_issues(bars: DataFrame, calendar: DataFrame, five_minute: DataFrame | None = None) -> DataFrame:
    """(issue, n, status): bars off the trading calendar (days it lacks count; an empty calendar raises none), invalid OHLC of daily and of five-minute bars.

    status is failed where there is an issue, else passed; the data are as good as their worst row here.
    """
    known = calendar.filter("is_trading_day").select(F.col("calendar_date").alias("trade_date"))
    marks = bars.join(known, "trade_date", "left_anti").select(F.lit("off").alias("mark")).unionByName(calendar.limit(1).select(F.lit("some").alias("mark")))
    off = marks.agg(F.lit("bar_on_non_trading_date").alias("issue"), F.when(F.count_if(F.col("mark") == "some") > 0, F.count_if(F.col("mark") == "off")).otherwise(0).alias("n"))
    found = off.unionByName(bars.agg(F.lit("invalid_ohlc").alias("issue"), F.count_if(~valid_ohlc()).alias("n")))
    if five_minute is not None:
        found = found.unionByName(five_minute.agg(F.lit("invalid_five_minute_ohlc").alias("issue"), F.count_if(~valid_ohlc()).alias("n")))
    return found.withColumn("status", F.when(F.col("n") > 0, "failed").otherwise("passed"))


def provenance_bounds(tables: list[DataFrame]) -> DataFrame:
    """Distinct payloads of several tables, a hash of their sorted list, first and last receipt.

    The list is hashed in two levels, so no task holds it whole: the sorted payloads of each of 4096
    ranges of hashes, then the digests of the ranges in their order.
    """
    slim = [t.select("source_payload_sha256", "source_received_at") for t in tables]
    every = slim[0]
    for t in slim[1:]:
        every = every.unionByName(t)
    once = every.groupBy("source_payload_sha256").agg(F.min("source_received_at").alias("a"), F.max("source_received_at").alias("b"))
    part = once.groupBy(F.substring(F.sha2("source_payload_sha256", 256), 1, 3).alias("part")).agg(
        F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("source_payload_sha256")), "\n"), 256).alias("digest"), F.min("a").alias("a"), F.max("b").alias("b")
    )
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "digest"))), lambda x: x["digest"]), "\n")
    return part.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("payloads"), F.sha2(ordered, 256).alias("payload_set_hash"), F.min("a").alias("first_received"), F.max("b").alias("last_received"))


def opening_coverage(expected: DataFrame, covered: DataFrame) -> DataFrame:
    """For each code, expected and covered pairs and their ratio (null where nothing was expected)."""
    pairs = expected.select("trade_date", "code").distinct().withColumn("e", F.lit(1)).join(covered.select("trade_date", "code").distinct().withColumn("c", F.lit(1)), ["trade_date", "code"], "left")
    by_code = pairs.groupBy("code").agg(F.count("*").alias("expected"), F.count("c").alias("covered"))
    return by_code.withColumn("ratio", F.when(F.col("expected") > 0, F.round(F.col("covered") / F.col("expected"), 8)))


def name_conflicts(members: DataFrame) -> DataFrame:
    """Member codes under more than one name."""
    return members.groupBy("member_code").agg(F.countDistinct("member_name").alias("names")).filter("names > 1")


def samples(issues: DataFrame, most: int = 100) -> DataFrame:
    """The first issues in the order of day and code."""
    return issues.orderBy("trade_date", "code").limit(most)


def coverage_report(counts: dict[str, DataFrame], issues: list[str], measured: str) -> DataFrame:
    """One row of counts, one column for each frame, by one aggregate; passed if ``measured`` is positive and every issue is zero."""
    every = None
    for name, frame in counts.items():
        one = frame.select(F.lit(name).alias("what"))
        every = one if every is None else every.unionByName(one)
    out = every.agg(*[F.count_if(F.col("what") == name).alias(name) for name in counts])
    ok = F.col(measured) > 0
    for name in issues:
        ok = ok & (F.col(name) == 0)
    return out.withColumn("status", F.when(ok, "passed").otherwise("failed"))


def snapshot_violations(bars: DataFrame) -> DataFrame:
    """Rows of a decision's bars that break its contract: (check, decision_date, code). Opening bars: ``coverage.checkpoint_violations``.

    bars: decision_date, as_of, code, trade_date, available_at, trade_status, signal_close, execution_close, previous_close.
    """
    priced = F.col("signal_close").isNotNull() & F.col("execution_close").isNotNull() & F.col("previous_close").isNotNull()
    positive = F.coalesce(F.least("signal_close", "execution_close", "previous_close") > 0, F.lit(True))
    checks = F.array_compact(F.array(
        F.when(F.col("trade_date") > F.col("decision_date"), F.lit("future_trade_date")),
        F.when(F.col("available_at") > F.col("as_of"), F.lit("unavailable_at_as_of")),
        F.when(F.col("trade_status") & ~priced, F.lit("tradable_without_price")),
        F.when(~positive, F.lit("price_not_positive")),
    ))
    return bars.select(F.explode(checks).alias("check"), "decision_date", "code")
