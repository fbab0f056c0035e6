"""Point-in-time coverage and snapshot assembly: what a span of decision days needs, and what of it is missing.

Findings are rows (issue, trade_date, code, n), so that counts are one aggregate and samples a sort by issue.
Tables are expected as seen at one moment (``catalog.scan``) and cut to the span.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import EXECUTION, SIGNAL
from . import quality

#: What fails a report, in the order it is reported.
ISSUES = [
    "missing_calendar_dates", "incomplete_membership_snapshots", "duplicate_member_pairs", "missing_instruments", "missing_universe_dates", "missing_universe_members",
    "missing_signal_prices", "missing_execution_prices", "price_track_date_mismatches", "missing_benchmark_dates", "late_row_groups", "trade_status_mismatches",
]
MEASURES = ["trading_days", "unique_member_codes", "raw_member_code_days", "excluded_out_of_listing_member_days", "expected_member_code_days", "covered_benchmark_days"]
PAIR = ["trade_date", "code"]


def _finding(issue: str, rows: DataFrame, day: str | None = None, code: str | None = None, n: str | None = None) -> DataFrame:
    value = lambda c, kind: F.lit(None).cast(kind) if c is None else F.col(c).cast(kind)
    return rows.select(F.lit(issue).alias("issue"), value(day, "date").alias("trade_date"), value(code, "string").alias("code"), (F.lit(1) if n is None else F.col(n)).cast("long").alias("n"))


def findings(calendar: DataFrame, members: DataFrame, instruments: DataFrame, universe: DataFrame, daily: DataFrame, benchmark: DataFrame, *, start: date, end: date, expected: DataFrame) -> DataFrame:
    """Every issue and measure of the span. Member pairs count as often as indexes name them.

    A member outside its listing window is not expected; one without an instrument is an issue of its
    own. Rows that could only be seen after 07:05 UTC of their day make their table a late group.
    """
    trading = calendar.filter("is_trading_day").select(F.col("calendar_date").alias("trade_date")).distinct()
    pairs = members.select(F.col("snapshot_date").alias("trade_date"), F.col("member_code").alias("code"))
    listed = quality.listing_split(pairs, instruments)
    wanted = listed.filter("listed").select(*PAIR)
    of_universe = universe.select(F.col("snapshot_date").alias("trade_date"), "code", "trade_status")
    signal, execution = (daily.filter(F.col("adjustment_flag") == flag) for flag in (SIGNAL, EXECUTION))
    lacking = lambda rows, table: rows.join(table.select(*PAIR).distinct(), PAIR, "left_anti")
    priced = benchmark.filter("close IS NOT NULL AND previous_close IS NOT NULL AND pct_change IS NOT NULL").select("trade_date").distinct()
    codes = pairs.select("code").distinct()
    late = None
    for name, table, day in (("index_memberships", members, "snapshot_date"), ("historical_universe", universe, "snapshot_date"), ("daily_bars", daily, "trade_date"), ("benchmark", benchmark, "trade_date")):
        one = table.agg(quality.late_rows(table, day).alias("late")).filter("late > 0").select(F.lit(name).alias("code"))
        late = one if late is None else late.unionByName(one)
    statuses = quality.status_mismatches(of_universe.join(wanted, PAIR), signal, execution)
    incomplete = quality.member_counts(members, trading.withColumnRenamed("trade_date", "snapshot_date"), expected).filter("NOT complete")
    rows = [
        _finding("missing_calendar_dates", quality.calendar_gaps(calendar, start, end), "calendar_date"),
        _finding("incomplete_membership_snapshots", incomplete, "snapshot_date", "index_code"),
        _finding("duplicate_member_pairs", quality.duplicate_member_pairs(members).filter("duplicates > 0"), "snapshot_date", None, "duplicates"),
        _finding("missing_instruments", codes.join(instruments.select("code"), "code", "left_anti"), None, "code"),
        _finding("missing_universe_dates", trading.join(of_universe.select("trade_date").distinct(), "trade_date", "left_anti"), "trade_date"),
        _finding("missing_universe_members", lacking(wanted, of_universe), *PAIR),
        _finding("missing_signal_prices", lacking(wanted, signal), *PAIR),
        _finding("missing_execution_prices", lacking(wanted, execution), *PAIR),
        _finding("price_track_date_mismatches", quality.symmetric_difference(signal, execution, PAIR, ("signal", "execution")), *PAIR),
        _finding("missing_benchmark_dates", trading.join(priced, "trade_date", "left_anti"), "trade_date"),
        _finding("late_row_groups", late, None, "code"),
        _finding("trade_status_mismatches", statuses, *PAIR),
        _finding("trading_days", trading, "trade_date"),
        _finding("unique_member_codes", codes, None, "code"),
        _finding("raw_member_code_days", pairs, *PAIR),
        _finding("excluded_out_of_listing_member_days", listed.filter("NOT listed"), *PAIR),
        _finding("expected_member_code_days", wanted, *PAIR),
        _finding("covered_benchmark_days", priced.join(trading, "trade_date"), "trade_date"),
    ]
    out = rows[0]
    for one in rows[1:]:
        out = out.unionByName(one)
    return out


def report(found: DataFrame) -> DataFrame:
    """One row: every count, what is covered, and status; passed with a trading day and without an issue."""
    count = lambda name: F.coalesce(F.sum(F.when(F.col("issue") == name, F.col("n"))), F.lit(0)).alias(name)
    one = found.agg(*map(count, MEASURES + ISSUES))
    for name, lost in (("universe_member", "missing_universe_members"), ("signal_price", "missing_signal_prices"), ("execution_price", "missing_execution_prices")):
        one = one.withColumn(f"covered_{name}_days", F.col("expected_member_code_days") - F.col(lost))
    ok = F.col("trading_days") > 0
    for name in ISSUES:
        ok = ok & (F.col(name) == 0)
    return one.withColumn("status", F.when(ok, "passed").otherwise("failed"))


def samples(found: DataFrame, most: int = 100, issues: list[str] | None = None) -> DataFrame:
    """The first findings of each issue by day and code, at most ``most`` of each."""
    out = None
    for name in issues or ISSUES:  # a bounded top list each: no issue's rows gather in one task
        one = found.filter(F.col("issue") == name).orderBy("trade_date", "code").limit(most)
        out = one if out is None else out.unionByName(one)
    return out


#: Codes that one row may hold: a market's instruments, many times over.
MOST_CODES = 1_000_000


def _one_row(codes: DataFrame) -> DataFrame:
    """All codes as one array, to be exploded where the days are; more than MOST_CODES are an error."""
    one = codes.agg(F.sort_array(F.collect_set("code")).alias("codes"))
    return F.broadcast(one.filter(F.assert_true(F.size("codes") <= MOST_CODES, F.lit(f"more than {MOST_CODES} codes")).isNull()))


def opening_pairs(calendar: DataFrame, universe: DataFrame, codes: DataFrame) -> DataFrame:
    """The (trade_date, code) pairs that need an opening bar: tradable members of the universe, and all codes on trading days without one."""
    trading = calendar.filter("is_trading_day").select(F.col("calendar_date").alias("trade_date"))
    known = universe.select(F.col("snapshot_date").alias("trade_date"), "code", "trade_status").join(codes, "code", "left_semi")
    without = trading.join(known.select("trade_date").distinct(), "trade_date", "left_anti")
    # every code on such a day is what is expected there: the grid is the result itself
    filled = without.crossJoin(_one_row(codes)).select("trade_date", F.explode("codes").alias("code"))
    return known.filter("trade_status").join(trading, "trade_date", "left_semi").select(*PAIR).unionByName(filled)


def opening_bars(five_minute: DataFrame, at: str = "09:35:00", zone: str = "Asia/Shanghai") -> DataFrame:
    """Pairs with an unadjusted bar that ends at the opening checkpoint, local time."""
    local = F.date_format(F.from_utc_timestamp("timestamp", zone), "HH:mm:ss")
    return five_minute.filter((local == at) & (F.col("adjustment_flag") == EXECUTION)).select(*PAIR).distinct()


def previous_trading_days(calendar: DataFrame) -> DataFrame:
    """(calendar_date, previous): for each trading day the one before it. One row a day, however many codes."""
    days = calendar.filter("is_trading_day").select("calendar_date")
    return days.withColumn("previous", F.lag("calendar_date").over(W.orderBy("calendar_date")))


def opening_states(opening: DataFrame, universe: DataFrame, execution: DataFrame, calendar: DataFrame) -> DataFrame:
    """Opening bars with the universe's state of the day and the execution close of the trading day before.

    is_st: the name contains ST. A bar without state or previous close keeps nulls there.
    """
    state = universe.select(F.col("snapshot_date").alias("trade_date"), "code", "trade_status", F.col("name").contains("ST").alias("is_st"))
    before = previous_trading_days(calendar).withColumnRenamed("calendar_date", "trade_date")
    close = execution.select("code", F.col("trade_date").alias("previous"), F.col("close").alias("previous_close"))
    return opening.join(before, "trade_date", "left").join(state, PAIR, "left").join(close, ["code", "previous"], "left")


def candidates(members: DataFrame, positions: DataFrame) -> DataFrame:
    """Members of each day, and codes held without being a member any more, for valuation only (is_candidate false)."""
    both = members.select(*PAIR, F.lit(True).alias("c")).unionByName(positions.select(*PAIR, F.lit(False).alias("c")))
    return both.groupBy(*PAIR).agg(F.bool_or("c").alias("is_candidate"))


def benchmark_returns(days: DataFrame, benchmark: DataFrame) -> DataFrame:
    """For each day the benchmark's change as a ratio; ``missing`` marks days without one."""
    change = benchmark.select("trade_date", (F.col("pct_change") / 100).alias("benchmark_return"))
    return days.join(change, "trade_date", "left").withColumn("missing", F.col("benchmark_return").isNull())


def assemble(decisions: DataFrame, calendar: DataFrame, universe: DataFrame, paired: DataFrame, *, opening: bool = False) -> DataFrame:
    """One row for each decision (decision_date, code): the bar it may look at and the ``checks`` it fails.

    At the close that is the day's bar, at the opening the one of the trading day before (``through``).
    paired comes from ``trading.pair_tracks``. A bar is expected of a member that trades that day.
    """
    days = calendar.select(F.col("calendar_date").alias("decision_date"), "is_trading_day").join(previous_trading_days(calendar).withColumnRenamed("calendar_date", "decision_date"), "decision_date", "left")
    state = universe.select(F.col("snapshot_date").alias("decision_date"), "code", F.col("trade_status").alias("member_trades"))
    bars = paired.select(F.col("trade_date").alias("through"), "code", "signal_close", "execution_close", "pairing")
    rows = decisions.join(days, "decision_date", "left").withColumn("through", F.col("previous") if opening else F.col("decision_date"))
    rows = rows.join(state, ["decision_date", "code"], "left").join(bars, ["through", "code"], "left")
    checks = F.array_compact(F.array(
        F.when(F.col("is_trading_day").isNull(), F.lit("calendar_missing")), F.when(~F.col("is_trading_day"), F.lit("not_a_trading_day")),
        F.when(F.col("through").isNull() & F.col("is_trading_day"), F.lit("no_day_before")), F.when(F.col("member_trades").isNull(), F.lit("not_in_universe")),
        F.when(F.col("member_trades") & F.col("pairing").isNull(), F.lit("bar_missing")), F.when(F.col("pairing") != "paired", F.concat(F.lit("tracks_"), F.col("pairing"))),
    ))
    return rows.select("decision_date", "code", "through", "signal_close", "execution_close", checks.alias("checks"))


def _prefix_counts(events: DataFrame, questions: DataFrame, by: list[str]) -> DataFrame:
    """(by, day, upto): the sum of n over the events (by, day, n) up to each day asked for (by, day). One sorted pass, no pairs."""
    both = events.select(*by, "day", "n", F.lit(0).alias("asks")).unionByName(questions.select(*by, "day", F.lit(0).cast("long").alias("n"), F.lit(1).alias("asks")).distinct())
    upto = F.sum("n").over(W.partitionBy(*by).orderBy("day", "asks").rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn("upto", upto).filter("asks = 1").select(*by, "day", "upto")


def history_gaps(decisions: DataFrame, calendar: DataFrame, universe: DataFrame, paired: DataFrame) -> DataFrame:
    """``decisions`` with missing_dates, missing_bars and ``checks`` for the history each of them looks at.

    decisions: decision_date, code, history_start, through. Every date from history_start to decision_date is in the
    calendar, and every day up to ``through`` on which the code is a trading member has a bar on both tracks. A
    range's gap is the difference of two running counts: of calendar days (one row a day), and of missing bars by code.
    Null bounds have no gaps to count.
    """
    before = F.date_sub("history_start", 1)
    dates = calendar.select(F.col("calendar_date").alias("day"), F.lit(1).cast("long").alias("n")).distinct()
    spans = decisions.select("history_start", "decision_date").distinct()
    asked = spans.select(F.col("decision_date").alias("day")).unionByName(spans.select(before.alias("day"))).filter("day IS NOT NULL")
    known = _prefix_counts(dates.withColumn("one", F.lit(0)), asked.withColumn("one", F.lit(0)), ["one"])  # days of a calendar
    count = lambda name: known.select(F.col("day").alias(f"_{name}_day"), F.col("upto").alias(f"_{name}"))
    spans = spans.join(count("last"), F.col("decision_date") == F.col("_last_day"), "left").join(count("first"), before == F.col("_first_day"), "left")
    spans = spans.select("history_start", "decision_date", (F.datediff("decision_date", "history_start") + 1 - (F.col("_last") - F.col("_first"))).cast("long").alias("missing_dates"))

    there = paired.filter("pairing = 'paired'").select(F.col("trade_date").alias("day"), "code").distinct().withColumn("_there", F.lit(True))
    gaps = universe.filter("trade_status").select(F.col("snapshot_date").alias("day"), "code").distinct().join(there, ["day", "code"], "left")
    gaps = gaps.filter("_there IS NULL").select("code", "day", F.lit(1).cast("long").alias("n"))
    asked = decisions.select("code", F.col("through").alias("day")).unionByName(decisions.select("code", before.alias("day"))).filter("day IS NOT NULL")
    lacking = _prefix_counts(gaps, asked, ["code"])
    lack = lambda name: lacking.select(F.col("code").alias(f"_{name}_code"), F.col("day").alias(f"_{name}_bar_day"), F.col("upto").alias(f"_{name}_bars"))
    rows = decisions.join(spans, ["history_start", "decision_date"], "left")
    rows = rows.join(lack("last"), (F.col("code") == F.col("_last_code")) & (F.col("through") == F.col("_last_bar_day")), "left").join(lack("first"), (F.col("code") == F.col("_first_code")) & (before == F.col("_first_bar_day")), "left")
    missing = F.greatest(F.coalesce(F.col("_last_bars") - F.col("_first_bars"), F.lit(0)), F.lit(0))
    rows = rows.withColumns({"missing_dates": F.coalesce("missing_dates", F.lit(0)), "missing_bars": missing})
    checks = F.array_compact(F.array(F.when(F.col("missing_dates") > 0, F.lit("calendar_incomplete")), F.when(F.col("missing_bars") > 0, F.lit("history_bar_missing"))))
    return rows.select(*decisions.columns, "missing_dates", "missing_bars", checks.alias("checks"))


def required_missing(days: DataFrame, codes: list[str], universe: DataFrame) -> DataFrame:
    """(decision_date, code, check): required codes that a decision day's universe lacks."""
    wanted = days.select("decision_date").distinct().withColumn("code", F.explode(F.array(*map(F.lit, codes))))
    known = universe.select(F.col("snapshot_date").alias("decision_date"), "code").distinct()
    return wanted.join(known, ["decision_date", "code"], "left_anti").withColumn("check", F.lit("required_code_missing"))


def universe_view(days: DataFrame, positions: DataFrame, calendar: DataFrame, universe: DataFrame, paired: DataFrame, *, members: DataFrame | None = None, fixed: DataFrame | None = None, opening: bool = False) -> DataFrame:
    """What each decision day looks at: its members (or, with ``fixed``, the same codes every day) and what is held besides.

    days: decision_date; positions and members: trade_date, code; fixed: code. Each row is assembled as in
    ``assemble``; what is only held is there for valuation (is_candidate false). Histories: ``features.history_window``.
    """
    if fixed is not None:  # the same codes on every day: that grid is the view itself
        members = days.select(F.col("decision_date").alias("trade_date")).crossJoin(_one_row(fixed)).select("trade_date", F.explode("codes").alias("code"))
    both = candidates(members, positions).withColumnRenamed("trade_date", "decision_date").join(days.select("decision_date").distinct(), "decision_date", "left_semi")
    return assemble(both, calendar, universe, paired, opening=opening).join(both, ["decision_date", "code"])


def checkpoint_violations(opening: DataFrame, at: str = "09:35:00", zone: str = "Asia/Shanghai") -> DataFrame:
    """Opening bars that break a snapshot's contract: (check, decision_date, code).

    opening: decision_date, code, timestamp, previous_close, prior_close (of the daily bar before).
    """
    local = F.from_utc_timestamp("timestamp", zone)
    opening = opening.withColumn("_rows", F.count("*").over(W.partitionBy("decision_date", "code")))
    checks = F.array_compact(F.array(
        F.when((F.date_format(local, "HH:mm:ss") != at) | (F.to_date(local) != F.col("decision_date")), F.lit("not_the_checkpoint")),
        F.when(~F.col("previous_close").eqNullSafe(F.col("prior_close")), F.lit("previous_close")), F.when(F.col("_rows") > 1, F.lit("repeated")),
    ))
    return opening.select(F.explode(checks).alias("check"), "decision_date", "code")
