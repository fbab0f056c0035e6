"""Queries over coverage, snapshot assembly, and the ledger's and the operations' read models."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import admission as gate
from ..operators import coverage, features, ops, quality, trading, views
from ..sources.scratch import written
from . import book, market
from . import standins as S

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# -- coverage --------------------------------------------------------------------------------------

START, END = date(1995, 1, 1), date(1997, 12, 31)


def _day(column: str):
    return F.datediff(column, F.lit("1970-01-01").cast("date"))


def _span(sf_bars: DataFrame) -> DataFrame:
    return sf_bars.filter(F.col("trade_date").between(START, END))


def _universe(bars: DataFrame) -> DataFrame:
    """The universe of the days, with a status of its own and gaps."""
    name = F.concat(F.when(F.col("is_st"), F.lit("ST ")).otherwise(F.lit("")), "code")
    return bars.filter(_day("trade_date") % 19 != 4).select(F.col("trade_date").alias("snapshot_date"), "code", name.alias("name"), (F.col("volume") % 5 != 1).alias("trade_status"))


def _calendar(bars: DataFrame) -> DataFrame:
    return S.calendar(bars).filter((_day("calendar_date") % 97 != 0) & F.col("calendar_date").between(START, END))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = written(S.paired_bars(spark, sf_dir), "bars")  # read by most of the parts
    bars = _span(every)
    at = lambda c, hours: (F.col(c).cast("timestamp") + F.make_dt_interval(F.lit(0), hours)).alias("available_at")
    members = S.lines(spark, sf_dir).filter(F.col("trade_date").between(START, END)).select(F.col("trade_date").alias("snapshot_date"), "index_code", F.col("code").alias("member_code")).distinct()
    members = written(members.select("*", at("snapshot_date", F.lit(6))), "members")
    universe = _universe(bars).select("*", at("snapshot_date", F.when(_day("snapshot_date") % 50 == 0, 8).otherwise(6)))
    signal, execution = S.tracks(bars)
    daily = signal.unionByName(execution).select("*", at("trade_date", F.lit(6)))
    benchmark = bars.filter("code = 'brand#11'").select("trade_date", F.col("execution_close").alias("close"), F.col("execution_close").alias("previous_close"), F.when(F.col("volume") % 9 != 0, 1.0).alias("pct_change"), at("trade_date", F.lit(6)))
    expected = members.select("index_code").distinct().select("index_code", F.lit(None).cast("date").alias("valid_date"), F.lit(5).alias("expected"))
    return coverage.findings(_calendar(every), members, S.instruments(every).filter("code <> 'brand#13'"), universe, daily, benchmark, start=START, end=END, expected=expected)


_IN = "BETWEEN DATE '1995-01-01' AND DATE '1997-12-31'"
COVER = S.TRACKS + S.CALENDAR.removeprefix(S.BARS) + "," + S.INSTRUMENTS + f""",
    cal AS (SELECT * FROM calendar WHERE date_diff('day', DATE '1970-01-01', calendar_date) % 97 <> 0 AND calendar_date {_IN}),
    tday AS (SELECT calendar_date AS trade_date FROM cal WHERE is_trading_day),
    mem AS (SELECT DISTINCT trade_date, index_code, code FROM line WHERE trade_date {_IN}),
    ins AS (SELECT * FROM instruments WHERE code <> 'brand#13'),
    listed AS (SELECT m.trade_date, m.code, m.trade_date >= ipo_date AND (out_date IS NULL OR m.trade_date < out_date) AS l FROM mem m JOIN ins i ON m.code = i.code),
    wanted AS (SELECT trade_date, code FROM listed WHERE l),
    uni AS (SELECT trade_date, code, CASE WHEN is_st THEN 'ST ' ELSE '' END || code AS name, volume % 5 <> 1 AS trade_status, d FROM dated WHERE d % 19 <> 4 AND trade_date {_IN}),
    sig AS (SELECT * FROM signal WHERE trade_date {_IN}),
    exe AS (SELECT * FROM execution WHERE trade_date {_IN}),
    bench AS (SELECT DISTINCT trade_date FROM bars WHERE code = 'brand#11' AND volume % 9 <> 0 AND trade_date {_IN})"""


@query("WITH " + COVER + """,
    grid AS (SELECT trade_date, index_code FROM tday CROSS JOIN (SELECT DISTINCT index_code FROM mem)),
    one AS (
        SELECT (SELECT count(*) FROM tday) AS trading_days, (SELECT count(DISTINCT code) FROM mem) AS unique_member_codes, (SELECT count(*) FROM mem) AS raw_member_code_days,
               (SELECT count(*) FROM listed WHERE NOT l) AS excluded_out_of_listing_member_days, (SELECT count(*) FROM wanted) AS expected_member_code_days, (SELECT count(*) FROM bench SEMI JOIN tday USING (trade_date)) AS covered_benchmark_days,
               1096 - (SELECT count(*) FROM cal) AS missing_calendar_dates,
               (SELECT count(*) FROM (SELECT g.trade_date, g.index_code, count(m.code) AS n FROM grid g LEFT JOIN mem m ON g.trade_date = m.trade_date AND g.index_code = m.index_code GROUP BY ALL) WHERE n <> 5) AS incomplete_membership_snapshots,
               (SELECT sum(n - k) FROM (SELECT count(*) AS n, count(DISTINCT code) AS k FROM mem GROUP BY trade_date))::BIGINT AS duplicate_member_pairs,
               (SELECT count(*) FROM (SELECT DISTINCT code FROM mem) ANTI JOIN ins USING (code)) AS missing_instruments,
               (SELECT count(*) FROM tday ANTI JOIN uni USING (trade_date)) AS missing_universe_dates,
               (SELECT count(*) FROM wanted ANTI JOIN uni USING (trade_date, code)) AS missing_universe_members,
               (SELECT count(*) FROM wanted ANTI JOIN sig USING (trade_date, code)) AS missing_signal_prices,
               (SELECT count(*) FROM wanted ANTI JOIN exe USING (trade_date, code)) AS missing_execution_prices,
               (SELECT count(*) FROM sig ANTI JOIN exe USING (trade_date, code)) + (SELECT count(*) FROM exe ANTI JOIN sig USING (trade_date, code)) AS price_track_date_mismatches,
               (SELECT count(*) FROM tday ANTI JOIN bench USING (trade_date)) AS missing_benchmark_dates,
               (SELECT count(*) FROM (SELECT 1 FROM uni WHERE d % 50 = 0 LIMIT 1)) AS late_row_groups,
               (SELECT count(*) FROM wanted w JOIN uni u USING (trade_date, code) JOIN sig s USING (trade_date, code) JOIN exe e USING (trade_date, code) WHERE u.trade_status <> s.trade_status OR u.trade_status <> e.trade_status) AS trade_status_mismatches
    )
    SELECT *, expected_member_code_days - missing_universe_members AS covered_universe_member_days, expected_member_code_days - missing_signal_prices AS covered_signal_price_days,
           expected_member_code_days - missing_execution_prices AS covered_execution_price_days, 'failed' AS status FROM one
""")
def point_in_time_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.report(_findings(spark, sf_dir))


@query("WITH " + COVER + """
    SELECT * FROM (SELECT 'missing_instruments' AS issue, NULL::DATE AS trade_date, code, 1::BIGINT AS n FROM (SELECT DISTINCT code FROM mem) ANTI JOIN ins USING (code))
    UNION ALL (SELECT 'missing_universe_members', trade_date, code, 1 FROM wanted ANTI JOIN uni USING (trade_date, code) ORDER BY trade_date, code LIMIT 100)
    UNION ALL (SELECT 'missing_execution_prices', trade_date, code, 1 FROM wanted ANTI JOIN exe USING (trade_date, code) ORDER BY trade_date, code LIMIT 100)
    UNION ALL (SELECT 'missing_benchmark_dates', trade_date, NULL, 1 FROM tday ANTI JOIN bench USING (trade_date) ORDER BY 2 LIMIT 100)
""")
def coverage_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.samples(_findings(spark, sf_dir), 100, ["missing_instruments", "missing_universe_members", "missing_execution_prices", "missing_benchmark_dates"])


OPENING = COVER + """,
    five AS (SELECT DISTINCT trade_date, code FROM bars WHERE volume % 3 <> 0),
    want AS (
        SELECT trade_date, code FROM uni SEMI JOIN tday USING (trade_date) WHERE trade_status
        UNION ALL SELECT trade_date, code FROM (SELECT trade_date FROM tday ANTI JOIN uni USING (trade_date)) CROSS JOIN (SELECT DISTINCT code FROM bars)
    )"""


def _opening(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    every = written(S.paired_bars(spark, sf_dir), "bars")
    minutes = F.when(F.col("volume") % 3 != 0, 35).otherwise(40)
    five = every.select("trade_date", "code", F.lit("3").alias("adjustment_flag"), (F.col("trade_date").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(1), minutes)).alias("timestamp"))
    return coverage.opening_pairs(_calendar(every), _universe(_span(every)), every.select("code").distinct()), coverage.opening_bars(five)


@query("WITH " + OPENING + """
    SELECT w.code, count(*) AS expected, count(f.trade_date) AS covered, round(count(f.trade_date) / count(*), 8) AS ratio FROM want w LEFT JOIN five f ON w.trade_date = f.trade_date AND w.code = f.code GROUP BY 1
""")
def opening_coverage_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.opening_coverage(*_opening(spark, sf_dir))


@query("WITH " + OPENING + "SELECT trade_date, code FROM want ANTI JOIN five USING (trade_date, code) ORDER BY 1, 2 LIMIT 100")
def opening_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted, covered = _opening(spark, sf_dir)
    return quality.samples(quality.missing(wanted, covered, ["trade_date", "code"]))


# -- snapshots -------------------------------------------------------------------------------------


@query("WITH " + COVER + "SELECT calendar_date, lag(calendar_date) OVER (ORDER BY calendar_date) AS previous FROM cal WHERE is_trading_day")
def previous_trading_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.previous_trading_days(_calendar(S.paired_bars(spark, sf_dir)))


@query("WITH " + COVER + """,
    prev AS (SELECT calendar_date, lag(calendar_date) OVER (ORDER BY calendar_date) AS previous FROM cal WHERE is_trading_day)
    SELECT b.trade_date, b.code, b.low AS opening_price, p.previous, u.trade_status, contains(u.name, 'ST') AS is_st, e.close AS previous_close
    FROM (SELECT * FROM bars WHERE trade_date BETWEEN DATE '1995-01-01' AND DATE '1997-12-31') b LEFT JOIN prev p ON b.trade_date = p.calendar_date LEFT JOIN uni u ON b.trade_date = u.trade_date AND b.code = u.code LEFT JOIN execution e ON e.code = b.code AND e.trade_date = p.previous
""")
def opening_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = S.paired_bars(spark, sf_dir)
    opening = _span(every).select("trade_date", "code", F.col("low").alias("opening_price"))
    return coverage.opening_states(opening, _universe(_span(every)), S.tracks(every)[1], _calendar(every)).select("trade_date", "code", "opening_price", "previous", "trade_status", "is_st", "previous_close")


@query("WITH " + COVER + """,
    held AS (SELECT trade_date + 1 AS trade_date, code FROM bars WHERE volume % 7 = 0)
    SELECT coalesce(u.trade_date, h.trade_date) AS trade_date, coalesce(u.code, h.code) AS code, u.code IS NOT NULL AS is_candidate FROM uni u FULL JOIN held h ON u.trade_date = h.trade_date AND u.code = h.code
""")
def candidate_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = S.paired_bars(spark, sf_dir)
    members = _universe(_span(bars)).select(F.col("snapshot_date").alias("trade_date"), "code")
    return coverage.candidates(members, bars.filter("volume % 7 = 0").select(F.date_add("trade_date", 1).alias("trade_date"), "code"))


@query("WITH " + COVER + """
    SELECT t.trade_date, round((b.volume % 11 - 5) / 100, 8) AS benchmark_return, b.volume IS NULL AS missing FROM tday t LEFT JOIN (SELECT * FROM bars WHERE code = 'brand#11') b ON t.trade_date = b.trade_date
""")
def benchmark_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = S.paired_bars(spark, sf_dir)
    days = _calendar(bars).filter("is_trading_day").select(F.col("calendar_date").alias("trade_date"))
    changes = bars.filter("code = 'brand#11'").select("trade_date", (F.col("volume") % 11 - 5).cast("double").alias("pct_change"))
    return coverage.benchmark_returns(days, changes).select("trade_date", F.round("benchmark_return", 8).alias("benchmark_return"), "missing")


ASKED = "SELECT snapshot_date, code, true AS is_candidate FROM universe"


def _assembly(through: str, asked: str = ASKED, more: str = "") -> str:
    return "WITH " + COVER + "," + S.UNIVERSE + f""",
    prev AS (SELECT calendar_date, lag(calendar_date) OVER (ORDER BY calendar_date) AS previous FROM cal WHERE is_trading_day),
    pairs AS (
        SELECT coalesce(s.code, e.code) AS code, coalesce(s.trade_date, e.trade_date) AS trade_date, s.close AS signal_close, e.close AS execution_close,
               CASE WHEN s.code IS NULL THEN 'only_execution' WHEN e.code IS NULL THEN 'only_signal' WHEN s.volume <> e.volume THEN 'volume' ELSE 'paired' END AS pairing
        FROM signal s FULL OUTER JOIN execution e ON s.code = e.code AND s.trade_date = e.trade_date
    ),
    j AS (
        SELECT q.snapshot_date AS decision_date, q.code, {through} AS through, q.is_candidate, c.is_trading_day, u.trade_status AS t, p.* EXCLUDE (code, trade_date)
        FROM ({asked}) q LEFT JOIN cal c ON c.calendar_date = q.snapshot_date LEFT JOIN prev v ON v.calendar_date = q.snapshot_date
        LEFT JOIN uni u ON u.trade_date = q.snapshot_date AND u.code = q.code LEFT JOIN pairs p ON p.trade_date = {through} AND p.code = q.code
    )
    SELECT decision_date, code, through, signal_close, execution_close{more}, array_to_string(list_filter([
        CASE WHEN is_trading_day IS NULL THEN 'calendar_missing' END, CASE WHEN NOT is_trading_day THEN 'not_a_trading_day' END, CASE WHEN through IS NULL AND is_trading_day THEN 'no_day_before' END,
        CASE WHEN t IS NULL THEN 'not_in_universe' END, CASE WHEN t AND pairing IS NULL THEN 'bar_missing' END, CASE WHEN pairing <> 'paired' THEN 'tracks_' || pairing END], lambda x: x IS NOT NULL), ',') AS checks FROM j
    """


def _assembled(spark: SparkSession, sf_dir: str, opening: bool) -> DataFrame:
    bars = written(S.paired_bars(spark, sf_dir), "bars")
    decisions = S.universe(spark, sf_dir).withColumnRenamed("snapshot_date", "decision_date")
    out = coverage.assemble(decisions, _calendar(bars), _universe(_span(bars)), trading.pair_tracks(*S.tracks(bars)), opening=opening)
    return out.withColumn("checks", F.array_join("checks", ","))


@query(_assembly("q.snapshot_date"))
def snapshot_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assembled(spark, sf_dir, False)


@query(_assembly("v.previous"))
def snapshot_assembly_opening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assembled(spark, sf_dir, True)


@query("WITH " + COVER + "," + S.UNIVERSE + """,
    q AS (SELECT snapshot_date AS decision_date, code, CAST(snapshot_date - INTERVAL 30 DAY AS DATE) AS history_start FROM universe),
    span AS (SELECT decision_date, any_value(history_start) AS history_start, 31 - (SELECT count(*) FROM cal WHERE calendar_date BETWEEN any_value(history_start) AND decision_date) AS missing_dates FROM q GROUP BY 1),
    gap AS (
        SELECT u.trade_date, u.code FROM uni u WHERE trade_status AND NOT EXISTS (
            SELECT 1 FROM signal s JOIN execution e ON s.code = e.code AND s.trade_date = e.trade_date WHERE s.volume = e.volume AND s.code = u.code AND s.trade_date = u.trade_date)
    ),
    m AS (SELECT q.decision_date, q.code, q.history_start, missing_dates, count(g.code) AS missing_bars FROM q JOIN span ON span.decision_date = q.decision_date LEFT JOIN gap g ON g.code = q.code AND g.trade_date BETWEEN q.history_start AND q.decision_date GROUP BY ALL)
    SELECT *, array_to_string(list_filter([CASE WHEN missing_dates > 0 THEN 'calendar_incomplete' END, CASE WHEN missing_bars > 0 THEN 'history_bar_missing' END], lambda x: x IS NOT NULL), ',') AS checks FROM m
""")
def snapshot_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = written(S.paired_bars(spark, sf_dir), "bars")
    day = F.col("snapshot_date")
    decisions = S.universe(spark, sf_dir).select(day.alias("decision_date"), "code", F.date_sub(day, 30).alias("history_start"), day.alias("through"))
    out = coverage.history_gaps(decisions, _calendar(bars), _universe(_span(bars)), trading.pair_tracks(*S.tracks(bars)))
    return out.select("decision_date", "code", "history_start", "missing_dates", "missing_bars", F.array_join("checks", ",").alias("checks"))


@query("WITH " + COVER + "," + S.UNIVERSE + """
    SELECT decision_date, code, 'required_code_missing' AS "check" FROM (SELECT DISTINCT snapshot_date AS decision_date FROM universe), (SELECT unnest(['brand#11', 'brand#23', 'index#1']) AS code) r
    WHERE NOT EXISTS (SELECT 1 FROM uni u WHERE u.trade_date = decision_date AND u.code = r.code)
""")
def required_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = S.paired_bars(spark, sf_dir)
    days = S.universe(spark, sf_dir).select(F.col("snapshot_date").alias("decision_date"))
    return coverage.required_missing(days, ["brand#11", "brand#23", "index#1"], _universe(_span(bars)))


HELD_TOO = """
    SELECT coalesce(u.snapshot_date, h.snapshot_date) AS snapshot_date, coalesce(u.code, h.code) AS code, u.code IS NOT NULL AS is_candidate
    FROM universe u
    FULL JOIN (SELECT trade_date + 1 AS snapshot_date, code FROM bars WHERE volume % 7 = 0 AND trade_date + 1 IN (SELECT snapshot_date FROM universe)) h
    ON u.snapshot_date = h.snapshot_date AND u.code = h.code
"""
FIXED = """
    SELECT coalesce(u.snapshot_date, h.snapshot_date) AS snapshot_date, coalesce(u.code, h.code) AS code, u.code IS NOT NULL AS is_candidate
    FROM (SELECT DISTINCT snapshot_date, c AS code FROM universe, (SELECT unnest(['brand#11', 'brand#12', 'brand#13']) AS c)) u
    FULL JOIN (SELECT trade_date + 1 AS snapshot_date, code FROM bars WHERE volume % 7 = 0 AND trade_date + 1 IN (SELECT snapshot_date FROM universe)) h
    ON u.snapshot_date = h.snapshot_date AND u.code = h.code
"""


def _view(spark: SparkSession, sf_dir: str, codes: list[str] | None) -> DataFrame:
    bars = written(S.paired_bars(spark, sf_dir), "bars")
    members = S.universe(spark, sf_dir).withColumnRenamed("snapshot_date", "trade_date")
    held = bars.filter("volume % 7 = 0").select(F.date_add("trade_date", 1).alias("trade_date"), "code")
    days = members.select(F.col("trade_date").alias("decision_date")).distinct()
    fixed = None if codes is None else spark.createDataFrame([(c,) for c in codes], "code string")
    out = coverage.universe_view(days, held, _calendar(bars), _universe(_span(bars)), trading.pair_tracks(*S.tracks(bars)), members=members, fixed=fixed)
    return out.withColumn("checks", F.array_join("checks", ","))


@query(_assembly("q.snapshot_date", HELD_TOO, ", is_candidate"))
def daily_universe_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, None)


@query(_assembly("q.snapshot_date", FIXED, ", is_candidate"))
def fixed_universe_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, ["brand#11", "brand#12", "brand#13"])


@query("WITH " + COVER + """,
    asked AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS calendar_date FROM orders), twice AS (SELECT * FROM cal UNION ALL SELECT * FROM cal WHERE date_diff('day', DATE '1970-01-01', calendar_date) % 23 = 0)
    SELECT a.calendar_date, count(c.calendar_date) AS rows, CASE WHEN count(c.calendar_date) = 1 THEN bool_and(is_trading_day) END AS is_trading_day FROM asked a LEFT JOIN twice c ON a.calendar_date = c.calendar_date GROUP BY 1
""")
def trading_day_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _calendar(S.paired_bars(spark, sf_dir))
    asked = S.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("calendar_date")).distinct()
    return views.trading_day_lookup(asked, known.unionByName(known.filter(_day("calendar_date") % 23 == 0)))


@query("WITH " + COVER + "SELECT max(calendar_date) AS latest FROM cal WHERE is_trading_day AND calendar_date <= DATE '1996-07-15'")
def latest_trading_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.latest_trading_day(_calendar(S.paired_bars(spark, sf_dir)), F.to_date(F.lit("1996-07-15")))


@query("WITH " + S.TRACKS + "SELECT trade_date, code, '2' AS adjustment_flag, close FROM signal WHERE volume % 13 = 1")
def bars_by_business_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal, _ = S.tracks(S.paired_bars(spark, sf_dir))
    return views.by_business_keys(signal.filter("volume % 13 = 1").select("trade_date", "code", "adjustment_flag", "close"), "daily_bars")


# -- ledger ----------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS intent_id, CAST(o_orderdate AS DATE) + 60 AS expires_on FROM orders ORDER BY expires_on DESC, intent_id DESC LIMIT 200")
def newest_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    intents, _ = book._intents(spark, sf_dir)
    return views.listed(intents.select("intent_id", "expires_on"), ["expires_on", "intent_id"], newest_first=True, most=200)


@query("WITH " + book.FILLS + "SELECT fill_id, track, occurred_on FROM fill WHERE track = 'F' AND occurred_on <= DATE '1996-12-31'")
def fills_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = book.fills(spark, sf_dir)
    return views.listed(rows, ["occurred_on", "seq"], time="occurred_on", as_of=F.to_date(F.lit("1996-12-31")), track="F").select("fill_id", "track", "occurred_on")


@query("WITH " + S.BARS + """,
    point AS (SELECT date_trunc('month', trade_date)::DATE AS decision_id, code, count(*) AS points, min(trade_date) AS first_day, max(trade_date) AS last_day, round(arg_max(execution_close, trade_date), 6) AS last_close FROM bars GROUP BY ALL)
    SELECT o_orderkey AS signal_id, p.*, 'snapshot of ' || decision_id AS snapshot_id FROM orders JOIN point p ON date_trunc('month', o_orderdate)::DATE = decision_id AND p.code = 'brand#' || (o_custkey % 25 + 1) WHERE CAST(o_orderdate AS DATE) <= DATE '1996-06-30'
""")
def signal_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = S.paired_bars(spark, sf_dir)
    prices = bars.select(F.trunc("trade_date", "month").alias("decision_id"), "code", "trade_date", "signal_close", "execution_close")
    made = F.col("o_orderdate").cast("date")
    signals = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("signal_id"), F.trunc(made, "month").alias("decision_id"), F.concat(F.lit("brand#"), F.col("o_custkey") % 25 + 1).alias("code"), made.alias("created_at"))
    decisions = prices.select("decision_id").distinct().withColumn("snapshot_id", F.concat(F.lit("snapshot of "), F.col("decision_id").cast("string")))
    out = views.signal_details(signals, prices, decisions, F.to_date(F.lit("1996-06-30")))
    at = F.col("price_points")
    return out.select("signal_id", "decision_id", "code", F.size(at).cast("long").alias("points"), at[0]["trade_date"].alias("first_day"), F.element_at(at, -1)["trade_date"].alias("last_day"), F.round(F.element_at(at, -1)["execution_close"], 6).alias("last_close"), "snapshot_id")


AS_OF = "1996-06-30"
SEEN = book.LOTS.replace("FROM lineitem", f"FROM lineitem WHERE CAST(l_shipdate AS DATE) <= DATE '{AS_OF}'")
BOARD = SEEN + f""",
    price AS (SELECT code, arg_max(price, occurred_on) AS last_price FROM (SELECT code, occurred_on, max(price) AS price FROM fill GROUP BY ALL) GROUP BY 1),
    held AS (
        SELECT track, l.code, CAST(sum(quantity_left) AS BIGINT) AS quantity, any_value(last_price) AS last_price FROM lots l LEFT JOIN price p ON l.code = p.code WHERE quantity_left > 0 GROUP BY track, l.code
    ),
    cash AS (SELECT track, sum(CASE WHEN side = 'buy' THEN -quantity * price ELSE quantity * price END - fees) AS cash FROM fill GROUP BY 1),
    view AS (SELECT c.track, cash, coalesce(n, 0) AS positions, coalesce(v, 0) AS market_value, cash + coalesce(v, 0) AS equity FROM cash c LEFT JOIN (SELECT track, count(*) AS n, sum(quantity * last_price) AS v FROM held GROUP BY 1) h ON c.track = h.track)"""


def _board(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    fills = book.fills(spark, sf_dir)
    intents, skips = book._intents(spark, sf_dir)
    prices = fills.groupBy("code", F.col("occurred_on").alias("priced_on")).agg(F.max("price").alias("price"))
    return views.dashboard(fills, intents, skips, prices, AS_OF, ["F", "O"])


@query("WITH " + BOARD + """
    SELECT v.track, round(v.cash, 2) AS cash, v.positions, round(v.market_value, 2) AS market_value, round(v.equity, 2) AS equity, round(v.cash - b.cash, 2) AS cash_difference, round(v.equity - b.equity, 2) AS equity_difference FROM view v CROSS JOIN (SELECT * FROM view WHERE track = 'F') b
""")
def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    r2 = lambda c: F.round(c, 2).alias(c)
    return _board(spark, sf_dir)["tracks"].select("track", r2("cash"), "positions", r2("market_value"), r2("equity"), r2("cash_difference"), r2("equity_difference"))


@query("WITH " + BOARD + "," + book.INTENTS + book.signal_status_sql(AS_OF))
def dashboard_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _board(spark, sf_dir)["signals"].select("intent_id", "track", "filled", "remaining", "reason", "status")


@query("WITH " + BOARD + """
    SELECT code, CAST(coalesce(sum(quantity) FILTER (track = 'F'), 0) AS BIGINT) AS "F", CAST(coalesce(sum(quantity) FILTER (track = 'O'), 0) AS BIGINT) AS "O",
           CAST(coalesce(sum(quantity) FILTER (track = 'O'), 0) - coalesce(sum(quantity) FILTER (track = 'F'), 0) AS BIGINT) AS "O_minus_F" FROM held GROUP BY 1
""")
def dashboard_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _board(spark, sf_dir)["reconciliation"]


@query("WITH " + BOARD + "SELECT track, round(cash, 2) AS cash, positions, round(market_value, 2) AS market_value, round(equity, 2) AS equity FROM view")
def replay_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fills = book.fills(spark, sf_dir)
    days = fills.filter(F.col("occurred_on") <= F.to_date(F.lit(AS_OF))).groupBy("code", "occurred_on").agg(F.max("price").alias("price"))
    prices = days.groupBy("code").agg(F.max_by("price", "occurred_on").alias("price"))
    boundary = fills.filter(F.col("occurred_on") <= F.to_date(F.lit(AS_OF))).agg(F.max("occurred_on")).first()[0]  # one value
    r2 = lambda c: F.round(c, 2).alias(c)
    return views.replay_audit(fills, prices, str(boundary)).select("track", r2("cash"), "positions", r2("market_value"), r2("equity"))


ADMISSION = book.FILLS.replace("l_linestatus AS track, l_partkey % 50 AS code", "l_linestatus || '-' || l_orderkey % 300 AS track, l_partkey % 3 AS code") + """,
    sent AS (
        SELECT *, fill_id AS key, 0 AS copy FROM fill
        UNION ALL SELECT * REPLACE (fill_id || '-again' AS fill_id), fill_id, 1 FROM fill WHERE intent_id % 29 = 0
        UNION ALL SELECT * REPLACE (fill_id || '-other' AS fill_id, quantity + 1 AS quantity), fill_id, 2 FROM fill WHERE intent_id % 31 = 0
        UNION ALL SELECT * REPLACE (fill_id || '-later' AS fill_id, occurred_on + 9 AS occurred_on), fill_id, 3 FROM fill WHERE intent_id % 5 = 0
    ),
    skip AS (
        SELECT intent_id, side || '-' || intent_id % 300 AS track, min(skipped_on) AS skipped_on FROM (
            SELECT o_orderkey AS intent_id, 'F' AS side, CAST(o_orderdate AS DATE) + 45 AS skipped_on FROM orders WHERE o_orderkey % 7 = 0
            UNION ALL SELECT o_orderkey, 'F', CAST(o_orderdate AS DATE) + 30 FROM orders WHERE o_orderkey % 14 = 0
            UNION ALL SELECT o_orderkey, 'O', CAST(o_orderdate AS DATE) + 30 FROM orders WHERE o_orderkey % 11 = 0) GROUP BY ALL
    ),
    ev AS (
        SELECT s.*, skipped_on, o_orderkey AS known, 60 + o_orderkey % 120 AS wanted, CAST(o_orderdate AS DATE) - 700 AS created_on, CAST(o_orderdate AS DATE) + 600 AS expires_on,
               (-1.0 * CASE WHEN side = 'buy' THEN quantity ELSE -quantity END * price)::DOUBLE - fees AS amount, row_number() OVER (PARTITION BY s.track ORDER BY occurred_on, seq, copy, fill_id) AS k
        FROM sent s LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 37 <> 0) o ON intent_id = o_orderkey LEFT JOIN skip ON skip.intent_id = s.intent_id AND skip.track = s.track
    ),
    step AS (
        SELECT DISTINCT track, 0::BIGINT AS k, NULL::VARCHAR AS fill_id, NULL::VARCHAR AS key, NULL::VARCHAR AS reason, 150000::DOUBLE AS cash,
               []::STRUCT(key VARCHAR, intent_id BIGINT, code BIGINT, side VARCHAR, quantity BIGINT, occurred_on DATE)[] AS taken FROM ev
        UNION ALL
        SELECT track, k, fill_id, key, reason, CASE WHEN reason IS NULL THEN cash + amount ELSE cash END,
               CASE WHEN reason IS NULL THEN list_append(taken, {'key': key, 'intent_id': intent_id::BIGINT, 'code': code::BIGINT, 'side': side, 'quantity': quantity::BIGINT, 'occurred_on': occurred_on}) ELSE taken END
        FROM (
            SELECT e.*, cash, taken, CASE
                WHEN known IS NULL THEN 'unknown_intent' WHEN e.occurred_on < created_on THEN 'before_intent' WHEN e.occurred_on > expires_on THEN 'after_expiry'
                WHEN len(list_filter(taken, lambda x: x.key = e.key AND x.quantity = e.quantity AND x.occurred_on = e.occurred_on)) > 0 THEN 'replay'
                WHEN len(list_filter(taken, lambda x: x.key = e.key)) > 0 THEN 'conflict'
                WHEN skipped_on <= e.occurred_on THEN 'after_skip'
                WHEN coalesce(list_sum(list_transform(list_filter(taken, lambda x: x.intent_id = e.intent_id), lambda x: x.quantity)), 0) + e.quantity > wanted THEN 'over_intent'
                WHEN cash + amount < 0 THEN 'short_cash'
                WHEN e.side = 'sell' AND e.quantity > coalesce(list_sum(list_transform(list_filter(taken, lambda x: x.code = e.code), lambda x: CASE WHEN x.side = 'sell' THEN -x.quantity WHEN x.occurred_on < e.occurred_on THEN x.quantity ELSE 0 END)), 0) THEN 't_plus_one'
                END AS reason
            FROM step s JOIN ev e ON e.track = s.track AND e.k = s.k + 1)
    )"""


@query("WITH RECURSIVE " + ADMISSION + """
    SELECT track, fill_id, key, CASE WHEN reason IS NULL THEN 'accepted' WHEN reason IN ('replay', 'conflict') THEN reason ELSE 'rejected' END AS verdict, CASE WHEN reason NOT IN ('replay', 'conflict') THEN reason END AS reason FROM step WHERE k > 0
""")
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as events of 600 tracks; an intent's lines stand on two. Some come again: unchanged, changed, or nine days later."""
    fills = book.fills(spark, sf_dir).withColumn("key", F.col("fill_id")).withColumn("code", F.col("seq.l_partkey") % 3).withColumn("track", F.concat_ws("-", "track", F.col("intent_id") % 300))
    numbered = lambda every, copy, name: fills.filter(f"intent_id % {every} = 0").withColumn("fill_id", F.concat("fill_id", F.lit(name))).withColumn("seq", F.struct("seq", F.lit(copy).alias("copy")))
    sent = numbered(1, 0, "").unionByName(numbered(29, 1, "-again")).unionByName(numbered(31, 2, "-other").withColumn("quantity", F.col("quantity") + 1)).unionByName(numbered(5, 3, "-later").withColumn("occurred_on", F.date_add("occurred_on", 9)))
    orders = S.table(spark, sf_dir, "orders")
    made = F.col("o_orderdate").cast("date")
    intents = orders.filter("o_orderkey % 37 <> 0").select(F.col("o_orderkey").alias("intent_id"), (60 + F.col("o_orderkey") % 120).alias("quantity"), F.date_sub(made, 700).alias("created_on"), F.date_add(made, 600).alias("expires_on"))
    skip = lambda every, side, days: orders.filter(f"o_orderkey % {every} = 0").select(F.col("o_orderkey").alias("intent_id"), F.concat_ws("-", F.lit(side), F.col("o_orderkey") % 300).alias("track"), F.date_add(made, days).alias("skipped_on"))
    skips = skip(7, "F", 45).unionByName(skip(14, "F", 30)).unionByName(skip(11, "O", 30))
    cash = sent.select("track").distinct().withColumn("cash", F.lit(150_000.0))
    return gate.admitted(sent, intents, skips, cash)


@query("WITH " + market.POOL + """,
    t AS (SELECT trade_date, count(*) AS positions, round(sum(0.9 / n), 6) AS gross FROM (SELECT trade_date, count(*) OVER (PARTITION BY trade_date) AS n FROM intents WHERE strategy = 'momentum' AND rank <= 5) GROUP BY 1)
    SELECT trade_date AS decision_id, positions, gross, 64 AS id_length, true AS own_id FROM t
""")
def shadow_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = features.momentum_candidates(features.price_features(S.paired_bars(spark, sf_dir))).filter("rank <= 5")
    n = F.count("*").over(W.partitionBy("trade_date"))
    targets = top.select(F.col("trade_date").alias("decision_id"), "code", (F.lit(0.9) / n).alias("weight"), F.lit("applied").alias("outcome"))
    base = top.select(F.col("trade_date").alias("decision_id")).distinct().withColumn("snapshot_id", F.col("decision_id").cast("string"))
    out = views.shadow_decisions(base, targets, {"prompt_version": "1", "overlay_version": "1"})
    gross = F.aggregate("target", F.lit(0.0), lambda a, x: a + x["weight"])
    return out.select("decision_id", F.size("target").cast("long").alias("positions"), F.round(gross, 6).alias("gross"), F.length("shadow_id").alias("id_length"), (F.col("shadow_id") != F.col("snapshot_id")).alias("own_id"))


@query("SELECT DISTINCT l_extendedprice - l_tax * 1000 AS price, rtrim(rtrim(CAST(CAST(l_extendedprice - l_tax * 1000 AS DECIMAL(38,6)) AS VARCHAR), '0'), '.') AS written FROM lineitem")
def decimal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = S.table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") - F.col("l_tax") * 1000).alias("price")).distinct()
    return price.select("price", views.decimal_text(F.col("price")).alias("written"))


# -- operations ------------------------------------------------------------------------------------

NOW = "2024-01-20 00:00:00"


@query("WITH " + book.CHECKS + f""",
    latest AS (SELECT provider, arg_max(state, (checked_at, event_id)) AS state, arg_max(critical, (checked_at, event_id)) AS critical, max(checked_at) AS checked_at FROM checks WHERE checked_at <= TIMESTAMP '{NOW}' GROUP BY 1)
    SELECT count(*) FILTER (critical) > 0 AND count(*) FILTER (critical AND (state <> 'healthy' OR TIMESTAMP '{NOW}' - checked_at > INTERVAL 15 MINUTE)) = 0 AS health_gate_ready,
           (SELECT count(*) FROM latest WHERE state = 'degraded' OR (critical AND state = 'not_configured')) AS active_alerts,
           (SELECT count(DISTINCT CAST(ts AS DATE)) FROM events WHERE ts <= TIMESTAMP '{NOW}') AS observed_days, (SELECT count(DISTINCT CAST(ts AS DATE)) FROM events WHERE ts <= TIMESTAMP '{NOW}') >= 60 AS review_ready
    FROM latest
""")
def operations_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = ops.latest_per_key(book._checks(spark, sf_dir).select("provider", "state", "critical", "checked_at", "event_id"), ["provider"], ["checked_at", "event_id"], NOW)
    observed = S.table(spark, sf_dir, "events").filter(F.col("ts") <= F.to_timestamp(F.lit(NOW))).select(F.to_date("ts").alias("trading_date"))
    return views.operations_status(latest, ops.alerts_from_health(latest), observed, NOW)


@query(f"""
    WITH s AS (SELECT event_id AS session_id, ts AS started_at, user_id FROM events WHERE event_type = 'view'), e AS (SELECT event_id FROM events WHERE event_id % 10 < 8),
    i AS (SELECT DISTINCT user_id AS incident_id FROM events WHERE event_type = 'error'), r AS (SELECT DISTINCT user_id AS incident_id FROM events WHERE event_type = 'purchase')
    SELECT 'unclosed_session' AS problem, CAST(session_id AS VARCHAR) AS key FROM s WHERE session_id NOT IN (SELECT event_id FROM e)
    UNION ALL SELECT 'active_incident', CAST(incident_id AS VARCHAR) FROM i WHERE incident_id NOT IN (SELECT incident_id FROM r)
    UNION ALL SELECT 'clock_moved_back', CAST(session_id AS VARCHAR) FROM s WHERE started_at > TIMESTAMP '{NOW}' + INTERVAL 5 SECOND
""")
def fetch_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = S.table(spark, sf_dir, "events")
    sessions = events.filter("event_type = 'view'").select(F.col("event_id").alias("session_id"), F.col("ts").alias("started_at"))
    users = lambda kind: events.filter(F.col("event_type") == kind).select(F.col("user_id").alias("incident_id")).distinct()
    return views.fetch_readiness(sessions, events.filter("event_id % 10 < 8").select(F.col("event_id").alias("session_id")), users("error"), users("purchase"), NOW)
