"""Queries over the market-shaped views: scans, quality and coverage, features, regime, allocation, orders."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import allocate, features, quality, regime, trading
from ..sources import catalog
from . import standins as S

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r8(name: str):
    return F.round(name, 8).alias(name)


def r6(name: str, as_name: str | None = None):
    return F.round(name, 6).alias(as_name or name)


# -- scans and keys ------------------------------------------------------------------------------


@query("""
    SELECT event_id, user_id, event_type, value FROM events
    WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' AND event_type IN ('click', 'error') AND value >= 10 AND value <= 60
""")
def scan_as_of_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.scan(S.table(spark, sf_dir, "events"), as_of=datetime(2024, 1, 15), available="ts", columns=["event_id", "user_id", "event_type", "value"], contained_in={"event_type": ["click", "error"]}, ranges={"value": (10, 60)})


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND false")
def scan_empty_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.scan(S.table(spark, sf_dir, "orders"), columns=["o_orderkey", "o_custkey"], equal={"o_orderstatus": "F"}, contained_in={"o_orderpriority": []})


@query("SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.duplicate_keys(S.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("WITH " + S.TRACKS + """
    SELECT code, trade_date, close, adjustment_flag FROM (
        SELECT code, trade_date, close, '2' AS adjustment_flag FROM signal UNION ALL SELECT code, trade_date, close, '3' FROM execution)
    WHERE code IN ('brand#1', 'brand#7') AND trade_date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'
""")
def daily_bar_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal, execution = S.tracks(S.paired_bars(spark, sf_dir))
    bars = signal.unionByName(execution).withColumn("available_at", F.col("trade_date").cast("timestamp"))
    out = catalog.bar_series(bars, ["brand#1", "brand#7"], date(1996, 1, 1), date(1997, 12, 31), datetime(2010, 1, 1), ["2", "3"])
    return out.select("code", "trade_date", "close", "adjustment_flag")


# -- quality and coverage -------------------------------------------------------------------------


@query("""
    SELECT 'lineitem' AS dataset, sum(n)::BIGINT AS rows, sum(n - 1)::BIGINT AS duplicate_keys, sum(l)::BIGINT AS without_provenance
    FROM (SELECT count(*) AS n, count(*) FILTER (l_shipdate IS NULL) AS l FROM lineitem GROUP BY l_orderkey, l_linenumber)
    UNION ALL SELECT 'orders', sum(n)::BIGINT, sum(n - 1)::BIGINT, sum(l)::BIGINT FROM (SELECT count(*) AS n, count(*) FILTER (o_orderdate IS NULL) AS l FROM orders GROUP BY o_orderkey)
    UNION ALL SELECT 'events', sum(n)::BIGINT, sum(n - 1)::BIGINT, sum(l)::BIGINT FROM (SELECT count(*) AS n, count(*) FILTER (ts IS NULL OR props IS NULL) AS l FROM events GROUP BY event_id)
""")
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda name, keys, provenance: quality.dataset_summary(S.table(spark, sf_dir, name), name, keys, provenance)
    return of("lineitem", ["l_orderkey", "l_linenumber"], ["l_shipdate"]).unionByName(of("orders", ["o_orderkey"], ["o_orderdate"])).unionByName(of("events", ["event_id"], ["ts", "props"]))


@query("WITH " + S.CALENDAR + """
    SELECT *, CASE WHEN n > 0 THEN 'failed' ELSE 'passed' END AS status FROM (
        SELECT 'bar_on_non_trading_date' AS issue, count(*) AS n FROM bars b LEFT JOIN (SELECT * FROM calendar WHERE is_trading_day AND extract('isodow' FROM calendar_date) <= 5) c ON trade_date = calendar_date WHERE calendar_date IS NULL
        UNION ALL SELECT 'invalid_ohlc', count(*) FROM bars WHERE NOT (high >= greatest(execution_close, low, signal_close) AND low <= least(execution_close, high, signal_close))
        UNION ALL SELECT 'invalid_five_minute_ohlc', count(*) FROM lineitem WHERE round(l_extendedprice / l_quantity, 2) <= 0 OR l_discount > 0.09)
""")
def quality_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = S.paired_bars(spark, sf_dir)
    days = S.calendar(bars).withColumn("is_trading_day", F.col("is_trading_day") & (F.weekday("calendar_date") < 5))
    # order lines as five-minute bars; those with the largest discount have a low above their close
    price = F.round(F.col("l_extendedprice") / F.col("l_quantity"), 2)
    short = S.table(spark, sf_dir, "lineitem").select(price.alias("open"), price.alias("high"), F.when(F.col("l_discount") > 0.09, price + 1).otherwise(price).alias("low"), price.alias("close"))
    return quality.quality_issues(bars.withColumn("open", F.col("execution_close")).withColumn("close", F.col("signal_close")), days, short)


@query("WITH " + S.CALENDAR + """
    SELECT CAST(d AS DATE) AS calendar_date FROM (SELECT unnest(generate_series(DATE '1994-06-01', DATE '2003-06-01', INTERVAL 1 DAY)) AS d)
    WHERE CAST(d AS DATE) NOT IN (SELECT calendar_date FROM calendar WHERE is_trading_day)
""")
def calendar_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.calendar_gaps(S.calendar(S.paired_bars(spark, sf_dir)).filter("is_trading_day"), date(1994, 6, 1), date(2003, 6, 1))


_EXPECTED = "SELECT DISTINCT index_code, 25 AS usual FROM members"


@query("WITH " + S.MEMBERSHIPS + f""",
    wanted AS (SELECT * FROM (SELECT DISTINCT snapshot_date FROM members) CROSS JOIN ({_EXPECTED}))
    SELECT w.snapshot_date, w.index_code, count(DISTINCT member_code) AS members,
           CASE WHEN w.snapshot_date = DATE '1998-03-01' AND w.index_code = 'ECONOMY' THEN 24 ELSE usual END AS expected,
           count(DISTINCT member_code) = CASE WHEN w.snapshot_date = DATE '1998-03-01' AND w.index_code = 'ECONOMY' THEN 24 ELSE usual END AS complete
    FROM wanted w LEFT JOIN members m ON w.snapshot_date = m.snapshot_date AND w.index_code = m.index_code GROUP BY w.snapshot_date, w.index_code, usual
""")
def membership_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = S.memberships(spark, sf_dir)
    expected = members.select("index_code").distinct().select("index_code", F.lit(None).cast("date").alias("valid_date"), F.lit(25).alias("expected"))
    expected = expected.unionByName(spark.sql("SELECT 'ECONOMY' AS index_code, DATE'1998-03-01' AS valid_date, 24 AS expected"))
    return quality.member_counts(members, members.select("snapshot_date").distinct(), expected)


@query("WITH " + S.MEMBERSHIPS + "SELECT snapshot_date, count(*) - count(DISTINCT member_code) AS duplicates FROM members GROUP BY 1")
def duplicate_member_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_member_pairs(S.memberships(spark, sf_dir))


@query("WITH " + S.LINES + "SELECT code AS member_code, count(DISTINCT index_code) AS names FROM line GROUP BY 1 HAVING count(DISTINCT index_code) > 1")
def name_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.name_conflicts(S.lines(spark, sf_dir).select(F.col("code").alias("member_code"), F.col("index_code").alias("member_name")))


@query("WITH " + S.BARS + "," + S.INSTRUMENTS + """
    SELECT b.trade_date, b.code, b.trade_date >= ipo_date AND (out_date IS NULL OR b.trade_date < out_date) AS listed FROM bars b JOIN instruments i ON b.code = i.code
""")
def listing_window_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = S.paired_bars(spark, sf_dir)
    return quality.listing_split(bars, S.instruments(bars))


@query("WITH " + S.TRACKS + """
    SELECT coalesce(s.code, e.code) AS code, coalesce(s.trade_date, e.trade_date) AS trade_date,
           CASE WHEN s.code IS NULL THEN 'only_execution' WHEN e.code IS NULL THEN 'only_signal' WHEN s.volume <> e.volume THEN 'volume' ELSE 'paired' END AS pairing
    FROM signal s FULL OUTER JOIN execution e ON s.code = e.code AND s.trade_date = e.trade_date
""")
def price_track_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal, execution = S.tracks(S.paired_bars(spark, sf_dir))
    return trading.pair_tracks(signal, execution).select("code", "trade_date", "pairing")


@query("WITH " + S.TRACKS + """
    SELECT trade_date, code, 'signal' AS only_in FROM signal WHERE (code, trade_date) NOT IN (SELECT (code, trade_date) FROM execution)
    UNION ALL SELECT trade_date, code, 'execution' FROM execution WHERE (code, trade_date) NOT IN (SELECT (code, trade_date) FROM signal)
""")
def price_track_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal, execution = S.tracks(S.paired_bars(spark, sf_dir))
    return quality.symmetric_difference(signal, execution, ["trade_date", "code"], ("signal", "execution"))


@query("WITH " + S.TRACKS + """
    SELECT u.trade_date, u.code, u.trade_status AS u, s.trade_status AS s, e.volume % 5 <> 1 AS e
    FROM bars u JOIN signal s ON u.code = s.code AND u.trade_date = s.trade_date JOIN execution e ON u.code = e.code AND u.trade_date = e.trade_date
    WHERE u.trade_status <> s.trade_status OR u.trade_status <> (e.volume % 5 <> 1)
""")
def status_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = S.paired_bars(spark, sf_dir)
    signal, execution = S.tracks(bars)
    return quality.status_mismatches(bars, signal, execution.withColumn("trade_status", F.col("volume") % 5 != 1))


@query("""
    SELECT event_type, count(*) FILTER (ts > CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL '7 hours 5 minutes') AS late, count(*) AS rows FROM events GROUP BY 1
""")
def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "events").groupBy("event_type").agg(quality.late_rows(None, "to_date(ts)", "ts").alias("late"), F.count("*").alias("rows"))


@query("WITH " + S.BARS + "," + S.UNIVERSE + """
    SELECT code, count(*) AS expected, count(trade_date) AS covered, round(count(trade_date) / count(*), 8) AS ratio
    FROM (SELECT u.code, b.trade_date FROM universe u LEFT JOIN bars b ON u.code = b.code AND u.snapshot_date = b.trade_date) GROUP BY 1
""")
def opening_coverage_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.opening_coverage(S.universe(spark, sf_dir).withColumnRenamed("snapshot_date", "trade_date"), S.paired_bars(spark, sf_dir))


@query("WITH " + S.TRACKS + "," + S.UNIVERSE + """,
    a AS (SELECT count(*) AS universe_days FROM universe),
    b AS (SELECT count(*) AS missing_bars FROM universe u LEFT JOIN bars b ON u.code = b.code AND snapshot_date = trade_date WHERE b.code IS NULL),
    c AS (SELECT count(*) AS missing_signal FROM execution WHERE (code, trade_date) NOT IN (SELECT (code, trade_date) FROM signal)),
    d AS (SELECT count(*) AS missing_execution FROM signal WHERE (code, trade_date) NOT IN (SELECT (code, trade_date) FROM execution))
    SELECT *, CASE WHEN universe_days > 0 AND missing_bars = 0 AND missing_signal = 0 AND missing_execution = 0 THEN 'passed' ELSE 'failed' END AS status FROM a, b, c, d
""")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = S.paired_bars(spark, sf_dir)
    signal, execution = S.tracks(bars)
    wanted = S.universe(spark, sf_dir).withColumnRenamed("snapshot_date", "trade_date")
    keys = ["trade_date", "code"]
    counts = {"universe_days": wanted, "missing_bars": quality.missing(wanted, bars, keys), "missing_signal": quality.missing(execution, signal, keys), "missing_execution": quality.missing(signal, execution, keys)}
    return quality.coverage_report(counts, list(counts)[1:], "universe_days")


@query("WITH " + S.BARS + "," + S.UNIVERSE + """
    SELECT snapshot_date AS trade_date, u.code FROM universe u LEFT JOIN bars b ON u.code = b.code AND snapshot_date = trade_date WHERE b.code IS NULL ORDER BY 1, 2 LIMIT 100
""")
def missing_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = S.universe(spark, sf_dir).withColumnRenamed("snapshot_date", "trade_date")
    return quality.samples(quality.missing(wanted, S.paired_bars(spark, sf_dir), ["trade_date", "code"]))


# -- features and strategies ------------------------------------------------------------------------

FEATURES = S.BARS + """,
    priced AS (SELECT *, signal_close / lag(signal_close) OVER w - 1 AS r, row_number() OVER w AS observations, signal_close / lag(signal_close, 20) OVER w - 1 AS momentum,
                      signal_close / lag(signal_close, 5) OVER w - 1 AS short_return FROM bars WHERE trade_status WINDOW w AS (PARTITION BY code ORDER BY trade_date)),
    vol AS (SELECT *, CASE WHEN count(r) OVER v = 20 THEN stddev_samp(r) OVER v * sqrt(252) END AS volatility FROM priced WINDOW v AS (PARTITION BY code ORDER BY trade_date ROWS 19 PRECEDING)),
    features AS (
        SELECT code, trade_date, observations, momentum, short_return, volatility, momentum / nullif(volatility, 0) AS score,
               CASE WHEN is_st THEN 'st_stock' WHEN observations < 21 THEN 'insufficient_history' WHEN round(volatility, 12) = 0 THEN 'zero_volatility' END AS exclusion FROM vol
        UNION ALL SELECT code, trade_date, NULL, NULL, NULL, NULL, NULL, 'not_tradable' FROM bars WHERE NOT trade_status
    )"""


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.price_features(S.paired_bars(spark, sf_dir))


@query("WITH " + FEATURES + "SELECT code, trade_date, observations, round(momentum, 6) AS momentum, round(short_return, 6) AS short_return, round(volatility, 6) AS volatility, round(score, 6) AS score, exclusion FROM features")
def price_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).select("code", "trade_date", F.col("observations").cast("long").alias("observations"), r6("momentum"), r6("short_return"), r6("volatility"), r6("score"), "exclusion")


@query("WITH " + FEATURES + """
    SELECT trade_date, code, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, code) AS rank FROM features WHERE exclusion IS NULL AND momentum > 0) WHERE rank <= 10
""")
def momentum_top10_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.momentum_candidates(_features(spark, sf_dir)).select("trade_date", "code", F.col("rank").cast("long").alias("rank"), r6("score"))


POOL = FEATURES + """,
    pool AS (
        SELECT trade_date, 'momentum' AS strategy, code, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, code) AS rank, score, 1 / volatility AS inverse_volatility FROM features WHERE exclusion IS NULL AND momentum > 0
        UNION ALL SELECT trade_date, 'short_term_reversal', code, row_number() OVER (PARTITION BY trade_date ORDER BY short_return / volatility, code), -(short_return / volatility), 1 / volatility FROM features WHERE exclusion IS NULL AND short_return < 0
        UNION ALL SELECT trade_date, 'defensive_low_volatility', code, row_number() OVER (PARTITION BY trade_date ORDER BY volatility, code), -volatility, 1 / volatility FROM features WHERE exclusion IS NULL
    ),
    intents AS (SELECT * FROM pool WHERE rank <= 10)"""


@query("WITH " + POOL + "SELECT trade_date, strategy, code, rank, round(score, 6) AS score, round(inverse_volatility, 6) AS inverse_volatility FROM intents")
def strategy_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.strategy_pool(_features(spark, sf_dir)).select("trade_date", "strategy", "code", F.col("rank").cast("long").alias("rank"), r6("score"), r6("inverse_volatility"))


WEIGHTS = POOL + """,
    kept AS (SELECT *, row_number() OVER (PARTITION BY trade_date, strategy ORDER BY inverse_volatility DESC, code) - 1 AS k, sum(inverse_volatility) OVER (PARTITION BY trade_date, strategy ORDER BY inverse_volatility DESC, code ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM intents WHERE rank <= 8),
    run AS (SELECT *, min(CASE WHEN (0.95 - k * 0.2) * inverse_volatility / rest > 0.2 THEN 1 ELSE 0 END) OVER (PARTITION BY trade_date, strategy ORDER BY inverse_volatility DESC, code ROWS UNBOUNDED PRECEDING) AS capped FROM kept),
    freed AS (SELECT *, sum(capped) OVER g AS m, max(CASE WHEN capped = 0 THEN rest END) OVER g AS free FROM run WINDOW g AS (PARTITION BY trade_date, strategy)),
    weights AS (SELECT trade_date, strategy, code, rank, floor((CASE WHEN capped = 1 THEN 0.2 ELSE (0.95 - m * 0.2) * inverse_volatility / free END) * 1e8 + 1e-6) / 1e8 AS weight FROM freed)"""


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allocate.capped_weights(features.strategy_pool(_features(spark, sf_dir)), ["trade_date", "strategy"])


@query("WITH " + WEIGHTS + "SELECT trade_date, strategy, code, rank, round(weight, 8) AS weight FROM weights")
def waterfill_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, sf_dir).select("trade_date", "strategy", "code", F.col("rank").cast("long").alias("rank"), r8("weight"))


@query("WITH " + WEIGHTS + """
    SELECT trade_date, strategy, 'over_gross' AS "check" FROM weights GROUP BY ALL HAVING sum(weight) > 0.6 + 1e-12
    UNION ALL SELECT trade_date, strategy, 'over_cap' FROM weights GROUP BY ALL HAVING max(weight) > 0.15 + 1e-12
""")
def target_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allocate.target_violations(_weights(spark, sf_dir), ["trade_date", "strategy"], cap=0.15, gross=0.6)


@query("WITH " + WEIGHTS + """,
    days AS (SELECT trade_date, lead(trade_date) OVER (ORDER BY trade_date) AS following FROM (SELECT DISTINCT trade_date FROM weights)),
    old AS (SELECT following AS trade_date, strategy, code, weight AS a FROM weights JOIN days USING (trade_date) WHERE following IS NOT NULL),
    moved AS (SELECT coalesce(o.trade_date, n.trade_date) AS trade_date, coalesce(o.strategy, n.strategy) AS strategy, coalesce(a, 0) AS a, coalesce(weight, 0) AS b FROM old o FULL OUTER JOIN weights n ON o.trade_date = n.trade_date AND o.strategy = n.strategy AND o.code = n.code)
    SELECT trade_date, strategy, round((sum(abs(a - b)) + abs(sum(a) - sum(b))) / 2, 8) AS turnover FROM moved GROUP BY ALL
""")
def turnover_between_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = _weights(spark, sf_dir)
    days = weights.select("trade_date").distinct()
    following = F.lead("trade_date").over(features.W.orderBy("trade_date"))  # one row a day
    old = weights.join(days.withColumn("next", following), "trade_date").filter("next IS NOT NULL").select(F.col("next").alias("trade_date"), "strategy", "code", "weight")
    return allocate.turnover(old, weights, ["trade_date", "strategy"]).select("trade_date", "strategy", r8("turnover"))


@query("WITH " + WEIGHTS + """,
    m AS (SELECT * FROM weights WHERE strategy = 'momentum'), l AS (SELECT * FROM weights WHERE strategy = 'defensive_low_volatility')
    SELECT coalesce(m.trade_date, l.trade_date) AS trade_date, coalesce(m.code, l.code) AS code, round(coalesce(l.weight, 0) - coalesce(m.weight, 0), 8) AS change
    FROM m FULL OUTER JOIN l ON m.trade_date = l.trade_date AND m.code = l.code WHERE abs(coalesce(l.weight, 0) - coalesce(m.weight, 0)) > 1e-8
""")
def weight_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = _weights(spark, sf_dir)
    of = lambda name: weights.filter(F.col("strategy") == name)
    return features.weight_changes(of("momentum"), of("defensive_low_volatility"), ["trade_date", "code"]).select("trade_date", "code", r8("change"))


@query("WITH " + S.BARS + """,
    r AS (SELECT trade_date, CASE WHEN trade_status THEN signal_close / lag(signal_close) OVER (PARTITION BY code ORDER BY trade_date) - 1 ELSE 0 END AS r FROM bars)
    SELECT trade_date, round(avg(r), 6) AS market_return, count(r) AS codes FROM r GROUP BY 1
""")
def equal_weight_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.market_returns(S.paired_bars(spark, sf_dir)).select("trade_date", r6("market_return"), "codes")


@query("WITH " + S.BARS + "SELECT code, trade_date, back FROM (SELECT code, trade_date, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS back FROM bars WHERE trade_status AND trade_date <= DATE '1999-12-31') WHERE back <= 21")
def last_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.last_bars(S.paired_bars(spark, sf_dir), 21, at="1999-12-31").select("code", "trade_date", F.col("back").cast("long").alias("back"))


@query("WITH " + S.BARS + """,
    k AS (SELECT *, count(CASE WHEN trade_status THEN 1 END) OVER (PARTITION BY code ORDER BY trade_date) AS k FROM bars),
    d AS (SELECT code, trade_date AS decision_date, k AS k_now FROM k WHERE extract('day' FROM trade_date) = 1)
    SELECT k.code, d.decision_date, k.trade_date FROM k JOIN d ON k.code = d.code AND k.trade_date <= d.decision_date AND k_now - k.k < 5 WHERE trade_status OR k.trade_date = d.decision_date
""")
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = S.paired_bars(spark, sf_dir)
    decisions = bars.filter(F.dayofmonth("trade_date") == 1).select("code", F.col("trade_date").alias("decision_date"))
    return features.history_window(bars, decisions, 5).select("code", "decision_date", "trade_date")


# -- regime -------------------------------------------------------------------------------------------

REGIME = S.BARS + """,
    one AS (SELECT *, signal_close / lag(signal_close) OVER w - 1 AS r, signal_close / lag(signal_close, 20) OVER w - 1 AS trend, row_number() OVER w AS at FROM bars WHERE trade_status WINDOW w AS (PARTITION BY code ORDER BY trade_date)),
    seen AS (SELECT * FROM one WHERE trend IS NOT NULL),
    market AS (SELECT s.trade_date, s.at - o.at AS back, avg(o.r) AS m FROM seen s JOIN one o ON s.code = o.code AND o.at > s.at - 20 AND o.at <= s.at GROUP BY ALL),
    vol AS (SELECT trade_date, stddev_samp(m) * sqrt(252) AS annualized_volatility FROM market GROUP BY 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY amount DESC, code) AS place, count(*) OVER (PARTITION BY trade_date) AS n FROM seen),
    size AS (SELECT trade_date, count(*) AS universe_size FROM bars GROUP BY 1),
    regime AS (
        SELECT r.trade_date, avg(trend) AS trend_return, any_value(v.annualized_volatility) AS annualized_volatility, avg(CASE WHEN trend > 0 THEN 1.0 ELSE 0.0 END) AS breadth, avg(turnover) AS average_turnover,
               sum(CASE WHEN place <= greatest(1, ceil(n * 0.1)) THEN amount END) / sum(amount) AS concentration, any_value(universe_size) AS universe_size, count(*) / any_value(universe_size) AS daily_coverage
        FROM ranked r JOIN vol v ON r.trade_date = v.trade_date JOIN size s ON r.trade_date = s.trade_date GROUP BY r.trade_date
        HAVING any_value(universe_size) >= 5 AND count(*) / any_value(universe_size) >= 0.8
    )"""


@query("WITH " + REGIME + """
    SELECT trade_date, round(trend_return, 6) AS trend_return, round(annualized_volatility, 6) AS annualized_volatility, round(breadth, 6) AS breadth, round(average_turnover, 6) AS average_turnover,
           round(concentration, 6) AS concentration, universe_size, round(daily_coverage, 6) AS daily_coverage FROM regime
""")
def regime_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = regime.regime_features(S.paired_bars(spark, sf_dir))
    return out.select("trade_date", r6("trend_return"), r6("annualized_volatility"), r6("breadth"), r6("average_turnover"), r6("concentration"), "universe_size", r6("daily_coverage"))


@query("WITH " + REGIME + """,
    c AS (SELECT s.trade_date, universe_size, coalesce(covered, 0) AS covered FROM size s LEFT JOIN (SELECT trade_date, count(*) AS covered FROM seen GROUP BY 1) k ON k.trade_date = s.trade_date)
    SELECT trade_date, 'universe_size' AS gate, universe_size::DOUBLE AS value, 5.0::DOUBLE AS least FROM c WHERE universe_size < 5
    UNION ALL SELECT trade_date, 'daily_coverage', round(covered / universe_size, 8), 0.8::DOUBLE FROM c WHERE covered / universe_size < 0.8
""")
def regime_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regime.regime_gates(S.paired_bars(spark, sf_dir)).select("trade_date", "gate", r8("value"), "least")


LABELS = REGIME + """,
    terms AS (
        SELECT *, least(greatest(trend_return / 0.08, -2), 2) AS t, least(greatest((annualized_volatility - 0.2) / 0.15, -2), 2) AS v, least(greatest((breadth - 0.5) / 0.25, -2), 2) AS b,
               least(greatest(average_turnover - 1.0, -2), 2) AS u, least(greatest((concentration - 0.2) / 0.2, -2), 2) AS c FROM regime
    ),
    scores AS (
        SELECT *, 0.35 * t + 0.25 * b + 0.1 * u - 0.1 * v - 0.05 * c AS s1, 0.35 * (1 - least(abs(t), 1)) + 0.2 * (1 - least(abs(b), 1)) + 0.2 * u - 0.15 * v AS s2,
               -0.25 * t - 0.2 * b + 0.25 * v + 0.2 * c AS s3, -0.35 * t - 0.2 * b + 0.25 * v + 0.1 * c AS s4 FROM terms
    ),
    probs AS (SELECT *, exp(s1 / 0.75) AS e1, exp(s2 / 0.75) AS e2, exp(s3 / 0.75) AS e3, exp(s4 / 0.75) AS e4 FROM scores),
    labels AS (
        SELECT *, e1 / (e1 + e2 + e3 + e4) AS p1, e2 / (e1 + e2 + e3 + e4) AS p2, e3 / (e1 + e2 + e3 + e4) AS p3, e4 / (e1 + e2 + e3 + e4) AS p4,
               annualized_volatility >= 0.45 OR (trend_return <= -0.12 AND breadth <= 0.2) AS emergency FROM probs
    )"""


@query("WITH " + LABELS + """
    SELECT trade_date, round(p1, 8) AS p_risk_on, round(p2, 8) AS p_mean_reverting, round(p3, 8) AS p_defensive, round(1 - (round(p1, 8) + round(p2, 8) + round(p3, 8)), 8) AS p_risk_off, emergency,
           CASE WHEN emergency OR p4 >= greatest(p1, p2, p3) THEN 'risk_off' WHEN p1 >= greatest(p2, p3) THEN 'risk_on' WHEN p2 >= p3 THEN 'mean_reverting' ELSE 'defensive' END AS selected FROM labels
""")
def regime_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = regime.regime_labels(regime.regime_features(S.paired_bars(spark, sf_dir)))
    return out.select("trade_date", r8("p_risk_on"), r8("p_mean_reverting"), r8("p_defensive"), r8("p_risk_off"), "emergency", "selected")


REPLAY = f"""
    label AS (
        WITH {LABELS}
        SELECT trade_date, emergency, round(p1, 8) AS p1, round(p2, 8) AS p2, round(p3, 8) AS p3, round(1 - (round(p1, 8) + round(p2, 8) + round(p3, 8)), 8) AS p4,
               CASE WHEN emergency OR p4 >= greatest(p1, p2, p3) THEN 'cash' WHEN p1 >= greatest(p2, p3) THEN 'momentum' WHEN p2 >= p3 THEN 'short_term_reversal' ELSE 'defensive_low_volatility' END AS recommended FROM labels
    ),
    target AS (
        SELECT trade_date, map_from_entries(list((strategy, m))) AS desired FROM (
            SELECT trade_date, strategy, map_from_entries(list((code, CAST(round(weight * 1e8) AS BIGINT)))) AS m FROM (WITH {WEIGHTS} SELECT * FROM weights) GROUP BY ALL) GROUP BY 1
    ),
    d AS (
        SELECT l.trade_date, emergency, recommended, desired, row_number() OVER (ORDER BY l.trade_date) AS n,
               MAP {{'momentum': p1, 'short_term_reversal': p2, 'defensive_low_volatility': p3, 'cash': p4}} AS p
        FROM label l LEFT JOIN target t ON t.trade_date = l.trade_date
    ),
    scenario AS (SELECT i AS scenario, 2000000 * (1 + i % 10) AS most, 0.02 * ((i // 10) % 5)::DOUBLE AS hysteresis, 1 + i // 50 AS change_every FROM (SELECT unnest(range(0, 200)) AS i)),
    step AS (
        SELECT scenario, most, hysteresis, change_every, 0::BIGINT AS n, NULL::VARCHAR AS active, MAP {{}}::MAP(VARCHAR, BIGINT) AS held, 0::BIGINT AS moved FROM scenario
        UNION ALL
        SELECT scenario, most, hysteresis, change_every, n, active, CASE WHEN whole THEN wanted WHEN way <= 0 THEN held ELSE blended END,
               CASE WHEN whole THEN full_ WHEN way <= 0 THEN 0 ELSE list_sum(list_transform(z, lambda x: abs(greatest(part(x.a, x.b, full_, way), 0) - x.a))) + abs(list_sum(list_transform(z, lambda x: greatest(part(x.a, x.b, full_, way), 0) - x.a))) END::BIGINT
        FROM (
            SELECT *, map_from_entries(list_filter(list_transform(z, lambda x: (x.c, part(x.a, x.b, full_, way))), lambda e: e[2] > 0)) AS blended FROM (
                SELECT *, first_ OR emergency OR full_ <= 2 * most AS whole, 2 * (most - len(z) - 1) AS way FROM (
                    SELECT *, (coalesce(list_sum(list_transform(z, lambda x: abs(x.b - x.a))), 0) + abs(coalesce(list_sum(list_transform(z, lambda x: x.b - x.a)), 0)))::BIGINT AS full_ FROM (
                        SELECT *, list_transform(list_sort(list_distinct(list_concat(map_keys(held), map_keys(wanted)))), lambda c: {{'c': c, 'a': coalesce(held[c], 0), 'b': coalesce(wanted[c], 0)}}) AS z FROM (
                            SELECT *, CASE WHEN emergency OR active = 'cash' THEN MAP {{}}::MAP(VARCHAR, BIGINT) ELSE coalesce(desired[active], MAP {{}}::MAP(VARCHAR, BIGINT)) END AS wanted FROM (
                                SELECT s.scenario, most, hysteresis, change_every, d.n, held, emergency, desired, s.active IS NULL AS first_,
                                       CASE WHEN s.active IS NULL OR s.active = recommended THEN recommended WHEN (d.n - 1) % change_every <> 0 THEN s.active WHEN emergency THEN 'cash'
                                            WHEN p[recommended] - p[s.active] >= hysteresis THEN recommended ELSE s.active END AS active
                                FROM step s JOIN d ON d.n = s.n + 1))))))
    )""".replace("part(x.a, x.b, full_, way)", "(x.a * full_ + (x.b - x.a) * way) // full_")


@query("WITH RECURSIVE " + REPLAY + """
    SELECT CAST(scenario AS INT) AS scenario, d.trade_date, active AS active_strategy, array_to_string(list_transform(list_sort(map_entries(held)), lambda e: e.key || ':' || e.value), ',') AS held, moved FROM step JOIN d ON d.n = step.n
""")
def scenario_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = S.paired_bars(spark, sf_dir)
    labels = regime.regime_labels(regime.regime_features(bars)).select("trade_date", "selected", "emergency", *[r8(f"p_{k}") for k in regime.LABELS])
    number = F.col("id")
    scenarios = spark.range(200).select(number.cast("int").alias("scenario"), (0.02 * (1 + number % 10)).alias("max_turnover"), (0.02 * (F.floor(number / 10) % 5)).alias("hysteresis"), (1 + F.floor(number / 50)).alias("change_every"))
    out = allocate.replay(labels, allocate.capped_weights(features.strategy_pool(features.price_features(bars)), ["trade_date", "strategy"]), scenarios)
    written = F.array_join(F.transform(F.array_sort(F.map_entries("weights")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return out.select("scenario", "trade_date", "active_strategy", written.alias("held"), "moved")


# -- risk and orders -----------------------------------------------------------------------------------


def _decisions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Momentum targets against positions that follow from the bars: a few lots of every third code."""
    bars = S.paired_bars(spark, sf_dir)
    states = trading.decision_states(bars)
    targets = allocate.capped_weights(features.momentum_candidates(features.price_features(bars)).withColumn("inverse_volatility", 1 / F.col("volatility")), ["trade_date"])
    number = F.regexp_extract("code", r"(\d+)$", 1).cast("int")
    positions = bars.filter(number % 3 == 0).select("trade_date", "code", (F.lit(100) * (1 + number % 4) + 50).cast("long").alias("quantity"), F.when(F.col("volume") % 4 == 0, 0).otherwise(100 * (1 + number % 4) + 50).cast("long").alias("sellable"))
    cash = bars.select("trade_date").distinct().select("trade_date", F.lit(400000).cast("decimal(24,2)").alias("cash"))
    held = positions.join(bars.select("trade_date", "code", "execution_close"), ["trade_date", "code"])
    value = held.groupBy("trade_date").agg(F.sum(F.col("quantity") * F.col("execution_close")).alias("v"))
    equities = cash.join(value, "trade_date", "left").select("trade_date", (400000.0 + F.coalesce("v", F.lit(0.0))).alias("equity"))
    return targets, positions, states, equities, cash


RISK = WEIGHTS.replace("WITH", "") + """,
    state AS (SELECT *, last_value(execution_close IGNORE NULLS) OVER (PARTITION BY code ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_close FROM bars),
    position AS (SELECT trade_date, code, 100 * (1 + n % 4) + 50 AS quantity, CASE WHEN volume % 4 = 0 THEN 0 ELSE 100 * (1 + n % 4) + 50 END AS sellable, execution_close
                 FROM (SELECT *, CAST(regexp_extract(code, '(\\d+)$', 1) AS INT) AS n FROM bars) WHERE n % 3 = 0),
    eq AS (SELECT d.trade_date, 400000.0::DOUBLE + coalesce(v, 0) AS equity FROM (SELECT DISTINCT trade_date FROM bars) d LEFT JOIN (SELECT trade_date, sum(quantity * execution_close) AS v FROM position GROUP BY 1) p ON d.trade_date = p.trade_date),
    target AS (SELECT trade_date, code, rank, weight FROM weights WHERE strategy = 'momentum'),
    j AS (
        SELECT coalesce(t.trade_date, p.trade_date) AS trade_date, coalesce(t.code, p.code) AS code, coalesce(weight, 0) AS requested_weight, coalesce(rank, 10000) AS rank, quantity, sellable
        FROM target t FULL OUTER JOIN position p ON t.trade_date = p.trade_date AND t.code = p.code
    ),
    cur AS (
        SELECT j.*, equity, s.execution_close, s.previous_close, s.trade_status, s.volume, s.is_st, coalesce(coalesce(quantity, 0) * s.execution_close / equity, 0) AS current_weight, CASE WHEN s.is_st THEN 0.05 ELSE 0.10 END AS ratio
        FROM j JOIN eq e ON j.trade_date = e.trade_date LEFT JOIN state s ON j.trade_date = s.trade_date AND j.code = s.code
    ),
    limits AS (
        SELECT *, coalesce(execution_close >= round(CAST(previous_close AS DECIMAL(20, 6)) * CAST(1 + ratio AS DECIMAL(4, 2)), 2), true) AS up, coalesce(execution_close <= round(CAST(previous_close AS DECIMAL(20, 6)) * CAST(1 - ratio AS DECIMAL(4, 2)), 2), true) AS down FROM cur
    ),
    risk AS (
        SELECT *, CASE WHEN requested_weight > current_weight THEN CASE WHEN NOT coalesce(trade_status AND volume > 0, false) THEN 'suspended' WHEN is_st THEN 'st_buy_blocked' WHEN up THEN 'limit_up' END
                       WHEN requested_weight < current_weight THEN CASE WHEN NOT coalesce(trade_status AND volume > 0, false) THEN 'suspended' WHEN down THEN 'limit_down' WHEN quantity > 0 AND sellable = 0 THEN 't_plus_one' END END AS reason FROM limits
    )"""


@query("WITH " + RISK + "SELECT trade_date, code, round(requested_weight, 8) AS requested_weight, round(CASE WHEN reason IS NULL THEN requested_weight ELSE current_weight END, 8) AS approved_weight, reason FROM risk")
def risk_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets, positions, states, equities, _ = _decisions(spark, sf_dir)
    return trading.hard_risk(targets, positions, states, equities).select("trade_date", "code", r8("requested_weight"), r8("approved_weight"), "reason")


@query("WITH " + RISK + """,
    d AS (SELECT *, CAST(floor(equity * requested_weight / execution_close) AS BIGINT) AS shares FROM risk WHERE reason IS NULL AND trade_status),
    e AS (SELECT *, shares - shares % 100 AS desired, least(coalesce(quantity, 0) - (shares - shares % 100), coalesce(sellable, 0)) AS asked FROM d),
    q AS (SELECT *, CASE WHEN desired = 0 THEN asked ELSE asked - asked % 100 END AS n FROM e WHERE NOT coalesce(execution_close <= round(CAST(previous_close AS DECIMAL(20, 6)) * 0.90, 2), true))
    SELECT trade_date, code, 'sell' AS side, n AS quantity, round(execution_close, 2) AS price,
           CAST(round(greatest(n * CAST(execution_close AS DECIMAL(20, 6)) * 0.0003, 5) + n * CAST(execution_close AS DECIMAL(20, 6)) * 0.00001 + n * CAST(execution_close AS DECIMAL(20, 6)) * 0.0005, 2) AS DOUBLE) AS fees
    FROM q WHERE n > 0
""")
def planned_sells(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets, positions, states, equities, _ = _decisions(spark, sf_dir)
    sells = trading.planned_sells(trading.hard_risk(targets, positions, states, equities))
    return sells.select("trade_date", "code", "side", "quantity", F.round("price", 2).alias("price"), F.col("fees").cast("double").alias("fees"))


@query("WITH RECURSIVE " + RISK + """,
    d AS (SELECT *, CAST(floor(equity * requested_weight / execution_close) AS BIGINT) AS shares FROM risk WHERE reason IS NULL AND trade_status AND execution_close IS NOT NULL AND NOT up),
    a AS (SELECT *, shares - shares % 100 - coalesce(quantity, 0) AS delta FROM d),
    o AS MATERIALIZED (
        SELECT * FROM (SELECT trade_date, code, delta - delta % 100 AS asked, CAST(execution_close AS DECIMAL(12, 2)) AS price, row_number() OVER (PARTITION BY trade_date ORDER BY rank, code) AS k FROM a WHERE delta - delta % 100 > 0) WHERE k <= 8
    ),
    r AS (
        SELECT DISTINCT trade_date, 0::BIGINT AS k, CAST(400000 AS DECIMAL(24, 2)) AS cash, NULL::VARCHAR AS code, 0::BIGINT AS quantity, CAST(0 AS DECIMAL(12, 2)) AS price, CAST(0 AS DECIMAL(20, 2)) AS fees FROM o
        UNION ALL
        SELECT trade_date, k, CAST(cash - CASE WHEN q > 0 THEN q * price + f ELSE 0 END AS DECIMAL(24, 2)), code, q, price, CAST(f AS DECIMAL(20, 2)) FROM (
            SELECT *, CAST(round(greatest(q * price * 0.0003, 5) + q * price * 0.00001, 2) AS DECIMAL(20, 2)) AS f FROM (
                SELECT o.trade_date, o.k, r.cash, o.code, o.price, coalesce(list_filter(list_transform(range(0, 4 + CAST(ceil(10 / (o.price * 100)) AS BIGINT)), lambda i: least(o.asked, CAST(floor(r.cash / (o.price * 100)) AS BIGINT) * 100) - i * 100),
                       lambda n: n > 0 AND n * o.price + round(greatest(n * o.price * 0.0003, 5) + n * o.price * 0.00001, 2) <= r.cash)[1], 0) AS q
                FROM r JOIN o ON o.trade_date = r.trade_date AND o.k = r.k + 1)))
    SELECT trade_date, row_number() OVER (PARTITION BY trade_date ORDER BY k) - 1 AS place, 'buy' AS side, code, quantity, price, fees, last_cash AS cash_after
    FROM (SELECT *, min(cash) OVER (PARTITION BY trade_date) AS last_cash FROM r) WHERE quantity > 0
""")
def planned_buys(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets, positions, states, equities, cash = _decisions(spark, sf_dir)
    return trading.planned_buys(trading.hard_risk(targets, positions, states, equities), cash)


@query("WITH " + S.BARS + """,
    marks AS (SELECT DISTINCT code, CAST(date_trunc('month', trade_date) AS DATE) AS as_of FROM bars)
    SELECT m.code, as_of, b.execution_close AS price, b.trade_date AS priced_on FROM marks m ASOF LEFT JOIN bars b ON m.code = b.code AND m.as_of >= b.trade_date
""")
def latest_price_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = S.paired_bars(spark, sf_dir)
    return trading.latest_price(bars, bars.select("code", F.trunc("trade_date", "month").alias("as_of")).distinct())


@query("WITH " + S.BARS + "," + S.UNIVERSE + """,
    b AS (SELECT *, lag(execution_close) OVER (PARTITION BY code ORDER BY trade_date) AS previous_close FROM bars)
    SELECT u.code, snapshot_date AS trade_date, execution_close AS open, execution_close AS last, round(CAST(previous_close AS DECIMAL(20,6)) * 1.10, 2)::DOUBLE AS limit_up, round(CAST(previous_close AS DECIMAL(20,6)) * 0.90, 2)::DOUBLE AS limit_down,
           0.0::DOUBLE AS volume, 0.0::DOUBLE AS total_turnover FROM universe u JOIN b ON u.code = b.code AND snapshot_date = trade_date
""")
def opening_auction(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = S.paired_bars(spark, sf_dir).withColumn("previous_close", F.lag("execution_close").over(features.by_code())).withColumn("open", F.col("execution_close"))
    out = trading.opening_auction(S.universe(spark, sf_dir).withColumnRenamed("snapshot_date", "trade_date"), bars)
    return out.withColumns({c: F.col(c).cast("double") for c in ("limit_up", "limit_down")})


@query("WITH " + S.BARS + "," + S.UNIVERSE + """
    SELECT snapshot_date AS trade_date, u.code, coalesce(NOT trade_status, true) AS suspended, coalesce(is_st, false) AS is_st FROM universe u LEFT JOIN bars b ON u.code = b.code AND snapshot_date = trade_date
""")
def market_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trading.market_lookup(S.universe(spark, sf_dir).withColumnRenamed("snapshot_date", "trade_date"), S.paired_bars(spark, sf_dir)).select("trade_date", "code", "suspended", "is_st")
