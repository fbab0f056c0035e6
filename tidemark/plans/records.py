"""Queries over stored records: raw audits, provenance, order intents, research splits, terms of actions, overlay proposals."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions import market as rules
from ..operators import allocate, coverage, evaluation, ledger, overlay, publish, quality, regime, trading
from ..sources import requests
from ..sources.scratch import written
from . import ingest, market
from . import standins as S

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# -- raw data and requests --------------------------------------------------------------------------


@query("WITH " + ingest.VERSIONS + """
    SELECT (SELECT count(DISTINCT seen) FROM stored WHERE seen NOT IN (SELECT seen FROM incoming)) AS missing_payloads, count(*) FILTER (i.o_orderkey IS NULL) AS missing_rows, count(*) FILTER (s.o_orderkey IS NULL) AS unexpected_rows,
           count(*) FILTER (s.cents <> i.cents) AS mismatched_rows, 0::BIGINT AS duplicate_keys, (SELECT count(*) FROM incoming WHERE seen > TIMESTAMP '1998-06-01 00:00:00') AS future_rows, (SELECT count(*) FROM incoming WHERE o_custkey % 50 = 3) AS lost_provenance
    FROM stored s FULL OUTER JOIN incoming i ON s.o_orderkey = i.o_orderkey
""")
def raw_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, incoming = ingest._versions(spark, sf_dir)
    incoming = incoming.withColumn("source", F.when(F.col("o_custkey") % 50 != 3, "feed"))
    return publish.audit_stored(stored, incoming, ["o_orderkey"], ["o_custkey", "o_orderstatus", "cents"], provenance=["source", "seen"], day="seen", as_of=F.to_timestamp(F.lit("1998-06-01 00:00:00")), payload="seen")


@query("""
    SELECT o_orderpriority AS operation, count(*) FILTER (EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 4)) AS stored, count(*) FILTER (NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 4)) AS pending FROM orders GROUP BY 1
""")
def request_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = S.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("operation"))
    stored = S.table(spark, sf_dir, "lineitem").filter("l_linenumber = 4").select(F.col("l_orderkey").alias("o_orderkey"))
    return publish.request_status(asked, stored, "o_orderkey")


@query("""
    WITH p AS (SELECT sha256(o_orderpriority || CAST(CAST(o_orderdate AS DATE) AS VARCHAR)) AS payload, o_orderdate AS t FROM orders UNION ALL SELECT sha256(event_type || CAST(user_id AS VARCHAR)), ts FROM events),
    once AS (SELECT payload, min(t) AS a, max(t) AS b FROM p GROUP BY 1),
    part AS (SELECT substr(sha256(payload), 1, 3) AS part, count(*) AS n, sha256(string_agg(payload, chr(10) ORDER BY payload)) AS digest, min(a) AS a, max(b) AS b FROM once GROUP BY 1)
    SELECT sum(n)::BIGINT AS payloads, sha256(string_agg(digest, chr(10) ORDER BY part)) AS payload_set_hash, min(a) AS first_received, max(b) AS last_received FROM part
""")
def provenance_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = lambda table, payload, at: S.table(spark, sf_dir, table).select(F.sha2(payload, 256).alias("source_payload_sha256"), F.col(at).cast("timestamp").alias("source_received_at"))
    return quality.provenance_bounds([mark("orders", F.concat("o_orderpriority", F.col("o_orderdate").cast("date").cast("string")), "o_orderdate"), mark("events", F.concat("event_type", F.col("user_id").cast("string")), "ts")])


@query("WITH " + S.MEMBERSHIPS + """
    SELECT DISTINCT 'daily_bars' AS operation, member_code AS code, flag FROM members, (SELECT unnest(['2', '3']) AS flag)
""")
def history_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = S.memberships(spark, sf_dir)
    complete = members.select("snapshot_date").distinct().withColumn("complete", F.lit(True))
    return requests.history_requests(members, complete, date(1995, 1, 1), date(2001, 12, 31)).select("operation", "code", "flag")


# -- bars and terms -----------------------------------------------------------------------------------


@query("WITH " + S.BARS + """,
    b AS (SELECT *, trade_date + 2 - CAST(volume % 6 AS INT) AS decision_date FROM bars)
    SELECT decision_date, code, unnest(list_filter([CASE WHEN trade_date > decision_date THEN 'future_trade_date' END, CASE WHEN trade_date > decision_date THEN 'unavailable_at_as_of' END, CASE WHEN trade_status AND volume % 10 = 0 THEN 'tradable_without_price' END], lambda x: x IS NOT NULL)) AS "check" FROM b
""")
def snapshot_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = S.paired_bars(spark, sf_dir).withColumn("decision_date", F.date_sub(F.date_add("trade_date", 2), (F.col("volume") % 6).cast("int")))
    close = F.when(F.col("volume") % 10 != 0, F.col("signal_close"))
    return quality.snapshot_violations(bars.select("decision_date", F.col("decision_date").cast("timestamp").alias("as_of"), "code", "trade_date", F.col("trade_date").cast("timestamp").alias("available_at"), "trade_status", close.alias("signal_close"), "execution_close", F.col("execution_close").alias("previous_close")))


@query("WITH " + S.BARS + """
    SELECT trade_date AS decision_date, code, unnest(list_filter([CASE WHEN volume % 8 = 0 THEN 'not_the_checkpoint' END, CASE WHEN volume % 9 = 0 THEN 'previous_close' END], lambda x: x IS NOT NULL)) AS "check" FROM bars
""")
def checkpoint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("trade_date").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(1), F.when(F.col("volume") % 8 == 0, 40).otherwise(35))
    opening = S.paired_bars(spark, sf_dir).select(F.col("trade_date").alias("decision_date"), "code", at.alias("timestamp"), F.col("execution_close").alias("prior_close"), (F.col("execution_close") + F.when(F.col("volume") % 9 == 0, 1).otherwise(0)).alias("previous_close"))
    return coverage.checkpoint_violations(opening)


@query("WITH " + S.BARS + "SELECT code, trade_date FROM bars WHERE volume % 9 > 4")
def stale_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("trade_date").cast("timestamp")
    states = S.paired_bars(spark, sf_dir).select("code", "trade_date", at.alias("as_of"), F.date_sub("trade_date", (F.col("volume") % 9).cast("int")).cast("timestamp").alias("available_at"))
    return trading.stale_states(states).select("code", "trade_date")


@query("WITH " + S.BARS + "SELECT code, min(trade_date) AS first_bar, max(trade_date) AS last_bar, count(*) AS bars FROM bars GROUP BY 1")
def available_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trading.available_range(S.paired_bars(spark, sf_dir))


@query("""
    SELECT p_partkey AS code, p_type AS kind, CASE WHEN p_partkey % 3 = 0 THEN DATE '2000-01-01' + (p_partkey % 1000)::INT ELSE DATE '2099-12-31' END AS de_listed_date FROM part WHERE p_size % 2 = 1 AND p_type IN ('ECONOMY', 'PROMO', 'SMALL')
""")
def tradable_instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    out = F.when(key % 3 == 0, F.date_add(F.lit("2000-01-01").cast("date"), (key % 1000).cast("int")))
    stored = S.table(spark, sf_dir, "part").select(key.alias("code"), F.col("p_type").alias("kind"), (F.col("p_size") % 2).cast("string").alias("security_type"), out.alias("out_date"))
    return trading.tradable_instruments(stored, types=["ECONOMY", "PROMO", "SMALL"]).select("code", "kind", "de_listed_date")


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(CASE WHEN l_linenumber <> 2 THEN CAST(l_shipdate AS DATE) END, CASE WHEN l_linenumber <> 3 THEN CAST(l_shipdate AS DATE) + 3 END, CAST(l_shipdate AS DATE) + 5) AS announced_on,
           CASE WHEN l_linenumber <> 3 THEN CAST(l_shipdate AS DATE) + 3 ELSE CAST(l_shipdate AS DATE) + 5 END AS book_closed_on, CAST(l_shipdate AS DATE) + 5 AS ex_on, CASE WHEN l_linenumber <> 4 THEN CAST(l_shipdate AS DATE) + 9 ELSE CAST(l_shipdate AS DATE) + 5 END AS payable_on,
           CASE WHEN l_linenumber <> 5 THEN l_tax ELSE 0 END AS cash_per_share, round(1 + l_discount + CASE WHEN l_linenumber <> 6 THEN l_tax ELSE 0 END, 8) AS split_ratio FROM lineitem
""")
def action_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, day = F.col("l_linenumber"), F.col("l_shipdate").cast("date")
    terms = rules.dividend_terms(F.when(n != 2, day), F.when(n != 3, F.date_add(day, 3)), F.date_add(day, 5), F.when(n != 4, F.date_add(day, 9)), F.when(n != 5, F.col("l_tax")))
    return S.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[c.alias(k) for k, c in terms.items()], F.round(rules.split_ratio(F.col("l_discount"), F.when(n != 6, F.col("l_tax"))), 8).alias("split_ratio"))


@query("SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%H:%M:%S') AS wall FROM events")
def local_wall_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "events").select("event_id", rules.local_wall_time(F.col("ts").cast("timestamp")).alias("wall"))


@query("WITH " + S.TRACKS + "SELECT s.code, s.trade_date, greatest(s.trade_date, e.trade_date + CAST(e.volume % 2 AS INT)) AS available_on FROM signal s JOIN execution e ON s.code = e.code AND s.trade_date = e.trade_date")
def pair_available_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal, execution = S.tracks(S.paired_bars(spark, sf_dir))
    late = F.date_add("trade_date", (F.col("volume") % 2).cast("int")).alias("available_at")
    return trading.pair_available_at(signal.select("code", "trade_date", F.col("trade_date").alias("available_at")), execution.select("code", "trade_date", late)).withColumnRenamed("available_at", "available_on")


@query("WITH " + market.REGIME + """,
    o AS (SELECT trade_date, sum((execution_close / low - 1) * amount) / sum(amount) AS moved, count(*) AS opened FROM bars WHERE trade_status AND volume > 0 AND amount > 0 GROUP BY 1)
    SELECT r.trade_date, round(moved, 6) AS opening_return FROM regime r JOIN o ON r.trade_date = o.trade_date WHERE opened / round(universe_size * daily_coverage) >= 0.80
""")
def opening_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = S.paired_bars(spark, sf_dir)
    opening = bars.select("trade_date", "code", F.col("low").alias("open_price"), F.col("execution_close").alias("close_price"), "amount", "volume", "trade_status")
    return regime.with_opening(regime.regime_features(bars), opening).select("trade_date", F.round("opening_return", 6).alias("opening_return"))


# -- portfolios -----------------------------------------------------------------------------------------


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = S.paired_bars(spark, sf_dir)
    return bars.filter("volume % 3 = 0").select("trade_date", "code", F.col("volume").alias("quantity"), F.col("execution_close").alias("price"), F.lit(1000.0).alias("cash"))


@query("WITH " + S.BARS + """, p AS (SELECT trade_date, code, volume AS quantity, execution_close AS price FROM bars WHERE volume % 3 = 0), e AS (SELECT trade_date, 1000 + sum(quantity * price) AS equity FROM p GROUP BY 1)
    SELECT p.trade_date, code, round(equity, 2) AS equity, round(quantity * price / equity, 8) AS weight FROM p JOIN e ON p.trade_date = e.trade_date
""")
def current_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _positions(spark, sf_dir)
    rows = trading.current_weights(held, trading.equity(held, ["trade_date"]), ["trade_date"])
    return rows.select("trade_date", "code", F.round("equity", 2).alias("equity"), F.round("weight", 8).alias("weight"))


SELLS = S.BARS + ", sells AS (SELECT trade_date, code, volume AS quantity, CAST(execution_close AS DECIMAL(20, 6)) AS price, CAST(5 AS DECIMAL(20, 2)) AS fees FROM bars WHERE volume % 4 = 0)"


@query("WITH " + SELLS + "SELECT trade_date, code, CAST(100 + sum(quantity * price - fees) OVER (PARTITION BY trade_date ORDER BY code ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS cash_after FROM sells")
def cash_after_sells(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = S.paired_bars(spark, sf_dir)
    sells = bars.filter("volume % 4 = 0").select("trade_date", "code", F.col("volume").alias("quantity"), F.col("execution_close").alias("price"), F.lit(5).cast("decimal(20,2)").alias("fees"))
    cash = bars.select("trade_date").distinct().withColumn("cash", F.lit(100).cast("decimal(20,2)"))
    return trading.cash_after_sells(sells, cash).select("trade_date", "code", F.col("cash_after").cast("double").alias("cash_after"))


@query("WITH " + SELLS + "SELECT trade_date AS decision_id, count(*) AS orders, count(*) AS signals, true AS apart FROM sells GROUP BY 1")
def order_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = S.paired_bars(spark, sf_dir).filter("volume % 4 = 0").select(F.col("trade_date").alias("decision_id"), "code", F.lit("sell").alias("side"))
    made = ledger.order_intents(orders.unionByName(orders))  # planned twice, recorded once
    return made.groupBy("decision_id").agg(F.count("*").alias("orders"), F.countDistinct("signal_id").alias("signals"), F.bool_and(F.col("signal_id") != F.col("intent_id")).alias("apart"))


@query("WITH " + market.WEIGHTS + """,
    s AS (SELECT trade_date, sum(weight) AS w, count(*) AS n FROM weights WHERE strategy = 'momentum' GROUP BY 1)
    SELECT trade_date, round(0.1, 6) AS cash, round(1 - w, 6) AS "left" FROM s WHERE abs(0.1 - (1 - w)) > 1e-9
""")
def cash_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = market._weights(spark, sf_dir).filter("strategy = 'momentum'")
    cash = targets.select("trade_date").distinct().withColumn("cash", F.lit(0.1))
    return allocate.cash_violations(targets, cash, ["trade_date"]).select("trade_date", F.round("cash", 6).alias("cash"), F.round("left", 6).alias("left"))


@query("WITH " + market.POOL + """
    SELECT DISTINCT b.trade_date AS decision_id, b.code FROM bars b WHERE volume % 5 = 0 AND (trade_date, code) NOT IN (SELECT (trade_date, code) FROM intents)
""")
def proposals_outside_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    proposals = S.paired_bars(spark, sf_dir).filter("volume % 5 = 0").select(F.col("trade_date").alias("decision_id"), "code")
    pool = market.strategy_pool(spark, sf_dir).select(F.col("trade_date").alias("decision_id"), "code")
    return ledger.proposals_outside_pool(proposals, pool)


@query("WITH " + S.BARS + """,
    v AS (SELECT trade_date AS as_of, sum(amount) AS total_value FROM bars GROUP BY 1), c AS (SELECT trade_date AS as_of, sum(turnover) AS cost FROM bars WHERE volume % 2 = 0 GROUP BY 1),
    p AS (SELECT v.*, coalesce(cost, 0) AS cost, lag(total_value, 1, 1000000.0) OVER (ORDER BY v.as_of) AS before FROM v LEFT JOIN c ON v.as_of = c.as_of),
    k AS (SELECT trade_date AS as_of, (volume % 11 - 5) / 100 AS b FROM bars WHERE code = 'brand#11'), r AS (SELECT trade_date AS as_of FROM bars WHERE code = 'brand#12')
    SELECT p.as_of, round(total_value / before - 1, 8) AS net_return, round(cost / before, 8) AS cost_rate, round(b, 8) AS benchmark_return, CASE WHEN r.as_of IS NOT NULL THEN 'known' END AS regime,
           concat_ws(',', CASE WHEN b IS NULL THEN 'benchmark' END, CASE WHEN r.as_of IS NULL THEN 'regime' END) AS missing
    FROM p LEFT JOIN k ON p.as_of = k.as_of LEFT JOIN r ON p.as_of = r.as_of
""")
def evaluation_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = S.paired_bars(spark, sf_dir)
    values = bars.groupBy(F.col("trade_date").alias("as_of")).agg(F.sum("amount").alias("total_value")).withColumn("parameter_id", F.lit(1))
    trades = bars.filter("volume % 2 = 0").select(F.lit(1).alias("parameter_id"), F.col("trade_date").cast("timestamp").alias("traded_at"), F.col("turnover").alias("cost"))
    benchmark = bars.filter("code = 'brand#11'").select(F.col("trade_date").alias("as_of"), ((F.col("volume") % 11 - 5) / 100).alias("benchmark_return"))
    regimes = bars.filter("code = 'brand#12'").select(F.col("trade_date").alias("as_of"), F.lit("known").alias("regime"))
    out = evaluation.evaluation_periods(values, trades, benchmark, regimes, ["parameter_id"], 1_000_000.0)
    return out.select("as_of", *[F.round(c, 8).alias(c) for c in ("net_return", "cost_rate", "benchmark_return")], "regime", F.array_join("missing", ",").alias("missing"))


@query("""
    WITH s AS (SELECT CASE o_orderpriority[1:1] WHEN '1' THEN 'train' WHEN '2' THEN 'validation' ELSE 'test' END AS name, min(CAST(o_orderdate AS DATE)) AS first, max(CAST(o_orderdate AS DATE)) AS last FROM orders GROUP BY 1),
    n AS (SELECT *, lead(first) OVER (ORDER BY CASE name WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END) AS next_first FROM s)
    SELECT name, 'overlap' AS "check" FROM n WHERE last >= next_first
""")
def split_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.substring("o_orderpriority", 1, 1)
    name = F.when(kind == "1", "train").when(kind == "2", "validation").otherwise("test")
    splits = S.table(spark, sf_dir, "orders").groupBy(name.alias("name")).agg(F.min(F.col("o_orderdate").cast("date")).alias("first"), F.max(F.col("o_orderdate").cast("date")).alias("last"), F.sum("o_orderkey").alias("content_sum"))
    return evaluation.split_violations(splits)


@query("WITH " + S.BARS + """,
    p AS (SELECT code, trade_date, execution_close AS price, CAST(date_trunc('month', trade_date) + INTERVAL 1 MONTH AS TIMESTAMP) AS decided_at FROM bars WHERE volume % 6 <> 0)
    SELECT code, arg_max(price, (decided_at, trade_date)) AS price, arg_max(trade_date, (decided_at, trade_date)) AS trade_date FROM p WHERE decided_at <= TIMESTAMP '1997-07-15 00:00:00' GROUP BY 1
""")
def latest_decision_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = F.add_months(F.trunc("trade_date", "month"), 1).cast("timestamp")
    prices = S.paired_bars(spark, sf_dir).select("code", "trade_date", F.when(F.col("volume") % 6 != 0, F.col("execution_close")).alias("price"), decided.alias("decided_at"))
    return ledger.latest_decision_prices(prices, "1997-07-15 00:00:00").select("code", "price", "trade_date")


@query("WITH " + S.BARS + """
    SELECT code, trade_date, sha256('{"code":"' || code || '","configuration_id":"' || sha256('{"cap":"0.2","positions":"8"}') || '","trade_date":"' || CAST(trade_date AS VARCHAR) || '","volume":' || volume || '}') AS decision_id FROM bars
""")
def decision_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = {c: F.col(c) for c in ("trade_date", "code", "volume")}
    return S.paired_bars(spark, sf_dir).select("code", "trade_date", hashing.decision_id(stages, {"positions": "8", "cap": "0.2"}).alias("decision_id"))


@query("""
    WITH b AS (SELECT o_orderkey AS run_id, o_orderpriority AS regime, o_orderstatus AS pool FROM orders WHERE o_orderkey % 31 <> 0),
    s AS (SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 9 = 0 THEN 'other' ELSE o_orderpriority END AS regime, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS pool FROM orders)
    SELECT s.run_id, unnest(list_filter([CASE WHEN b.run_id IS NULL OR s.regime IS DISTINCT FROM b.regime THEN 'regime' END, CASE WHEN b.run_id IS NULL OR s.pool IS DISTINCT FROM b.pool THEN 'pool' END], lambda x: x IS NOT NULL)) AS stage FROM s LEFT JOIN b ON s.run_id = b.run_id
""")
def stage_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    orders = S.table(spark, sf_dir, "orders")
    base = orders.filter(k % 31 != 0).select(k.alias("run_id"), F.col("o_orderpriority").alias("regime"), F.col("o_orderstatus").alias("pool"))
    shadow = orders.select(k.alias("run_id"), F.when(k % 9 == 0, "other").otherwise(F.col("o_orderpriority")).alias("regime"), F.when(k % 5 != 0, F.col("o_orderstatus")).alias("pool"))
    return ledger.stage_differences(base, shadow, ["regime", "pool"])


# -- overlay ---------------------------------------------------------------------------------------------

DRAFTS = """
    d AS (
        SELECT o_orderkey AS k, o_orderkey % 11 AS a, o_orderkey % 13 AS b, o_orderkey % 17 AS c FROM orders
    ),
    e AS (
        SELECT k AS decision, list_filter([CASE WHEN a = 1 THEN 'identity.decision' END, CASE WHEN a = 2 THEN 'identity.snapshot' END, CASE WHEN b = 1 THEN 'window.made' END, CASE WHEN b = 2 THEN 'window.answered' END, CASE WHEN b = 3 THEN 'window.validity' END,
               CASE WHEN c = 1 THEN 'mix.repeated' END, CASE WHEN c = 2 THEN 'mix.unknown' END, CASE WHEN c IN (2, 3) THEN 'mix.sum' END, CASE WHEN c IN (3, 4) THEN 'mix.change' END, CASE WHEN a = 3 THEN 'evidence.unknown' END], lambda x: x IS NOT NULL) AS errors FROM d
    )"""


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as parsed proposals, some of them with faults."""
    k = F.col("o_orderkey")
    a, b, c = k % 11, k % 13, k % 17
    start = F.to_timestamp(F.lit("2024-01-02 07:00:00"))
    after = lambda minutes: start + F.make_dt_interval(F.lit(0), F.lit(0), minutes)
    item = lambda name, w: F.struct(F.lit(name).alias("strategy"), F.lit(w).alias("weight"))
    mix = (
        F.when(c == 1, F.array(item("momentum", "0.30"), item("momentum", "0.30"), item("short_term_reversal", "0.40"))).when(c == 2, F.array(item("momentum", "0.55"), item("short_term_reversal", "0.40"), item("other", "0.10")))
        .when(c == 3, F.array(item("momentum", "0.30"), item("short_term_reversal", "0.40"))).when(c == 4, F.array(item("momentum", "0.90"), item("short_term_reversal", "0.10"))).otherwise(F.array(item("momentum", "0.65"), item("short_term_reversal", "0.35")))
    )
    draft = F.struct(
        F.when(a == 1, "x").otherwise("decision").alias("decision_id"), F.when(a == 2, "x").otherwise("snapshot").alias("snapshot_id"), after(F.when(b == 1, 1).otherwise(12)).alias("generated_at"), after(F.when(b == 2, 14).when(b == 3, 70).otherwise(50)).alias("valid_until"),
        F.lit("1").alias("risk_scale"), mix.alias("strategy_weights"), F.array(F.struct(F.when(a == 3, "z").otherwise("x").alias("evidence_id"))).alias("evidence"),
    )
    return S.table(spark, sf_dir, "orders").select(
        k.alias("decision"), draft.alias("draft"), F.lit("decision").alias("base_decision_id"), F.lit("snapshot").alias("base_snapshot_id"), start.alias("as_of"), after(F.lit(10)).alias("requested_at"), after(F.lit(15)).alias("completed_at"), after(F.lit(60)).alias("deadline"),
        F.lit(False).alias("cache_hit"), F.create_map(F.lit("momentum"), F.lit(0.6), F.lit("short_term_reversal"), F.lit(0.4)).alias("base_weights"), F.array(F.lit("x"), F.lit("y")).alias("known_evidence"),
    )


@query("WITH " + DRAFTS + "SELECT decision, array_to_string(list_sort(errors), ',') AS errors FROM e")
def proposal_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = overlay.proposal_errors(drafts(spark, sf_dir), ["momentum", "short_term_reversal"])
    return judged.select("decision", F.array_join(F.array_sort("errors"), ",").alias("errors"))


@query("WITH " + DRAFTS + """,
    r AS (SELECT decision, errors, list_concat(errors, list_filter([CASE WHEN decision % 5 = 0 THEN 'gross' END, CASE WHEN decision % 7 = 0 THEN 'turnover' END, CASE WHEN decision % 19 = 0 THEN 'blocked_orders' END], lambda x: x IS NOT NULL)) AS reasons FROM e)
    SELECT decision, CASE WHEN len(errors) = 0 AND decision % 23 = 0 THEN 'unchanged' WHEN len(reasons) = 0 THEN 'applied' ELSE 'fallback' END AS outcome, array_to_string(list_sort(reasons), ',') AS reasons FROM r
""")
def overlay_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = overlay.proposal_errors(drafts(spark, sf_dir), ["momentum", "short_term_reversal"]).select("decision", "errors", (F.col("decision") % 23 == 0).alias("unchanged"))
    keys = judged.select("decision")
    weights = lambda w: keys.withColumn("code", F.lit("a")).withColumn("weight", w)
    moved = keys.withColumn("turnover", F.when(F.col("decision") % 7 == 0, 0.2).otherwise(0.05))
    blended = weights(F.when(F.col("decision") % 5 == 0, 0.9).otherwise(0.5))
    out = overlay.overlay_outcomes(judged, blended, weights(F.lit(0.6)), moved, keys.filter("decision % 19 = 0").withColumn("code", F.lit("a")), ["decision"])
    return out.select("decision", "outcome", F.array_join(F.array_sort("reasons"), ",").alias("reasons"))


_BLENDED = """
    day AS (SELECT DISTINCT trade_date, date_diff('day', DATE '1970-01-01', trade_date) AS d FROM weights),
    draft AS (SELECT *, [0.5, 0.55, 0.6, 0.65, 0.7][d % 5 + 1]::DOUBLE AS m, [0.5, 0.45, 0.4, 0.35, 0.3][d % 5 + 1]::DOUBLE AS r, [1.0, 0.9, 0.8][d % 3 + 1]::DOUBLE AS scale FROM day),
    both_ AS (SELECT w.trade_date, strategy, code, rank, weight, CASE strategy WHEN 'momentum' THEN m ELSE r END AS mix, CASE strategy WHEN 'momentum' THEN 0.6 ELSE 0.4 END::DOUBLE AS own, scale FROM weights w JOIN draft ON draft.trade_date = w.trade_date WHERE strategy IN ('momentum', 'short_term_reversal')),
    summed AS (SELECT trade_date, code, sum(weight * mix * scale) AS w, sum(weight * own * 1.0::DOUBLE) AS b, min(rank) AS rank FROM both_ GROUP BY ALL),
    blended AS (SELECT trade_date, code, rank, floor(least(w, 0.2) * 1e8 + 1e-6) / 1e8 AS weight FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY round(w, 12) DESC, code) AS place FROM summed WHERE w >= 1e-8) WHERE place <= 8),
    own AS (SELECT trade_date, code, rank, floor(least(b, 0.2) * 1e8 + 1e-6) / 1e8 AS weight FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY round(b, 12) DESC, code) AS place FROM summed WHERE b >= 1e-8) WHERE place <= 8),
    target AS (SELECT * FROM blended),"""
_EVALUATED = market.RISK.replace("\n    target AS (SELECT trade_date, code, rank, weight FROM weights WHERE strategy = 'momentum'),", _BLENDED) + """,
    sums AS (
        SELECT trade_date, sum(a) AS base_gross, sum(b) AS gross, round((sum(abs(a - b)) + abs(sum(a) - sum(b))) / 2, 8) AS turnover FROM (
            SELECT coalesce(o.trade_date, n.trade_date) AS trade_date, coalesce(o.weight, 0) AS a, coalesce(n.weight, 0) AS b FROM own o FULL JOIN blended n ON o.trade_date = n.trade_date AND o.code = n.code) GROUP BY 1
    ),
    stopped AS (SELECT trade_date, count(*) AS n FROM risk WHERE reason IS NOT NULL GROUP BY 1),
    judged AS (
        SELECT f.trade_date, f.d, list_filter([CASE WHEN f.d % 11 = 1 THEN 'identity.snapshot' END, CASE WHEN gross > base_gross + 1e-12 THEN 'gross' END, CASE WHEN turnover > 0.1 THEN 'turnover' END, CASE WHEN n > 0 THEN 'blocked_orders' END], lambda x: x IS NOT NULL) AS reasons
        FROM draft f LEFT JOIN sums ON sums.trade_date = f.trade_date LEFT JOIN stopped ON stopped.trade_date = f.trade_date
    ),
    ruled AS (SELECT trade_date, reasons, CASE WHEN d % 11 <> 1 AND d % 5 = 2 AND d % 3 = 0 THEN 'unchanged' WHEN len(reasons) = 0 THEN 'applied' ELSE 'fallback' END AS outcome FROM judged)"""


def _evaluated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A draft for each day with targets: its mix and risk scale by the day's number, some for another snapshot."""
    approved = ["momentum", "short_term_reversal"]
    pool = written(market._weights(spark, sf_dir).filter(F.col("strategy").isin(approved)).select("trade_date", "strategy", "code", "weight", "rank"), "overlay-pool")
    d = F.datediff("trade_date", F.lit("1970-01-01").cast("date"))
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), d % n)
    item = lambda name, w: F.struct(F.lit(name).alias("strategy"), w.alias("weight"))
    at = lambda minutes: F.to_timestamp(F.col("trade_date")) + F.make_dt_interval(F.lit(0), F.lit(7), F.lit(minutes))
    snapshot = F.concat(F.lit("snapshot of "), F.col("trade_date").cast("string"))
    days = market._weights(spark, sf_dir).select("trade_date").distinct()
    mix = F.array(item("momentum", pick(["0.50", "0.55", "0.60", "0.65", "0.70"], 5)), item("short_term_reversal", pick(["0.50", "0.45", "0.40", "0.35", "0.30"], 5)))
    draft = F.struct(
        F.col("trade_date").cast("string").alias("decision_id"), F.when(d % 11 == 1, "another").otherwise(snapshot).alias("snapshot_id"), at(12).alias("generated_at"), at(50).alias("valid_until"), pick(["1", "0.9", "0.8"], 3).alias("risk_scale"),
        mix.alias("strategy_weights"), F.array(F.struct(F.lit("x").alias("evidence_id"))).alias("evidence"),
    )
    drafts = days.select(
        "trade_date", draft.alias("draft"), F.col("trade_date").cast("string").alias("base_decision_id"), snapshot.alias("base_snapshot_id"), at(0).alias("as_of"), at(10).alias("requested_at"), at(15).alias("completed_at"), at(60).alias("deadline"),
        F.lit(False).alias("cache_hit"), F.create_map(F.lit("momentum"), F.lit(0.6), F.lit("short_term_reversal"), F.lit(0.4)).alias("base_weights"), F.array(F.lit("x")).alias("known_evidence"),
    )
    base = overlay.blend(pool.withColumn("mix", F.when(F.col("strategy") == "momentum", 0.6).otherwise(0.4)), ["trade_date"])
    _, positions, states, equities, _ = market._decisions(spark, sf_dir)
    return overlay.evaluate(drafts, pool, base, positions, states, equities, approved)


@query("WITH " + _EVALUATED + "SELECT trade_date, outcome, array_to_string(list_sort(reasons), ',') AS reasons FROM ruled")
def overlay_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir)[0].select("trade_date", "outcome", F.array_join(F.array_sort("reasons"), ",").alias("reasons"))


@query("WITH " + _EVALUATED + """
    SELECT b.trade_date, code, round(weight, 8) AS weight, 'overlay' AS origin FROM blended b JOIN ruled r ON r.trade_date = b.trade_date WHERE outcome = 'applied'
    UNION ALL SELECT o.trade_date, code, round(weight, 8), 'base' FROM own o JOIN ruled r ON r.trade_date = o.trade_date WHERE outcome <> 'applied'
""")
def overlay_final_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir)[1].select("trade_date", "code", F.round("weight", 8).alias("weight"), "origin")
