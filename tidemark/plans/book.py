"""Queries over trade and operations events, and walk-forward evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import evaluation, features, ledger, ops, overlay, regime
from . import market
from . import standins as S
from .market import FEATURES, r6

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# -- fills, cash, lots ---------------------------------------------------------------------------------


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as fills: two tracks, 50 codes; returned lines are sales. seq orders lines of a day."""
    line = S.table(spark, sf_dir, "lineitem")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    qty = F.col("l_quantity").cast("long")
    return line.select(
        key.alias("fill_id"), F.col("l_linestatus").alias("track"), (F.col("l_partkey") % 50).alias("code"), F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"), qty.alias("quantity"),
        (F.round(F.col("l_extendedprice") * 100 / qty) / 100).alias("price"), (F.col("l_tax") * 100).alias("fees"), F.col("l_shipdate").cast("date").alias("occurred_on"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("seq"), F.col("l_orderkey").alias("intent_id"),
    )


FILLS = """
    fill AS (
        SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS fill_id, l_linestatus AS track, l_partkey % 50 AS code, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side,
               CAST(l_quantity AS BIGINT) AS quantity, round(l_extendedprice * 100 / CAST(l_quantity AS BIGINT)) / 100 AS price, l_tax * 100 AS fees, CAST(l_shipdate AS DATE) AS occurred_on,
               (l_orderkey, l_linenumber, l_partkey, l_suppkey) AS seq, l_orderkey AS intent_id
        FROM lineitem
    )"""


@query("WITH " + FILLS + """,
    move AS (SELECT track, occurred_on, 'trade' AS kind, CASE WHEN side = 'buy' THEN -quantity * price ELSE quantity * price END AS amount FROM fill UNION ALL SELECT track, occurred_on, 'fee', -fees FROM fill WHERE fees <> 0)
    SELECT track, kind, count(*) AS movements, round(sum(amount), 2) AS amount FROM move GROUP BY ALL
""")
def cash_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.cash_movements(fills(spark, sf_dir)).groupBy("track", "kind").agg(F.count("*").alias("movements"), F.round(F.sum("amount"), 2).alias("amount"))


@query("WITH " + FILLS + """,
    day AS (SELECT track, occurred_on, sum(CASE WHEN side = 'buy' THEN -quantity * price ELSE quantity * price END - fees) AS amount FROM fill GROUP BY ALL)
    SELECT track, occurred_on, round(sum(amount) OVER (PARTITION BY track ORDER BY occurred_on ROWS UNBOUNDED PRECEDING), 2) AS balance FROM day
""")
def running_cash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.running_cash(ledger.cash_movements(fills(spark, sf_dir))).select("track", "occurred_on", F.round("balance", 2).alias("balance"))


LOTS = FILLS + """,
    lots AS (
        SELECT *, greatest(least(quantity, hi - sold), 0) AS quantity_left FROM (
            SELECT *, coalesce(sum(CASE WHEN side = 'sell' THEN quantity END) OVER (PARTITION BY track, code), 0) AS sold,
                   sum(CASE WHEN side = 'buy' THEN quantity ELSE 0 END) OVER (PARTITION BY track, code ORDER BY occurred_on, seq ROWS UNBOUNDED PRECEDING) AS hi FROM fill)
        WHERE side = 'buy'
    )"""


@query("WITH " + LOTS + "SELECT fill_id, track, code, occurred_on, CAST(quantity_left AS BIGINT) AS quantity_left, round((quantity * price + fees) * quantity_left / quantity, 2) AS cost_left FROM lots WHERE quantity_left > 0")
def fifo_remaining_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.remaining_lots(fills(spark, sf_dir)).select("fill_id", "track", "code", "occurred_on", "quantity_left", F.round("cost_left", 2).alias("cost_left"))


@query("WITH " + FILLS + """,
    cum AS (SELECT track, code, side, fill_id, sum(quantity) OVER w AS hi, sum(quantity) OVER w - quantity AS lo FROM fill WINDOW w AS (PARTITION BY track, code, side ORDER BY occurred_on, seq ROWS UNBOUNDED PRECEDING)),
    mark AS (
        SELECT track, code, lo, lead(lo) OVER o AS next, last_value(CASE WHEN side = 'buy' THEN fill_id END IGNORE NULLS) OVER u AS buy, last_value(CASE WHEN side = 'buy' THEN hi END IGNORE NULLS) OVER u AS b_hi,
               last_value(CASE WHEN side = 'sell' THEN fill_id END IGNORE NULLS) OVER u AS sell, last_value(CASE WHEN side = 'sell' THEN hi END IGNORE NULLS) OVER u AS s_hi
        FROM cum WINDOW o AS (PARTITION BY track, code ORDER BY lo, side), u AS (PARTITION BY track, code ORDER BY lo, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    )
    SELECT track, code, buy, sell, CAST(least(coalesce(next, b_hi), b_hi, s_hi) - lo AS BIGINT) AS quantity FROM mark WHERE buy IS NOT NULL AND sell IS NOT NULL AND least(coalesce(next, b_hi), b_hi, s_hi) > lo
""")
def fifo_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.matched_lots(fills(spark, sf_dir))


@query("WITH " + FILLS + """,
    run AS (
        SELECT *, coalesce(sum(CASE WHEN side = 'buy' THEN quantity ELSE 0 END) OVER (PARTITION BY track, code ORDER BY occurred_on RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS settled,
               sum(CASE WHEN side = 'sell' THEN quantity ELSE 0 END) OVER (PARTITION BY track, code ORDER BY occurred_on, seq ROWS UNBOUNDED PRECEDING) AS sold FROM fill
    )
    SELECT fill_id, track, code, occurred_on, CAST(settled AS BIGINT) AS settled, CAST(sold AS BIGINT) AS sold FROM run WHERE side = 'sell' AND sold > settled
""")
def settlement_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.settlement_violations(fills(spark, sf_dir))


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = fills(spark, sf_dir)
    prices = every.filter("code % 10 <> 7").groupBy("code").agg(F.max_by("price", F.struct("occurred_on", "seq")).alias("price"))
    return ledger.positions(ledger.remaining_lots(every), prices, "1998-01-01")


HELD = LOTS + """,
    price AS (SELECT code, max_by(price, (occurred_on, seq)) AS last_price FROM fill WHERE code % 10 <> 7 GROUP BY 1),
    held AS (
        SELECT track, l.code, CAST(sum(quantity_left) AS BIGINT) AS quantity, CAST(sum(CASE WHEN occurred_on < DATE '1998-01-01' THEN quantity_left ELSE 0 END) AS BIGINT) AS sellable_quantity,
               sum((quantity * price + fees) * quantity_left / quantity) / sum(quantity_left) AS average_cost, any_value(last_price) AS last_price
        FROM lots l LEFT JOIN price p ON l.code = p.code WHERE quantity_left > 0 GROUP BY track, l.code
    )"""


@query("WITH " + HELD + "SELECT track, code, quantity, sellable_quantity, round(average_cost, 4) AS average_cost, last_price, round(quantity * last_price, 2) AS market_value FROM held")
def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held(spark, sf_dir).select("track", "code", "quantity", "sellable_quantity", F.round("average_cost", 4).alias("average_cost"), "last_price", F.round("market_value", 2).alias("market_value"))


@query("WITH " + HELD + """,
    cash AS (SELECT track, sum(CASE WHEN side = 'buy' THEN -quantity * price ELSE quantity * price END - fees) AS cash FROM fill GROUP BY 1),
    priced AS (SELECT track, CASE WHEN bool_and(last_price IS NOT NULL) THEN sum(quantity * last_price) END AS market_value, count(*) AS positions FROM held WHERE track = 'O' OR last_price IS NOT NULL GROUP BY 1)
    SELECT c.track, round(cash, 2) AS cash, positions, round(market_value, 2) AS market_value, round(cash + market_value, 2) AS equity FROM cash c LEFT JOIN priced p ON c.track = p.track
""")
def track_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _held(spark, sf_dir).filter("track = 'O' OR last_price IS NOT NULL")
    cash = ledger.cash_movements(fills(spark, sf_dir)).groupBy("track").agg(F.sum("amount").alias("cash"))
    r2 = lambda c: F.round(c, 2).alias(c)
    return ledger.track_views(held, cash).select("track", r2("cash"), "positions", r2("market_value"), r2("equity"))


@query("WITH " + HELD + """
    SELECT code, CAST(coalesce(sum(quantity) FILTER (track = 'O'), 0) AS BIGINT) AS "O", CAST(coalesce(sum(quantity) FILTER (track = 'F'), 0) AS BIGINT) AS "F",
           CAST(coalesce(sum(quantity) FILTER (track = 'F'), 0) - coalesce(sum(quantity) FILTER (track = 'O'), 0) AS BIGINT) AS "F_minus_O" FROM held GROUP BY 1
""")
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.reconciliation(_held(spark, sf_dir), ["O", "F"])


INTENTS = """
    intent AS (SELECT o_orderkey AS intent_id, CAST(60 + o_orderkey % 120 AS BIGINT) AS quantity, CAST(o_orderdate AS DATE) AS created_on, CAST(o_orderdate AS DATE) + 60 AS expires_on FROM orders),
    skip AS (
        SELECT o_orderkey AS intent_id, 'F' AS track, CAST(o_orderdate AS DATE) + 20 AS skipped_on, o_orderpriority AS reason FROM orders WHERE o_orderkey % 41 = 0
        UNION ALL SELECT o_orderkey, 'F', CAST(o_orderdate AS DATE) + 50, 'again' FROM orders WHERE o_orderkey % 82 = 0
        UNION ALL SELECT o_orderkey, 'O', CAST(o_orderdate AS DATE) + 40, o_orderpriority FROM orders WHERE o_orderkey % 43 = 0
    )"""


def _intents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An intent for each order; some are skipped on one of the tracks, or twice on one."""
    orders = S.table(spark, sf_dir, "orders")
    made = F.col("o_orderdate").cast("date")
    intents = orders.select(F.col("o_orderkey").alias("intent_id"), (60 + F.col("o_orderkey") % 120).alias("quantity"), made.alias("created_on"), F.date_add(made, 60).alias("expires_on"))
    skip = lambda every, track, days, reason: orders.filter(f"o_orderkey % {every} = 0").select(F.col("o_orderkey").alias("intent_id"), F.lit(track).alias("track"), F.date_add(made, days).alias("skipped_on"), reason.alias("reason"))
    priority = F.col("o_orderpriority")
    return intents, skip(41, "F", 20, priority).unionByName(skip(82, "F", 50, F.lit("again"))).unionByName(skip(43, "O", 40, priority))


def signal_status_sql(as_of: str) -> str:
    return f"""
        SELECT i.intent_id, t.track, CAST(coalesce(filled, 0) AS BIGINT) AS filled, CAST(greatest(i.quantity - coalesce(filled, 0), 0) AS BIGINT) AS remaining, reason,
               CASE WHEN skipped_on IS NOT NULL THEN 'skipped' WHEN coalesce(filled, 0) >= i.quantity THEN 'filled' WHEN DATE '{as_of}' >= expires_on THEN 'expired' WHEN coalesce(filled, 0) > 0 THEN 'partial' ELSE 'active' END AS status
        FROM intent i CROSS JOIN (SELECT unnest(['F', 'O']) AS track) t
        LEFT JOIN (SELECT intent_id, track, sum(quantity) AS filled FROM fill WHERE occurred_on <= DATE '{as_of}' GROUP BY ALL) f ON i.intent_id = f.intent_id AND f.track = t.track
        LEFT JOIN (SELECT intent_id, track, arg_min(reason, (skipped_on, reason)) AS reason, min(skipped_on) AS skipped_on FROM skip WHERE skipped_on <= DATE '{as_of}' GROUP BY ALL) s ON i.intent_id = s.intent_id AND s.track = t.track
        WHERE created_on <= DATE '{as_of}'"""


@query("WITH " + FILLS + "," + INTENTS + signal_status_sql("1996-06-30"))
def signal_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    intents, skips = _intents(spark, sf_dir)
    return ledger.signal_status(intents, fills(spark, sf_dir), skips, "1996-06-30", ["F", "O"]).select("intent_id", "track", "filled", "remaining", "reason", "status")


@query("WITH " + FILLS + "," + INTENTS + """,
    run AS (SELECT fill_id, f.intent_id, sum(f.quantity) OVER (PARTITION BY f.intent_id, f.track ORDER BY occurred_on, seq ROWS UNBOUNDED PRECEDING) AS total, i.quantity AS wanted, occurred_on, expires_on FROM fill f JOIN intent i ON f.intent_id = i.intent_id)
    SELECT fill_id, intent_id, CASE WHEN total > wanted THEN 'over_intent' ELSE 'after_expiry' END AS reason FROM run WHERE total > wanted OR occurred_on > expires_on
""")
def overfills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.overfills(_intents(spark, sf_dir)[0], fills(spark, sf_dir))


@query("""
    WITH e AS (SELECT event_id, user_id || '-' || CAST(ts AS DATE) AS k, event_type, ts FROM events), r AS (SELECT *, row_number() OVER w AS n, first_value(event_type) OVER w AS f FROM e WINDOW w AS (PARTITION BY k ORDER BY ts, event_id))
    SELECT event_id, CASE WHEN n = 1 THEN 'accepted' WHEN event_type = f THEN 'replay' ELSE 'conflict' END AS verdict FROM r
""")
def event_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = S.table(spark, sf_dir, "events").withColumn("key", F.concat_ws("-", "user_id", F.to_date("ts")))
    return ledger.admit(events, "key", ["event_type"], ["ts", "event_id"]).select("event_id", "verdict")


@query("""
    SELECT 'lineitem.l_orderkey' AS foreign_key, l_orderkey AS value, count(*) AS rows FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 2
    UNION ALL SELECT 'orders.o_custkey', o_custkey, count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY') GROUP BY 2
""")
def fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = S.table(spark, sf_dir, "orders")
    a = ledger.orphans(S.table(spark, sf_dir, "lineitem"), "l_orderkey", orders.filter("o_orderstatus <> 'P'"), "o_orderkey", "lineitem.l_orderkey")
    return a.unionByName(ledger.orphans(orders, "o_custkey", S.table(spark, sf_dir, "customer").filter("c_mktsegment <> 'MACHINERY'"), "c_custkey", "orders.o_custkey"))


FINGERPRINTED = {
    "lineitem": {"l_discount": "d", "l_extendedprice": "d", "l_linenumber": "", "l_linestatus": "", "l_orderkey": "", "l_partkey": "", "l_quantity": "d", "l_returnflag": "", "l_shipdate": "t", "l_suppkey": "", "l_tax": "d"},
    "orders": {"o_custkey": "", "o_orderdate": "t", "o_orderkey": "", "o_orderpriority": "", "o_orderstatus": "", "o_totalprice": "d"},
    "events": {"event_id": "", "event_type": "", "props": "", "ts": "t", "user_id": "", "value": "d"},
}


def _fingerprint_sql(table: str, columns: dict[str, str]) -> str:
    of = {"d": "CAST(CAST({} AS DECIMAL(38,6)) AS VARCHAR)", "t": "CAST(epoch_us({}) AS VARCHAR)", "": "CAST({} AS VARCHAR)"}
    texts = [of[kind].format(c) for c, kind in sorted(columns.items())]
    row = " || ".join(f"coalesce(length({x}) || ':' || {x}, '-')" for x in texts)
    return f"""
        SELECT '{table}' AS "table", CAST(('0x' || substr(h, 25, 8))::BIGINT % 16 AS INT) AS bucket, count(*) AS rows, CAST(sum(('0x' || substr(h, 1, 12))::BIGINT) % 281474976710656 AS BIGINT) AS first_sum,
               CAST(sum(('0x' || substr(h, 13, 12))::BIGINT) % 281474976710656 AS BIGINT) AS second_sum FROM (SELECT md5({row}) AS h FROM {table}) GROUP BY 2"""


@query(" UNION ALL ".join(_fingerprint_sql(t, c) for t, c in FINGERPRINTED.items()))
def table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, columns in FINGERPRINTED.items():
        one = hashing.fingerprint(S.table(spark, sf_dir, name), list(columns)).withColumn("table", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT greatest((SELECT max(l_shipdate) FROM lineitem), (SELECT max(o_orderdate) FROM orders), (SELECT max(ts) FROM events)) AS boundary")
def replay_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda name, c: (S.table(spark, sf_dir, name), c)
    return ledger.latest_moment([of("lineitem", "l_shipdate"), of("orders", "o_orderdate"), of("events", "ts")]).withColumnRenamed("latest", "boundary")


@query("WITH " + FILLS + """,
    run AS (SELECT fill_id, track, occurred_on, row_number() OVER w AS place, 2000000 + sum(CASE WHEN side = 'buy' THEN -quantity * price ELSE quantity * price END - fees) OVER w AS balance FROM fill WINDOW w AS (PARTITION BY track ORDER BY occurred_on, seq ROWS UNBOUNDED PRECEDING)),
    low AS (SELECT track, min(place) AS place FROM run WHERE balance < 0 GROUP BY 1)
    SELECT r.track, r.fill_id, r.occurred_on, round(r.balance, 2) AS balance FROM run r JOIN low l ON l.track = r.track AND l.place = r.place
""")
def first_negative_cash(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = fills(spark, sf_dir)
    opening = every.select("track").distinct().withColumn("cash", F.lit(2_000_000.0))
    return ledger.first_negative(every, opening).select("track", "fill_id", "occurred_on", F.round("balance", 2).alias("balance"))


# -- operations ------------------------------------------------------------------------------------------


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY ALL")
def latest_event_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.latest_per_key(S.table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], "2024-01-20 00:00:00").select("user_id", "event_type", "event_id")


@query("""
    WITH e AS (SELECT *, CASE WHEN event_type IN ('error', 'purchase') THEN 'open' ELSE 'resolved' END AS phase FROM events), r AS (SELECT *, lag(phase) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM e)
    SELECT user_id, event_id, phase FROM r WHERE before <> phase OR (before IS NULL AND phase <> 'resolved')
""")
def alert_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = S.table(spark, sf_dir, "events").withColumn("phase", F.when(F.col("event_type").isin("error", "purchase"), "open").otherwise("resolved"))
    return ops.transitions(events, "user_id", "phase", ["ts", "event_id"], "resolved").select("user_id", "event_id", "phase")


@query("""
    SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS in_window,
           round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts))) / 1000000, 3) AS since_previous FROM events
""")
def rolling_24h_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.rolling_attempts(S.table(spark, sf_dir, "events"), "user_id", "ts").select("event_id", "in_window", F.round("since_previous", 3).alias("since_previous"))


@query("SELECT CAST(ts + INTERVAL 8 HOUR AS DATE) AS local_day, count(*) AS attempts, greatest(400 - count(*), 0) AS \"left\" FROM events GROUP BY 1")
def daily_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.daily_budget(S.table(spark, sf_dir, "events"), "ts", 400)


@query("""
    WITH s AS (SELECT user_id, count(DISTINCT value) AS attempts, arg_max(CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN 'running' ELSE 'succeeded' END, (ts, value)) AS phase, max(ts) AS last_at FROM events GROUP BY 1)
    SELECT user_id, attempts, phase, phase = 'running' AND epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(last_at)) > 3600 AS lease_over FROM s
""")
def job_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = S.table(spark, sf_dir, "events").withColumn("phase", F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "running").otherwise("succeeded"))
    return ops.job_runs(events, "user_id", "value", "phase", "ts", "2024-02-01 00:00:00", 3600).select("user_id", "attempts", "phase", "lease_over")


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("event_type") == "error", "degraded").when(F.col("event_type") == "purchase", "not_configured").otherwise("healthy")
    return S.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("provider"), state.alias("state"), (F.col("user_id") % 3 == 0).alias("critical"), F.col("ts").alias("checked_at"))


CHECKS = "checks AS (SELECT event_id, user_id AS provider, CASE event_type WHEN 'error' THEN 'degraded' WHEN 'purchase' THEN 'not_configured' ELSE 'healthy' END AS state, user_id % 3 = 0 AS critical, ts AS checked_at FROM events)"


@query("WITH " + CHECKS + """,
    latest AS (SELECT provider, arg_max(state, (checked_at, event_id)) AS state, arg_max(critical, (checked_at, event_id)) AS critical FROM checks GROUP BY 1)
    SELECT count(*) AS checks, count(*) FILTER (critical) AS critical, count(*) FILTER (critical AND state <> 'healthy') AS unhealthy, count(*) FILTER (critical) > 0 AND count(*) FILTER (critical AND state <> 'healthy') = 0 AS ready FROM latest
""")
def health_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.health_summary(ops.latest_per_key(_checks(spark, sf_dir), ["provider"], ["checked_at", "event_id"]))


@query("WITH " + CHECKS + """,
    a AS (SELECT *, CASE WHEN state = 'degraded' OR (critical AND state = 'not_configured') THEN 'open' ELSE 'resolved' END AS phase, CASE WHEN critical THEN 'critical' ELSE 'warning' END AS severity FROM checks),
    t AS (SELECT *, lag(phase) OVER (PARTITION BY provider ORDER BY checked_at, event_id) AS before FROM a)
    SELECT provider, event_id, phase, severity FROM t WHERE before <> phase OR (before IS NULL AND phase <> 'resolved')
""")
def health_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.transitions(ops.alerts_from_health(_checks(spark, sf_dir)), "provider", "phase", ["checked_at", "event_id"], "resolved").select("provider", "event_id", "phase", "severity")


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 40)")
def unfinished_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = S.table(spark, sf_dir, "events")
    return ops.unfinished(events.filter("event_type = 'signup'"), events.filter("event_type = 'error' AND value > 40"), "user_id")


@query("""
    SELECT role, count(*) AS messages, CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN 0 ELSE t END), 0) AS BIGINT) AS tokens_in, CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN t ELSE 0 END), 0) AS BIGINT) AS tokens_out,
           round((sum(CASE WHEN role = 'assistant' THEN 0 ELSE t END) * 2.5 + sum(CASE WHEN role = 'assistant' THEN t ELSE 0 END) * 10) / 1000000, 6) AS cost
    FROM (SELECT role, CAST(coalesce(ceil(octet_length(encode(text)) / 4), 0) AS BIGINT) AS t FROM conversations) GROUP BY 1
""")
def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.usage_summary(S.table(spark, sf_dir, "conversations"), ["role"], 2.5, 10.0).select("role", "messages", "tokens_in", "tokens_out", r6("cost"))


@query("SELECT conv_id, count(*) AS messages, md5(string_agg(coalesce(role, '') || ':' || coalesce(text, ''), '|' ORDER BY turn, role, text)) AS digest FROM conversations GROUP BY 1")
def run_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = ops.run_messages(S.table(spark, sf_dir, "conversations"), "conv_id", "turn", ["role", "text"])
    joined = F.array_join(F.transform("messages", lambda m: F.concat(F.coalesce(m["role"], F.lit("")), F.lit(":"), F.coalesce(m["text"], F.lit("")))), "|")
    return runs.select("conv_id", F.size("messages").cast("long").alias("messages"), F.md5(joined.cast("binary")).alias("digest"))


# -- evaluation --------------------------------------------------------------------------------------------


def periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four parameters over all days with a market return: scaled returns, the market as benchmark, a regime by month."""
    day = features.market_returns(S.paired_bars(spark, sf_dir)).filter("market_return IS NOT NULL AND abs(market_return) < 0.5")
    rows = day.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(3))))
    gross = F.round(F.col("market_return") * (0.5 + 0.2 * F.col("p")) + 0.001 * (F.dayofmonth("trade_date") % (F.col("p") + 2)), 9)
    cost = 0.0001 * (F.col("p") + 1)
    made = rows.select(F.concat(F.lit("p"), F.col("p")).alias("parameter_id"), F.col("trade_date").alias("as_of"), gross.alias("gross_return"), F.round("market_return", 9).alias("benchmark_return"), cost.alias("cost_rate"), F.element_at(F.array(*[F.lit(x) for x in regime.LABELS]), F.month("trade_date") % 4 + 1).alias("regime"))
    return made.withColumn("net_return", F.col("gross_return") - F.col("cost_rate"))


PERIODS = S.BARS + """,
    ret AS (SELECT trade_date, CASE WHEN trade_status THEN signal_close / lag(signal_close) OVER (PARTITION BY code ORDER BY trade_date) - 1 ELSE 0 END AS r FROM bars),
    day AS (SELECT trade_date, avg(r) AS market_return FROM ret GROUP BY 1 HAVING abs(avg(r)) < 0.5),
    gross AS (
        SELECT 'p' || p AS parameter_id, trade_date AS as_of, round(market_return * (0.5 + 0.2 * p::DOUBLE) + 0.001 * (extract('day' FROM trade_date) % (p + 2)), 9) AS gross_return, round(market_return, 9) AS benchmark_return, 0.0001 * (p + 1)::DOUBLE AS cost_rate,
               ['risk_on', 'mean_reverting', 'defensive', 'risk_off'][CAST(extract('month' FROM trade_date) % 4 + 1 AS INT)] AS regime
        FROM day, (SELECT unnest(range(0, 4)) AS p)
    ),
    period AS (SELECT *, gross_return - cost_rate AS net_return FROM gross)"""


def _performance_sql(source: str, keys: str) -> str:
    return f"""(
        SELECT {keys}, count(*) AS observations, exp(sum(lg)) - 1 AS cumulative_return, exp(sum(lg) * 252 / count(*)) - 1 AS annualized_return, coalesce(stddev_samp(net_return), 0) * sqrt(252) AS annualized_volatility,
               CASE WHEN coalesce(stddev_samp(net_return), 0) > 0 THEN avg(net_return) / stddev_samp(net_return) * sqrt(252) ELSE 0 END AS sharpe, max(1 - growth / greatest(1, peak)) AS max_drawdown,
               (avg(net_return) - coalesce(CASE WHEN var_samp(benchmark_return) > 0 THEN covar_samp(net_return, benchmark_return) / var_samp(benchmark_return) END, 0) * avg(benchmark_return)) * 252 AS annualized_alpha,
               coalesce(CASE WHEN var_samp(benchmark_return) > 0 THEN covar_samp(net_return, benchmark_return) / var_samp(benchmark_return) END, 0) AS beta, avg(cost_rate) AS average_cost_rate
        FROM (SELECT *, max(growth) OVER (PARTITION BY {keys} ORDER BY as_of ROWS UNBOUNDED PRECEDING) AS peak
              FROM (SELECT *, ln(1 + net_return) AS lg, exp(sum(ln(1 + net_return)) OVER (PARTITION BY {keys} ORDER BY as_of ROWS UNBOUNDED PRECEDING)) AS growth FROM {source}))
        GROUP BY {keys})"""


_FIGURES = ["cumulative_return", "annualized_return", "annualized_volatility", "sharpe", "max_drawdown", "annualized_alpha", "beta", "average_cost_rate"]
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in _FIGURES)


@query("WITH " + PERIODS + f"SELECT parameter_id, regime, observations, {_ROUNDED} FROM " + _performance_sql("period", "parameter_id, regime"))
def performance_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.performance(periods(spark, sf_dir), ["parameter_id", "regime"]).select("parameter_id", "regime", "observations", *[r6(c) for c in _FIGURES])


@query("WITH " + PERIODS + """
    SELECT parameter_id, as_of, round(1 - growth / greatest(1, max(growth) OVER (PARTITION BY parameter_id ORDER BY as_of ROWS UNBOUNDED PRECEDING)), 6) AS drawdown
    FROM (SELECT *, exp(sum(ln(1 + net_return)) OVER (PARTITION BY parameter_id ORDER BY as_of ROWS UNBOUNDED PRECEDING)) AS growth FROM period)
""")
def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.drawdowns(periods(spark, sf_dir), ["parameter_id"]).select("parameter_id", "as_of", r6("drawdown"))


FOLDS = PERIODS + """,
    numbered AS (SELECT *, row_number() OVER (PARTITION BY parameter_id ORDER BY as_of) - 1 AS idx, count(*) OVER (PARTITION BY parameter_id) AS n FROM period),
    folds AS (SELECT CAST(unnest(range(0, CAST(floor((max(n) - 252) / 63) AS BIGINT))) AS INT) AS fold FROM numbered),
    trained AS (SELECT * FROM numbered, folds WHERE idx >= fold * 63 AND idx < fold * 63 + 252),
    tested AS (SELECT * FROM numbered, folds WHERE idx >= fold * 63 + 252 AND idx < fold * 63 + 315),
    scored AS (SELECT fold, parameter_id, sharpe, row_number() OVER (PARTITION BY fold ORDER BY round(sharpe, 12) DESC, parameter_id) AS place FROM """ + _performance_sql("trained", "fold, parameter_id") + """),
    chosen AS (SELECT fold, parameter_id AS selected_parameter, sharpe AS training_sharpe FROM scored WHERE place = 1),
    oos AS (SELECT t.*, 'oos' AS scope FROM tested t JOIN chosen c ON t.fold = c.fold AND t.parameter_id = c.selected_parameter)"""


def _oos(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    trained, tested = evaluation.in_folds(periods(spark, sf_dir), 252, 63)
    chosen = evaluation.choose_parameters(trained)
    return chosen, evaluation.out_of_sample(tested, chosen)


@query("WITH " + FOLDS + "SELECT fold, selected_parameter, round(training_sharpe, 6) AS training_sharpe FROM chosen")
def walk_forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _oos(spark, sf_dir)[0].select("fold", "selected_parameter", r6("training_sharpe"))


@query("WITH " + FOLDS + f"SELECT scope, observations, {_ROUNDED} FROM " + _performance_sql("oos", "scope"))
def out_of_sample_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.performance(_oos(spark, sf_dir)[1].withColumn("scope", F.lit("oos")), ["scope"]).select("scope", "observations", *[r6(c) for c in _FIGURES])


DEFLATED = PERIODS + """,
    s AS (SELECT parameter_id, count(*) AS n, avg(net_return) AS m, stddev_samp(net_return) AS sd FROM period GROUP BY 1),
    k AS (SELECT p.parameter_id, any_value(n) AS n, any_value(m) / any_value(sd) AS o, avg(power(net_return - m, 3)) / power(avg(power(net_return - m, 2)), 1.5) AS sk, avg(power(net_return - m, 4)) / power(avg(power(net_return - m, 2)), 2) AS ku FROM period p JOIN s ON p.parameter_id = s.parameter_id GROUP BY 1),
    e AS (SELECT *, sqrt((1 + o * o / 2) / n) * ((1 - 0.5772156649015329) * 0.6744897501960817 + 0.5772156649015329 * 1.3287219496247633) AS ex FROM k)"""


@query("WITH " + DEFLATED + """
    SELECT parameter_id, n AS observations, round(o, 6) AS observed, round(ex, 6) AS expected_max, round((o - ex) * sqrt(n - 1) / sqrt(1 - sk * o + (ku - 1) * o * o / 4), 5) AS statistic FROM e
""")
def deflated_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.deflated_sharpe(periods(spark, sf_dir), ["parameter_id"], trials=4).select("parameter_id", "observations", r6("observed"), r6("expected_max"), F.round("statistic", 5).alias("statistic"))


# the normal distribution function by Simpson's rule
@query("WITH " + DEFLATED + """,
    t AS (SELECT parameter_id, n, o, ex, (o - ex) * sqrt(n - 1) / sqrt(1 - sk * o + (ku - 1) * o * o / 4) AS z FROM e),
    area AS (SELECT parameter_id, sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-power(z * i / 4000, 2) / 2)) * z / 12000 / sqrt(2 * pi()) AS a FROM t, (SELECT unnest(range(0, 4001)) AS i) GROUP BY parameter_id, z)
    SELECT t.parameter_id, n AS observations, round(o, 6) AS observed, round(ex, 6) AS expected_max, round(z, 5) AS statistic, round(0.5 + a, 7) AS probability FROM t JOIN area ON t.parameter_id = area.parameter_id
""")
def deflated_sharpe_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.with_probability(evaluation.deflated_sharpe(periods(spark, sf_dir), ["parameter_id"], trials=4))
    return out.select("parameter_id", "observations", r6("observed"), r6("expected_max"), F.round("statistic", 5).alias("statistic"), F.round("probability", 7).alias("probability"))


@query("WITH " + PERIODS + """,
    a AS (SELECT row_number() OVER (ORDER BY as_of) - 1 AS idx, net_return - benchmark_return AS x FROM period WHERE parameter_id = 'p1'),
    c AS (SELECT count(*) AS n FROM a),
    st AS (SELECT s, b, ('0x' || substr(md5('7-' || s || '-' || b), 1, 8))::BIGINT % (n - 20 + 1) AS start FROM c, (SELECT unnest(range(0, 200)) AS s), (SELECT unnest(range(0, 100000)) AS b) WHERE b < ceil(n / 20)),
    d AS (SELECT s, start + o AS idx FROM st, c, (SELECT unnest(range(0, 20)) AS o) WHERE b * 20 + o < n),
    m AS (SELECT s, avg(x) AS mean FROM d JOIN a ON d.idx = a.idx GROUP BY 1),
    p AS (SELECT *, row_number() OVER (ORDER BY mean, s) - 1 AS place FROM m)
    SELECT round(max(CASE WHEN place = 4 THEN mean END), 8) AS confidence_lower, round(max(CASE WHEN place = 194 THEN mean END), 8) AS confidence_upper, avg(CASE WHEN mean > 0 THEN 1.0 ELSE 0.0 END) AS probability_positive FROM p
""")
def block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = periods(spark, sf_dir).filter("parameter_id = 'p1'").withColumn("x", F.col("net_return") - F.col("benchmark_return"))
    series = evaluation.numbered(one).select("idx", "x")
    out = evaluation.bootstrap_summary(evaluation.bootstrap_means(series, "x", samples=200, block_size=20, seed=7), 200)
    return out.select(F.round("confidence_lower", 8).alias("confidence_lower"), F.round("confidence_upper", 8).alias("confidence_upper"), "probability_positive")


@query("WITH " + PERIODS + """,
    w AS (SELECT as_of, max(net_return) FILTER (parameter_id = 'p0') AS base, max(net_return) FILTER (parameter_id = 'p1') AS shadow, max(net_return) FILTER (parameter_id = 'p2') AS actual, max(benchmark_return) AS benchmark, max(cost_rate) AS cost FROM period GROUP BY 1),
    s AS (SELECT count(*) AS days, exp(sum(ln(1 + benchmark))) - 1 AS benchmark, exp(sum(ln(1 + base))) - 1 AS base, exp(sum(ln(1 + shadow))) - 1 AS shadow, exp(sum(ln(1 + actual))) - 1 AS actual, avg(cost) AS c FROM w)
    SELECT days, round(base - benchmark, 5) AS strategy_effect, round(shadow - base, 5) AS overlay_effect, round(actual - base, 5) AS manual_effect, round(c, 6) AS average_cost_rate, days >= 60 AS ready FROM s
""")
def compound_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda p: F.max(F.when(F.col("parameter_id") == p, F.col("net_return")))
    wide = periods(spark, sf_dir).groupBy(F.col("as_of").alias("trading_date")).agg(of("p0").alias("base"), of("p1").alias("shadow"), of("p2").alias("actual"), F.max("benchmark_return").alias("benchmark"), F.max("cost_rate").alias("cost"))
    review = evaluation.forward_review(wide, ["benchmark", "base", "shadow", "actual"], "cost")
    out = evaluation.attribution(review, {"strategy_effect": ("base", "benchmark"), "overlay_effect": ("shadow", "base"), "manual_effect": ("actual", "base")})
    return out.select("days", *[F.round(c, 5).alias(c) for c in ("strategy_effect", "overlay_effect", "manual_effect")], r6("average_cost_rate"), "ready")


@query("WITH " + FILLS + """,
    day AS (SELECT track, occurred_on AS as_of, sum(fees) AS cost, sum(CASE WHEN side = 'sell' THEN 1 ELSE -1 END * quantity) AS moved FROM fill GROUP BY ALL),
    v AS (SELECT *, 1000000 + sum(moved) OVER (PARTITION BY track ORDER BY as_of ROWS UNBOUNDED PRECEDING) AS total_value FROM day),
    b AS (SELECT *, coalesce(lag(total_value) OVER (PARTITION BY track ORDER BY as_of), 1000000) AS before FROM v)
    SELECT track, as_of, round(total_value / before - 1, 9) AS net_return, round(cost / before, 9) AS cost_rate, round(total_value / before - 1 + cost / before, 9) AS gross_return FROM b
""")
def value_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = fills(spark, sf_dir).groupBy("track", F.col("occurred_on").alias("as_of")).agg(F.sum("fees").alias("cost"), F.sum(F.when(F.col("side") == "sell", F.col("quantity")).otherwise(-F.col("quantity"))).alias("moved"))
    total = (1_000_000 + F.sum("moved").over(W.partitionBy("track").orderBy("as_of").rowsBetween(W.unboundedPreceding, 0))).cast("double")
    out = evaluation.value_periods(day.withColumn("total_value", total).select("track", "as_of", "total_value"), day.select("track", "as_of", "cost"), ["track"], 1_000_000.0)
    return out.select("track", "as_of", *[F.round(c, 9).alias(c) for c in ("net_return", "cost_rate", "gross_return")])


@query("WITH " + PERIODS + "SELECT 'below_minus_one' AS \"check\", as_of FROM period WHERE false UNION ALL SELECT 'grid', as_of FROM period WHERE NOT (parameter_id = 'p3' AND extract('day' FROM as_of) = 13) GROUP BY 2 HAVING count(*) < 4")
def series_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.series_violations(periods(spark, sf_dir).filter("NOT (parameter_id = 'p3' AND day(as_of) = 13)"))


# -- overlay -------------------------------------------------------------------------------------------------


@query("WITH " + market.LABELS + """
    SELECT trade_date, unnest(['annualized_volatility', 'breadth', 'concentration', 'trend_return']) AS evidence, unnest([round(annualized_volatility, 6), round(breadth, 6), round(concentration, 6), round(trend_return, 6)]) AS value FROM labels
""")
def evidence_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = regime.regime_labels(regime.regime_features(S.paired_bars(spark, sf_dir)))
    return overlay.evidence_rows(labels, ["trade_date"], ["annualized_volatility", "breadth", "concentration", "trend_return"]).select("trade_date", "evidence", r6("value"))


@query("WITH " + market.WEIGHTS + """,
    mix AS (SELECT trade_date, strategy, code, rank, weight * CASE strategy WHEN 'momentum' THEN 0.5 WHEN 'defensive_low_volatility' THEN 0.3 ELSE 0.2 END * 0.9 AS w FROM weights),
    s AS (SELECT trade_date, code, sum(w) AS w, min(rank) AS rank FROM mix GROUP BY ALL),
    t AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY round(w, 12) DESC, code) AS place FROM s WHERE w >= 1e-8)
    SELECT trade_date, code, rank, round(floor(least(w, 0.2) * 1e8 + 1e-6) / 1e8, 8) AS weight FROM t WHERE place <= 8
""")
def overlay_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = market._weights(spark, sf_dir)
    mix = F.when(F.col("strategy") == "momentum", 0.5).when(F.col("strategy") == "defensive_low_volatility", 0.3).otherwise(0.2)
    return overlay.blend(weights.withColumn("mix", mix), ["trade_date"], risk_scale=0.9).select("trade_date", "code", F.col("rank").cast("long").alias("rank"), F.round("weight", 8).alias("weight"))


# -- consistency of stored records ---------------------------------------------------------------------------


@query("""
    SELECT DISTINCT l_orderkey AS decision_id, unnest(list_filter([CASE WHEN o_orderkey IS NULL THEN 'unknown_decision' END, CASE WHEN (l_orderkey + CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END) % 7 <> o_orderkey % 7 THEN 'other_snapshot' END,
           CASE WHEN l_shipdate >= o_orderdate THEN 'prior_not_earlier' END], lambda x: x IS NOT NULL)) AS "check" FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 50 <> 3) o ON l_orderkey = o_orderkey
""")
def trace_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = S.table(spark, sf_dir, "orders").filter("o_orderkey % 50 <> 3").select(F.col("o_orderkey").alias("decision_id"), (F.col("o_orderkey") % 7).alias("snapshot_id"), F.col("o_orderdate").alias("as_of"))
    stages = S.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("decision_id"), ((F.col("l_orderkey") + (F.col("l_linenumber") == 7).cast("int")) % 7).alias("stage_snapshot_id"), F.col("l_shipdate").alias("prior_as_of"))
    return ledger.trace_violations(decisions, stages)


@query("""
    WITH d AS (SELECT o_orderkey AS id, o_custkey % 3 AS snap, CASE WHEN o_orderkey % 2 = 0 THEN 'base' ELSE 'shadow' END AS track, CAST(o_orderdate AS DATE) AS day FROM orders),
    o AS (SELECT CAST(o_orderdate AS DATE) AS trading_date, min(o_orderkey) AS b, max(o_orderkey) AS s, max(o_totalprice) / 100000 - 2 AS r, min(o_totalprice) / 100000 AS c FROM orders GROUP BY 1)
    SELECT DISTINCT trading_date, unnest(list_filter([CASE WHEN x.snap <> y.snap THEN 'other_snapshot' END, CASE WHEN x.track <> 'base' OR y.track <> 'shadow' THEN 'track' END, CASE WHEN r < -1 THEN 'return' END, CASE WHEN NOT c BETWEEN 0 AND 1 THEN 'cost' END], lambda v: v IS NOT NULL)) AS "check"
    FROM o JOIN d x ON b = x.id JOIN d y ON s = y.id
""")
def observation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, day = S.table(spark, sf_dir, "orders"), F.col("o_orderdate").cast("date")
    decisions = orders.select(F.col("o_orderkey").alias("decision_id"), (F.col("o_custkey") % 3).alias("snapshot_id"), F.when(F.col("o_orderkey") % 2 == 0, "base").otherwise("shadow").alias("track"), day.alias("decision_date"))
    seen = orders.groupBy(day.alias("trading_date")).agg(F.min("o_orderkey").alias("base_id"), F.max("o_orderkey").alias("shadow_id"), F.array(F.max("o_totalprice") / 100000 - 2).alias("returns"), (F.min("o_totalprice") / 100000).alias("cost_rate"))
    return ledger.observation_violations(seen, decisions)


@query("""
    SELECT user_id AS track, arg_max(ts, (ts, event_id)) AS as_of, CAST(arg_max(json_extract(props, '$.k'), (ts, event_id)) AS BIGINT) AS k FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1
""")
def latest_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = S.table(spark, sf_dir, "events").select(F.col("user_id").alias("track"), F.col("ts").alias("as_of"), F.col("event_id").alias("seq"), F.col("props").alias("payload"))
    return ledger.latest_allocation(states, "2024-01-15 00:00:00", "k long")


@query("""
    WITH r AS (SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS moved, o_orderkey % 3 AS days, o_orderkey % 2 = 0 AS applied, o_orderpriority LIKE '1%' AS failed FROM orders)
    SELECT run_id, unnest(list_filter([CASE WHEN moved = 1 THEN 'other_snapshot' END, CASE WHEN applied AND days >= 2 THEN 'applied_after_deadline' END, CASE WHEN applied AND failed THEN 'applied_without_success' END], lambda v: v IS NOT NULL)) AS "check" FROM r
""")
def run_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    runs = S.table(spark, sf_dir, "orders").select(
        k.alias("run_id"), (k % 5).alias("base_snapshot"), ((k + (F.col("o_orderstatus") == "P").cast("int")) % 5).alias("shadow_snapshot"), F.col("o_orderdate").cast("date").alias("requested_at"), F.date_add(F.col("o_orderdate").cast("date"), (k % 3).cast("int")).alias("completed_at"),
        F.date_add(F.col("o_orderdate").cast("date"), 2).alias("deadline"), F.when(F.col("o_orderpriority").startswith("1"), "failed").otherwise("succeeded").alias("status"), F.when(k % 2 == 0, "applied").otherwise("fallback").alias("outcome"), F.lit(1.0).alias("weight_sum"),
    )
    return ledger.run_violations(runs)
