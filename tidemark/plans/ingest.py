"""Queries over raw rows, payloads and requests that follow from the benchmark tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import normalize, publish
from ..sources import requests
from . import standins as S

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def raw_daily_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars as a provider's rows of texts, some of them broken in the ways providers break them."""
    bars = S.paired_bars(spark, sf_dir)
    number = F.lpad(F.regexp_extract("code", r"(\d+)$", 1), 2, "0")
    code = F.concat(F.lit("sh.6000"), number)
    d = F.datediff("trade_date", F.lit("1970-01-01").cast("date"))
    text = lambda c: F.format_string("%.2f", F.col(c))
    fields = {
        "date": F.col("trade_date").cast("string"), "code": code, "open": text("signal_close"), "high": text("high"), "low": text("low"), "close": text("execution_close"), "preclose": F.lit(""),
        "volume": F.when(d % 19 == 0, "").otherwise(F.col("volume").cast("string")), "amount": text("amount"), "adjustflag": F.when(d % 23 == 1, "2").when(d % 29 == 2, "x").otherwise("3"),
        "turn": F.lit(""), "tradestatus": F.when(d % 31 == 3, "Y").when(F.col("trade_status"), "1").otherwise("0"), "pctChg": F.lit(""), "isST": F.lit("0"),
    }
    row = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)])
    asked = F.create_map(F.lit("code"), code, F.lit("start_date"), F.lit("1995-01-01"), F.lit("end_date"), F.lit("2000-12-31"), F.lit("adjustflag"), F.lit("3"))
    payload = F.sha2(F.concat_ws("/", "code", F.year("trade_date")), 256)
    return bars.select(F.concat(F.lit("raw/"), payload).alias("path"), d.alias("row_index"), F.lit("daily_bars").alias("operation"), asked.alias("query"), row.alias("row"), F.lit("provider").alias("source"), F.col("trade_date").cast("timestamp").alias("received_at"), payload.alias("payload_sha256"))


RAW = S.BARS + """,
    raw AS (SELECT *, 'sh.6000' || lpad(regexp_extract(code, '(\\d+)$', 1), 2, '0') AS instrument, date_diff('day', DATE '1970-01-01', trade_date) AS d FROM bars),
    marked AS (
        SELECT instrument, trade_date, CASE WHEN d % 31 = 3 THEN 'Y' WHEN trade_status THEN '1' ELSE '0' END AS st, d % 19 = 0 AS blank, CASE WHEN d % 23 = 1 THEN '2' WHEN d % 29 = 2 THEN 'x' ELSE '3' END AS flag,
               volume, high < greatest(signal_close, low, execution_close) OR low > least(signal_close, high, execution_close) AS odd FROM raw
    ),
    judged AS (
        SELECT *, array_to_string(list_sort(list_filter([
            CASE WHEN trade_date < DATE '1995-01-01' OR trade_date > DATE '2000-12-31' THEN 'date: not the one asked for' END, CASE WHEN st = 'Y' THEN 'tradestatus: not 0 or 1' END,
            CASE WHEN st = '1' AND blank THEN 'volume: blank on a trading day' END, CASE WHEN flag = 'x' THEN 'adjustflag: unknown' END, CASE WHEN flag <> '3' THEN 'adjustflag: not the one asked for' END,
            CASE WHEN odd THEN 'ohlc: inconsistent' END], lambda x: x IS NOT NULL)), '; ') AS reasons FROM marked
    )"""


@query("WITH " + RAW + "SELECT instrument AS code, trade_date, CASE WHEN st <> '1' AND blank THEN 0 WHEN blank THEN NULL ELSE volume END AS volume, reasons FROM judged")
def normalize_daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = normalize.normalize(raw_daily_rows(spark, sf_dir), "daily_bars")
    return out.select("code", "trade_date", "volume", F.array_join(F.array_sort("errors"), "; ").alias("reasons"))


@query("WITH " + RAW + "SELECT reason, count(*) AS rows FROM (SELECT unnest(string_split(reasons, '; ')) AS reason FROM judged WHERE reasons <> '') GROUP BY 1")
def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, refused = normalize.split(normalize.normalize(raw_daily_rows(spark, sf_dir), "daily_bars"), "daily_bars")
    return refused.select(F.explode("errors").alias("reason")).groupBy("reason").agg(F.count("*").alias("rows"))


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as stored rows (seven in ten) and as an incoming batch in which some differ."""
    orders = S.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.col("o_orderdate").alias("seen"))
    stored = orders.filter("o_orderkey % 10 < 7")
    incoming = orders.filter("o_orderkey % 10 > 3").withColumn("cents", F.col("cents") + F.when(F.col("o_orderkey") % 37 == 0, 1).otherwise(0))
    return stored, incoming


VERSIONS = """
    o AS (SELECT o_orderkey, o_custkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderdate AS seen FROM orders),
    stored AS (SELECT * FROM o WHERE o_orderkey % 10 < 7),
    incoming AS (SELECT * REPLACE (cents + CASE WHEN o_orderkey % 37 = 0 THEN 1 ELSE 0 END AS cents) FROM o WHERE o_orderkey % 10 > 3)"""


@query("WITH " + VERSIONS + """
    SELECT coalesce(s.o_orderkey, i.o_orderkey) AS o_orderkey, CASE WHEN i.o_orderkey IS NULL THEN 'kept' WHEN s.o_orderkey IS NULL THEN 'inserted' WHEN s.cents = i.cents THEN 'unchanged' ELSE 'updated' END AS action,
           coalesce(i.cents, s.cents) AS cents FROM stored s FULL OUTER JOIN incoming i ON s.o_orderkey = i.o_orderkey
""")
def merge_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, incoming = _versions(spark, sf_dir)
    return publish.merge(stored, incoming, ["o_orderkey"], ["o_custkey", "o_orderstatus", "cents"], "seen").select("o_orderkey", "action", "cents")


@query("WITH " + VERSIONS + "SELECT i.o_orderkey, CASE WHEN s.o_orderkey IS NULL THEN 'inserted' WHEN s.cents = i.cents THEN 'unchanged' ELSE 'conflict' END AS action FROM incoming i LEFT JOIN stored s ON s.o_orderkey = i.o_orderkey")
def strict_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, incoming = _versions(spark, sf_dir)
    return publish.strict_merge(stored, incoming, ["o_orderkey"], ["o_custkey", "o_orderstatus", "cents"]).select("o_orderkey", "action")


@query("WITH " + VERSIONS + """
    SELECT count(*) FILTER (i.o_orderkey IS NULL) AS missing_rows, count(*) FILTER (s.o_orderkey IS NULL) AS unexpected_rows, count(*) FILTER (s.cents <> i.cents) AS mismatched_rows, 0::BIGINT AS duplicate_keys
    FROM stored s FULL OUTER JOIN incoming i ON s.o_orderkey = i.o_orderkey
""")
def reconcile_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, incoming = _versions(spark, sf_dir)
    return publish.reconcile(stored, incoming, ["o_orderkey"], ["o_custkey", "o_orderstatus", "cents"])


def payload_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored payloads and new ones: order keys by customer group; some overlap, some disagree, some repeat a key."""
    orders = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.round(F.col("o_totalprice") * 100).cast("long").alias("v"))
    n = F.col("k")
    put = lambda df, p: df.withColumn("source_payload_sha256", p).withColumn("raw_artifact", F.concat(F.lit("raw/"), p))
    block = (n / 100).cast("long")
    stored = put(orders.filter(block % 3 == 0), F.concat(F.lit("a"), F.lpad(block.cast("string"), 9, "0")))
    again = put(orders.filter(block % 6 == 0), F.concat(F.lit("a"), F.lpad(block.cast("string"), 9, "0")))
    fresh = put(orders.filter(block % 3 == 1), F.concat(F.lit("b"), F.lpad(block.cast("string"), 9, "0")))
    # c overlaps b: every fifth block of c disagrees on one key
    other = put(orders.filter(block % 3 == 1).withColumn("v", F.col("v") + F.when((block % 5 == 0) & (n % 100 == 7), 1).otherwise(0)), F.concat(F.lit("c"), F.lpad(block.cast("string"), 9, "0")))
    twice = put(orders.filter(block % 3 == 2).unionByName(orders.filter((block % 6 == 2) & (n % 100 == 0))), F.concat(F.lit("d"), F.lpad(block.cast("string"), 9, "0")))
    return stored, again.unionByName(fresh).unionByName(other).unionByName(twice)


@query("""
    WITH b AS (SELECT DISTINCT o_orderkey // 100 AS block FROM orders), k AS (SELECT DISTINCT o_orderkey // 100 AS block FROM orders WHERE o_orderkey % 100 = 7), z AS (SELECT DISTINCT o_orderkey // 100 AS block FROM orders WHERE o_orderkey % 100 = 0)
    SELECT 'a' || lpad(block::VARCHAR, 9, '0') AS source_payload_sha256, 'seen' AS verdict FROM b WHERE block % 6 = 0
    UNION ALL SELECT 'b' || lpad(block::VARCHAR, 9, '0'), 'accepted' FROM b WHERE block % 3 = 1
    UNION ALL SELECT 'c' || lpad(block::VARCHAR, 9, '0'), CASE WHEN block % 5 = 0 AND block IN (SELECT block FROM k) THEN 'conflict' ELSE 'accepted' END FROM b WHERE block % 3 = 1
    UNION ALL SELECT 'd' || lpad(block::VARCHAR, 9, '0'), CASE WHEN block % 6 = 2 AND block IN (SELECT block FROM z) THEN 'repeated_key' ELSE 'accepted' END FROM b WHERE block % 3 = 2
""")
def ingest_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, incoming = payload_rows(spark, sf_dir)
    return publish.payload_verdicts(incoming, stored, ["k"], ["v"])


@query("""
    SELECT o_orderkey AS k, CASE WHEN o_orderkey // 100 % 3 = 1 THEN 'b' ELSE 'd' END || lpad((o_orderkey // 100)::VARCHAR, 9, '0') AS source_payload_sha256 FROM orders
    WHERE o_orderkey // 100 % 3 = 1 OR (o_orderkey // 100 % 3 = 2 AND NOT (o_orderkey // 100 % 6 = 2 AND o_orderkey // 100 IN (SELECT o_orderkey // 100 FROM orders WHERE o_orderkey % 100 = 0)))
""")
def ingest_new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, incoming = payload_rows(spark, sf_dir)
    verdicts = publish.payload_verdicts(incoming, stored, ["k"], ["v"])
    return publish.new_rows(incoming, verdicts, stored, ["k"]).select("k", "source_payload_sha256")


@query("WITH " + S.TRACKS + "," + S.UNIVERSE + """,
    wanted AS (SELECT snapshot_date, code, unnest(['2', '3']) AS adjustment_flag FROM universe),
    stored AS (SELECT code, trade_date, '2' AS adjustment_flag FROM signal UNION ALL SELECT code, trade_date, '3' FROM execution)
    SELECT w.code, w.adjustment_flag, min(snapshot_date) AS first, max(snapshot_date) AS last, count(*) AS days FROM wanted w LEFT JOIN stored s ON w.code = s.code AND snapshot_date = trade_date AND w.adjustment_flag = s.adjustment_flag WHERE s.code IS NULL GROUP BY ALL
""")
def gap_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal, execution = S.tracks(S.paired_bars(spark, sf_dir))
    return requests.gap_plan(S.universe(spark, sf_dir).withColumnRenamed("snapshot_date", "trade_date"), signal.unionByName(execution))


@query("WITH " + S.MEMBERSHIPS + """
    SELECT DISTINCT 'daily_bars' AS operation, member_code AS code, flag FROM members, (SELECT unnest(['2', '3']) AS flag) WHERE snapshot_date = (SELECT max(snapshot_date) FROM members)
""")
def member_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.member_requests(S.memberships(spark, sf_dir), date(1995, 1, 1), date(2001, 12, 31)).select("operation", "code", "flag")


@query("WITH " + S.CALENDAR + """
    SELECT operation, CAST(calendar_date AS VARCHAR) AS day FROM calendar, (SELECT unnest(['historical_universe', 'hs300_stocks', 'zz500_stocks']) AS operation) WHERE is_trading_day
    UNION ALL SELECT 'daily_bars', NULL
""")
def daily_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = requests.daily_requests(S.calendar(S.paired_bars(spark, sf_dir)), "sh.000300")
    of = lambda k: F.try_element_at(F.col("query"), F.lit(k))
    return out.select("operation", F.coalesce(of("day"), of("date")).alias("day"))


@query("""
    WITH r AS (SELECT event_id, event_type, user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS d FROM events)
    SELECT event_id, CASE event_type WHEN 'click' THEN 'unknown_operation' WHEN 'error' THEN 'missing_key' WHEN 'view' THEN CASE WHEN user_id % 2 = 0 THEN 'code' ELSE '' END WHEN 'signup' THEN 'date' ELSE '' END AS errors FROM r
""")
def validate_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, day = F.col("event_type"), F.to_date("ts").cast("string")
    request = (
        F.when(kind == "click", F.to_json(F.struct(F.lit("refresh").alias("operation"), F.create_map(F.lit("day"), day).alias("query"))))
        .when(kind == "error", F.to_json(F.struct(F.lit("trade_calendar").alias("operation"), F.create_map(F.lit("start_date"), day).alias("query"))))
        .when(kind == "view", F.to_json(F.struct(F.lit("instruments").alias("operation"), F.create_map(F.lit("code"), F.when(F.col("user_id") % 2 == 0, "600000").otherwise("sh.600000")).alias("query"))))
        .when(kind == "signup", F.to_json(F.struct(F.lit("hs300_stocks").alias("operation"), F.create_map(F.lit("date"), F.concat(day, F.lit("x"))).alias("query"))))
        .otherwise(F.to_json(F.struct(F.lit("historical_universe").alias("operation"), F.create_map(F.lit("day"), day).alias("query"))))
    )
    return requests.validate(S.table(spark, sf_dir, "events").select("event_id", request.alias("value"))).select("event_id", F.array_join("errors", ",").alias("errors"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def pending_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = S.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return publish.pending(S.table(spark, sf_dir, "orders").select("o_orderkey"), stored, "o_orderkey")
