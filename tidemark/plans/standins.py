"""Market-shaped views over the benchmark tables, as DataFrames and as the SQL the oracles start from.

Prices are whole cents; sums are integers and division comes last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as trades of a code (the part's brand) on a day (of shipping)."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_brand").alias("code"), F.col("p_type").alias("index_code"))
    line = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return line.select(
        "code", "index_code", F.col("l_shipdate").cast("date").alias("trade_date"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long").alias("net_cents"), F.col("l_quantity").cast("long").alias("qty"),
        (F.col("l_returnflag") == "R").alias("returned"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
    )


LINES = """
    line AS (
        SELECT lower(p_brand) AS code, p_type AS index_code, CAST(l_shipdate AS DATE) AS trade_date, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
               CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT) AS net_cents, CAST(l_quantity AS BIGINT) AS qty,
               l_returnflag = 'R' AS returned, l_orderkey, l_partkey, l_suppkey, l_linenumber
        FROM lineitem JOIN part ON l_partkey = p_partkey
    )"""


def paired_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bar for each code and day: signal and execution price, volume, amount, turnover, status flags."""
    day = lines(spark, sf_dir).groupBy("code", "trade_date").agg(
        F.sum("cents").alias("c"), F.sum("net_cents").alias("n"), F.sum("qty").alias("volume"), F.bool_and("returned").alias("is_st"),
        F.min(F.round(F.col("cents") / F.col("qty"))).cast("long").alias("low_cents"), F.max(F.round(F.col("cents") / F.col("qty"))).cast("long").alias("high_cents"),
    )
    return day.select(
        "code", "trade_date", (F.round(F.col("n") / F.col("volume")) / 100).alias("signal_close"), (F.round(F.col("c") / F.col("volume")) / 100).alias("execution_close"),
        (F.col("low_cents") / 100).alias("low"), (F.col("high_cents") / 100).alias("high"), "volume", (F.col("c") / 100).alias("amount"), (F.col("volume") / 100).alias("turnover"), (F.col("volume") % 7 != 0).alias("trade_status"), "is_st",
    )


BARS = LINES + """,
    bars AS (
        SELECT code, trade_date, round(sum(net_cents) / sum(qty)) / 100 AS signal_close, round(sum(cents) / sum(qty)) / 100 AS execution_close,
               min(round(cents / qty)) / 100 AS low, max(round(cents / qty)) / 100 AS high, CAST(sum(qty) AS BIGINT) AS volume, CAST(sum(cents) AS BIGINT) / 100 AS amount, CAST(sum(qty) AS BIGINT) / 100 AS turnover,
               CAST(sum(qty) AS BIGINT) % 7 <> 0 AS trade_status, bool_and(returned) AS is_st
        FROM line GROUP BY code, trade_date
    )"""


def tracks(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two price tracks, with gaps: days of the signal track and other days of the execution track are missing."""
    day = F.datediff("trade_date", F.lit("1970-01-01").cast("date"))
    signal = bars.filter(day % 11 != 3).select("code", "trade_date", F.col("signal_close").alias("close"), "volume", "trade_status", "is_st", F.lit("2").alias("adjustment_flag"))
    execution = bars.filter(day % 13 != 5).select("code", "trade_date", F.col("execution_close").alias("close"), (F.col("volume") + F.when(day % 17 == 2, 1).otherwise(0)).alias("volume"), "trade_status", "is_st", F.lit("3").alias("adjustment_flag"))
    return signal, execution


TRACKS = BARS + """,
    dated AS (SELECT *, date_diff('day', DATE '1970-01-01', trade_date) AS d FROM bars),
    signal AS (SELECT code, trade_date, signal_close AS close, volume, trade_status, is_st FROM dated WHERE d % 11 <> 3),
    execution AS (SELECT code, trade_date, execution_close AS close, volume + CASE WHEN d % 17 = 2 THEN 1 ELSE 0 END AS volume, trade_status, is_st FROM dated WHERE d % 13 <> 5)"""


def calendar(bars: DataFrame) -> DataFrame:
    """Every day from the first bar to the last, and whether there was a bar."""
    span = bars.agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("calendar_date"))
    traded = bars.select(F.col("trade_date").alias("calendar_date")).distinct().withColumn("is_trading_day", F.lit(True))
    return days.join(traded, "calendar_date", "left").select("calendar_date", F.coalesce("is_trading_day", F.lit(False)).alias("is_trading_day"))


CALENDAR = BARS + """,
    calendar AS (
        SELECT calendar_date, trade_date IS NOT NULL AS is_trading_day
        FROM (SELECT CAST(unnest(generate_series(min(trade_date), max(trade_date), INTERVAL 1 DAY)) AS DATE) AS calendar_date FROM bars) s
        LEFT JOIN (SELECT DISTINCT trade_date FROM bars) t ON calendar_date = trade_date
    )"""


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members (brands) of indexes (part types) on the first trading day of each month."""
    one = lines(spark, sf_dir).select("trade_date", "index_code", F.col("code").alias("member_code"))
    return one.withColumn("snapshot_date", F.trunc("trade_date", "month")).select("snapshot_date", "index_code", "member_code", F.concat(F.lit("name of "), "member_code").alias("member_name"))


MEMBERSHIPS = LINES + """,
    members AS (SELECT CAST(date_trunc('month', trade_date) AS DATE) AS snapshot_date, index_code, code AS member_code, 'name of ' || code AS member_name FROM line)"""


def instruments(bars: DataFrame) -> DataFrame:
    """Listed from a code's first bar; half of the codes are out from 200 days before their last."""
    span = bars.groupBy("code").agg(F.min("trade_date").alias("ipo_date"), F.max("trade_date").alias("last"))
    number = F.regexp_extract("code", r"(\d+)$", 1).cast("int")
    return span.select("code", "ipo_date", F.when(number % 2 == 0, F.date_sub("last", 200)).alias("out_date"))


INSTRUMENTS = """
    instruments AS (
        SELECT code, min(trade_date) AS ipo_date, CASE WHEN CAST(regexp_extract(code, '(\\d+)$', 1) AS INT) % 2 = 0 THEN max(trade_date) - 200 END AS out_date
        FROM bars GROUP BY code
    )"""


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day of order, code) pairs with a line."""
    order = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("snapshot_date"))
    return lines(spark, sf_dir).join(order, F.col("l_orderkey") == F.col("o_orderkey")).select("snapshot_date", "code").distinct()


UNIVERSE = """
    universe AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS snapshot_date, code FROM line JOIN orders ON l_orderkey = o_orderkey)"""
