"""Projections of operations events: latest states, alert transitions, attempts and budgets, health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.market import token_cost, token_estimate


def latest_per_key(events: DataFrame, keys: list[str], order: list[str], as_of: str | None = None) -> DataFrame:
    """The last event of each key, as an aggregate (nothing is sorted): the greatest ``order``."""
    seen = events if as_of is None else events.filter(F.col(order[0]) <= F.to_timestamp(F.lit(as_of)))
    rest = [c for c in events.columns if c not in keys]
    return seen.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("e")).select(*keys, "e.*")


HEALTH_STATES = ["healthy", "degraded", "unavailable", "not_configured"]


def record_health(checks: DataFrame, path: str) -> DataFrame:
    """Appends provider checks (provider, state, critical, checked_at, latency_ms) and gives the refused ones with the reason."""
    reason = F.when(F.col("provider").isNull() | (F.trim("provider") == ""), "provider").when(~F.coalesce(F.col("state").isin(HEALTH_STATES), F.lit(False)), "state").when(F.coalesce(F.col("latency_ms") < 0, F.lit(True)), "latency").when(F.col("checked_at").isNull(), "checked_at")
    judged = checks.withColumn("reason", reason)
    judged.filter("reason IS NULL").drop("reason").write.mode("append").parquet(path)
    return judged.filter("reason IS NOT NULL")


def transitions(events: DataFrame, key: str, phase: str, order: list[str], closed: str) -> DataFrame:
    """Events that change the phase of their key; a key can't begin closed."""
    before = F.lag(phase).over(W.partitionBy(key).orderBy(*order))
    marked = events.withColumn("before", before)
    return marked.filter(F.coalesce(F.col("before") != F.col(phase), F.col(phase) != closed))


def rolling_attempts(attempts: DataFrame, key: str, ts: str, hours: int = 24) -> DataFrame:
    """Attempts of the key within the hours before and including each, and seconds since the previous one."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    w = W.partitionBy(key).orderBy(micros)
    return attempts.withColumns({"in_window": F.count("*").over(w.rangeBetween(-(hours * 3_600_000_000 - 1), 0)), "since_previous": (micros - F.lag(micros).over(w)) / 1_000_000})


def daily_budget(attempts: DataFrame, ts: str, limit: int, zone: str = "Asia/Shanghai") -> DataFrame:
    """Attempts of each local day and what is left of a daily limit."""
    day = F.to_date(F.from_utc_timestamp(F.col(ts), zone)).alias("local_day")
    return attempts.groupBy(day).agg(F.count("*").alias("attempts")).withColumn("left", F.greatest(F.lit(limit) - F.col("attempts"), F.lit(0)))


def job_runs(events: DataFrame, run: str, attempt: str, phase: str, ts: str, now: str, lease_seconds: int) -> DataFrame:
    """State of each run: attempts, last phase, and whether a running attempt's lease is over."""
    state = events.groupBy(run).agg(F.countDistinct(attempt).alias("attempts"), F.max_by(phase, F.struct(ts, attempt)).alias("phase"), F.max(ts).alias("last_at"))
    age = F.unix_timestamp(F.to_timestamp(F.lit(now))) - F.unix_timestamp("last_at")
    return state.withColumn("lease_over", (F.col("phase") == "running") & (age > lease_seconds))


def health_summary(latest: DataFrame, state: str = "state", healthy: str = "healthy") -> DataFrame:
    """One row: checks, critical ones, unhealthy critical ones; ready if there are critical ones and all are healthy."""
    bad = F.col("critical") & (F.col(state) != healthy)
    return latest.agg(F.count("*").alias("checks"), F.count_if("critical").alias("critical"), F.count_if(bad).alias("unhealthy")).withColumn("ready", (F.col("critical") > 0) & (F.col("unhealthy") == 0))


def alerts_from_health(checks: DataFrame) -> DataFrame:
    """The alert phase each check asks for: open if degraded or unavailable, or critical and not configured; else resolved."""
    bad = F.col("state").isin("degraded", "unavailable") | (F.col("critical") & (F.col("state") == "not_configured"))
    return checks.withColumns({"phase": F.when(bad, "open").otherwise("resolved"), "severity": F.when(F.col("critical"), "critical").otherwise("warning")})


def unfinished(begun: DataFrame, ended: DataFrame, key: str) -> DataFrame:
    """Sessions without a terminal event, incidents without a recovery."""
    return begun.select(key).distinct().join(ended.select(key).distinct(), key, "left_anti")


def usage_summary(messages: DataFrame, keys: list[str], per_million_in: float, per_million_out: float) -> DataFrame:
    """Messages, estimated tokens in and out and their cost. messages: keys, role, text."""
    tokens = F.coalesce(token_estimate(F.col("text")), F.lit(0))
    sums = messages.groupBy(*keys).agg(F.count("*").alias("messages"), F.sum(F.when(F.col("role") == "assistant", 0).otherwise(tokens)).alias("tokens_in"), F.sum(F.when(F.col("role") == "assistant", tokens).otherwise(0)).alias("tokens_out"))
    return sums.withColumn("cost", token_cost(F.col("tokens_in"), F.col("tokens_out"), per_million_in, per_million_out))


def run_messages(messages: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """Each run with its messages in order, an array bounded by the run's own length."""
    return messages.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *fields))).alias("messages"))
