"""Publishing normalised rows: idempotent ingest of payloads, merges, reconciliation, bounded segments, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.catalog import ContractError
from ..sources.scratch import written
from ..sources.store import Store, Version


def _content(columns: list[str]):
    """Business values as one comparable struct (nulls equal)."""
    return F.struct(*[F.col(c) for c in columns])


def _settle(disputed: DataFrame, keys: list[str], payload: str, order: str) -> DataFrame:
    """The payloads among ``disputed`` (keys, payload, order, _new) that disagree with an accepted earlier one.

    In rounds over written tables: a payload with no earlier undecided one against it is accepted, one that
    disagrees with an accepted one is refused. The earliest undecided payload is settled in every round, and
    a round settles all that don't depend on each other; a key's rows meet by aggregates, never in pairs.
    """
    place = F.struct(order, payload)
    undecided = written(disputed, "payloads-undecided")
    accepted = written(disputed.limit(0).select(*keys, F.col("_new").alias("_held")), "payloads-accepted")
    refused = written(disputed.limit(0).select(payload), "payloads-refused")
    while not undecided.isEmpty():
        contents = undecided.groupBy(*keys, "_new").agg(F.min(place).alias("_m"))
        first = contents.groupBy(*keys).agg(F.min(F.struct("_m", "_new")).alias("_a"))
        second = contents.join(first, keys).filter(~F.col("_new").eqNullSafe(F.col("_a._new"))).groupBy(*keys).agg(F.min("_m").alias("_b"))
        rows = undecided.join(first, keys).join(second, keys, "left").join(accepted, keys, "left")
        against = F.when(F.col("_new").eqNullSafe(F.col("_a._new")), F.col("_b")).otherwise(F.col("_a._m"))
        flags = rows.groupBy(payload).agg(F.bool_or(F.col("_held").isNotNull() & ~F.col("_new").eqNullSafe(F.col("_held"))).alias("_no"), F.bool_or(F.coalesce(against < place, F.lit(False))).alias("_wait"))
        settled = written(flags.filter("_no OR NOT _wait"), "payloads-settled")
        refused = written(refused.unionByName(settled.filter("_no").select(payload)), "payloads-refused")
        now = undecided.join(settled.filter("NOT _no").select(payload), payload, "left_semi").select(*keys, F.col("_new").alias("_held"))
        accepted = written(accepted.unionByName(now).groupBy(*keys).agg(F.min("_held").alias("_held")), "payloads-accepted")  # accepted payloads agree
        undecided = written(undecided.join(settled.select(payload), payload, "left_anti"), "payloads-undecided")
    return refused


def payload_verdicts(rows: DataFrame, stored: DataFrame, keys: list[str], values: list[str], payload: str = "source_payload_sha256", order: str = "raw_artifact", known: DataFrame | None = None) -> DataFrame:
    """(payload, verdict): seen, repeated_key, conflict or accepted.

    A payload stored before is skipped; one that repeats a key in itself, or disagrees with stored rows or
    with an accepted earlier payload (in path order), is refused as a whole. stored: of the stored rows at least
    those with a key of ``rows``; known: the payloads stored before, where ``stored`` doesn't show them all.
    """
    before = (stored if known is None else known).select(payload).distinct()
    seen = rows.select(payload).distinct().join(before, payload, "left_semi")
    fresh = written(rows.join(seen, payload, "left_anti"), "payloads-fresh")  # read several times below
    repeated = written(fresh.groupBy(payload, *keys).count().filter("count > 1").select(payload).distinct(), "payloads-repeated")
    content = fresh.join(repeated, payload, "left_anti").select(payload, order, *keys, _content(values).alias("_new"))
    against = written(content.join(stored.select(*keys, _content(values).alias("_old")), keys).filter(~F.col("_new").eqNullSafe(F.col("_old"))).select(payload).distinct(), "payloads-against")
    rest = content.join(against, payload, "left_anti")
    # keys with more than one content: only these payloads can disagree with each other
    unclear = rest.groupBy(*keys).agg(F.min("_new").alias("_lo"), F.max("_new").alias("_hi")).filter(~F.col("_lo").eqNullSafe(F.col("_hi"))).select(*keys)
    conflict = against.unionByName(_settle(rest.join(unclear, keys), keys, payload, order))
    return (
        seen.withColumn("verdict", F.lit("seen")).unionByName(repeated.withColumn("verdict", F.lit("repeated_key"))).unionByName(conflict.withColumn("verdict", F.lit("conflict")))
        .unionByName(fresh.select(payload).distinct().join(repeated, payload, "left_anti").join(conflict, payload, "left_anti").withColumn("verdict", F.lit("accepted")))
    )


def new_rows(rows: DataFrame, verdicts: DataFrame, stored: DataFrame, keys: list[str], payload: str = "source_payload_sha256", order: str = "raw_artifact") -> DataFrame:
    """What the accepted payloads add: keys not stored yet, of equal rows the one of the earliest payload."""
    accepted = rows.join(verdicts.filter("verdict = 'accepted'").select(payload), payload, "left_semi")
    fresh = accepted.join(stored.select(*keys), keys, "left_anti")
    return fresh.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(order, payload))).filter("_n = 1").drop("_n")


def merge(stored: DataFrame, incoming: DataFrame, keys: list[str], values: list[str], order: str) -> DataFrame:
    """The merged table with ``action``: kept, inserted, updated or unchanged. The last of an incoming key counts; unchanged rows keep their old provenance."""
    last = incoming.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")
    names = [c for c in stored.columns if c not in keys]
    both = stored.select(*keys, F.struct(*names).alias("_old"), _content(values).alias("_ov")).join(last.select(*keys, F.struct(*names).alias("_new"), _content(values).alias("_nv")), keys, "full_outer")
    action = F.when(F.col("_nv").isNull(), "kept").when(F.col("_ov").isNull(), "inserted").when(F.col("_ov").eqNullSafe(F.col("_nv")), "unchanged").otherwise("updated")
    kept = F.when(action.isin("kept", "unchanged"), F.col("_old")).otherwise(F.col("_new"))
    return both.withColumn("action", action).withColumn("_row", kept).select(*keys, "_row.*", "action")


def strict_merge(stored: DataFrame, incoming: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Incoming rows with ``action``: inserted, unchanged, conflict (differs from the stored row or among themselves). Nothing is overwritten."""
    many = incoming.groupBy(*keys).agg(F.countDistinct(_content(values)).alias("_contents"))
    joined = incoming.join(many, keys).join(stored.select(*keys, _content(values).alias("_ov")), keys, "left")
    action = F.when((F.col("_contents") > 1) | (F.col("_ov").isNotNull() & ~F.col("_ov").eqNullSafe(_content(values))), "conflict").when(F.col("_ov").isNull(), "inserted").otherwise("unchanged")
    return joined.withColumn("action", action).drop("_ov", "_contents")


def reconcile(expected: DataFrame, actual: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Counts of missing, unexpected, mismatched and repeated keys between what the raw data say and what is stored."""
    e = expected.groupBy(*keys).agg(F.min(_content(values)).alias("_e"))
    a = actual.groupBy(*keys).agg(F.min(_content(values)).alias("_a"), F.count("*").alias("n"))
    both = e.join(a, keys, "full_outer")
    return both.agg(
        F.count_if(F.col("_a").isNull()).alias("missing_rows"), F.count_if(F.col("_e").isNull()).alias("unexpected_rows"),
        F.count_if(F.col("_a").isNotNull() & F.col("_e").isNotNull() & ~F.col("_a").eqNullSafe(F.col("_e"))).alias("mismatched_rows"), F.count_if(F.col("n") > 1).alias("duplicate_keys"),
    )


def pending(requests: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Requests whose result is not stored yet."""
    return requests.join(stored.select(key).distinct(), key, "left_anti")


def request_status(requests: DataFrame, stored: DataFrame, key: str, by: str = "operation") -> DataFrame:
    """For each operation how many requests are stored and how many are pending."""
    known = stored.select(key).distinct().withColumn("_there", F.lit(True))
    return requests.join(known, key, "left").groupBy(by).agg(F.count("_there").alias("stored"), F.count_if(F.col("_there").isNull()).alias("pending"))


def quarantine(merged: DataFrame, path: str, batch: int | str) -> DataFrame:
    """Writes the conflicts of a strict merge to the quarantine table and gives the rows that may go on.

    A batch has a folder of its own (``batch=...``), which a repeated run writes anew: nothing comes twice.
    """
    merged.filter("action = 'conflict'").drop("action").write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return merged.filter("action <> 'conflict'")


def audit_stored(expected: DataFrame, actual: DataFrame, keys: list[str], values: list[str], *, provenance: list[str], day: str, as_of, payload: str = "source_payload_sha256") -> DataFrame:
    """One row: what the stored table lacks of the raw payloads, holds against them, or holds from the future or without provenance."""
    parts = [
        expected.select(payload).distinct().join(actual.select(payload).distinct(), payload, "left_anti").agg(F.count("*").alias("n")).withColumn("what", F.lit("missing_payloads")),
        actual.filter(F.col(day) > as_of).agg(F.count("*").alias("n")).withColumn("what", F.lit("future_rows")),
        actual.filter(F.greatest(*[F.col(c).isNull().cast("int") for c in provenance]) == 1).agg(F.count("*").alias("n")).withColumn("what", F.lit("lost_provenance")),
    ]
    counts = reconcile(expected, actual, keys, values)
    parts.append(counts.unpivot([], counts.columns, "what", "n").select("n", "what"))
    every = parts[0]
    for one in parts[1:]:
        every = every.unionByName(one)
    names = ["missing_payloads", *counts.columns, "future_rows", "lost_provenance"]
    return every.agg(*[F.sum(F.when(F.col("what") == n, F.col("n"))).alias(n) for n in names])


def publish_segments(frames: dict[str, DataFrame], root: str, keys: dict[str, list[str]], most_rows: int = 1_000_000, most_bytes: int = 2 << 30) -> Version:
    """Adds rows to several data sets at once, in files within both bounds (sources.store)."""
    return Store(next(iter(frames.values())).sparkSession, root, keys, most_rows, most_bytes).commit(frames)


def write_report(report: DataFrame, folder: str) -> str:
    """Writes a one-row report as JSON under a name that its content gives; the same report again is left as it is."""
    rows = report.select(F.to_json(F.struct(*sorted(report.columns)), {"ignoreNullFields": "false"}).alias("json")).withColumn("id", F.sha2("json", 256)).limit(2).collect()
    if len(rows) != 1:
        raise ContractError("a report has one row")
    path = f"{folder}/{rows[0].id[:16]}"
    report.sparkSession.createDataFrame([(rows[0].json,)], "value string").coalesce(1).write.mode("ignore").text(path)
    return path
