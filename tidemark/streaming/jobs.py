"""Structured Streaming jobs: incremental ingest, late rows. Those with keyed state are in ``state``.

Every job takes a checkpoint folder and can be restarted; none keeps anything on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import normalize, publish
from ..schemas import KEYS, SCHEMAS, business_columns
from ..sources import envelopes
from ..sources.scratch import written
from ..sources.store import Store

#: The column that names a row's payload.
PAYLOAD = "source_payload_sha256"


def ingest_stream(payloads: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str):
    """Feeds new payload files to ``process`` batch by batch; a batch that failed is run again with the same number.

    ``process`` decides by content what is new (publish.payload_verdicts), so a second run adds nothing.
    """
    return payloads.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def raw_store(spark: SparkSession, root: str, dataset: str) -> Store:
    """The store that ingest_raw fills: the data set, the payloads in it, and what was refused."""
    return Store(spark, root, {dataset: KEYS[dataset], "payloads": [PAYLOAD]})


def ingest_raw(spark: SparkSession, raw_root: str, root: str, dataset: str, checkpoint: str):
    """The whole chain for one data set: new envelope files are verified, normalised and committed to the store under ``root``.

    A payload with one bad row is refused whole, as is one that repeats a key or disagrees with what is
    stored; an invalid envelope is refused by its file. All go to ``refused`` (path, payload, reasons) in the same commit as the
    rows, so a batch that runs again adds nothing anywhere. A batch reads only stored files that may hold
    one of its keys or payloads. ``root`` belongs to one data set.
    """
    keys = KEYS[dataset]
    values = [c for c in business_columns(dataset) if c not in keys]
    store = raw_store(spark, root, dataset)
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(raw_root)

    def process(batch: DataFrame, number: int) -> None:
        version = store.version()
        if version.done.get(checkpoint, -1) >= number:
            return
        checked = written(envelopes.verify(batch), "ingest-envelopes")
        rows = written(normalize.normalize(envelopes.raw_rows(checked), dataset), "ingest-normalised")
        good, bad = normalize.split(rows, dataset)
        faulty = bad.groupBy("path", PAYLOAD).agg(F.array_sort(F.collect_set(F.concat(F.col("row_index").cast("string"), F.lit(": "), F.array_join("errors", "; ")))).alias("reasons"))  # one payload's rows
        faulty = written(faulty, "ingest-faulty")
        good = written(good.join(faulty.select(PAYLOAD).distinct(), PAYLOAD, "left_anti").select(SCHEMAS[dataset].names), "ingest-good")
        stored = store.holding(dataset, good.select(*keys), SCHEMAS[dataset], version)
        known = store.holding("payloads", good.select(PAYLOAD), f"{PAYLOAD} string", version)
        verdicts = written(publish.payload_verdicts(good, stored, keys, values, known=known), "ingest-verdicts")
        judged = verdicts.filter("verdict IN ('repeated_key', 'conflict')").join(good.select(PAYLOAD, F.col("raw_artifact").alias("path")).distinct(), PAYLOAD)
        refused = faulty.unionByName(judged.select("path", PAYLOAD, F.array("verdict").alias("reasons"))).unionByName(checked.filter("NOT valid").select("path", F.lit(None).cast("string").alias(PAYLOAD), F.array("reason").alias("reasons")))
        accepted = verdicts.filter("verdict = 'accepted'").select(PAYLOAD)
        store.commit({dataset: publish.new_rows(good, verdicts, stored, keys).select(SCHEMAS[dataset].names), "payloads": accepted, "refused": refused}, checkpoint, number)

    return ingest_stream(found, process, checkpoint)


def late_row_stream(bars: DataFrame, keys: list[str], stamp: str, available: str, delay: str = "1 day") -> DataFrame:
    """For each local day, rows and late rows, every business key counted once within the watermark."""
    once = bars.withWatermark(stamp, delay).dropDuplicatesWithinWatermark(keys)
    late = F.count_if(F.col(available) > F.date_trunc("day", F.col(stamp)) + F.expr("INTERVAL '07:05' HOUR TO MINUTE"))
    return once.groupBy(F.window(stamp, "1 day")).agg(F.count("*").alias("rows"), late.alias("late")).select(F.to_date("window.start").alias("day"), "rows", "late")
