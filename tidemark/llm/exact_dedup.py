"""Exact deduplication as a stateful stream.

Two chained streams and one check, all of them DataFrame operations:

1. *fingerprint*: every row becomes (digest of the normalised text, stable id, content locator).
   The locator is the file and the row in it, so content can be found again without carrying it.
2. *state*: an aggregation keyed by digest, without watermark or expiry, in the RocksDB state
   store. A key's state is the smallest (id, locator) and a count. Partial aggregation makes the
   copies of a hot group one row for each map task before the shuffle.
3. *full bytes*: rows whose digest was hit (count over 1) are read again through their locators;
   the smallest and largest normalised text of each such digest must be the same bytes. A digest
   for which they differ is split by the text itself. Only rows that a bitmap of the hits' locators
   lets through are shuffled with their text.

A restart with the same ``work`` folder continues from the streams' checkpoints.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, cut, perhaps_in, scratch, text_or_empty

#: State on disk with a bound on RocksDB's own memory in each executor.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "400",
    # many small stores: preallocated log and manifest files would outweigh the state itself
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def normalised(text: str = "text"):
    """Each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(text_or_empty(text), SPACE, " ")


def with_locator(docs: DataFrame) -> DataFrame:
    """Adds where each row's content lies: (_file, _row). ``docs`` must be a plain Parquet scan."""
    return docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def sha256(norm: Column) -> Column:
    return F.sha2(norm, 256)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    return with_locator(docs).select(digest(normalised(text_col)).alias("digest"), F.col(id_col).alias("id"), "_file", "_row")


def first_holders(prints: DataFrame) -> DataFrame:
    """The keyed state: for each digest the smallest (id, locator), null ids last, and the count."""
    holder = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "_file", "_row")).alias("holder")
    return prints.groupBy("digest").agg(holder, F.count("*").alias("copies"))


def _drain(writer, checkpoint: str) -> None:
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def deduplicate(spark: SparkSession, path: str, schema, *, id_col: str = "doc_id", text_col: str = "text", files_per_trigger: int = 64, work: str | None = None, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row for each row under ``path``: id, keep_id, group_size, kept, text_sha256.

    path: a Parquet glob. Null and empty texts are equal to each other. Of equal texts the row with
    the smallest id stays, of rows that repeat an id too exactly one; null ids come last. An empty
    table gives an empty result. Columns besides the two named are not read.
    files_per_trigger bounds a micro-batch; ``work`` (a shared folder) is where state and progress live:
    a call with the work of an earlier one goes on from there and takes in the files that are new.
    digest: a column of the normalised text; whatever it is, texts are only equal if their bytes are.
    """
    work = work or scratch(spark, "exact-dedup")
    with _settings(spark, STATE_CONF):
        docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
        _drain(fingerprints(docs, id_col, text_col, digest).writeStream.format("parquet").option("path", f"{work}/prints"), f"{work}/prints-progress")
        print_schema = "digest string, id long, _file string, _row long"
        stream = spark.readStream.schema(print_schema).option("maxFilesPerTrigger", 4 * files_per_trigger).parquet(f"{work}/prints")

        def publish(changed: DataFrame, batch: int) -> None:
            # a batch that is run again writes the same folder again
            changed.select("digest", "holder", "copies", F.lit(batch).alias("batch")).write.mode("overwrite").parquet(f"{work}/changes/{batch:09d}")

        _drain(first_holders(stream).writeStream.outputMode("update").foreachBatch(publish), f"{work}/state-progress")
    prints = spark.read.schema(print_schema).parquet(f"{work}/prints")
    changes = spark.read.schema("digest string, holder struct<no_id:boolean,id:long,_file:string,_row:long>, copies long, batch int").option("recursiveFileLookup", "true").parquet(f"{work}/changes")
    last = changes.groupBy("digest").agg(F.max_by(F.struct("holder", "copies"), "batch").alias("s"))
    groups = cut(last.select("digest", F.col("s.copies").alias("copies"), F.col("s.holder.id").alias("keep_id"), F.col("s.holder._file").alias("keep_file"), F.col("s.holder._row").alias("keep_row")), "dedup-groups")

    at = F.xxhash64("_file", "_row").alias("_at")
    hits = cut(prints.join(groups.filter("copies > 1").select("digest"), "digest").select("digest", "id", "_file", "_row", at), "dedup-hits")
    content = with_locator(spark.read.schema(schema).parquet(path)).select(F.col(text_col).alias("_text"), "_file", "_row", at)
    hit_texts = perhaps_in(content, "_at", hits).drop("_at").join(hits.drop("_at"), ["_file", "_row"]).withColumn("norm", normalised("_text"))
    differing = cut(hit_texts.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b")).filter("a <> b").select("digest"), "dedup-differing")

    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("_file") == F.col("keep_file")) & (F.col("_row") == F.col("keep_row"))
    whole = prints.join(groups, "digest").select("digest", "id", "keep_id", F.col("copies").alias("group_size"), kept.alias("kept"))
    if not differing.isEmpty():
        again = hit_texts.join(differing, "digest").select("norm", "digest", "id", "_file", "_row")
        own = again.groupBy("digest", "norm").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "_file", "_row")).alias("holder"), F.count("*").alias("copies"))
        split = again.join(own, ["digest", "norm"])
        here = F.struct(F.col("id").isNull().alias("no_id"), "id", "_file", "_row")
        whole = whole.join(differing, "digest", "left_anti").unionByName(split.select("digest", "id", F.col("holder.id").alias("keep_id"), F.col("copies").alias("group_size"), (here == F.col("holder")).alias("kept")))
    return whole.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))
