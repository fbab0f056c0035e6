"""Helpers the text operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; the words of a text are the runs between it.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a session on one machine (tests) names none, a temporary folder is set; on a cluster that would be
    a folder others can't read, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other call uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows of a few numbers that a task writes at least, where the number of rows is known beforehand.
TASK_ROWS = 20_000


def _write(df: DataFrame, path: str, rows: int | None = None) -> DataFrame:
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // TASK_ROWS)))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again, which ends its lineage."""
    return _write(df, scratch(df.sparkSession, name))


class Tables:
    """Tables in the shared folder that are deleted when the ``with`` block ends, or earlier by ``drop``.

    What the block returns must not read them any more: write it with the module's ``cut``.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.made: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *error) -> None:
        self.drop(*[df for df, _ in self.made])

    def cut(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """rows: about how many, if known; then there are no more tasks than these rows need."""
        path = scratch(self.spark, name)
        out = _write(df, path, rows)
        self.made.append((out, path))
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes the tables of ``frames``; frames of other origin are left alone."""
        hadoop, conf = self.spark._jvm.org.apache.hadoop.fs.Path, self.spark._jsc.hadoopConfiguration()
        for df, path in self.made:
            if any(df is f for f in frames):
                at = hadoop(path)
                at.getFileSystem(conf).delete(at, True)
        self.made = [(df, path) for df, path in self.made if not any(df is f for f in frames)]


def by_slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Smaller batches over the same memory, so that only so many texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def slices_of_words(data: bytes, table: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, about ``size`` bytes of it at a time. table: what each byte becomes; a space parts words."""
    flat, at = data.translate(table), 0
    while at < len(flat):
        end = flat.find(b" ", at + size)
        end = len(flat) if end < 0 else end
        yield flat[at:end].split()
        at = end


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def plain_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns of names that no operator uses, and those names by the original ones."""
    names = {c: f"doc_{k}" for k, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


#: A bitmap has 16 bits for each member, within these bounds: 128 KB and 128 MB.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 30


def bits_for(members: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << (16 * members - 1).bit_length() if members else 0))


def _flagged(df: DataFrame, key: str, members: DataFrame, bits: int | None) -> DataFrame:
    """``df`` with _in: 0 if the key is certainly not in ``members`` (a written table with the same column).

    Decided by a bitmap sized by the number of members (bits_for), whose upper bound is why it can be
    broadcast. Beyond 64 million members it holds less than 16 bits for each, beyond a billion nearly
    all rows get 1 and the bitmap saves nothing; then it is left out and the exact join that follows in any case does the work.
    """
    if bits is None:
        n = members.count()
        if n > MOST_BITS:
            return df.withColumn("_bitmap_in", F.lit(1))
        bits = bits_for(n)
    place = lambda name: F.pmod(F.xxhash64(F.col(name)), F.lit(bits)) + 1
    # the places are dealt by bucket before the maps are made: partial maps of every task would outweigh them by far
    places = members.select(place(key).alias("_bitmap_place")).select("_bitmap_place", F.bitmap_bucket_number("_bitmap_place").alias("_bitmap_bucket")).repartition("_bitmap_bucket")
    bitmap = places.groupBy("_bitmap_bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bitmap_place")).alias("_bitmap_map"))
    at = F.bitmap_bit_position("_bitmap_place").cast("int")
    byte = F.conv(F.hex(F.substring("_bitmap_map", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.coalesce(F.floor(byte / F.pow(F.lit(2), at % 8)).cast("int") % 2, F.lit(0))
    joined = df.withColumn("_bitmap_place", place(key)).join(F.broadcast(bitmap), F.bitmap_bucket_number("_bitmap_place") == F.col("_bitmap_bucket"), "left")
    return joined.withColumn("_bitmap_in", bit).drop("_bitmap_place", "_bitmap_bucket", "_bitmap_map")


def perhaps_in(df: DataFrame, key: str, members: DataFrame, bits: int | None = None) -> DataFrame:
    """All rows of ``df`` whose key is in ``members`` and few others, so the exact join that follows need not shuffle the rest."""
    return _flagged(df, key, members, bits).filter("_bitmap_in = 1").drop("_bitmap_in")


def without(df: DataFrame, key: str, members: DataFrame, bits: int | None = None, on: list[str] | None = None) -> DataFrame:
    """The rows of ``df`` whose key (null is a value) is not in ``members``. Only rows that may be are shuffled.

    With ``on`` the key only marks such rows, and those columns decide.
    """
    flagged = _flagged(df, key, members, bits)
    maybe = flagged.filter("_bitmap_in = 1")
    if on is None:
        gone = members.select(F.col(key).alias("_bitmap_gone"))
        doubtful = maybe.join(gone, F.col(key).eqNullSafe(F.col("_bitmap_gone")), "left_anti")
    else:
        doubtful = maybe.join(members.select(*on), on, "left_anti").select(flagged.columns)
    return flagged.filter("_bitmap_in = 0").unionByName(doubtful).drop("_bitmap_in")


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components: of each task's edges, one from every node to the smallest it reaches there.

    A task holds the nodes of so many edges at most, and goes on with the next.
    """

    def run(frames: Iterator[pd.DataFrame], most: int = 1_000_000) -> Iterator[pd.DataFrame]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        def flush() -> pd.DataFrame:
            found = [(x, r) for x in list(up) if (r := root(x)) != x]
            up.clear()
            return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

        for pdf in frames:
            for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
                if (a := root(a)) != (b := root(b)):
                    up[max(a, b)] = min(a, b)
            if len(up) > most:
                yield flush()
        yield flush()

    return edges.select("a", "b").mapInPandas(run, "a long, b long")


def components(edges: DataFrame, name: str, tables: Tables, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable. ``edges``: a and b, long.

    Edges are contracted within each task first. What is left takes alternating large-star and
    small-star steps. A node's smallest neighbour comes from a partial aggregate and is joined back as a
    table of its own, so a hub's edges can be split. The result reads a table of ``tables``.
    """

    def star(both: DataFrame, keep, rows: int) -> DataFrame:
        least = tables.cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), f"{name}-least", rows)
        out = tables.cut(both.join(least, "u").filter(keep).select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), f"{name}-edges", rows)
        tables.drop(least)
        return out

    now = tables.cut(_contracted(edges.filter("a <> b")).distinct(), f"{name}-edges")
    rows = now.count()
    for _ in range(most_rounds):
        # settled: every node has one edge to a smallest one, which has none itself
        ends = now.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("from")), F.struct(F.col("b").alias("node"), F.lit(0).alias("from")))).alias("e"))
        unsettled = ends.groupBy("e.node").agg(F.sum("e.from").alias("n"), F.min("e.from").alias("to")).filter("n > 1 OR (n = 1 AND to = 0)")
        if unsettled.isEmpty():
            break
        mirrored = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = star(mirrored, F.col("v") > F.col("u"), rows)
        tables.drop(now)
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        now = star(down.unionByName(down.select("u", F.col("u").alias("v"))), F.lit(True), rows)
        tables.drop(large)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    least = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return least.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
