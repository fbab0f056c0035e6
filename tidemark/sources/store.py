"""A store of data sets in segments, changed by commits: a reader sees a whole version or the one before it.

``root/<data set>/<commit>/`` holds a commit's files of a data set, in disjoint ranges of the business key;
``root/_segments/<commit>/`` has for each file its rows, bytes, lowest and highest key and a Bloom filter of its
keys. ``root/_versions/<n>.json`` names the commits that count, the next batch of every stream, and nothing
else, so a version stays small. A commit writes all its files first; then one rename makes its version the
newest. What a failed commit has left is in no version and is never read.

``holding`` reads, for a batch of keys, only files whose range and filter admit one of them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .catalog import ContractError

#: Bits of a filter for each key, and hash functions: one key in about a hundred passes wrongly.
BITS, HASHES = 10, 5


def key_text(keys: list[str]) -> Column:
    """A business key as one text."""
    return F.concat_ws("\u0001", *[F.coalesce(F.col(k).cast("string"), F.lit("\u0002")) for k in keys])


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """HASHES places of each 64-bit hash in a filter of so many bits."""
    h = hashes.astype(np.int64).view(np.uint64)
    first, second = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return (first[:, None] + second[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(bits)


def bloom(hashes: np.ndarray) -> bytes:
    size = max(8, -(-len(hashes) * BITS // 8))
    held = np.zeros(size * 8, bool)
    held[_places(hashes, size * 8)] = True
    return np.packbits(held, bitorder="little").tobytes()


def may_hold(made: bytes, hashes: np.ndarray) -> np.ndarray:
    held = np.unpackbits(np.frombuffer(made, np.uint8), bitorder="little")
    return held[_places(hashes, len(held))].all(axis=1)


@dataclass(frozen=True)
class Version:
    number: int = 0
    commits: tuple[str, ...] = ()
    #: data sets of each commit
    tables: dict[str, list[str]] = field(default_factory=dict)
    #: the last batch of each stream
    done: dict[str, int] = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, root: str, keys: dict[str, list[str]], most_rows: int = 1_000_000, most_bytes: int = 2 << 30):
        self.spark, self.root, self.keys, self.most_rows, self.most_bytes = spark, root.rstrip("/"), keys, most_rows, most_bytes

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> Version:
        """The newest version; an empty one for a store without commits."""
        at, fs = self._at(f"{self.root}/_versions")
        if not fs.exists(at):
            return Version()
        numbers = [int(x.getPath().getName().removesuffix(".json")) for x in fs.listStatus(at) if x.getPath().getName().endswith(".json")]
        if not numbers:
            return Version()
        stream = fs.open(self._at(f"{self.root}/_versions/{max(numbers):012d}.json")[0])
        try:
            said = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return Version(max(numbers), tuple(said["commits"]), said["tables"], said["done"])

    def _publish(self, version: Version) -> None:
        """Makes a version the newest by renaming a finished file; fails if another commit was faster."""
        final, fs = self._at(f"{self.root}/_versions/{version.number:012d}.json")
        written, _ = self._at(f"{self.root}/_versions/.{uuid.uuid4().hex}")
        out = fs.create(written, False)
        out.write(bytearray(json.dumps({"commits": version.commits, "tables": version.tables, "done": version.done}).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(written, final):
            fs.delete(written, False)
            raise ContractError(f"version {version.number} was published by another commit")

    def read(self, name: str, schema, version: Version | None = None) -> DataFrame:
        """A data set as of a version (the newest one unless given)."""
        version = version or self.version()
        paths = [f"{self.root}/{name}/{c}" for c in version.commits if name in version.tables[c]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def segments(self, name: str, version: Version | None = None) -> DataFrame:
        """commit, path, rows, bytes, low, high, filter of a data set's files."""
        version = version or self.version()
        schema = "name string, commit string, path string, rows long, bytes long, low string, high string, filter binary"
        paths = [f"{self.root}/_segments/{c}" for c in version.commits if name in version.tables[c]]
        found = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return found.filter(F.col("name") == name).drop("name")

    def _stage(self, name: str, frame: DataFrame, commit: str) -> None:
        """Writes a data set's files, none over the bounds: where bytes are, with fewer rows a file, as many as the last attempt's bytes for each row allow."""
        path, rows = f"{self.root}/{name}/{commit}", self.most_rows
        if self.keys.get(name):
            frame = frame.withColumn("_key", key_text(self.keys[name]))
            frame = frame.repartitionByRange("_key").sortWithinPartitions("_key").drop("_key")
        while True:
            frame.write.option("maxRecordsPerFile", rows).option("compression", "zstd").mode("overwrite").parquet(path)
            at, fs = self._at(path)
            most = max((x.getLen() for x in fs.listStatus(at)), default=0)
            if most <= self.most_bytes:
                return
            fewer = int(rows * 0.9 * self.most_bytes / most)
            if rows <= 1:
                raise ContractError(f"{name}: a row takes more than {self.most_bytes} bytes")
            rows = max(1, min(fewer, rows - 1))

    def _describe(self, name: str, commit: str, schema) -> DataFrame:
        files = self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{commit}")
        key = key_text(self.keys.get(name) or [])
        rows = files.select(F.lit(name).alias("name"), F.lit(commit).alias("commit"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"), key.alias("key"), F.xxhash64(key).alias("h"))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:  # one file
            one = pdf.iloc[0]
            return pd.DataFrame([(one["name"], one["commit"], one["path"], len(pdf), int(one["bytes"]), pdf["key"].min(), pdf["key"].max(), bloom(pdf["h"].to_numpy()))], columns=["name", "commit", "path", "rows", "bytes", "low", "high", "filter"])

        return rows.groupBy("path").applyInPandas(run, "name string, commit string, path string, rows long, bytes long, low string, high string, filter binary")

    def commit(self, frames: dict[str, DataFrame], stream: str | None = None, batch: int | None = None) -> Version:
        """Adds rows to all of ``frames``' data sets at once. A batch of a stream that is done already changes nothing."""
        before = self.version()
        if stream is not None and before.done.get(stream, -1) >= batch:
            return before
        commit = f"{before.number + 1:012d}-{uuid.uuid4().hex[:8]}"
        for name, frame in frames.items():
            self._stage(name, frame, commit)
        described = None
        for name, frame in frames.items():
            one = self._describe(name, commit, frame.schema)
            described = one if described is None else described.unionByName(one)
        described.write.parquet(f"{self.root}/_segments/{commit}")
        done = before.done | ({stream: batch} if stream is not None else {})
        after = Version(before.number + 1, (*before.commits, commit), before.tables | {commit: list(frames)}, done)
        self._publish(after)
        return after

    def paths_holding(self, name: str, keys: DataFrame, version: Version | None = None) -> DataFrame:
        """(path) of the files that may hold one of ``keys`` (with the data set's key columns).

        Files of a commit are disjoint ranges, so a key meets the one file of it that begins at or before the
        key: a running last value, in windows that hold the batch's keys and a commit's files.
        """
        segments = self.segments(name, version)
        text = key_text(self.keys[name])
        asked = keys.select(text.alias("key"), F.xxhash64(text).alias("h")).distinct()
        commits = segments.select("commit").distinct()
        begins = segments.select("commit", F.col("low").alias("key"), F.struct("path", "high").alias("file"), F.lit(None).cast("long").alias("h"), F.lit(0).alias("asks"))
        questions = asked.crossJoin(F.broadcast(commits)).select("commit", "key", F.lit(None).cast("struct<path:string,high:string>").alias("file"), "h", F.lit(1).alias("asks"))  # a name for each commit
        upto = W.partitionBy("commit").orderBy("key", "asks").rowsBetween(W.unboundedPreceding, 0)
        met = begins.unionByName(questions).withColumn("file", F.last("file", ignorenulls=True).over(upto)).filter("asks = 1 AND key <= file.high")
        hashes = met.groupBy(F.col("file.path").alias("path")).agg(F.collect_set("h").alias("hashes"))  # of one batch

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                yield pdf[[bool(may_hold(f, np.asarray(h, np.int64)).any()) for f, h in zip(pdf["filter"], pdf["hashes"])]][["path"]]

        return hashes.join(segments.select("path", "filter"), "path").mapInPandas(run, "path string")

    def holding(self, name: str, keys: DataFrame, schema, version: Version | None = None) -> DataFrame:
        """The rows of the files that may hold one of ``keys``: all rows with such a key, and others of those files."""
        paths = [r.path for r in self.paths_holding(name, keys, version).collect()]  # files that a batch touches
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
