"""Conflict-constrained best-fit packing of documents into fixed-length sequences.

Documents are dealt to shards of bounded size by a hash, and every shard is packed by itself; what
stands in bins of all shards that stayed too empty is dealt and packed once more. Within a shard, pieces come in order of decreasing length. Bins are kept ordered by what room
they have left, each with a bitmap of its sources and one of its duplicate clusters; from the first
bin with enough room the search goes to its successors until one is compatible, which is the tightest
that is. Sharing a duplicate cluster is never allowed, sharing a source unless ``distinct_sources`` is
off. A hot source is spread over all shards; it can only cost room, never tasks.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def best_fit(pieces: list[tuple[int, int, int]], capacity: int, often: int = 64) -> list[int]:
    """The bin of each piece (length, source bit, cluster bit; bits of 0 conflict with nothing).

    Pieces must come in the order of packing. Bins with equal room are tried in order of their number.
    Of a source or cluster with more than ``often`` pieces, the bins without it are kept in an order of
    their own, so that its pieces don't search among the bins that hold it.
    """
    sources: list[int] = []
    clusters: list[int] = []
    counts = Counter(x for _, s, c in pieces for x in ((0, s), (1, c)) if x[1])
    # (room left, bin), ordered: of all open bins, and of those without a frequent source or cluster
    every: list[tuple[int, int]] = []
    without: dict[tuple[int, int], list[tuple[int, int]]] = {x: [] for x, n in counts.items() if n > often}

    def orders(b: int) -> list[list[tuple[int, int]]]:
        return [every, *(order for (kind, bit), order in without.items() if not (clusters if kind else sources)[b] & bit)]

    out = []
    for length, source, cluster in pieces:
        own = max(((0, source), (1, cluster)), key=lambda x: counts[x] if x[1] else 0)
        order = without.get(own, every)
        for k in range(bisect_left(order, (length, -1)), len(order)):
            room, b = order[k]
            if not (sources[b] & source or clusters[b] & cluster):
                for x in orders(b):
                    del x[bisect_left(x, (room, b))]
                break
        else:
            room, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[b] |= source
        clusters[b] |= cluster
        out.append(b)
        if room > length:
            for x in orders(b):
                insort(x, (room - length, b))
    return out


def _shard(pieces: list[tuple], capacity: int, distinct_sources: bool) -> list[tuple]:
    """Packs one shard. pieces: (id, piece, start, length, source, cluster). Gives each with its bin, place in the bin and the bin's content.

    A document has at most one piece shorter than a bin, so its own pieces never conflict.
    """
    pieces = sorted(pieces, key=lambda p: (-p[3], p[0] is None, p[0] or 0, p[1], p[4] or "", p[5] or ""))
    source_bits = {s: 1 << i for i, s in enumerate(sorted({p[4] for p in pieces if p[4] is not None}))} if distinct_sources else {}
    often = Counter(p[5] for p in pieces if p[5] is not None and p[3] < capacity)
    cluster_bits = {c: 1 << i for i, c in enumerate(sorted(c for c, n in often.items() if n > 1))}  # single ones can't conflict
    bins = best_fit([(p[3], source_bits.get(p[4], 0), cluster_bits.get(p[5], 0)) for p in pieces], capacity)
    filled: dict[int, int] = {}
    out = []
    for p, b in zip(pieces, bins):
        out.append((*p, b, filled.get(b, 0)))
        filled[b] = filled.get(b, 0) + p[3]
    return [(*r, filled[r[6]]) for r in out]


_PIECE = ["id", "piece", "start", "length", "source", "cluster"]


def _packed(dealt: DataFrame, shards: int, capacity: int, distinct_sources: bool) -> DataFrame:
    """dealt: _PIECE and shard. Every shard is one unit of work, and the number of tasks is set: merging tasks by bytes would leave few."""
    spark = dealt.sparkSession
    tasks = max(1, min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shards // 16))))
    ordered = dealt.select("shard", *_PIECE).repartition(tasks, "shard").sortWithinPartitions("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        for shard, group in groupby(rows, key=lambda r: r[0]):
            packed = _shard([r[1:] for r in group], capacity, distinct_sources)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*packed), kinds)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([shard] * len(packed), pa.int32())], [*_PIECE, "bin", "place", "content", "shard"])

    return ordered.mapInArrow(run, "id long, piece int, start long, length long, source string, cluster string, bin int, place long, content long, shard int")


def pack(docs: DataFrame, *, capacity: int, length_col: str, id_col: str = "doc_id", source_col: str = "source", cluster_col: str = "cluster", distinct_sources: bool = True, shard_pieces: int = 4096, full: float = 0.95) -> DataFrame:
    """One row for each piece: id, piece, start, length, shard, bin (within the shard), place (in the bin).

    A document longer than capacity is cut into pieces of capacity and a rest. Documents with null or
    no length give no piece. Null sources and clusters conflict with nothing. Rows that repeat an id
    are documents of their own. Ties in length are packed by id, piece, source and cluster. An empty
    table gives an empty result; other columns are not read. Only id, length, source and cluster are
    shuffled, never texts. Pieces are dealt by all they have and, of rows alike, by their number, so a
    shard has about shard_pieces of them whatever repeats. Bins don't reach across shards; the pieces in
    bins less than ``full`` go into shards of a second round, numbered after those of the first.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(length_col).cast("long"), F.lit(0)).alias("_all"), F.col(source_col).cast("string").alias("source"), F.col(cluster_col).cast("string").alias("cluster")).filter("_all > 0")
    slim = cut(slim, "packing-lengths")  # lengths may come from whole texts
    alike = slim.groupBy("id", "_all", "source", "cluster").agg(F.count("*").alias("_rows"))
    piece = F.explode(F.sequence(F.lit(0), F.ceil(F.col("_all") / capacity).cast("int") - 1))
    pieces = alike.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), "_rows"))).withColumn("piece", piece)
    pieces = pieces.withColumn("start", F.col("piece").cast("long") * capacity).withColumn("length", F.least(F.col("_all") - F.col("start"), F.lit(capacity).cast("long")))
    total = slim.agg(F.sum(F.ceil(F.col("_all") / capacity))).first()[0] or 0
    shards = max(1, -(-total // shard_pieces))
    by = F.xxhash64("id", "piece", "length", "source", "cluster", "_row")
    first = cut(_packed(pieces.withColumn("shard", F.pmod(by, F.lit(shards)).cast("int")), shards, capacity, distinct_sources), "packed")
    out = ["id", "piece", "start", "length", "shard", "bin", "place"]
    loose = first.filter(F.col("content") < full * capacity)
    if shards > 1 and (n := loose.count()):
        more = max(1, -(-n // shard_pieces))
        again = loose.select(*_PIECE, F.pmod(F.xxhash64("shard", "bin", F.lit(3)), F.lit(more)).cast("int").alias("shard"))
        second = _packed(again, more, capacity, distinct_sources).withColumn("shard", F.col("shard") + shards)
        first = first.filter(F.col("content") >= full * capacity).select(*out).unionByName(second.select(*out))
    return first.select(F.col("id").alias(id_col), *out[1:])
