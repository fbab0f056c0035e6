"""How far the sources of a language diverge: exact audit from count-level bitmaps.

Terms that enough documents of a language hold get an address (block, bit). In each block, every
(source, count) level has a bitset of the terms that the source holds that often, and count 0 has the
complement of the others. For two sources the AND of two levels' bitsets and its popcount give the
joint cell: how many terms have that pair of counts. As a term's contribution depends on its two
counts alone, a pair's divergence is the sum of its cells times the contribution f of the cell.

Blocks are dealt by the term's frequency class and a hash, so terms of a block have few different
counts and all blocks about equally many rows, whatever the vocabulary. Sources of a language are
dealt into tiles, so a group holds two tiles' rows of one block at most. Words are counted inside the
tasks that read the texts; what is shuffled are partial counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, slices_of_words

#: Byte table: ASCII letters in lower case, every other ASCII character a space, bytes of other characters as they are.
TERMS = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))

#: Contributions are counted in units of one of so many.
UNIT = 1_000_000_000


def count_terms(docs: DataFrame, lang: Column, source: Column, text: Column, most_entries: int = 200_000) -> DataFrame:
    """(lang, source, term, n, docs) by task and part: sums are still to be made. A task holds most_entries counts or one text's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often: dict[tuple, Counter] = {}
        held: dict[tuple, Counter] = {}

        def flush() -> pa.RecordBatch:
            rows = [(*group, term, n, held[group][term]) for group, terms in often.items() for term, n in terms.items()]
            kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
            often.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for at in range(batch.num_rows):
                group = (batch[0][at].as_py(), batch[1][at].as_py())
                own: set[bytes] = set()
                counts = often.setdefault(group, Counter())
                for words in slices_of_words(batch[2][at].as_py(), TERMS):
                    counts.update(words)
                    own.update(words)
                held.setdefault(group, Counter()).update(own)
                if sum(map(len, often.values())) > most_entries:
                    yield flush()
        yield flush()

    rows = docs.select(lang.alias("lang"), source.alias("source"), F.coalesce(text, F.lit("")).cast("binary").alias("text"))
    made = rows.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return made.withColumn("term", F.col("term").cast("string"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT (count + 2) / (total + 2 kept)), in decimals so that large counts stay exact."""
    over = F.lit(UNIT).cast("decimal(10,0)") * (count.cast("decimal(18,0)") + 2)
    # the quotient is at most UNIT: as a plain long
    return F.call_function("div", over.cast("decimal(38,0)"), (total.cast("decimal(18,0)") + 2 * kept.cast("decimal(18,0)")).cast("decimal(38,0)")) + 1


def contribution(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _cells(rows: pd.DataFrame) -> dict[tuple[str, str], int]:
    """Sum of joint cells times f for each pair of sources of a block. rows: source, bit, n, p; bit -1: the source's share at count 0, and the number of the block's terms as n."""
    terms = int(rows["n"].to_numpy()[rows["bit"].to_numpy() < 0][0])
    words = -(-terms // 64)
    full = np.full(words, ~np.uint64(0))
    full[-1] >>= np.uint64(64 * words - terms)
    names, bits, shares = [], [], []
    for name, own in rows.groupby("source", sort=True):
        zero = int(own["p"].to_numpy()[own["bit"].to_numpy() < 0][0])
        own = own[own["bit"] >= 0]
        levels, first, place = np.unique(own["n"].to_numpy(), return_index=True, return_inverse=True)
        made = np.zeros((len(levels) + 1, words), np.uint64)
        at = own["bit"].to_numpy().astype(np.int64)
        np.bitwise_or.at(made, (place, at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
        made[-1] = full & ~np.bitwise_or.reduce(made[:-1], axis=0)
        names.append(name)
        bits.append(made)
        shares.append(np.append(own["p"].to_numpy()[first], zero).astype(np.int64))
    out = {}
    if len(names) < 2:
        return out
    starts = np.cumsum([0, *map(len, bits)])
    every, p_all = np.concatenate(bits), np.concatenate(shares)
    for a in range(len(names) - 1):
        from_ = starts[a + 1]
        sums = np.zeros(len(names) - a - 1, np.int64)
        rest, q = every[from_:], p_all[from_:]
        step = max(1, 4_000_000 // max(1, rest.size))
        for k in range(0, len(bits[a]), step):
            joint = np.bitwise_count(bits[a][k : k + step, None, :] & rest[None]).sum(axis=2, dtype=np.int64)
            p = shares[a][k : k + step, None]
            sums += np.add.reduceat((joint * ((p - q) ** 2 // (p + q))).sum(axis=0), starts[a + 1 : -1] - from_)
        out |= {(names[a], names[a + 1 + k]): int(s) for k, s in enumerate(sums)}
    return out


def _pairs(kept: DataFrame, groups: DataFrame, block_terms: int, tile: int) -> DataFrame:
    """(lang, source, item, value) for each pair of sources of a language, from kept (lang, source, term, n, p, total, first: one row of each term)."""
    sizes = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    kind = F.floor(F.log2("total")).cast("int")
    classes = kept.groupBy("lang", kind.alias("kind")).agg(F.count("*").alias("rows")).join(sizes, "lang")
    classes = cut(classes.select("lang", "kind", F.ceil(F.col("rows") / (block_terms * F.least("sources", F.lit(tile)))).cast("int").alias("blocks"), F.ceil(F.col("sources") / tile).cast("int").alias("tiles")), "divergence-classes")
    placed = kept.withColumn("kind", kind).join(classes, ["lang", "kind"])
    block = F.pmod(F.xxhash64("term"), "blocks").cast("int")
    bit = (F.dense_rank().over(W.partitionBy("lang", "kind", "block").orderBy("term")) - 1).cast("int")
    terms = placed.withColumn("block", block).withColumn("bit", bit).select("lang", "kind", "block", "tiles", "source", "bit", "n", "p")
    # every source has a row of each block, with its share at count 0
    sized = cut(placed.filter("first").groupBy("lang", "kind", block.alias("block"), "tiles").agg(F.count("*").alias("n")), "divergence-blocks")
    zeros = groups.join(sized, "lang").select("lang", "kind", "block", "tiles", "source", F.lit(-1).alias("bit"), "n", F.col("p0").alias("p"))
    own = F.pmod(F.xxhash64("source"), "tiles").cast("int")
    both = terms.unionByName(zeros).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = both.select("lang", "kind", "block", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "own", "source", "bit", "n", "p")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tiles = dict(zip(pdf["source"], pdf["own"]))
        # a pair within one tile is counted in that tile's own group only
        found = [(key[0], a, b, s) for (a, b), s in _cells(pdf).items() if key[3] == key[4] or tiles[a] != tiles[b]]
        return pd.DataFrame(found, columns=["lang", "source", "item", "value"])

    summed = dealt.groupBy("lang", "kind", "block", "left", "right").applyInPandas(run, "lang string, source string, item string, value long")
    summed = cut(summed.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "divergence-pairs")
    return summed.unionByName(summed.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))


def audit(docs: DataFrame, *, min_docs: int = 10, top: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", block_terms: int = 256, tile: int = 64) -> DataFrame:
    """lang, source, part, item, value, rank for every (lang, source) group of ``docs``.

    Null text, language and source count as ''. A term is a run of ASCII letters and characters beyond
    ASCII, A-Z in lower case. A language keeps the terms in min_docs of its rows. With N the sum of a
    group's counts over the V kept terms, a term's share is 1 + floor(1e9 (count + 2) / (N + 2 V)), and
    f of two shares floor((p - q)^2 / (p + q)); all of it exact. Part ``pair``: every other source of the
    language with f summed over all kept terms, 0 if there are none. Part ``term``: the ``top`` terms
    whose share is above the language's. Ranks by value descending, then item; ties leave no gap.
    Repeated rows count as they come, other columns are not read; an empty table gives an empty result.
    """
    lang, source = F.coalesce(F.col(lang_col), F.lit("")), F.coalesce(F.col(source_col), F.lit(""))
    counted = count_terms(docs, lang, source, F.col(text_col)).repartition("lang", "term")
    counted = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    one = W.partitionBy("lang", "term")
    counted = counted.withColumn("all_docs", F.sum("docs").over(one)).withColumn("total", F.sum("n").over(one)).withColumn("first", F.row_number().over(one.orderBy("source")) == 1)
    kept = cut(counted.filter(F.col("all_docs") >= min_docs).select("lang", "source", "term", "n", "total", "first"), "divergence-kept")
    sums = kept.groupBy("lang").agg(F.count(F.when(F.col("first"), 1)).alias("terms"), F.sum("n").alias("lang_sum"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("sum"))
    groups = docs.select(lang.alias("lang"), source.alias("source")).distinct().join(own, ["lang", "source"], "left").join(sums, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("sum", "terms", "lang_sum")])
    # without a kept term there is no share
    groups = cut(groups.withColumn("p0", F.when(F.col("terms") > 0, share(F.lit(0), F.col("sum"), F.col("terms")))), "divergence-groups")
    shared = kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("sum"), F.col("terms"))).withColumn("q", share(F.col("total"), F.col("lang_sum"), F.col("terms")))
    terms = shared.filter("p > q").select("lang", "source", F.col("term").alias("item"), contribution(F.col("p"), F.col("q")).alias("value"))
    best = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).withColumn("part", F.lit("term"))

    some = groups.filter("terms > 0")
    found = _pairs(shared.select("lang", "source", "term", "n", "p", "total", "first"), some, block_terms, tile)
    none = groups.filter("terms = 0")
    found = found.unionByName(none.alias("a").join(none.alias("b"), F.expr("a.lang = b.lang AND a.source <> b.source")).selectExpr("a.lang", "a.source", "b.source AS item", "0L AS value"))
    pairs = found.withColumn("rank", F.row_number().over(best)).withColumn("part", F.lit("pair"))
    columns = ["lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")]
    return pairs.select(*columns).unionByName(terms.select(*columns))
