"""N-gram Jaccard join by T-occurrence search (DivideSkip), to connected components.

Texts with the same shingle set are one class; classes are searched. Every step is exact (over
64-bit shingle hashes), for the threshold t and sets A, B of a linked pair:

1. *Signatures.* A shares at least t |A| shingles with B. In a common order, here that of the hashes,
   the first |A| - ceil(t |A|) + l(A) shingles of A and of B then share l = min(l(A), l(B)) or more.
   Only these are shuffled, about a third of all.
2. *T-occurrence bound.* Of a signature, only shingles that other classes' signatures hold too can
   be shared; a class with fewer than l(ceil(t |A|)) of them links with nothing. For what is left the
   bound is taken again over whole sets: ceil(t |A|) shingles must be held by others too. So texts
   that have just a passage in common leave here.
3. *Blocks.* Of these shingles, all but the ceil(t |A|) - 1 most frequent are looked at: of a linked
   pair at least one of them is shared. Connected components over them are blocks, and every linked
   pair lies within one.
4. *Search.* In a cell (a block, or a part of a large one) neighbours by size are compared first;
   what is then outside the largest component queries an inverted index of the cell: the longest
   lists are set aside, the short ones are merged by a heap with skips, and candidates with enough
   occurrences are looked up in the long ones by binary search. Components already joined are not
   compared again, so a group of near copies costs about its size, not its square.
5. *Large blocks* are dealt into cells by hash; a few members stand in all cells and join them.
   Whatever stays outside the block's largest component then queries the block's parts: members of
   one size band and like components, about VOLUME shingles in each. A query goes to a part only if
   the part's band can hold a partner and some member shares one of the looked-at shingles.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, by_slices, components, cut, perhaps_in, without

CELL = 128
LEADERS = 8
#: Shingles in a part of a large block, and the queries one copy of it answers.
VOLUME = 1 << 19
QUERIES = 2048


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 250_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _WordHashes()


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles, A-Z in lower case.

    Fewer than ``size`` words are one shingle; no words, none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.int64)
    one = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    made = one[: len(one) - width + 1] + np.uint64(width)
    for i in range(1, width):
        made = (made ^ (made >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + one[i : len(one) - width + 1 + i]
    made = (made ^ (made >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.unique((made ^ (made >> np.uint64(29))).view(np.int64))


def least_overlap(n: int, percent: int) -> int:
    """ceil(t n)"""
    return -(-percent * n // 100)


def _extra(n: int) -> int:
    return 1 + n // 12


def signature_length(n: int, percent: int) -> int:
    return min(n, n - least_overlap(n, percent) + _extra(n))


def linked(shared: int, a: int, b: int, percent: int) -> bool:
    return 100 * shared >= percent * (a + b - shared) and shared > 0


def merge_skip(lists: list[list[int]], least: int) -> list[tuple[int, int]]:
    """(value, occurrences) of the values that at least ``least`` of the sorted lists hold."""
    heap = [(x[0], k, 0) for k, x in enumerate(lists) if x]
    heapq.heapify(heap)
    out = []
    while len(heap) >= least and heap:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= least:
            out.append((top, len(popped)))
            for _, k, at in popped:
                if at + 1 < len(lists[k]):
                    heapq.heappush(heap, (lists[k][at + 1], k, at + 1))
            continue
        # values below the least-th smallest head can't occur often enough
        while heap and len(popped) < least - 1:
            popped.append(heapq.heappop(heap))
        if not heap:
            break
        to = heap[0][0]
        for _, k, at in popped:
            if (j := bisect_left(lists[k], to, at)) < len(lists[k]):
                heapq.heappush(heap, (lists[k][j], k, j))
    return out


class Index:
    """An inverted index of a cell: shingle -> ascending places of the members that hold it. Members come in order of size."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = [len(s) for s in sets]
        tokens = np.concatenate(sets)
        places = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.places = places[order]
        self.tokens, inverse = np.unique(tokens[order], return_inverse=True)
        self.keys = inverse * len(sets) + self.places  # ascending: a list's part within a range of sizes is found by bisection

    def search(self, query: np.ndarray, percent: int, wanted, own: int | None = None) -> Iterator[tuple[int, int]]:
        """DivideSkip: (place, shared shingles) of the members that may link with the query.

        wanted(place): whether it is still of interest. own: the query's place, if it is a member.
        """
        n, count = len(query), len(self.sizes)
        least = least_overlap(n, percent)
        at = np.searchsorted(self.tokens, query)
        at = at[at < len(self.tokens)]
        at = at[np.isin(self.tokens[at], query, assume_unique=True)]
        if len(at) < least:
            return
        low, high = bisect_left(self.sizes, least), bisect_left(self.sizes, 100 * n // percent + 1)
        begin, end = np.searchsorted(self.keys, at * count + low), np.searchsorted(self.keys, at * count + high)
        shared = end - begin > (0 if own is None else 1)  # a list of the query alone says nothing
        if shared.sum() < least:
            return
        begin, end = begin[shared], end[shared]
        order = np.argsort(end - begin, kind="stable")
        begin, end = begin[order], end[order]
        longest = int(end[-1] - begin[-1])
        n_long = min(least - 1, int(least / (0.01 * np.log2(longest + 1) + 1)))
        split = len(begin) - n_long
        short = [self.places[b:e].tolist() for b, e in zip(begin[:split], end[:split])]
        long_ = [self.places[b:e] for b, e in zip(begin[split:], end[split:])]
        for place, found in merge_skip(short, least - n_long):
            if not wanted(place):
                continue
            need = -(-percent * (n + self.sizes[place]) // (100 + percent))
            left = len(long_)
            for x in long_:
                if found + left < need:
                    break
                k = int(np.searchsorted(x, place))
                found += k < len(x) and int(x[k]) == place
                left -= 1
            yield place, found


class _Union:
    def __init__(self, labels: list[int]):
        self.up: dict[int, int] = {x: x for x in labels}

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def link_cell(members: list[tuple[int, int, np.ndarray, bool]], percent: int) -> list[tuple[int, int]]:
    """Joins the members (id, component, set, query only) of a cell; gives (component, component it is joined to)."""
    members = sorted(members, key=lambda m: (len(m[2]), m[0]))
    union = _Union([m[1] for m in members])
    for (_, c, s, _), (_, d, u, _) in zip(members, members[1:]):
        if union.root(c) != union.root(d) and linked(len(np.intersect1d(s, u, assume_unique=True)), len(s), len(u), percent):
            union.join(c, d)
    roots = [union.root(m[1]) for m in members]
    if len(set(roots)) > 1:
        queries = [i for i, m in enumerate(members) if m[3]]
        if not queries:
            largest = max(set(roots), key=lambda r: (roots.count(r), -r))
            queries = [i for i, r in enumerate(roots) if r != largest]
        index = Index([m[2] for m in members])
        for i in queries:
            own, size = members[i][1], len(members[i][2])
            for place, shared in index.search(members[i][2], percent, lambda p: union.root(members[p][1]) != union.root(own), i):
                if union.root(members[place][1]) != union.root(own) and linked(shared, size, len(members[place][2]), percent):
                    union.join(own, members[place][1])
    return sorted({(m[1], union.root(m[1])) for m in members if union.root(m[1]) != m[1]})


def _search(cells: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) from rows of cells: block, cell, id, component, hashes, query."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for pdf in frames for r in zip(pdf["block"], pdf["cell"], pdf["id"], pdf["component"], pdf["hashes"], pdf["query"]))
        for _, group in groupby(rows, key=lambda r: r[:2]):
            found = link_cell([(int(i), int(c), np.asarray(h, np.int64), bool(q)) for _, _, i, c, h, q in group], percent)
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])

    # ranges of cells even out what hashing would not: a cell is never divided. The work goes by comparisons, not by bytes,
    # so the number of tasks is not left to be merged by their size
    tasks = 2 * int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.repartitionByRange(tasks, "block", "cell").sortWithinPartitions("block", "cell")
    return dealt.mapInPandas(run, "a long, b long")


def _fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in by_slices(batches):
            sets = [shingles(t, size) for t in batch.column(1).to_pylist()]
            classes = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
            signatures = pa.array([s[: signature_length(len(s), percent)] for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), classes, signatures], ["id", "n", "class", "signature"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_text")).mapInArrow(run, "id long, n long, class binary, signature array<long>")


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """The sets of (node, only, _text); where ``only`` names a class, just that of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in by_slices(batches):
            rows = zip(*(batch.column(k).to_pylist() for k in range(3)))
            sets = [(node, s) for node, only, t in rows for s in [shingles(t, size)] if only is None or only == xxhash.xxh3_128_digest(s.tobytes())]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in sets], pa.int64()), pa.array([s for _, s in sets], pa.list_(pa.int64()))], ["id", "hashes"])

    return texts.select("node", "only", "_text").mapInArrow(run, "id long, hashes array<long>")


def _repeated(tokens: DataFrame, must: Column, tables: Tables) -> DataFrame:
    """From (id, n, h): the ids with ``must`` shingles or more that others hold too, and the rarest of these (df, h), all but must - 1.

    Counting and looking up are two shuffles, so that a shingle that very many hold is pre-aggregated
    in the one and can be split in the other; a bitmap keeps the unrepeated out of the latter.
    """
    met = tables.cut(tokens.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1"), "ngram-met")
    held = perhaps_in(tokens, "h", met).join(met, "h").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("held")).filter(F.size("held") >= must)
    return held.select("id", F.slice("held", F.lit(1), (F.size("held") - must + 1).cast("int")).alias("rarest"))


def _ask_parts(rows: DataFrame, searched: DataFrame, percent: int, tables: Tables) -> DataFrame:
    """Edges between the members outside their block's largest component and all others of the block.

    rows: id, hashes, block, component, largest. searched: (id, h), the looked-at shingles.
    """
    # sizes of a linked pair lie within a factor of 100 / percent: in one band or two neighbouring ones
    band = F.floor(F.log(F.size("hashes").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    sized = tables.cut(rows.select("id", "block", "component", (F.col("component") != F.col("largest")).alias("asks"), F.size("hashes").cast("long").alias("n"), band.alias("band")), "ngram-sized")
    volumes = sized.groupBy("block", "band", "component").agg(F.sum("n").alias("volume"))
    small = volumes.filter(F.col("volume") < VOLUME).groupBy("block", "band").agg(F.sum("volume").alias("rest"))
    placed = sized.join(volumes, ["block", "band", "component"]).join(small, ["block", "band"], "left")
    of = lambda key, total: F.pmod(F.xxhash64(key, F.lit(17)), F.ceil(F.col(total) / VOLUME).cast("long"))
    part = F.when(F.col("volume") < VOLUME, F.xxhash64("block", "band", of("component", "rest"))).otherwise(F.xxhash64("block", "band", "component", of("id", "volume")))
    placed = tables.cut(placed.select("id", "block", "component", "asks", "band", part.alias("part")), "ngram-placed")
    held = tables.cut(searched.join(placed.select("id", "asks", "band", "part"), "id"), "ngram-routes")
    stands = held.select("h", "part", F.col("band").alias("at")).distinct()
    asked = held.filter("asks").select("h", "id", "band").join(stands, "h").filter(F.abs(F.col("band") - F.col("at")) <= 1).select("id", "part").distinct()
    asked = tables.cut(asked, "ngram-asked")
    copies = tables.cut(asked.groupBy("part").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("copies")), "ngram-copies")
    sets = rows.select("id", "hashes")
    index = placed.join(copies, "part").withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select("part", "cell", "id", "component", F.lit(False).alias("query"))
    queries = asked.join(copies, "part").join(placed.select("id", "component"), "id").select("part", F.pmod(F.xxhash64("id", F.lit(11)), "copies").cast("int").alias("cell"), "id", "component", F.lit(True).alias("query"))
    cells = index.unionByName(queries).join(sets, "id")
    return _search(cells.select(F.col("part").alias("block"), "cell", "id", "component", "hashes", "query"), percent)


def _answer(docs: DataFrame, prints: DataFrame, tables: Tables, id_col: str, text_col: str, size: int, percent: int) -> tuple[DataFrame, bool]:
    """(class, component) from the tables of this call, and whether an id has several texts."""
    n = prints.count()
    rows = prints.filter("class IS NOT NULL AND id IS NOT NULL")
    classes = tables.cut(rows.groupBy("class").agg(F.min("id").alias("rep"), F.count("*").alias("rows")), "ngram-classes", n)
    # a class is known by its smallest id; where an id has several texts, by a hash of its own
    mark = F.xxhash64("class")
    several = tables.cut(rows.groupBy("id").agg(F.min(mark).alias("one"), F.max(mark).alias("other")).filter("one <> other").select("id"), "ngram-several", n)
    shared_ids = not several.isEmpty()
    marked = F.xxhash64("id", "class").alias("_copy")
    copies = tables.cut(rows.select("class", "id").join(classes.filter("rows > 1"), "class").filter("id <> rep").select("id", "class", marked).distinct(), "ngram-copies", n)
    first_rows = without(rows.select("*", marked), "_copy", copies, on=["id", "class"]).drop("_copy")  # signatures stay where they are
    if shared_ids:
        known = several.select(F.col("id").alias("rep"), F.lit(True).alias("is_shared"))
        classes = tables.cut(classes.join(known, "rep", "left").withColumn("node", F.when(F.col("is_shared"), mark).otherwise(F.col("rep"))), "ngram-classes", n)
        first_rows = first_rows.join(known.withColumnRenamed("rep", "id"), "id", "left").withColumn("node", F.when(F.col("is_shared"), mark).otherwise(F.col("id")))
    else:
        classes, first_rows = classes.withColumn("node", F.col("rep")), first_rows.withColumn("node", F.col("id"))
    signatures = first_rows.select(F.col("node").alias("id"), "n", F.explode("signature").alias("h"))

    least = F.ceil(F.lit(percent) * F.col("n") / 100)
    survivors = tables.cut(_repeated(signatures, 1 + F.floor(least / 12), tables).select(F.col("id").alias("node")), "ngram-survivors")
    wanted = survivors.select("node", F.col("node").alias("id"), F.lit(None).cast("binary").alias("only"))
    if shared_ids:
        named = classes.filter("is_shared").select("node", "rep", "class")
        wanted = tables.cut(survivors.join(named, "node", "left").select("node", F.coalesce("rep", "node").alias("id"), F.col("class").alias("only")), "ngram-wanted")
    texts = perhaps_in(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_text")), "id", wanted)
    sets = tables.cut(_sets(texts.join(wanted, "id"), size), "ngram-sets")
    whole = sets.select("id", F.size("hashes").cast("long").alias("n"), F.explode("hashes").alias("h"))
    held = _repeated(whole, least, tables)
    searched = tables.cut(held.select("id", F.explode("rarest").alias("x")).select("id", F.col("x.h").alias("h")), "ngram-searched")
    first = tables.cut(searched.groupBy("h").agg(F.min("id").alias("first"), F.count("*").alias("holders")).filter("holders > 1").select("h", "first"), "ngram-first")
    blocks = components(searched.join(first, "h").select(F.col("id").alias("a"), F.col("first").alias("b")), "ngram-blocks", tables)
    blocks = tables.cut(blocks.select(F.col("node").alias("id"), F.col("component").alias("block")), "ngram-blocks", n)
    sizes = tables.cut(blocks.groupBy("block").agg(F.count("*").alias("members")), "ngram-sizes", n)
    members = tables.cut(blocks.join(sizes, "block"), "ngram-members", n)
    alone, sets = sets, tables.cut(sets.join(members, "id"), "ngram-sets")
    tables.drop(alone)
    parts = F.ceil(F.col("members") / CELL).cast("int")
    own = F.when(F.col("members") <= CELL, F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), parts)).cast("int")
    leads = (F.col("members") > CELL) & (F.pmod(F.xxhash64("id", F.lit(7)), F.col("members")) < LEADERS)
    cells = sets.withColumn("cell", F.explode(F.when(leads, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(own))))
    edges = tables.cut(_search(cells.select("block", "cell", "id", F.col("id").alias("component"), "hashes", F.lit(False).alias("query")), percent), "ngram-edges")

    large = sets.filter(F.col("members") > CELL)
    if not large.isEmpty():
        found = tables.cut(components(edges, "ngram-parts", tables), "ngram-parts", n)
        labelled = large.select("block", "id", "members").join(found, F.col("id") == F.col("node"), "left").select("block", "id", "members", F.coalesce("component", "id").alias("component"))
        labelled = tables.cut(labelled, "ngram-labelled", n)
        counts = labelled.groupBy("block", "component").agg(F.count("*").alias("k"))
        largest = tables.cut(counts.groupBy("block").agg(F.max_by("component", F.struct("k", "component")).alias("largest"), (F.sum("k") - F.max("k")).alias("outside")).filter("outside > 0"), "ngram-largest", n)
        rows_outside = tables.cut(large.select("id", "hashes").join(labelled, "id").join(largest, "block"), "ngram-outside")
        edges = edges.unionByName(tables.cut(_ask_parts(rows_outside, searched.join(first.select("h"), "h"), percent, tables), "ngram-edges"))
    if shared_ids:
        nodes = tables.cut(rows.select("id", "class").join(several, "id").join(classes.select("class", "node"), "class").select("id", "node").distinct(), "ngram-nodes", n)
        edges = edges.unionByName(nodes.join(nodes.groupBy("id").agg(F.min("node").alias("b")), "id").select(F.col("node").alias("a"), "b"))
    joined = tables.cut(components(edges, "ngram-components", tables).select(F.col("node").alias("_node"), "component"), "ngram-components", n)
    answer = classes.join(joined, F.col("node") == F.col("_node"), "left").select("class", "rep", F.coalesce("component", "node").alias("component"))
    if shared_ids:  # from nodes to the smallest id of the component
        answer = tables.cut(answer, "ngram-answer")
        answer = answer.join(answer.groupBy("component").agg(F.min("rep").alias("smallest")), "component").select("class", F.col("smallest").alias("component"))
    return answer.select("class", "component"), shared_ids


def link_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """For each row: id, n_shingles, component_id (the smallest id reachable by links, its own included).

    Two documents link when 100 * shared >= percent * united shingles. Null texts, empty ones and
    such without words have no shingle and link with nothing. Rows that repeat an id are one node,
    whatever their texts: it has the links of each of them. A null id gets a null component. An empty
    table gives an empty result. Other columns are not read.
    """
    prints = cut(_fingerprints(docs, id_col, text_col, size, percent), "ngram-prints")
    with Tables(docs.sparkSession) as tables:
        answer, shared_ids = _answer(docs, prints, tables, id_col, text_col, size, percent)
        answer = cut(answer, "ngram-answer")
    out = prints.select("id", "n", "class").join(answer, "class", "left")
    if shared_ids:  # an id's row without a shingle belongs to its other rows
        ids = cut(out.filter("id IS NOT NULL").groupBy("id").agg(F.min("component").alias("of_id")), "ngram-ids")
        out = out.join(ids, "id", "left").withColumn("component", F.coalesce("component", "of_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
