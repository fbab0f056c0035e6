"""Spelling variants by composition of automata.

Of two words at one edit from each other, the shorter of m code points, either the first a = ceil(m / 2)
code points are the same or the last m - a are. So every word is dealt, for m its own length and one less,
to the partition of its first a code points and to that of its last m - a, read backwards. A
partition is an initial state of the vocabulary's acceptor: all its words have reached that state. For
what follows, a minimised acceptor A is made, and composed with the one-edit transducer E and with A
again: states (p, e, q), where p and q are states of A and e tells whether the edit is spent. Up to
the edit p and q are the same state; from there on the right languages of p and q are intersected, once
for each pair of states. Accepted pairs are pairs of word numbers: an acceptor whose states know how
many words they accept numbers its words by summing on the way.

Partitions are streamed in sorted order, so a task holds one partition's words. Their size follows
from the vocabulary's shape: words of about m code points with the same half, never from how often a
word occurs.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices_of_words

#: Byte table over Latin-1: its letters (ASCII in lower case), all else a space.
LETTERS = bytes(b if b >= 0xC0 else ord(chr(b).lower()) if b < 128 and chr(b).isalpha() else 32 for b in range(256))


def misspelled(words: Counter, prefix: bytes, one_in: int) -> Iterator[tuple[bytes, int]]:
    """Each word (Latin-1) with its count; a word whose crc32 after ``prefix`` is divisible loses the code point that the crc tells."""
    start = zlib.crc32(prefix)
    for word, n in words.items():
        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
        if not h % one_in:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        yield word, n


def count_words(docs: DataFrame, id_: Column, text: Column, least_length: int, one_in: int, most_entries: int = 300_000) -> DataFrame:
    """(word, n) by task and part: sums are still to be made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in often], pa.string()), pa.array(often.values(), pa.int64())], ["word", "n"])
            often.clear()
            return made

        for batch in batches:
            for at in range(batch.num_rows):
                # other characters become a question mark, which is no letter either
                data = batch[1][at].as_py().encode("latin-1", "replace")
                own: Counter = Counter()
                for words in slices_of_words(data, LETTERS):
                    own.update(words)
                for word, n in misspelled(own, batch[0][at].as_py().encode() + b":", one_in):
                    if len(word) >= least_length:
                        often[word] = often.get(word, 0) + n
                if len(often) > most_entries:
                    yield flush()
        yield flush()

    rows = docs.select(F.coalesce(id_.cast("string"), F.lit("")).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    return rows.mapInArrow(run, "word string, n long")


class Acceptor:
    """The minimal acyclic automaton of sorted, distinct words.

    edges[s]: {character: state}; final[s]; size[s]: words accepted from s. A state's number is greater than those it leads to.
    """

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.size: list[int] = []
        known: dict[tuple, int] = {}
        # states on the current word's path that may still get edges
        path: list[list] = [[False, {}]]
        last = ""

        def close(down_to: int) -> None:
            while len(path) > down_to + 1:
                final, edges = path.pop()
                path[-1][1][last[len(path) - 1]] = self._state(known, final, edges)

        for word in words:
            shared = 0
            while shared < min(len(word), len(last)) and word[shared] == last[shared]:
                shared += 1
            close(shared)
            path += [[False, {}] for _ in word[shared:]]
            path[-1][0] = True
            last = word
        close(0)
        self.start = self._state(known, *path[0])

    def _state(self, known: dict[tuple, int], final: bool, edges: dict[str, int]) -> int:
        key = (final, *edges.items())
        if key not in known:
            known[key] = len(self.edges)
            self.edges.append(edges)
            self.final.append(final)
            self.size.append(final + sum(self.size[s] for s in edges.values()))
        return known[key]

    def numbered(self, s: int) -> list[tuple[str, int, int]]:
        """(character, next state, number of the first word over that edge, counted among those from s)."""
        out, at = [], int(self.final[s])
        for c, t in self.edges[s].items():
            out.append((c, t, at))
            at += self.size[t]
        return out


def one_edit_pairs(words: list[str]) -> list[tuple[int, int]]:
    """All pairs (i, j) of numbers of sorted, distinct words at exactly one edit; of different lengths the shorter comes first."""
    a = Acceptor(words)
    arcs = [a.numbered(s) for s in range(len(a.edges))]
    shared: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def meet(p: int, q: int) -> list[tuple[int, int]]:
        """Words accepted from both states, by their numbers there. Depth is kept on a list: words may be very long."""
        stack = [(p, q)]
        while stack:
            x, y = stack[-1]
            if (x, y) in shared:
                stack.pop()
                continue
            if x == y:
                shared[x, y] = [(k, k) for k in range(a.size[x])]
                continue
            other = {c: (t, at) for c, t, at in arcs[y]}
            both = [(t, u, at, by) for c, t, at in arcs[x] if c in other for u, by in [other[c]]]
            if wait := [(t, u) for t, u, _, _ in both if (t, u) not in shared]:
                stack += wait
                continue
            found = [(0, 0)] if a.final[x] and a.final[y] else []
            for t, u, at, by in both:
                found += [(at + i, by + j) for i, j in shared[t, u]]
            shared[x, y] = found
        return shared[p, q]

    pairs: list[list[tuple[int, int]]] = []
    for p, out in enumerate(arcs):  # what a state leads to has a smaller number
        found: set[tuple[int, int]] = set()
        for c, t, at in out:
            found.update((at + i, at + j) for i, j in pairs[t])  # c on both sides, the edit comes later
            found.update((i, at + j) for i, j in meet(p, t))  # c inserted
            found.update((at + i, by + j) for d, u, by in out if c < d for i, j in meet(t, u))  # c replaced by d
        pairs.append(list(found))
    return pairs[a.start]


def near_pairs(words: DataFrame, least_length: int) -> DataFrame:
    """(word, n, other, other_n), in both directions, from words (word, n)."""
    spark = words.sparkSession
    size = F.length("word")
    dealt = words.select("word", "n", F.explode(F.sequence(F.greatest(size - 1, F.lit(least_length)), size)).alias("m"))
    half = F.ceil(F.col("m") / 2).cast("int")
    dealt = dealt.select("word", "n", "m", F.explode(F.array(F.struct(F.lit(False).alias("back"), F.substring("word", F.lit(1), half).alias("half")), F.struct(F.lit(True).alias("back"), F.substring("word", half - F.col("m"), F.col("m") - half).alias("half")))).alias("k"))
    dealt = dealt.select("m", "k.back", "k.half", "word", "n")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartition(tasks, "m", "back", "half").sortWithinPartitions("m", "back", "half", "word")

    def found(m: int, back: bool, group: list[tuple[str, int]]) -> Iterator[tuple]:
        n, first = dict(group), -(-m // 2)
        same = m - first if back else first
        rest = sorted(w[::-1][same:] if back else w[same:] for w in n)
        begun = group[0][0][::-1][:same] if back else group[0][0][:same]
        whole = [(begun + r)[::-1] if back else begun + r for r in rest]
        for i, j in one_edit_pairs(rest):
            u, v = whole[i], whole[j]
            # longer pairs are another partition's, pairs whose first half is the same too are the forward one's
            if min(len(u), len(v)) == m and not (back and u[:first] == v[:first]):
                yield u, n[u], v, n[v]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 4, kinds)], ["word", "n", "other", "other_n"])
            out.clear()
            return made

        for (m, back, _), group in groupby(rows, key=itemgetter(0, 1, 2)):
            words = [r[3:] for r in group]
            if len(words) > 1:
                out += found(m, back, words)
                if len(out) > 20_000:
                    yield flush()
        yield flush()

    once = ordered.mapInArrow(run, "word string, n long, other string, other_n long")
    turned = F.explode(F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))))
    return once.select(turned.alias("pair")).select("pair.*")


def roots(forms: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(word, root) from (word, form): each word's last form. A form is more frequent than its word, so there is no way back.

    Every round doubles the way that a word has gone, so n rounds suffice for ways of 2 ** n forms.
    """
    now = cut(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(most_rounds):
        further = now.select(F.col("word").alias("at"), F.col("root").alias("to"))
        joined = now.join(further, F.col("root") == F.col("at"), "left")
        after = cut(joined.select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")), "spelling-roots")
        moved = not after.filter("moved").isEmpty()
        now = after.select("word", "root")
        if not moved:
            return now
    raise RuntimeError(f"forms did not end in {most_rounds} rounds")


def variants(docs: DataFrame, *, least_length: int = 5, least_n: int = 3, ratio: int = 2, one_in: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the vocabulary of ``docs``.

    Words are runs of ASCII and Latin-1 letters (A-Z in lower case) of least_length code points that
    occur least_n times in all; one in ``one_in`` (by crc32 of ``id:word``) is made a misspelling by
    deleting one code point. n_near counts the words at exactly one inserted, deleted or replaced code
    point. form is the most frequent of them (ties: the smallest) if it occurs ``ratio`` (2 or more)
    times as often as the word, else null; root follows the forms, and is the word itself without one.
    Null texts have no word, a null id counts as an empty one, repeated rows count as they come, and
    other columns are not read; no words give an empty result.
    """
    counted = count_words(docs, F.col(id_col), F.col(text_col), least_length, one_in).groupBy("word").agg(F.sum("n").alias("n"))
    words = cut(counted.filter(F.col("n") >= least_n), "spelling-words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = near_pairs(words, least_length).groupBy("word").agg(F.count("*").alias("n_near"), F.first("n").alias("n"), best.alias("best"))
    strong = -F.col("best.less") >= ratio * F.col("n")
    near = cut(near.select("word", "n_near", F.when(strong, F.col("best.form")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")), "spelling-near")
    ends = roots(near.filter("form IS NOT NULL"))
    out = words.join(near, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
