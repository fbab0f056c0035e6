"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon turns a clause into symbols: insult and threat words with a weight each, words for a target,
negations, and words of reported speech. Four small transducers read them in a row and are composed
into one automaton when a model is made:

* negation: an insult or threat that closely follows a negation becomes a negated one;
* reported speech: after a verb of saying, what follows in the clause is quoted;
* threat: a word of violence is a threat only in a clause with a target; else it is left out;
* target: an insult in a clause with a target counts more.

Their weights are log odds and add up along the clause. A clause matches if its sum is positive; single
words never count by themselves. A text's score is a logistic function of what its matched clauses
weigh: in all, for its length, and at most in one clause.

The insult words, or beginnings of words, and their weights are learned from labelled rows: log odds by
how many toxic and other texts hold them, with the lower bound of what such counts allow.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_slices, cut

# Common words of four languages that stand for a symbol of the grammar.
TARGETS = "you your yours you're u he she they them him her his their this that these those du dich dir dein deine ihr euch er sie sein tu te toi ton ta vous votre il elle ils elles tú ti usted ustedes vosotros él ella ellos ellas".split()
NEGATIONS = "not no never isn't aren't don't doesn't wasn't neither nor without nicht kein keine nie niemals ohne ne pas jamais sans no nunca jamás sin ni".split()
REPORTS = "said says say saying wrote writes called calls quoted quote quotes claimed claims alleged reportedly sagte sagt schrieb nannte zitierte angeblich dit disait écrit appelé cité prétend dijo dice escribió llamó citó supuestamente".split()
THREATS = "kill kills killing murder stab shoot strangle behead töten umbringen erschießen ermorden tuer assassiner égorger étrangler matar asesinar apuñalar degollar".split()

#: Symbols: other, target, negation, report, insult, threat; negated and quoted insults and threats come in between.
OTHER, TARGET, NEGATION, REPORT, INSULT, THREAT = "o", "t", "n", "r", "i", "s"
SOFT = {INSULT: "I", THREAT: "S"}  # negated or quoted

_CLAUSE = re.compile(r"[.!?;:\n]+")
#: Byte table: ASCII letters and the apostrophe stay (texts are in lower case), other ASCII characters part words.
_FLAT = bytes(b if b >= 128 or chr(b).isalpha() or b == 39 else 32 for b in range(256))


@dataclass
class Transducer:
    """Sequential, weighted: arcs[state, symbol] = (next state, symbol put out, weight). Missing arcs keep state and symbol at weight 0."""

    arcs: dict[tuple, tuple] = field(default_factory=dict)
    start: object = 0

    def step(self, state, symbol: str) -> tuple:
        return self.arcs.get((state, symbol), (state, symbol, 0.0))


def compose(first: Transducer, second: Transducer, symbols: str) -> Transducer:
    """Reads with ``first``, whose output ``second`` reads; weights add. Only states that can be reached are made."""
    made, open_ = Transducer(start=(first.start, second.start)), [(first.start, second.start)]
    seen = set(open_)
    while open_:
        a, b = state = open_.pop()
        for symbol in symbols:
            a2, between, w1 = first.step(a, symbol)
            b2, out, w2 = second.step(b, between)
            made.arcs[state, symbol] = ((a2, b2), out, w1 + w2)
            if (a2, b2) not in seen:
                seen.add((a2, b2))
                open_.append((a2, b2))
    return made


def negation(window: int = 3, weight: float = -4.0) -> Transducer:
    """States: words since a negation, 0 for none near."""
    arcs: dict[tuple, tuple] = {(k, NEGATION): (1, NEGATION, 0.0) for k in range(window + 1)}
    for k in range(1, window + 1):
        arcs |= {(k, x): (0, SOFT[x], weight) for x in SOFT}
        arcs |= {(k, x): ((k + 1) % (window + 1), x, 0.0) for x in (OTHER, TARGET, REPORT)}
    return Transducer(arcs)


def reported(weight: float = -2.0) -> Transducer:
    arcs: dict[tuple, tuple] = {(k, REPORT): (1, REPORT, 0.0) for k in (0, 1)}
    return Transducer(arcs | {(1, x): (1, SOFT[x], weight) for x in SOFT})


def threats(lexical: float = 3.0) -> Transducer:
    """A word of violence, before or after a target, counts ``lexical`` once they have met. States: nothing, target, violence, both."""
    arcs: dict[tuple, tuple] = {(0, TARGET): (1, TARGET, 0.0), (2, TARGET): (3, TARGET, lexical)}
    for x in (THREAT, SOFT[THREAT]):
        arcs |= {(0, x): (2, OTHER, 0.0), (1, x): (3, OTHER, lexical), (2, x): (2, OTHER, 0.0), (3, x): (3, OTHER, 0.0)}
    return Transducer(arcs)


def targeted(weight: float = 1.0) -> Transducer:
    """The first insult of a clause with a target, whichever comes first, weighs more."""
    arcs: dict[tuple, tuple] = {(0, TARGET): (1, TARGET, 0.0), (0, INSULT): (2, INSULT, 0.0), (1, INSULT): (3, INSULT, weight), (2, TARGET): (3, TARGET, weight)}
    return Transducer(arcs)


def grammar() -> Transducer:
    symbols = OTHER + TARGET + NEGATION + REPORT + INSULT + THREAT
    made = negation()
    for part in (reported(), threats(), targeted()):
        made = compose(made, part, symbols)
    return made


class Lexicon:
    """Word to (symbol, weight). An entry ``x*`` stands for all longer words that begin with x; of several the longest holds.

    Words of the grammar keep their symbol. Results are remembered, for most_known words at a time.
    """

    def __init__(self, insults: dict[str, float], most_known: int = 500_000):
        self.insults, self.most_known = insults, most_known
        self.fixed = {w: (s, 0.0) for s, words in ((THREAT, THREATS), (REPORT, REPORTS), (TARGET, TARGETS), (NEGATION, NEGATIONS)) for w in words}
        self.longest = max((len(x) for x in insults), default=0)
        self.plain: set[str] = set()
        self.marked: dict[str, tuple[str, float]] = {}

    def _find(self, word: str) -> tuple[str, float] | None:
        if word in self.fixed:
            return self.fixed[word]
        if word in self.insults:
            return INSULT, self.insults[word]
        for k in range(min(len(word) - 1, self.longest), 2, -1):
            if (weight := self.insults.get(word[:k] + "*")) is not None:
                return INSULT, weight
        return None

    def hits(self, words: set[str]) -> bool:
        """Whether an insult or threat is among them."""
        if len(self.plain) + len(self.marked) > self.most_known:
            self.plain, self.marked = set(), {}
        for word in words - self.plain - self.marked.keys():
            if (found := self._find(word)) is None:
                self.plain.add(word)
            else:
                self.marked[word] = found
        return any(self.marked[w][0] in SOFT for w in words & self.marked.keys())

    def read(self, word: str) -> tuple[str, float]:
        return self.marked.get(word, (OTHER, 0.0))


class Reader:
    """What the grammar finds in a text. Lives inside tasks."""

    def __init__(self, insults: dict[str, float]):
        self.lexicon, self.grammar = Lexicon(insults), grammar()

    def __call__(self, text: str | None) -> tuple[tuple[float, float, float], list[tuple[str, float]]]:
        """The features of a text, and its matched clauses with their weights."""
        low = (text or "").lower()
        words = low.encode("utf-8", "replace").translate(_FLAT).decode().split()
        found = self._matched(low) if self.lexicon.hits(set(words)) else []
        total = sum(w for _, w in found)
        return (math.log1p(total), math.log1p(100.0 * total / max(20, len(words))), max((w for _, w in found), default=0.0)), found

    def _matched(self, low: str) -> list[tuple[str, float]]:
        out = []
        for clause in _CLAUSE.split(low):
            state, total = self.grammar.start, 0.0
            # a word said over and over is said once
            for word, _ in groupby(clause.encode("utf-8", "replace").translate(_FLAT).decode().split()):
                symbol, weight = self.lexicon.read(word)
                state, _, more = self.grammar.arcs[state, symbol]
                total += weight + more
            if total > 0:
                out.append((clause.strip(), total))
        return out


@dataclass
class Model:
    insults: dict[str, float]
    #: Constant, and factors of the features.
    factors: tuple[float, ...]

    def score(self, features: tuple[float, ...]) -> float:
        z = self.factors[0] + sum(f * x for f, x in zip(self.factors[1:], features))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept for testing: crc32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _held(texts: DataFrame, most_entries: int = 300_000) -> DataFrame:
    """(entry, fold, toxic, n) of (text, fold, toxic): in how many texts each word and beginning of a word is, by task and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often: dict[tuple[int, int], Counter] = {}

        def flush() -> pa.RecordBatch:
            rows = [(e, f, y, n) for (f, y), c in often.items() for e, n in c.items()]
            often.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, [pa.string(), pa.int32(), pa.int32(), pa.int64()])], ["entry", "fold", "toxic", "n"])

        for batch in by_slices(batches, 100):
            for text, fold, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                words = set(text.lower().encode("utf-8", "replace").translate(_FLAT).decode().split())
                own = {w[:40] for w in words if len(w) <= 40} | {w[:k] + "*" for w in words for k in range(3, min(len(w), 13))}
                often.setdefault((fold, toxic), Counter()).update(own)
                if sum(map(len, often.values())) > most_entries:
                    yield flush()
        yield flush()

    return texts.mapInArrow(run, "entry string, fold int, toxic int, n long").groupBy("entry", "fold", "toxic").agg(F.sum("n").alias("n"))


def weigh(held: dict[str, tuple[int, int]], toxic: int, other: int, *, least_docs: int, least_weight: float) -> dict[str, float]:
    """Entries with the lower bound (1.64 standard errors) of their log odds, if that is least_weight or more.

    held: in how many toxic and other texts an entry is. A beginning ``x*`` is left out if nine tenths of its
    toxic texts have one longer entry, which then says the same of fewer words. A word that begins like an
    entry ``x*`` needs no entry of its own unless its weight differs by more than half.
    """
    out: dict[str, float] = {}
    longer: dict[str, int] = {}
    for entry, (a, _) in held.items():
        shorter = entry.rstrip("*")[:-1] + "*"
        longer[shorter] = max(longer.get(shorter, 0), a)
    for entry, (a, b) in sorted(held.items(), key=lambda e: (len(e[0].rstrip("*")), e[0])):
        if a < least_docs or longer.get(entry, 0) >= 0.9 * a:
            continue
        odds = math.log((a + 0.5) * (other - b + 0.5) / ((toxic - a + 0.5) * (b + 0.5)))
        error = math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (toxic - a + 0.5) + 1 / (other - b + 0.5))
        weight = odds - 1.64 * error
        base = entry.rstrip("*")
        above = next((out[base[:k] + "*"] for k in range(len(base) - (not entry.endswith("*")), 2, -1) if base[:k] + "*" in out), None)
        if weight >= least_weight or (above is not None and b >= least_docs and weight < above - 0.5):
            if above is None or abs(weight - above) > 0.5:
                out[entry] = round(max(weight, 0.0), 4)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[float, ...]:
    """Factors by Newton's method; features never count against toxicity."""
    use = list(range(x.shape[1]))
    while True:
        design = np.column_stack([np.ones(len(x)), x[:, use]])
        factors = np.zeros(design.shape[1])
        penalty = ridge * np.diag([1e-6, *[1.0] * len(use)])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(design @ factors, -30, 30)))
            step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + penalty, design.T @ (y - p) - penalty @ factors)
            factors += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        if (factors[1:] >= 0).all():
            out = np.zeros(x.shape[1] + 1)
            out[[0, *[u + 1 for u in use]]] = factors
            return tuple(round(float(f), 6) for f in out)
        use = [u for u, f in zip(use, factors[1:]) if f >= 0]


def fit(docs: DataFrame, labels: DataFrame, *, most_docs: int = 20_000, most_entries: int = 5_000, least_docs: int = 4, least_weight: float = 1.0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the labelled rows that are not held out.

    Copies of a text with one label count once, and of several labels of an id the largest holds. Of the
    texts, about most_docs are drawn by a hash. Entries held by least_docs toxic texts, and their weights,
    are found on each half of them and on all; every text is read with the lexicon of the other half to
    fit the logistic function. Of more than most_entries entries the heaviest stay. The driver gets those
    entries and three numbers for each drawn text. Null texts and labels don't count; without both kinds
    of label every score is the share of toxic ones (0 without labels).
    """
    marks = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("mark")).agg(F.max(label_col).cast("int").alias("toxic"))
    hashed = docs.filter(F.col(text_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("mark"), F.xxhash64(text_col).alias("h"))
    # texts stay where they are: only ids and hashes are shuffled
    known = cut(hashed.join(marks, "mark").groupBy("h").agg(F.max("toxic").alias("toxic"), F.min("mark").alias("mark")), "toxicity-labelled")
    n = known.count()
    drawn = cut(known.filter(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < int(min(1.0, most_docs / max(1, n)) * (1 << 30))), "toxicity-drawn")
    chosen = docs.filter(~held_out(id_col)).select(F.col(id_col).alias("mark"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    # drawn holds about most_docs rows of three numbers
    texts = chosen.join(F.broadcast(drawn), ["mark", "h"]).select("h", "toxic", "text").dropDuplicates(["h"])
    texts = cut(texts.select("text", F.pmod("h", F.lit(2)).cast("int").alias("fold"), "toxic"), "toxicity-texts")
    sizes = {(r.fold, r.toxic): r["count"] for r in texts.groupBy("fold", "toxic").count().collect()}
    toxic, other = (sum(k for (_, y), k in sizes.items() if bool(y) == bool(x)) for x in (1, 0))
    if not toxic or not other:
        share = toxic / max(1, toxic + other)
        return Model({}, (math.log(share / (1 - share)) if 0 < share < 1 else 500.0 * (1 if share else -1), 0.0, 0.0, 0.0))

    counted = _held(texts).groupBy("entry").agg(*[F.coalesce(F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == y), F.col("n"))), F.lit(0)).alias(f"n{f}{y}") for f in (0, 1) for y in (0, 1)])
    rate = (F.col("n01") + F.col("n11")) / F.lit(float(toxic)) / ((F.col("n00") + F.col("n10") + 0.5) / F.lit(float(other)))
    often = counted.filter((F.col("n01") + F.col("n11") >= least_docs) & (rate > math.exp(least_weight)))
    rows = often.orderBy(rate.desc(), "entry").limit(4 * most_entries).collect()

    def lexicon(folds: tuple[int, ...]) -> dict[str, float]:
        held = {r.entry: tuple(sum(r[f"n{f}{y}"] for f in folds) for y in (1, 0)) for r in rows}
        found = weigh(held, *(sum(sizes.get((f, y), 0) for f in folds) for y in (1, 0)), least_docs=max(2, least_docs * len(folds) // 2), least_weight=least_weight)
        return dict(sorted(found.items(), key=lambda e: (-e[1], e[0]))[:most_entries])

    others = [lexicon((1,)), lexicon((0,))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = [Reader(x) for x in others]
        for batch in by_slices(batches, 100):
            made = [(*readers[fold](text)[0], toxic) for text, fold, toxic in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array([float(v) for v in c]) for c in (zip(*made) if made else [[]] * 4)], ["a", "b", "c", "y"])

    read = np.array([tuple(r) for r in texts.mapInArrow(run, "a double, b double, c double, y double").collect()])
    return Model(lexicon((0, 1)), _logistic(read[:, :3], read[:, 3]))


def score(docs: DataFrame, model: Model, *, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted (1 if score >= threshold), n_clauses and worst (the weight of the heaviest matched clause, if any).

    Whole texts are read. A null or empty text has no clause and gets the score of one without a match.
    Every row is scored by itself, repeated ones and those with a null id too; other columns are not
    read, and an empty table gives an empty result.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # bounded by fit's most_entries
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"), held_out(id_col).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        reader = Reader(model.insults)
        for batch in by_slices(batches, 100):
            read = [reader(text) for text in batch.column(0).to_pylist()]
            scores, n = [model.score(features) for features, _ in read], [len(found) for _, found in read]
            worst = [max((w for _, w in found), default=None) for _, found in read]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores, pa.float64()), pa.array(n, pa.int32()), pa.array(worst, pa.float64())], ["id", "held_out", "score", "n_clauses", "worst"])

    schema = rows.select("id", "held_out").schema.add("score", "double").add("n_clauses", "integer").add("worst", "double")
    return rows.mapInArrow(run, schema).select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_clauses", "worst")
