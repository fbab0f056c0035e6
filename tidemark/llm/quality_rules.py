"""Quality rules with robust multivariate outliers.

Each text becomes a vector of transformed statistics. For every (language, source) group the
minimum covariance determinant is estimated: from several robust starts, concentration steps take
the ``share`` of the group's rows with the smallest Mahalanobis distance and estimate mean and
covariance from those again; the start with the lowest determinant goes on until it settles, and a
last step takes all rows within a chi-square quantile (the usual reweighting). Rows outside the
final ellipsoid go. The estimate is regularised: a group's mean and covariance are drawn to its
language's by size, so a group of three rows is judged by its language and one of millions by itself.

All sums and quantiles run over all rows as partial aggregates, so a hot group costs no more than
its rows; what is kept for each group is one row of estimates.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_slices, cut

SYMBOLS = "#*$%&|<>"
#: Transformed statistics, and the least standard deviation of each. A floor takes the place of a
#: smaller spread only (most groups have no symbol or repeat at all); it never widens a larger one.
FLOORS = {"log_words": 0.3, "log_word_length": 0.05, "symbol_rate": 0.5, "upper_rate": 0.1, "dup_line_rate": 0.5, "repeat_rate": 0.5, "log_distinct": 0.01}
STATS = list(FLOORS)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

_SPACES = re.compile(r"[\x20\x09-\x0D]+")
_UPPER = bytes(range(65, 91))


def repeated_words(ids: np.ndarray, window: int = 8) -> int:
    """Words that stand in a window of ``window`` (a power of two) words found twice or more.

    Windows get ranks by doubling: equal ranks are equal windows, exactly.
    """
    rank, width = ids, 1
    while width < window:
        if len(rank) <= width:
            return 0
        key = rank[:-width].astype(np.int64) * (int(rank.max()) + 1) + rank[width:]
        rank, width = np.unique(key, return_inverse=True)[1], width * 2
    twice = np.bincount(rank)[rank] > 1
    if not twice.any():
        return 0
    cover = np.zeros(len(ids) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def measure(text: str | None) -> tuple:
    """The counts of one text (COUNTS), then its transformed statistics (STATS)."""
    if not text:
        return (0,) * len(COUNTS) + (0.0,) * len(STATS)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # splits at ASCII white space alone
    n = len(words)
    spaces = len(data) - sum(map(len, words))
    chars = len(text) - spaces
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if _SPACES.sub("", x)]
    dup = len(lines) - len(set(lines))
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    repeat = repeated_words(ids) if n >= 9 and len(seen) < n else 0
    upper = len(data) - len(data.translate(None, _UPPER))
    one = max(n, 1)
    return (
        n, chars, symbols, dup, repeat,
        math.log1p(n), math.log((chars + 1) / one), math.log1p(100 * symbols / one), math.log1p(100 * upper / max(chars, 1)),
        math.log1p(100 * dup / max(len(lines), 1)), math.log1p(100 * repeat / one), math.log((len(seen) + 1) / (one + 1)) / math.log(one + 2),
    )


def statistics(docs: DataFrame, *, text_col: str = "text", keep: list[str]) -> DataFrame:
    """The columns in ``keep`` with COUNTS (long) and STATS (double) of each whole text."""
    schema = docs.select(*keep).schema
    for c in COUNTS:
        schema = schema.add(c, "long")
    for c in STATS:
        schema = schema.add(c, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_slices(batches):
            made = list(zip(*[measure(t) for t in batch.column(0).to_pylist()]))
            kinds = [pa.int64()] * len(COUNTS) + [pa.float64()] * len(STATS)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(x, k) for x, k in zip(made, kinds))], [*keep, *COUNTS, *STATS])

    return docs.select(F.col(text_col).alias("_text"), *keep).mapInArrow(run, schema)


def chi2_cdf(x: float, k: int) -> float:
    """P(chi-square with k degrees <= x), by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, half = k / 2, x / 2
    term = total = 1 / a
    i = a
    while term > total * 1e-16:
        i += 1
        term *= half / i
        total += term
    return min(1.0, total * math.exp(-half + a * math.log(half) - math.lgamma(a)))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


def _level(*names: str) -> Column:
    """A key of the columns given, in which null is a value of its own."""
    return F.xxhash64(*[c for n in names for c in (F.col(n).isNull(), F.col(n))])


def _lower(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i + 1)]


def _whitened(columns: list[str]) -> Column:
    """Squared Mahalanobis distance from columns m (mean) and w (rows of the inverse Cholesky factor)."""
    total, at = F.lit(0.0), 0
    for i in range(len(columns)):
        z = F.lit(0.0)
        for j in range(i + 1):
            z = z + F.col("w")[at] * (F.col(columns[j]) - F.col("m")[j])
            at += 1
        total = total + z * z
    return total


def _sums(rows: DataFrame, values: list[Column], by: list[str]) -> DataFrame:
    """n, m1 (sums) and m2 (sums of products) of each group, one row each, by partial aggregates."""
    named = rows.select(*by, *[v.alias(f"_v{i}") for i, v in enumerate(values)])
    of = [F.col(f"_v{i}") for i in range(len(values))]
    return named.groupBy(*by).agg(F.count("*").alias("n"), F.array(*[F.sum(v) for v in of]).alias("m1"), F.array(*[F.sum(of[i] * of[j]) for i, j in _lower(len(of))]).alias("m2"))


def _with_wider_sums(sums: DataFrame, groups: DataFrame, d: int, starts: list[int]) -> DataFrame:
    """Adds the sums over the group's language (p...) and over everything (g...). Groups without a row get n = 0."""
    sizes = {"m1": d, "m2": len(_lower(d))}
    every = groups.select("grp", "parent", F.explode(F.array(*map(F.lit, starts))).alias("start")).join(sums, ["grp", "start"], "left")
    every = cut(every.select("grp", "parent", "start", F.coalesce("n", F.lit(0)).alias("n"), *[F.coalesce(c, F.array_repeat(F.lit(0.0), k)).alias(c) for c, k in sizes.items()]), "quality-sums")
    added = lambda mark: [F.sum("n").alias(f"{mark}n"), *[F.array(*[F.sum(F.col(c)[i]) for i in range(k)]).alias(f"{mark}{c}") for c, k in sizes.items()]]
    return every.join(every.groupBy("parent", "start").agg(*added("p")), ["parent", "start"]).join(every.groupBy("start").agg(*added("g")), "start")


def shrunk(levels: list[tuple[int, np.ndarray, np.ndarray]], prior: float, factor: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Mean and covariance of the last level, each level drawn to the one before it as if that were ``prior`` rows.

    levels: (rows, sums, sums of products as a lower triangle), from the widest to the group itself.
    None if there is no row at all.
    """
    mean = cov = None
    for n, m1, m2 in levels:
        if n == 0:
            continue
        d = len(m1)
        own = np.asarray(m1, float) / n
        second = np.zeros((d, d))
        second[np.tril_indices(d)] = np.asarray(m2, float) / n
        second = np.tril(second) + np.tril(second, -1).T
        spread = (second - np.outer(own, own)) * factor
        keep = 1.0 if mean is None else n / (n + prior)
        mean = own if mean is None else keep * own + (1 - keep) * mean
        cov = spread if cov is None else keep * spread + (1 - keep) * cov
    return None if mean is None else (mean, cov)


def _factor(mean: np.ndarray, cov: np.ndarray, floors: np.ndarray) -> tuple[list, list, float]:
    """mean, inverse Cholesky factor (lower triangle) and log determinant; a floor replaces a smaller variance only."""
    cov = cov + np.diag(np.maximum(0.0, floors**2 - np.diag(cov)) + 1e-9)  # the last term for collinear statistics
    root = np.linalg.cholesky(cov)
    return mean.tolist(), np.linalg.inv(root)[np.tril_indices(len(mean))].tolist(), 2 * float(np.log(np.diag(root)).sum())


_ESTIMATE = "grp long, parent long, start int, n long, m array<double>, w array<double>, logdet double"


def _estimates(sums: DataFrame, floors: dict[str, float], prior: float, factor: float, centred: DataFrame | None = None) -> DataFrame:
    """One row for each group and start. With ``centred`` (grp, c, s) the sums are of scaled values, of which only the correlations count."""
    least, scaled = np.array(list(floors.values())), centred is not None
    if scaled:
        sums = sums.join(centred.select("grp", "c", "s"), "grp")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for r in pdf.itertuples(index=False):
                found = shrunk([(r.gn, r.gm1, r.gm2), (r.pn, r.pm1, r.pm2), (r.n, r.m1, r.m2)], prior, factor)
                if found is None:
                    continue
                mean, cov = found
                if scaled:
                    size = np.sqrt(np.maximum(np.diag(cov), 1e-12))
                    corr = np.eye(len(size)) if r.start == 0 else cov / np.outer(size, size)
                    np.fill_diagonal(corr, 1.0)
                    mean, cov = np.asarray(r.c, float), np.outer(r.s, r.s) * corr
                made.append((r.grp, r.parent, r.start, r.n, *_factor(mean, cov, least)))
            yield pd.DataFrame(made, columns=["grp", "parent", "start", "n", "m", "w", "logdet"])

    return sums.mapInPandas(run, _ESTIMATE)


def _centres(rows: DataFrame, groups: DataFrame, values: list[Column], prior: float, name: str) -> DataFrame:
    """groups with ``name``: the medians of ``values``; those of few rows are drawn to the middle of their language's groups."""
    d = len(values)
    cols = [f"v{i}" for i in range(d)]
    own = rows.groupBy("grp").agg(F.count("*").alias("n"), *[F.percentile_approx(v, 0.5, 2000).alias(c) for v, c in zip(values, cols)])
    every = cut(groups.drop("n").join(own, "grp", "left").withColumn("n", F.coalesce("n", F.lit(0))), "quality-medians")
    middle = [F.percentile_approx(c, 0.5, 2000).alias(f"p_{c}") for c in cols]
    overall = [v or 0.0 for v in every.agg(*middle).first()]  # one row
    wide = every.join(every.groupBy("parent").agg(F.sum("n").alias("pn"), *middle), "parent")

    def drawn(own: Column, n: Column, to: Column) -> Column:
        return F.coalesce(F.try_divide(n * own + prior * to, n + prior), to)

    blended = [drawn(F.col(c), F.col("n"), drawn(F.col(f"p_{c}"), F.col("pn"), F.lit(g))) for c, g in zip(cols, overall)]
    return cut(wide.select(*groups.drop("n").columns, "n", F.array(*blended).alias(name)), "quality-centres")


#: Where concentration begins: scaled median deviations without correlation, with those of tanh, with those of spatial signs.
STARTS = [0, 1, 2]


def _first_estimates(rows: DataFrame, groups: DataFrame, floors: dict[str, float], prior: float) -> DataFrame:
    columns = list(floors)
    centre = _centres(rows, groups, [F.col(c) for c in columns], prior, "c")
    off = rows.join(centre.select("grp", "c"), "grp")
    spread = _centres(off, centre, [1.4826 * F.abs(F.col(c) - F.col("c")[i]) for i, c in enumerate(columns)], prior, "s")
    spread = cut(spread.withColumn("s", F.array(*[F.greatest(F.col("s")[i], F.lit(v)) for i, v in enumerate(floors.values())])), "quality-scales")
    z = [f"z{i}" for i in range(len(columns))]
    scaled = rows.join(spread.select("grp", "c", "s"), "grp").select("grp", *[((F.col(c) - F.col("c")[i]) / F.col("s")[i]).alias(z[i]) for i, c in enumerate(columns)])
    length = F.sqrt(sum((F.col(c) * F.col(c) for c in z), F.lit(1e-12)))
    bounded = _sums(scaled, [F.tanh(c) for c in z], ["grp"]).withColumn("start", F.lit(1))
    signs = _sums(scaled.withColumn("l", length), [F.col(c) / F.col("l") for c in z], ["grp"]).withColumn("start", F.lit(2))
    plain = bounded.withColumn("start", F.lit(0))
    wide = _with_wider_sums(plain.unionByName(bounded).unionByName(signs), groups, len(columns), STARTS)
    return _estimates(wide, floors, prior, 1.0, spread)


def determinant_estimates(rows: DataFrame, groups: DataFrame, *, floors: dict[str, float] = FLOORS, share: float = 0.75, inside: float = 0.975, prior: float = 30.0, first_steps: int = 2, most_steps: int = 10, settled: float = 0.01) -> DataFrame:
    """Centre m, whitening w and logdet for each of ``groups`` (grp, parent). rows: grp, parent and the columns of floors.

    From each of STARTS, first_steps concentration steps; of the results the one with the lowest
    determinant goes on until no group's log determinant changes by more than ``settled``, or for
    most_steps steps. A last step takes the rows within the chi-square quantile ``inside``: the core
    alone understates the spread of clean rows whose tails aren't normal. A group of n rows counts n, its language ``prior``
    rows in mean, covariance and the core's limit; with a prior of 0 this is the plain estimate.
    Without any row there is no estimate.
    """
    columns = list(floors)
    d = len(columns)
    q = chi2_quantile(share, d)
    consistent = lambda p: p / chi2_cdf(chi2_quantile(p, d), d + 2)
    now = cut(_first_estimates(rows, groups, floors, prior), "quality-start")

    def moments(chosen: DataFrame, p: float, starts: list[int]) -> DataFrame:
        return cut(_estimates(_with_wider_sums(_sums(chosen, [F.col(c) for c in columns], ["grp", "start"]), groups, d, starts), floors, prior, consistent(p)), "quality-step")

    def step(now: DataFrame, starts: list[int]) -> DataFrame:
        near = rows.join(now.select("grp", "start", "m", "w"), "grp").withColumn("d2", _whitened(columns)).select("grp", "start", "d2", *columns)
        own = near.groupBy("grp", "start").agg(F.percentile_approx("d2", share, 2000).alias("own"), F.count("*").alias("n"))
        limit = cut(own.select("grp", "start", ((F.col("n") * F.col("own") + prior * q) / (F.col("n") + prior)).alias("limit")), "quality-limit")  # a small table: the rows stay where they are
        return moments(near.join(limit, ["grp", "start"]).filter(F.col("d2") <= F.col("limit")), share, starts)

    for _ in range(first_steps):
        now = step(now, STARTS)
    lowest = now.groupBy("grp").agg(F.min_by("start", F.struct("logdet", "start")).alias("start"))
    now = cut(now.join(lowest, ["grp", "start"]).withColumn("start", F.lit(0)), "quality-lowest")
    for _ in range(most_steps - first_steps):
        after = step(now, [0])
        change = after.join(now.select("grp", F.col("logdet").alias("before")), "grp").agg(F.max(F.abs(F.col("logdet") - F.col("before")))).first()[0]
        now = after
        if change is None or change <= settled:
            break
    within = rows.join(now.select("grp", "start", "m", "w"), "grp").withColumn("d2", _whitened(columns)).filter(F.col("d2") <= chi2_quantile(inside, d)).select("grp", "start", *columns)
    return moments(within, inside, [0]).select("grp", "m", "w", "logdet")


def apply_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_words: int = 20, max_repeat_percent: int = 30, share: float = 0.75, tail: float = 1e-3, prior: float = 30.0) -> DataFrame:
    """One row for each row of ``docs``: id, COUNTS, base_failed, distance (Mahalanobis), kept.

    kept is false if base_failed (fewer than min_words words, or over max_repeat_percent of the words
    in repeated windows) or if the distance is beyond the chi-square quantile 1 - tail. Null texts
    count as empty and fail. Null languages and sources are groups of their own. Every row is judged:
    the estimate of a group of few rows, or of none that passes the base rules, is drawn to its
    language's and that to the one of all (``prior``). distance is null only where no row of the
    table passes the base rules, and then nothing is kept. Repeated rows are rows of their own. Equal
    rows get equal verdicts, so ties need no order. An empty table gives an empty result. Other columns are not read, whatever their names.
    """
    slim = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"), F.col(text_col).alias("_text"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    measured = statistics(slim, text_col="_text", keep=["_id", "_lang", "_source"])
    rows = measured.select("_id", *COUNTS, *STATS, failed.alias("base_failed"), _level("_lang", "_source").alias("grp"), _level("_lang").alias("parent"))
    rows = cut(rows, "quality-statistics")
    groups = cut(rows.groupBy("grp", "parent").agg(F.count("*").alias("n")), "quality-groups")
    # the base rules' failures would only widen the estimates
    estimates = determinant_estimates(rows.filter(~F.col("base_failed")).select("grp", "parent", *STATS), groups, share=share, prior=prior)
    judged = rows.join(estimates, "grp", "left").withColumn("d2", _whitened(STATS))
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= chi2_quantile(1 - tail, len(STATS)), F.lit(False))
    return judged.select(F.col("_id").alias(id_col), *COUNTS, "base_failed", F.sqrt("d2").alias("distance"), kept.alias("kept"))
