"""URL lists in time.

Dated additions to and removals from lists become validity intervals, and every capture is judged
by the entries that were active when it was fetched: an as-of join, as a union of intervals and
questions and a running last value. Questions are the distinct (pattern, day) of the captures, so a
window over a list's pattern holds at most its entries and the days: a hot host costs no more than
that. No table that grows with the data is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Tables, cut, plain_names


def intervals(entries: DataFrame, horizon: str) -> DataFrame:
    """From dated entries (list, pattern, action add or remove, listed_on): list, pattern, since, until.

    until is the day of the next entry of the same list and pattern, or ``horizon``. Of several on
    one day a removal counts. Entries without pattern or day are ignored. Intervals of a list and
    pattern don't overlap.
    """
    day = entries.filter("pattern IS NOT NULL AND listed_on IS NOT NULL").groupBy("list", "pattern", "listed_on").agg(F.max("action").alias("action"))
    following = F.lead("listed_on").over(W.partitionBy("list", "pattern").orderBy("listed_on"))
    spans = day.withColumn("until", F.coalesce(following, F.to_date(F.lit(horizon))))
    return spans.filter("action = 'add' AND until > listed_on").select("list", "pattern", F.col("listed_on").alias("since"), "until")


def patterns_of(host: Column, segment: Column) -> Column:
    """The patterns that cover a URL: each suffix of its host with two labels or more, alone and with the first path segment."""
    labels = F.split(host, r"\.")
    starts = F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1)))
    suffixes = F.transform(starts, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.array_distinct(F.concat(suffixes, F.transform(suffixes, lambda s: F.concat(s, F.lit("/"), segment))))


def active_on(questions: DataFrame, spans: DataFrame) -> DataFrame:
    """(pattern, day, list, since) for each question (pattern, day) and list whose interval holds that day."""
    asked = questions.join(spans.select("list", "pattern").distinct().hint("merge"), "pattern")
    moments = spans.select("list", "pattern", F.col("since").alias("day"), F.struct("since", "until").alias("span"), F.lit(0).alias("asks"))
    moments = moments.unionByName(asked.select("list", "pattern", "day", F.lit(None).cast("struct<since:date,until:date>").alias("span"), F.lit(1).alias("asks")))
    upto = W.partitionBy("list", "pattern").orderBy("day", "asks").rowsBetween(W.unboundedPreceding, W.currentRow)
    latest = moments.withColumn("span", F.last("span", ignorenulls=True).over(upto))
    return latest.filter("asks = 1 AND day < span.until").select("pattern", "day", "list", F.col("span.since").alias("since"))


def judge(captures: DataFrame, entries: DataFrame, *, horizon: str = "2100-01-01") -> DataFrame:
    """``captures`` (with host, segment, fetched_on) and n_active, decided_by, decided_list, since, blocked.

    The longest active pattern decides, of equal ones the first list by name; blocked unless that list
    is called allow. Captures without an active entry, or without host or day, are not blocked. Every
    row of captures is returned once, repeated ones too; empty tables on either side are allowed.
    Other columns of captures pass whatever their names; those called like a result are replaced.
    """
    result = ["n_active", "decided_by", "decided_list", "since", "blocked"]
    plain, names = plain_names(captures)
    host, segment, day = (F.col(names[c]) for c in ("host", "segment", "fetched_on"))
    segment = F.coalesce(segment, F.lit(""))
    probes = plain.filter((host != "") & day.isNotNull()).select(host.alias("_h"), segment.alias("_s"), day.alias("day")).distinct()
    order = F.struct(-F.length("pattern"), "list", "pattern", "since")
    with Tables(captures.sparkSession) as tables:
        keyed = tables.cut(probes.withColumn("pattern", F.explode(patterns_of(F.col("_h"), F.col("_s")))), "url-questions")
        active = active_on(keyed.select("pattern", "day").distinct(), tables.cut(intervals(entries, horizon), "url-intervals"))
        found = keyed.join(active.hint("merge"), ["pattern", "day"])
        best = found.groupBy("_h", "_s", F.col("day").alias("_d")).agg(F.count("*").alias("_n"), F.min_by(F.struct("pattern", "list", "since"), order).alias("_best"))
        best = cut(best, "url-verdicts")
    joined = plain.join(best.hint("merge"), (host == F.col("_h")) & (segment == F.col("_s")) & (day == F.col("_d")), "left")
    made = [F.coalesce("_n", F.lit(0)), F.col("_best.pattern"), F.col("_best.list"), F.col("_best.since"), F.coalesce(F.col("_best.list"), F.lit("allow")) != "allow"]
    return joined.select(*[F.col(n).alias(c) for c, n in names.items() if c not in result], *[x.alias(c) for c, x in zip(result, made)])
