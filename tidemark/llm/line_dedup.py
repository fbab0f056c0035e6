"""Boilerplate lines by their frequency within a site.

Of each host, the share of its pages that contain a line is counted; lines whose share exceeds a
ratio are dropped from every page of that host. Lines travel as 64-bit hashes and are pre-aggregated
before the shuffle. What survives the ratio is small: a host cannot have more such lines than its
mean number of lines divided by the ratio, so they fit an array for each host. A page's own lines are
first intersected with that array by hashing, so its length doesn't multiply with the page's. Lines
are compared by 64-bit hashes, within one host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Tables, cut, plain_names, text_or_empty


def _key(line: Column) -> Column:
    """A line is compared with each run of white space as one space and none at its ends."""
    return F.xxhash64(F.trim(F.regexp_replace(line, SPACE, " ")))


def _has_word(line: Column) -> Column:
    """Whether anything but white space is in it: what is left without white space at the ends."""
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r")) != ""


def frequent_lines(pages: DataFrame, *, ratio: float, min_pages: int, host_col: str, text_col: str, copies_count: bool = True) -> DataFrame:
    """One row for each host with such lines: _host and their _keys (array)."""
    lines = F.array_distinct(F.transform(F.filter(F.split(text_or_empty(text_col), "\n"), _has_word), _key))
    keyed = pages.select(F.col(host_col).alias("_host"), lines.alias("_lines"))
    with Tables(pages.sparkSession) as tables:
        if not copies_count:
            keyed = tables.cut(keyed.distinct(), "line-texts")  # only hashes are shuffled, copies are merged before that
        counted = keyed.select("_host", F.explode("_lines").alias("key")).groupBy("_host", "key").agg(F.count("*").alias("pages"))
        counted = tables.cut(counted.filter(F.col("pages") >= min_pages), "line-counts")
        totals = tables.cut(keyed.groupBy(F.col("_host").alias("_total_host")).agg(F.count("*").alias("total")), "line-totals")
        over = counted.join(totals, F.col("_host").eqNullSafe(F.col("_total_host"))).filter(F.col("pages") > ratio * F.col("total"))
        return cut(over.groupBy("_host").agg(F.collect_set("key").alias("_keys")), "line-frequent")


def drop_frequent_lines(pages: DataFrame, *, ratio: float = 0.05, min_pages: int = 1, host_col: str = "host", text_col: str = "text", copies_count: bool = True) -> DataFrame:
    """``pages`` with text_col rewritten, and n_lines and n_dropped (lines with a word).

    A line goes if more than ``ratio`` of its host's pages contain it. That takes a host of under
    1 / ratio pages all its lines, as one page is over the ratio by itself; min_pages (1 unless asked
    for) is the least number of pages that have to contain a line for it to go. A
    page counts once for a line however often it repeats it, and repeated rows are pages of their
    own. Without copies_count, pages of a host with the same lines are one page in these counts: a
    document's copies aren't boilerplate. Lines without a word stay. Null hosts form one host. Null
    texts stay null, empty ones empty; an empty table gives an empty result. Other columns of any name
    are untouched, but those called n_lines or n_dropped are replaced.
    """
    plain, names = plain_names(pages)
    host_col, text = names[host_col], names[text_col]
    frequent = frequent_lines(plain, ratio=ratio, min_pages=min_pages, host_col=host_col, text_col=text, copies_count=copies_count)
    joined = plain.join(frequent, F.col(host_col).eqNullSafe(F.col("_host")), "left")
    lines = F.split(F.col(text), "\n")
    # keys as the lines stand, null for a line without a word; of these the page's own boilerplate
    own = F.when(F.col("_keys").isNotNull(), F.transform("_lines", lambda x: F.when(_has_word(x), _key(x))))
    rest = joined.withColumn("_lines", lines).withColumn("_own", own).withColumn("_gone", F.array_compact(F.array_intersect("_own", "_keys")))
    stays = lambda x, i: ~F.coalesce(F.array_contains(F.col("_gone"), F.get("_own", i)), F.lit(False))
    untouched = F.col("_keys").isNull() | (F.size("_gone") == 0)
    rest = rest.withColumn("_kept", F.when(untouched, F.col("_lines")).otherwise(F.filter("_lines", stays)))
    made = {
        text_col: F.when(untouched, F.col(text)).otherwise(F.array_join("_kept", "\n")),
        "n_lines": F.coalesce(F.size(F.filter("_lines", _has_word)), F.lit(0)),
        "n_dropped": F.coalesce(F.size("_lines") - F.size("_kept"), F.lit(0)),
    }
    return rest.select(*[made.get(c, F.col(names.get(c, c))).alias(c) for c in dict.fromkeys([*pages.columns, "n_lines", "n_dropped"])])


def host_of(url: str) -> Column:
    """The host of a URL in lower case, empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def html_text(html: str) -> Column:
    """The visible text of a page, a line for each block."""
    bare = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?is)<(?:script|style)\b.*?</(?:script|style)>|<!--.*?-->", " ")
    blocks = F.regexp_replace(bare, r"(?i)</?(?:p|br|li|ul|ol|h[1-6]|div|tr|table|title|article|nav|header|footer|section)\b[^>]*>", "\n")
    return F.regexp_replace(blocks, r"<[^>]*>", " ")
