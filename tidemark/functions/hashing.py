"""Identities: SHA-256 over a canonical JSON of columns sorted by name, and order-free table fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_id(columns: dict[str, Column]) -> Column:
    """Equal for equal values, whatever order the columns are given in. Nulls count."""
    named = [columns[k].alias(k) for k in sorted(columns)]
    return F.sha2(F.to_json(F.struct(*named), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}), 256)


def configuration_id(settings: dict[str, object]) -> Column:
    """The identity of a set of parameters."""
    return content_id({k: F.lit(v) for k, v in settings.items()})


def decision_id(stages: dict[str, Column], settings: dict[str, object]) -> Column:
    """The identity of a decision: all its stages and the configuration they ran with."""
    return content_id(stages | {"configuration_id": configuration_id(settings)})


#: Sums of a fingerprint are taken modulo this.
MODULUS = 1 << 48


def row_text(df: DataFrame, columns: list[str] | None = None, digits: int = 6) -> Column:
    """A row's values by name, each with its length before it and null as a dash, so that no two rows share a text.

    Fractions are written with ``digits`` decimals, moments as microseconds since 1970.
    """
    kinds = dict(df.dtypes)

    def text(name: str) -> Column:
        value = F.col(f"`{name}`")
        if kinds[name] in ("double", "float"):
            value = value.cast(f"decimal(38,{digits})")
        elif kinds[name].startswith("timestamp"):
            value = F.unix_micros(value.cast("timestamp"))
        said = value.cast("string")
        return F.coalesce(F.concat(F.length(said).cast("string"), F.lit(":"), said), F.lit("-"))

    return F.concat(*[text(c) for c in sorted(columns or df.columns)])


def fingerprint(df: DataFrame, columns: list[str] | None = None, *, buckets: int = 16, digits: int = 6) -> DataFrame:
    """(bucket, rows, first_sum, second_sum): the multiset of rows, whatever their order; a repeated row counts again.

    A row's MD5 gives its bucket and two 48-bit numbers, which are summed modulo 2 ** 48. Partial sums are all that
    is shuffled. Tables without rows have no bucket.
    """
    digest = F.md5(row_text(df, columns, digits).cast("binary"))
    number = lambda at, n: F.conv(F.substring("_digest", at, n), 16, 10).cast("long")
    rows = df.select(digest.alias("_digest")).select((number(25, 8) % buckets).cast("int").alias("bucket"), number(1, 12).alias("a"), number(13, 12).alias("b"))
    summed = lambda c: (F.sum(F.col(c).cast("decimal(38,0)")) % MODULUS).cast("long")
    return rows.groupBy("bucket").agg(F.count("*").alias("rows"), summed("a").alias("first_sum"), summed("b").alias("second_sum"))


def fingerprint_with(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The fingerprint of a table to which rows were added, from its own and that of the new rows alone."""
    summed = lambda c: (F.sum(c) % MODULUS).alias(c)
    return stored.unionByName(new).groupBy("bucket").agg(F.sum("rows").alias("rows"), summed("first_sum"), summed("second_sum"))


def differing_buckets(one: DataFrame, other: DataFrame) -> DataFrame:
    """(bucket): where two tables' rows differ; only rows of these buckets need to be compared."""
    sums = ["rows", "first_sum", "second_sum"]
    both = one.join(other.select("bucket", *[F.col(c).alias(f"_{c}") for c in sums]), "bucket", "full")
    same = F.lit(True)
    for c in sums:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return both.filter(~same).select("bucket")
