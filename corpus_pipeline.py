"""From raw documents to packed sequences: language ID, quality rules, line dedup, near dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written as Parquet to the shared
folder and read again as the next stage's documents. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language_id, line_dedup, ngram_join, packing, quality_rules
from tidemark.llm.common import Tables, cut, documents, plain_names, without
from tidemark.llm.queries import with_packing_columns


def _row_key(plain: DataFrame, names: dict[str, str]) -> DataFrame:
    """Adds _row_key: equal for rows with the same id, text, language and source, of which all get the same verdict."""
    return plain.withColumn("_row_key", F.xxhash64(*[x for c in ("doc_id", "text", "lang", "source") for x in (F.col(names[c]).isNull(), F.col(names[c]))]))


def _named(plain: DataFrame, names: dict[str, str]) -> DataFrame:
    return plain.select(*[F.col(n).alias(c) for c, n in names.items()])


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty ones too), and those between two languages, go.

    Rows are judged one by one: repeated ones and null ids are kept or dropped by their text alone.
    Without labelled rows there is nothing to judge by and everything goes; no rows give no rows.
    Columns of any name pass unchanged.
    """
    made = language_id.fit(docs)
    plain, names = plain_names(docs)
    judged = language_id.classify(plain, made, text_col=names["text"]).filter("accepted")
    return _named(judged, names)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failures of the rules (null and empty texts too) and robust outliers go.

    Verdicts are joined by a hash of id, text, language and source, so neither a null nor a repeated id
    takes another row with it. No rows give no rows. Columns of any name pass unchanged.
    """
    plain, names = plain_names(docs)
    keyed = _row_key(plain, names)
    of = {c: names[c] for c in ("text", "lang", "source")}
    verdicts = quality_rules.apply_rules(keyed.select("_row_key", *[F.col(n).alias(c) for c, n in of.items()]), id_col="_row_key")
    gone = cut(verdicts.filter("NOT kept").select("_row_key").distinct(), "pipeline-rejected")
    return _named(without(keyed, "_row_key", gone), names)


def drop_site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document's source is its site; a line goes if five different texts and over 5 % of them hold it.

    Copies count once, near dedup chooses among them. A document goes only if all its lines do; null
    and empty texts stay, as do repeated rows. n_chars follows a text that changed, where there is
    such a column. Columns of any name pass unchanged.
    """
    plain, names = plain_names(docs)
    rest = line_dedup.drop_frequent_lines(plain, ratio=0.05, min_pages=5, host_col=names["source"], text_col=names["text"], copies_count=False)
    left = rest.filter("n_dropped = 0 OR n_dropped < n_lines")
    chars = F.when(F.col("n_dropped") > 0, F.length(names["text"]).cast("long")).otherwise(F.col(names.get("n_chars", names["text"])))
    return left.select(*[(chars if c == "n_chars" else F.col(n)).alias(c) for c, n in names.items()])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document with the smallest id stays, one row of it.

    Rows that repeat an id are one document; of those the row with the smallest hash of its text stays
    (equal hashes: equal texts, any of them). Rows without an id stay, as do those without a word.
    Columns of any name pass unchanged.
    """
    plain, names = plain_names(docs)
    id_, text = names["doc_id"], names["text"]
    found = cut(ngram_join.link_components(plain, id_col=id_, text_col=text), "pipeline-components")
    rest = without(plain, id_, cut(found.filter(f"component_id <> {id_}").select(id_).distinct(), "pipeline-linked"))
    repeated = cut(found.groupBy(id_).count().filter(f"count > 1 AND {id_} IS NOT NULL").select(id_), "pipeline-repeated")
    if not repeated.isEmpty():
        own = F.struct(*plain.columns)
        of = rest.join(repeated, id_).groupBy(id_).agg(F.min_by(own, F.xxhash64(F.coalesce(text, F.lit("")))).alias("_row"))
        rest = without(rest, id_, repeated).select(plain.columns).unionByName(of.select("_row.*").select(plain.columns))
    return _named(rest, names)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 words; documents without a word (null texts too) give no piece. Only id, source and text are read."""
    return packing.pack(with_packing_columns(docs), capacity=1024, length_col="n_words")


STAGES = [
    ("language_id", identify_languages),
    ("quality_rules", apply_quality_rules),
    ("line_dedup", drop_site_lines),
    ("ngram_jaccard", drop_near_copies),
    ("best_fit_packing", pack_sequences),
]

#: Compression, robust estimates and packing are beyond SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    with Tables(spark) as tables:
        for name, stage in STAGES[:-1]:
            before, docs = docs, tables.cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
            tables.drop(before)
        name, stage = STAGES[-1]
        return cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
