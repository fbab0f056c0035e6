"""Language identification by compression.

For each language a raw-content zstandard dictionary is made of labelled texts. A text is
compressed with every dictionary, block by block, so that a long text profits from a dictionary as
much as a short one; the language whose dictionary makes the sum smallest wins, and a decision is
rejected when the two smallest sums lie close together. What is compressed is the
text's words in lower case: digits, punctuation and immediate repeats of a word say nothing about
the language, but would decide between two close sizes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Tables, by_slices

#: Hashes of rows lie between 0 and this.
SPAN = 1 << 62

#: Result for a text without a letter.
UNDETERMINED = "und"

_NO_LETTERS = re.compile(r"[\W\d_]+")


def words_only(text: str) -> bytes:
    """The runs of letters in lower case, each run of equal words once, one space around each."""
    words = _NO_LETTERS.sub(" ", text.lower()).split(" ")
    return (" " + " ".join([w for w, _ in groupby(words)]) + " ").encode("utf-8", "surrogatepass")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept for testing: crc32 of its id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _drawn(docs: DataFrame, sample_rows: int, row_chars: int, id_col: str, text_col: str, lang_col: str, tables: Tables) -> DataFrame:
    """(lang, h, passage): of each language the sample_rows distinct (id, text) with the smallest hash h, of those with row_chars characters at most.

    Where a language has only longer texts, the shortest of them. Only languages, hashes and lengths are
    shuffled to choose. Hashes spread evenly, so a bound that about four times sample_rows of them fall
    below leaves just these to be put in order.
    """
    hashed = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), F.lit(SPAN))
    rows = docs.filter(F.col(text_col).rlike(r"\p{L}") & F.col(lang_col).isNotNull() & ~held_out(id_col))
    rows = rows.select(F.col(lang_col).alias("lang"), hashed.alias("h"), F.length(text_col).alias("n"), F.col(text_col).alias("passage"))
    over = F.when(F.col("n") > row_chars, F.col("n")).otherwise(0)
    distinct = tables.cut(rows.select("lang", "h", over.alias("over")).groupBy("lang", "h").agg(F.min("over").alias("over")), "language-rows")
    short = F.count(F.when(F.col("over") == 0, 1)).alias("short")
    # a row for each language
    counts = tables.cut(distinct.groupBy("lang").agg(short, F.min_by("h", F.struct("over", "h")).alias("shortest")), "language-counts")
    share = F.least(F.lit(1.0), 4.0 * sample_rows / F.greatest("short", F.lit(1)))
    low = (F.col("short") > 0) & (F.col("over") == 0) & ((share == 1.0) | (F.col("h") < share * SPAN))
    near = distinct.join(counts, "lang").filter(low | ((F.col("short") == 0) & (F.col("h") == F.col("shortest"))))
    place = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    chosen = tables.cut(near.withColumn("place", place).filter(F.col("place") <= sample_rows).select("lang", "h"), "language-sample")
    # sample_rows rows of two columns for each language
    return rows.join(F.broadcast(chosen), ["lang", "h"]).select("lang", "h", "passage").dropDuplicates(["lang", "h"])


def fit(docs: DataFrame, *, sample_rows: int = 1200, row_chars: int = 4000, dict_bytes: int = 131072, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Dictionaries by language, from a bounded sample of the labelled rows that are not held out.

    The sample: of the rows of a language with at most row_chars characters, the sample_rows with the
    smallest hash of id and text, rows that repeat both once; null and repeated ids are no different
    from others. In the order of that hash whole texts fill the dictionary until the next would take it
    over dict_bytes; so a dictionary has whole texts only and at most that size. If all rows of a
    language are longer, the first dict_bytes of one of the shortest serve. Rows without text or
    language are not used; without labelled rows the result is empty; other columns are not read. Each
    dictionary is made in a task of its own from that sample; the driver gets dict_bytes for each
    language.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        made = b""
        for passage in pdf.sort_values(["h", "passage"])["passage"]:
            words = words_only(passage)
            if made and len(made) + len(words) > dict_bytes:
                break
            made += words[:dict_bytes]
        return pd.DataFrame({"lang": pdf["lang"].iloc[:1], "content": [made]})

    with Tables(docs.sparkSession) as tables:
        drawn = _drawn(docs, sample_rows, row_chars, id_col, text_col, lang_col, tables)
        made = drawn.groupBy("lang").applyInPandas(run, "lang string, content binary")
        return {r.lang: bytes(r.content) for r in made.collect()}


class Classifier:
    """Compresses one text with every dictionary. Lives inside tasks."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = 3, block_bytes: int = 16384):
        import zstandard

        params = zstandard.ZstdCompressionParameters.from_level(level, min_match=4, write_content_size=False, write_dict_id=False, write_checksum=False)
        self.made, self.block_bytes = [], block_bytes
        for lang, content in sorted(dictionaries.items()):
            raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(compression_params=params)
            self.made.append((lang, zstandard.ZstdCompressor(dict_data=raw, compression_params=params)))

    def __call__(self, text: str | None) -> tuple[str, float]:
        """(language, relative margin between the two smallest sizes)."""
        if not text or not self.made or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        data = words_only(text)
        blocks = [data[k : k + self.block_bytes] for k in range(0, len(data), self.block_bytes)]
        sizes = sorted((sum([len(c.compress(x)) for x in blocks]), lang) for lang, c in self.made)
        if len(sizes) == 1:
            return sizes[0][1], 1.0
        return sizes[0][1], 1.0 - sizes[0][0] / sizes[1][0]


def classify(docs: DataFrame, dictionaries: dict[str, bytes], *, min_margin: float = 0.003, level: int = 3, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred, score (the relative margin, 0 to 1) and accepted to the columns in ``keep``.

    Whole texts are compressed. Null, empty and letterless texts get ``und``, score 0, not accepted.
    accepted: a language was found and the margin is min_margin or more. Ties go to the smaller
    language name. With no dictionary at all every row is ``und``. Repeated rows are rows of their own,
    an empty table gives an empty result; columns of docs called like the three results are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score", "accepted")]
    shipped = docs.sparkSession.sparkContext.broadcast(dictionaries)  # dict_bytes for each language
    text = docs[text_col].alias("_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Classifier(shipped.value, level)
        for batch in by_slices(batches):
            found = [of(t) for t in batch.column(0).to_pylist()]
            made = [[lang for lang, _ in found], [float(s) for _, s in found], [lang != UNDETERMINED and s >= min_margin for lang, s in found]]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *map(pa.array, made)], [*keep, "lang_pred", "score", "accepted"])

    columns = [docs[c] for c in keep]
    schema = docs.select(*columns).schema.add("lang_pred", "string").add("score", "double").add("accepted", "boolean")
    return docs.select(text, *columns).mapInArrow(run, schema)


def predict(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", **params) -> DataFrame:
    """The verdict of each row with its id, and whether the row was held out of the fit."""
    return classify(docs, dictionaries, keep=[id_col], **params).withColumn("held_out", held_out(id_col))
