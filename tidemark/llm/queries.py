"""The registered query of each operator, and DuckDB SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import byte_bpe, divergence, exact_dedup, language_id, license_scan, line_dedup, ngram_join, packing, quality_rules, spelling, token_files, toxicity, url_filters
from .common import SPACE, cut, documents, scratch, text_or_empty


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


#: Ids of the public byte-level vocabulary, its end-of-text token included.
VOCABULARY, END_ID = 50_257, 2


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, shape = scratch(spark, "token-files"), {"vocabulary": VOCABULARY, "end_id": END_ID}
    parts = token_files.write(documents(spark, sf_dir), folder, public_tokenizers.path("byte_bpe_50k.json"), **shape)
    return token_files.read(spark, folder, parts, **shape)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a glob, so that one file and a folder of files both serve as the stream's source
    return exact_dedup.deduplicate(spark, f"{sf_dir}/documents.parque[t]", documents(spark, sf_dir).schema)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", line_dedup.host_of("url").alias("host"), line_dedup.html_text("html").alias("text"))
    rest = line_dedup.drop_frequent_lines(cut(pages, "page-texts"), ratio=0.1)  # the HTML is read once
    squeezed = F.trim(F.regexp_replace("text", SPACE, " "))
    return rest.select("page_id", "host", "n_lines", "n_dropped", F.sha2(squeezed, 256).alias("text_sha256"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(documents(spark, sf_dir))


def with_packing_columns(docs: DataFrame) -> DataFrame:
    """n_words of each document and its duplicate cluster: the hash of its text without white space and case."""
    text = text_or_empty()
    words = F.length(F.regexp_replace(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "w"), SPACE, ""))
    return docs.select("doc_id", "source", words.alias("n_words"), F.xxhash64(F.lower(F.regexp_replace(text, SPACE, ""))).alias("cluster"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(with_packing_columns(documents(spark, sf_dir)), capacity=1024, length_col="n_words")


def captures_and_entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Captures from ``pages`` (fetched on a day that follows from page_id) and dated list entries from the hosts seen."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.select("page_id", line_dedup.host_of("url").alias("host"), F.regexp_extract(F.coalesce("url", F.lit("")), r"://[^/?#]+/([^/?#]*)", 1).alias("segment"), F.expr("date_add(DATE'2024-01-01', cast(page_id % 366 AS int))").alias("fetched_on"))
    number = lambda at: F.conv(F.substring(F.md5("pattern"), at, 4), 16, 10).cast("int")
    hosts = captures.filter("host <> ''").select("host").distinct()
    parents = hosts.select(F.regexp_extract("host", r"^[^.]+\.(.+\..+\..+)$", 1).alias("pattern")).filter("pattern <> ''").distinct()
    paths = captures.filter("host <> '' AND segment <> ''").select(F.concat("host", F.lit("/"), "segment").alias("pattern")).distinct()
    patterns = hosts.select(F.col("host").alias("pattern")).union(parents).union(paths).distinct()
    turn = F.explode(F.sequence(F.lit(0), number(1) % 5))
    dated = patterns.withColumn("turn", turn).withColumn("list", F.when(number(5) % 4 == 0, F.lit("allow")).when(number(5) % 4 == 1, F.lit("malware")).otherwise(F.lit("adult")))
    entries = dated.select("list", "pattern", F.when(F.col("turn") % 2 == 0, F.lit("add")).otherwise(F.lit("remove")).alias("action"), F.expr("date_add(DATE'2023-11-01', cast(conv(substring(md5(pattern), 9, 4), 16, 10) AS int) % 200 + turn * 45)").alias("listed_on"))
    return captures, entries


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures, entries = captures_and_entries(spark, sf_dir)
    return url_filters.judge(captures, entries)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_id.predict(docs, language_id.fit(docs))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_token_files": op2_token_files,
    "op3_quality_rules": op3_quality_rules,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_url_filters": op9_url_filters,
    "op10_language_id": op10_language_id,
    "op11_source_divergence": op11_source_divergence,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_toxicity": op13_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
        )
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)
    """,
    "op5_line_dedup": r"""
        WITH a AS (
            SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)) AS host,
                   regexp_replace(coalesce(html, ''), '(?is)<(?:script|style)\b.*?</(?:script|style)>|<!--.*?-->', ' ', 'g') AS bare
            FROM pages
        ), b AS (
            SELECT page_id, host, string_split(regexp_replace(regexp_replace(bare, '(?i)</?(?:p|br|li|ul|ol|h[1-6]|div|tr|table|title|article|nav|header|footer|section)\b[^>]*>', chr(10), 'g'), '<[^>]*>', ' ', 'g'), chr(10)) AS lines
            FROM a
        ), c AS (
            SELECT page_id, host, list_filter(list_transform(lines, lambda x: trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))), lambda x: x <> '') AS lines FROM b
        ), n AS (
            SELECT host, line, count(*) AS pages FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM c) GROUP BY ALL
        ), f AS (
            SELECT n.host, list(line) AS keys FROM n JOIN (SELECT host, count(*) AS total FROM c GROUP BY 1) t ON n.host = t.host
            WHERE pages > 0.1 * total GROUP BY 1
        ), r AS (
            SELECT page_id, c.host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(keys, []), x)) AS kept FROM c LEFT JOIN f ON c.host = f.host
        )
        SELECT page_id, host, len(lines)::INT AS n_lines, (len(lines) - len(kept))::INT AS n_dropped, sha256(coalesce(array_to_string(kept, ' '), '')) AS text_sha256 FROM r
    """,
    "op9_url_filters": r"""
        WITH c AS (
            SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)) AS host,
                   regexp_extract(coalesce(url, ''), '://[^/?#]+/([^/?#]*)', 1) AS segment, DATE '2024-01-01' + (page_id % 366)::INT AS fetched_on
            FROM pages
        ), p AS (
            SELECT host AS pattern FROM c WHERE host <> ''
            UNION SELECT regexp_extract(host, '^[^.]+\.(.+\..+\..+)$', 1) FROM c WHERE regexp_extract(host, '^[^.]+\.(.+\..+\..+)$', 1) <> ''
            UNION SELECT host || '/' || segment FROM c WHERE host <> '' AND segment <> ''
        ), h AS (
            SELECT pattern, ('0x' || substr(md5(pattern), 1, 4))::INT AS a, ('0x' || substr(md5(pattern), 5, 4))::INT AS b, ('0x' || substr(md5(pattern), 9, 4))::INT AS d FROM p
        ), e AS (
            SELECT CASE b % 4 WHEN 0 THEN 'allow' WHEN 1 THEN 'malware' ELSE 'adult' END AS list, pattern, turn,
                   DATE '2023-11-01' + (d % 200 + turn * 45)::INT AS since FROM (SELECT *, unnest(range(0, a % 5 + 1)) AS turn FROM h)
        ), s AS (
            SELECT *, coalesce(lead(since) OVER (PARTITION BY list, pattern ORDER BY since), DATE '2100-01-01') AS until FROM e
        ), m AS (
            SELECT c.*, s.pattern, s.list, s.since AS listed,
                   row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC, list, pattern, s.since) AS rn, count(*) OVER (PARTITION BY page_id) AS n
            FROM c JOIN s ON turn % 2 = 0 AND fetched_on >= s.since AND fetched_on < until
             AND (host = pattern OR ends_with(host, '.' || pattern) OR host || '/' || segment = pattern OR (contains(pattern, '/') AND ends_with(host || '/' || segment, '.' || pattern)))
        )
        SELECT c.page_id, c.host, c.segment, c.fetched_on, coalesce(n, 0) AS n_active, pattern AS decided_by, list AS decided_list, listed AS since, coalesce(list, 'allow') <> 'allow' AS blocked
        FROM c LEFT JOIN (SELECT * FROM m WHERE rn = 1) m ON c.page_id = m.page_id
    """,
    "op11_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
            FROM documents
        ), c AS (
            SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM (SELECT r, lang, source, unnest(words) AS term FROM d) GROUP BY ALL
        ), k AS (
            SELECT lang, term, sum(n) AS total FROM c GROUP BY ALL HAVING sum(docs) >= 10
        ), v AS (
            SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM k GROUP BY ALL
        ), g AS (
            SELECT DISTINCT lang, source FROM d
        ), f AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, total::HUGEINT AS total
            FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ), s AS (
            SELECT f.lang, f.source, f.term, f.n, 1 + (1000000000 * (f.n + 2)) // (sum(f.n) OVER (PARTITION BY f.lang, f.source) + 2 * v.v)::HUGEINT AS p,
                   1 + (1000000000 * (f.total + 2)) // (v.n + 2 * v.v) AS q
            FROM f JOIN v ON f.lang = v.lang
        ), pairs AS (
            SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
                SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
                FROM s x JOIN s y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
            ) t ON t.lang = a.lang AND t.source = a.source AND t.other = b.source
        ), terms AS (
            SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM s WHERE n > 0 AND p > q
        )
        SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
        UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM terms) WHERE rank <= 10
    """,
    "op12_spelling_variants": r"""
        WITH RECURSIVE crc AS (
            SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS steps
        ), runs AS (
            SELECT doc_id, run, count(*) AS n FROM (
                SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents
            ) GROUP BY ALL
        ), coded AS (
            SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS code FROM runs
        ), hashed AS (
            SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(code) // 2), lambda i: ('0x' || substr(code, 2 * i + 1, 2))::BIGINT)), lambda a, b: xor(a >> 8, steps[(xor(a, b) & 255) + 1])), 4294967295) AS h
            FROM coded, crc
        ), w AS (
            SELECT word, sum(n)::BIGINT AS n FROM (
                SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed
            ) WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3
        ), cuts AS (
            SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)
        ), pairs AS (
            SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
            UNION SELECT a.word, b.word, b.n FROM w a JOIN cuts b ON a.word = b.rest
            UNION SELECT b.word, a.word, a.n FROM w a JOIN cuts b ON a.word = b.rest
        ), near AS (
            SELECT word, count(*) AS n_near, arg_min(other, {'less': -other_n, 'other': other}) AS best, max(other_n) AS best_n FROM pairs GROUP BY 1
        ), forms AS (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * w.n THEN best END AS form, CASE WHEN best_n >= 2 * w.n THEN best_n END AS form_n FROM w LEFT JOIN near ON near.word = w.word
        ), ways AS (
            SELECT word, word AS at FROM forms
            UNION ALL SELECT ways.word, forms.form FROM ways JOIN forms ON forms.word = ways.at WHERE forms.form IS NOT NULL
        ), ends AS (
            SELECT ways.word, ways.at AS root FROM ways JOIN forms ON forms.word = ways.at WHERE forms.form IS NULL
        )
        SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN ends ON ends.word = forms.word
    """,
}
