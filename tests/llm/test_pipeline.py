import re

import corpus_pipeline
from pyspark.sql import functions as F
from test_dedup import brute_components

from tidemark.llm.common import cut


def test_stages_keep_columns_and_clean_documents(spark, sf):
    docs = start = spark.read.parquet(f"{sf}/documents.parquet")
    counts, after = [docs.count()], {}
    for name, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, docs, sf), f"test-{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == start.columns
            assert {r.doc_id for r in out.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
            docs, after[name] = out, {r.doc_id for r in out.select("doc_id").collect()}
        counts.append(out.count())
    assert counts[1] > 0.97 * counts[0] and counts[4] <= counts[3]
    # of what the quality rules see, documents without junk stay
    from tidemark.llm.quality_rules import measure

    clean = {r.doc_id for r in start.collect() if (m := measure(r.text))[0] >= 60 and not any(m[2:5])}
    assert len(clean) > 100 and len(clean & after["quality_rules"]) >= 0.95 * len(clean & after["language_id"])
    packed = {r.doc_id for r in out.select("doc_id").collect()}
    assert packed == {r.doc_id for r in docs.collect() if (r.text or "").split()}


def test_near_copies_leave_one(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(i, text + f" tail{i}", "en", "s", 1) for i in range(6)] + [(9, "other words entirely in this one here", "en", "s", 1), (9, "other words entirely in this one here", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [0, 9]


def test_copies_are_not_site_lines(spark):
    copy = "\n".join(" ".join(f"c{i}x{j}" for j in range(12)) for i in range(5))
    page = lambda n: "\n".join(["site menu home about", *(" ".join(f"p{n}l{i}w{j}" for j in range(12)) for i in range(4))])
    rows = [(i, copy, "en", "s", len(copy)) for i in range(30)] + [(100 + i, page(i), "en", "s", len(page(i))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    rest = cut(corpus_pipeline.drop_site_lines(spark, docs, ""), "test-copies")
    left = {r.doc_id: r.text for r in corpus_pipeline.drop_near_copies(spark, rest, "").collect()}
    assert sorted(left) == [0, *range(100, 160)] and left[0] == copy
    assert not any("menu" in t for t in left.values())


def test_empty_input(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_stages_keep_clashing_columns_nulls_and_long_texts(spark):
    import random

    r = random.Random(3)
    said = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8))) for _ in range(n))
    rows = [(i, said(80), "en" if i % 2 else "de", "s", 1, "mine", f"v{i}", False) for i in range(80)]
    rows += [(None, said(70), "en", None, 1, "mine", "null id", False), (None, "bad", "en", None, 1, "mine", "null id, bad", False), (200, None, None, "s", None, "mine", "null", False), (201, "", "en", "s", 0, "mine", "empty", False)]
    rows += [(300, said(50_000), "en", "s", 1, "mine", "long", False), (5, said(60), "en", "s", 1, "mine", "again", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, n_dropped string, accepted boolean")
    own = ["_row_key", "_bitmap_place", "_bitmap_in", "_bitmap_gone", "_host", "_lines", "_text", "doc_3", "_row", "grp", "class"]
    for name in own:
        docs = docs.withColumn(name, F.concat("n_dropped", F.lit(f" {name}")))
    texts, after = {x[6]: x[1] for x in rows}, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = cut(stage(spark, docs, ""), f"test-{name}")
        assert out.schema == docs.schema
        after[name] = out.collect()
        for x in after[name]:
            assert all(x[c] == f"{x.n_dropped} {c}" for c in own) and x.score == "mine" and x.accepted is False and texts[x.n_dropped] == x.text
    kept = {x.n_dropped for x in after["quality_rules"]}
    assert "null id" in kept and "null id, bad" not in kept and "again" in kept and "null" not in kept
    left = [x.doc_id for x in after["ngram_jaccard"]]
    assert sorted(x for x in left if x is not None) == [*range(80), 200, 201, 300] and left.count(None) == 2
    packed = corpus_pipeline.pack_sequences(spark, docs, "").groupBy("doc_id").agg(F.sum("length").alias("n"), F.count("*").alias("pieces")).collect()
    assert {x.doc_id: (x.n, x.pieces) for x in packed}[300] == (50_000, 49)


def test_run_equals_its_stages_by_brute_force(spark):
    """Each stage of the whole run on a small table against plain Python, given the verdicts of fitted operators."""
    from tidemark.llm import language_id, quality_rules

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    of = language_id.Classifier(language_id.fit(docs))
    rows = [r for r in rows if (s := of(r["text"]))[0] != "und" and s[1] >= 0.003]
    judged = spark.createDataFrame([tuple(r.values()) for r in rows], docs.schema)
    kept = {r.doc_id for r in quality_rules.apply_rules(judged).collect() if r.kept}
    rows = [r for r in rows if r["doc_id"] in kept]
    squeeze = lambda x: re.sub("[ \\t\\n\\x0b\\x0c\\r]+", " ", x).strip(" ")
    sites = {}
    for r in rows:
        lines = tuple(dict.fromkeys(squeeze(x) for x in r["text"].split("\n") if x.split()))
        sites.setdefault(r["source"], set()).add(lines)
    left = []
    for r in rows:
        pages = sites[r["source"]]
        gone = {x for x in {squeeze(x) for x in r["text"].split("\n") if x.split()} if (n := sum(x in p for p in pages)) >= 5 and n > 0.05 * len(pages)}
        lines = r["text"].split("\n")
        stay = [x for x in lines if not x.split() or squeeze(x) not in gone]
        if len(stay) == len(lines) or any(x.split() for x in stay):
            left.append({**r, "text": "\n".join(stay)})
    found = brute_components({r["doc_id"]: r["text"] for r in left})
    left = [r for r in left if found[r["doc_id"]][1] == r["doc_id"]]
    want = {}
    for r in left:
        if n := len(re.findall("[^\x20\x09-\x0d]+", r["text"])):
            want[r["doc_id"]] = n
    got, bins = {}, {}
    for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        bins[r.shard, r.bin] = bins.get((r.shard, r.bin), 0) + r.length
    assert got == want and max(bins.values()) <= 1024
