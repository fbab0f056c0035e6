import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, line_dedup, ngram_join
from tidemark.llm.common import Tables, components, perhaps_in, without


def brute_components(texts):
    sets = {}
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[d] = frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            k = len(sets[a] & sets[b])
            if k and 100 * k >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def planted(seed, groups, size, words=80):
    """Groups of near copies with edits around the threshold, texts that share a passage, and short ones."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 5)))
    passage = [word() for _ in range(40)]
    texts = []
    for g in range(groups):
        base = [word() for _ in range(r.randrange(6, words))]
        if g % 3 == 0:
            base = base[: len(base) // 2] + passage + base[len(base) // 2 :]
        for _ in range(r.randrange(1, size)):
            w = list(base)
            for _ in range(r.randrange(0, 5)):
                w[r.randrange(len(w))] = word()
            texts.append(" ".join(w) if r.random() < 0.8 else "\n".join(w).upper())
    return texts + ["a b c", "a b  c", "A B C", "a b c d", "a b c d e", None, "", "  \n", "one two three four", "one two three four"]


def test_ngram_components_equal_brute_force(docs):
    texts = planted(3, 40, 9)
    df = docs(texts, start=5).repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(df).collect()}
    assert got == brute_components({i + 5: t for i, t in enumerate(texts)})


def test_ngram_large_block_is_split_and_exact(docs):
    texts = planted(4, 3, 260, words=60)
    assert len(texts) > 2 * ngram_join.CELL
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(docs(texts).repartition(3)).collect()}
    assert got == brute_components(dict(enumerate(texts)))


def test_ngram_null_ids_repeated_rows_and_no_rows(spark, docs):
    df = docs(["q w e r t y u"] * 2).unionByName(docs(["q w e r t y u"])).withColumn("n", F.lit(1)).withColumn("class", F.lit("x"))
    df = df.unionByName(df.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    rows = ngram_join.link_components(df).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in rows if r.doc_id is not None) == [(False, 0)] * 3
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert ngram_join.link_components(docs([])).count() == 0


def test_ngram_one_id_with_several_texts(spark):
    text = lambda k, n: " ".join(f"t{k}w{i}" for i in range(n))
    a, b, tail = text("a", 40), text("b", 40), text("b", 40) + " tail"
    rows = [(3, a), (5, a), (5, b), (9, tail), (5, ""), (5, None), (11, text("c", 30)), (12, text("c", 30) + " x"), (12, text("d", 30)), (12, text("d", 30)), (13, text("d", 31)), (20, text("e", 20)), (21, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = ngram_join.link_components(df).collect()
    want = {3: 3, 5: 3, 9: 3, 11: 11, 12: 11, 13: 11, 20: 20, 21: 21}
    assert len(out) == len(rows) and all(r.component_id == want[r.doc_id] for r in out)


def test_ngram_outside_members_ask_the_parts_of_a_large_block(docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "VOLUME", 1500)
    monkeypatch.setattr(ngram_join, "QUERIES", 7)
    monkeypatch.setattr(ngram_join, "CELL", 16)
    texts = planted(9, 12, 40, words=70)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(docs(texts).repartition(3)).collect()}
    assert got == brute_components(dict(enumerate(texts)))


def test_ngram_long_texts(docs):
    r = random.Random(8)
    long_ = [f"w{r.randrange(5000)}" for _ in range(30_000)]
    near = list(long_)
    for i in range(0, 30_000, 400):
        near[i] = "changed"
    texts = [" ".join(long_), " ".join(near), " ".join(long_[:15_000]), "short one"]
    got = [x.component_id for x in sorted(ngram_join.link_components(docs(texts)).collect())]
    assert got == [0, 0, 2, 3]


def test_divide_skip_counts_like_a_scan():
    import numpy as np

    r = random.Random(2)
    sets = sorted((np.unique([r.randrange(200) for _ in range(r.randrange(5, 60))]).astype(np.int64) for _ in range(60)), key=len)
    index = ngram_join.Index(sets)
    for at, q in enumerate(sets):
        found = dict(index.search(q, 75, lambda p: True))
        assert {p: c for p, c in index.search(q, 75, lambda p: True, at) if p != at} == {p: c for p, c in found.items() if p != at}
        for i, s in enumerate(sets):
            k = len(np.intersect1d(q, s))
            if ngram_join.linked(k, len(q), len(s), 75):
                assert found[i] == k


def test_merge_skip():
    r = random.Random(5)
    for _ in range(200):
        lists = [sorted(r.sample(range(30), r.randrange(0, 12))) for _ in range(r.randrange(1, 8))]
        t = r.randrange(1, 5)
        count = defaultdict(int)
        for x in lists:
            for v in x:
                count[v] += 1
        assert ngram_join.merge_skip(lists, t) == sorted((v, c) for v, c in count.items() if c >= t)


@pytest.mark.parametrize("files", [1, 7])
def test_components_of_chains_and_hubs(spark, files):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(1, x) for x in range(2, 40)] + [(7, 7), (500, 400)]
    with Tables(spark) as tables:
        got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long").repartition(files), "t", tables).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 1 for i in range(1, 40)) and got[500] == got[400] == 400 and len(got) == 102
    with Tables(spark) as tables:
        assert components(spark.createDataFrame([], "a long, b long"), "t", tables).count() == 0


def test_tables_go_when_their_call_ends(spark, docs):
    import os

    from tidemark.llm.common import shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    texts = [" ".join(f"w{k}" for k in range(40)) + f" end{i}" for i in range(5)]
    assert {r.component_id for r in ngram_join.link_components(docs(texts)).collect()} == {0}
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert left == {"ngram-prints", "ngram-answer"}  # what the result itself reads


def test_bitmap_filter_keeps_all_members(spark):
    df, members = spark.range(5000), spark.range(0, 5000, 7)
    kept = {r.id for r in perhaps_in(df, "id", members, bits=1 << 16).collect()}
    assert kept >= set(range(0, 5000, 7)) and len(kept) < 1500
    assert {r.id for r in without(df, "id", members, bits=1 << 16).collect()} == set(range(5000)) - set(range(0, 5000, 7))
    assert perhaps_in(df, "id", members.limit(0)).count() == 0 and without(df, "id", members.limit(0)).count() == 5000


def test_exact_dedup(spark, docs, stored):
    texts = ["a b", "a  b", "a\tb", None, "", "c", "c", " c", "a b"]
    df = docs(texts).unionByName(docs(["c"], start=6)).withColumn("digest", F.lit("clash"))
    path, schema = stored(df, files=4)
    rows = exact_dedup.deduplicate(spark, path, schema, files_per_trigger=1).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert len(rows) == 10 and [by[i][0].keep_id for i in range(9)] == [0, 0, 0, 3, 3, 5, 5, 7, 0]
    assert by[0][0].group_size == 4 and by[5][0].group_size == 3 and by[7][0].group_size == 1
    assert sum(r.kept for r in rows) == 4 and sum(r.kept for r in by[6]) == 0


def test_exact_dedup_when_digests_clash(docs, stored):
    texts = ["aa", "bb", "aa", "c", "bb", "a  a", "a a", "long " * 40_000, "long " * 40_000]
    path, schema = stored(docs(texts), files=3)
    rows = exact_dedup.deduplicate(docs(texts).sparkSession, path, schema, digest=lambda norm: F.least(F.length(norm), F.lit(3)).cast("string")).collect()
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in rows}
    assert got == {0: (0, 2, True), 1: (1, 2, True), 2: (0, 2, False), 3: (3, 1, True), 4: (1, 2, False), 5: (5, 2, True), 6: (5, 2, False), 7: (7, 2, True), 8: (7, 2, False)}


def test_exact_dedup_goes_on_from_its_state(spark, docs, tmp_path):
    path, work = str(tmp_path / "in.parquet"), f"file://{tmp_path}/work"
    docs(["x", "y", "x"]).coalesce(1).write.parquet(path)
    schema = docs(["x"]).schema
    first = {r.doc_id: r.keep_id for r in exact_dedup.deduplicate(spark, path, schema, work=work).collect()}
    assert first == {0: 0, 1: 1, 2: 0}
    docs(["y", "x", "z"], start=10).coalesce(1).write.mode("append").parquet(path)
    both = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.deduplicate(spark, path, schema, work=work).collect()}
    assert both == {0: (0, 3), 1: (1, 2), 2: (0, 3), 10: (1, 2), 11: (0, 3), 12: (12, 1)}
    assert {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.deduplicate(spark, path, schema, work=work).collect()} == both


def test_exact_dedup_of_nothing(spark, docs, stored):
    path, schema = stored(docs([]))
    assert exact_dedup.deduplicate(spark, path, schema).count() == 0


def test_site_lines(spark):
    pages = [(i, "h", f"menu\nmenu \nown {i}\n\nfoot") for i in range(10)] + [(10, "h", None), (11, "h", ""), (12, "other", "menu\nx"), (13, None, "menu"), (0, "h", "menu\nown 0\n\nfoot")]
    df = spark.createDataFrame(pages, "page_id long, host string, text string").withColumn("keys", F.lit(1)).withColumn("n_lines", F.lit("clash"))
    rows = line_dedup.drop_frequent_lines(df, ratio=0.3, min_pages=3).collect()
    got = {(r.page_id, r.host): r for r in rows}
    assert len(rows) == 15 and got[3, "h"].text == "own 3\n" and got[3, "h"].n_dropped == 3 and got[3, "h"].n_lines == 4
    assert got[10, "h"].text is None and got[10, "h"].n_lines == 0 and got[12, "other"].text == "menu\nx" and got[13, None].text == "menu"
    assert line_dedup.drop_frequent_lines(df.limit(0)).count() == 0


def test_site_lines_by_ratio_alone_and_long_pages(spark):
    rows = [(i, "h", f"own {i}\nboth" if i < 2 else f"own {i}") for i in range(10)] + [(20 + i, "big", "\n".join(f"l{j}" for j in range(i % 2, 20_000, 2))) for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, host string, text string")
    got = {r.page_id: r for r in line_dedup.drop_frequent_lines(df, ratio=0.15).collect()}
    assert got[0].text == "own 0" and got[0].n_dropped == 1 and got[5].n_dropped == 0
    assert all(got[20 + i].n_dropped == 10_000 and got[20 + i].text == "" for i in range(4))
    assert all(r.n_dropped == r.n_lines for r in line_dedup.drop_frequent_lines(df, ratio=0.05).collect())  # one page of ten is over it
    assert {r.page_id: r.n_dropped for r in line_dedup.drop_frequent_lines(df, ratio=0.05, min_pages=2).collect() if r.page_id < 20} == {i: int(i < 2) for i in range(10)}


def test_site_lines_keep_columns_of_any_name(spark):
    own = ["_lines", "_own", "_gone", "_kept", "_host", "_keys", "_total_host", "key", "doc_0", "doc_2", "total", "pages"]
    df = spark.createDataFrame([(i, "h", f"menu\nown {i}") for i in range(10)], "page_id long, host string, text string")
    for name in own:
        df = df.withColumn(name, F.lit(f"my {name}"))
    rows = line_dedup.drop_frequent_lines(df, ratio=0.3).collect()
    assert {r.text for r in rows} == {f"own {i}" for i in range(10)} and all(r[name] == f"my {name}" for r in rows for name in own)
