import pytest
from pyspark.sql import functions as F

from tidemark.sources.catalog import ContractError
from tidemark.sources.store import Store, bloom, may_hold

ROW = "k long, v string"


def rows(spark, first, last, v="x", step=1):
    return spark.range(first, last, step, 3).select(F.col("id").alias("k"), F.concat(F.lit(v), F.col("id").cast("string")).alias("v"))


def test_filters_miss_no_key():
    import numpy as np

    r = np.random.default_rng(1)
    held, others = r.integers(-(1 << 62), 1 << 62, 5000), r.integers(-(1 << 62), 1 << 62, 5000)
    made = bloom(held)
    assert may_hold(made, held).all() and may_hold(made, others).mean() < 0.03 and not may_hold(bloom(held[:0]), others).any()


def test_commits_show_whole_versions(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/s", {"a": ["k"], "b": ["k"]})
    assert store.read("a", ROW).count() == 0 and store.version().number == 0
    store.commit({"a": rows(spark, 0, 100), "b": rows(spark, 0, 10)}, "feed", 0)
    first = store.version()
    again = store.commit({"a": rows(spark, 0, 100), "b": rows(spark, 0, 10)}, "feed", 0)  # the same batch once more
    assert again == first and store.read("a", ROW).count() == 100
    # a failure between two data sets leaves readers on the old version
    staged = Store._stage

    def failing(self, name, frame, commit):
        staged(self, name, frame, commit)
        if name == "a":
            raise OSError("lost")

    monkeypatch.setattr(Store, "_stage", failing)
    with pytest.raises(OSError):
        store.commit({"a": rows(spark, 100, 200), "b": rows(spark, 10, 20)}, "feed", 1)
    assert store.version() == first and store.read("a", ROW).count() == 100 and store.read("b", ROW).count() == 10
    monkeypatch.undo()
    store.commit({"a": rows(spark, 100, 200), "b": rows(spark, 10, 20)}, "feed", 1)
    assert store.read("a", ROW).count() == 200 and store.read("b", ROW).count() == 20 and store.read("a", ROW, first).count() == 100


def test_two_commits_of_one_version(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", {"a": ["k"]})
    seen = store.version()
    store.commit({"a": rows(spark, 0, 5)})
    other = Store(spark, f"file://{tmp_path}/s", {"a": ["k"]})
    other.version = lambda: seen
    with pytest.raises(ContractError):
        other.commit({"a": rows(spark, 5, 9)})
    assert store.read("a", ROW).count() == 5


def test_segments_within_both_bounds(spark, tmp_path):
    wide = rows(spark, 0, 4000).withColumn("v", F.sha2("v", 512))
    by_rows = Store(spark, f"file://{tmp_path}/r", {"a": ["k"]}, most_rows=300)
    by_rows.commit({"a": wide})
    assert by_rows.segments("a").agg(F.max("rows"), F.sum("rows")).first() == (300, 4000)
    by_bytes = Store(spark, f"file://{tmp_path}/b", {"a": ["k"]}, most_bytes=60_000)
    by_bytes.commit({"a": wide})
    found = by_bytes.segments("a").agg(F.max("bytes"), F.sum("rows"), F.count("*")).first()
    assert found[0] <= 60_000 and found[1] == 4000 and found[2] > 4 and by_bytes.read("a", ROW).count() == 4000
    with pytest.raises(ContractError):
        Store(spark, f"file://{tmp_path}/c", {"a": ["k"]}, most_bytes=10).commit({"a": wide.limit(3)})


def test_a_batch_reads_only_files_that_may_hold_its_keys(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", {"a": ["k"]}, most_rows=100)
    for n in range(4):  # every fourth key each: the ranges overlap, the filters don't
        store.commit({"a": rows(spark, 100_000 + n, 104_000, step=4)})
    assert store.segments("a").count() >= 40
    keys = spark.createDataFrame([(100_008,), (102_001,), (102_005,), (99,), (999_999,)], "k long")
    assert store.paths_holding("a", keys).count() <= 4
    got = store.holding("a", keys, ROW).join(keys, "k", "left_semi").collect()
    assert sorted(r.k for r in got) == [100_008, 102_001, 102_005]
    assert store.holding("a", keys.limit(0), ROW).count() == 0
