import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    def make(texts, start=0, lang="en", source="s"):
        rows = [(i + start, t, lang, source, None if t is None else len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOC)

    return make


@pytest.fixture
def stored(spark, tmp_path):
    """Writes a table of documents as files; gives (glob, schema)."""

    def put(df, files=1):
        path = str(tmp_path / "documents.parquet")
        df.repartition(files).write.parquet(path)
        return path, df.schema

    return put
