import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, lang[, source]]), with columns of awkward names."""

    def build(rows, extra=True):
        full = [(*r, *("en", "src0")[len(r) - 2 :], len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, DOC)
        if extra:
            names = ("th", "n", "id", "size", "kept", "hi", "cluster", "row", "__sha", "__row", "__id", "code", "section_no", "score", "features", "word", "secret", "bucket", "target")
            df = df.selectExpr("*", *[f"'x' AS `{c}`" for c in names])
        return df

    return build
