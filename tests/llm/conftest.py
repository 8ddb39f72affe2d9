import pytest
from pyspark.sql import functions as F

ODD_ROWS = [
    (1, "The cat sat on the mat. It was a warm day! Was it? Yes."),
    (2, "The cat sat on the mat. It was a warm day! Was it? Yes."),
    (3, None), (4, ""), (5, " \n\t "), (None, "a row without an id"), (6, "é ́ 日本語 Straße İ <|endoftext|> don't"),
    (7, "x" * 3000), (8, "word " * 3000), (8, "word " * 3000), (9, "A b C d"), (10, "a B c D"),
    (11, "mail jo.81@mail9.example.com or +1 (171) 555-2034, card 4111 1111 1111 1111 at 10.0.0.1."),
]


@pytest.fixture(scope="session")
def odd_docs(spark, tmp_path_factory):
    """Nulls, empty, long and repeated texts, ties, and extra columns with clashing names, as a written table."""
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in ODD_ROWS]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for extra in ("id", "n", "kept", "score", "u", "v", "part", "tox_score", "group_size", "keep_id", "spans", "a.b"):
        df = df.withColumn(extra, F.lit(1))
    df.coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("doc_id < 0")
