import pytest

LONG = "word next " * 30_000

ROWS = [
    (1, "the cat sat on the mat and the dog ran off", "en", "s1"),
    (2, None, None, None),
    (3, "", "en", ""),
    (4, "   \n\t ", None, "s1"),
    (5, "the cat sat on the mat and the dog ran off", "en", "s2"),
    (5, "the cat sat on the mat and the dog ran off", "en", "s2"),
    (6, LONG, "en", "s1"),
    (7, "l'été à la plage est très agréable pour les enfants", "fr", "s2"),
    (None, "no id here", "en", None),
    (8, "123 456 !!! ▁ \x85 \x1c x", "fr", "s3"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, blank, very long and repeated texts, and no n_chars."""
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
