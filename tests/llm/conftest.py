import pytest

#: Nulls in any column, empty and very long texts, ties, repeated rows, several scripts.
ROWS = [
    (1, "The quick brown fox's den, it'll do. 123 456!", "en", "a", 44),
    (2, "the QUICK brown fox's den, it'll do. 123 456!", "en", "a", 44),
    (3, None, "en", None, None),
    (4, "", None, "b", 0),
    (5, "", None, "b", 0),
    (5, "", None, "b", 0),
    (None, "lost id", "en", "a", 7),
    (None, None, None, None, None),
    (6, "Ärger über ÉTÉ, ärger über ÉTÉ — naïve “quotes” 中文字符 русский текст ქართული", "de", "c", 70),
    (7, "word " * 30_000, "en", "a", 150_000),
    (8, "x" * 30_000, "en", "a", 30_000),
    (9, " \t\n  spaced\x0b\x0c out\r\n\n\n  ", "en", "a", 20),
    (10, "<|endoftext|> inside <|startoftext|>text<|endoftext|>", "en", "a", 50),
    (11, "nul \x00 and \x1c sep \x85 nel   em \xa0 nbsp é ́x", "en", "a", 30),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Awkward documents, with extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, SCHEMA)
    for name in ("_text", "shard", "slot", "length", "kept", "keep_id", "digest", "_row", "n_tokens", "key", "_n", "_score", "_p", "_r", "_k1", "_k2", "_key", "_t", "_id", "unit", "bucket", "label", "rows", "run"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
