import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


#: Rows with nulls, empty and repeated texts, ties, odd characters, and columns that clash with names used inside.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away from here today", "en", "src0"),
    (2, "The quick brown fox jumps over the lazy dog and runs far away from here today", "en", "src0"),
    (3, "the QUICK brown fox jumps over the lazy dog and runs far away from here Today", "en", "src1"),
    (4, None, "en", None),
    (5, "", None, "src2"),
    (6, "Straße ÉCOLE 日本語   tabs\tand\nlines  ▁ <|endoftext|> Σίσυφος İx", "de", "src2"),
    (6, "same id, other text", "de", "src2"),
    (None, "no id at all", "fr", "src3"),
    (7, " \n\t ", "fr", "src3"),
    (8, "word " * 3000, "es", "src4"),
    (8, "word " * 3000, "es", "src4"),
    (9, "x" * 70000, "es", "src0"),
]


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit("clash") for c in ("score", "ids", "rid", "blocks", "name", "node", "copies", "label", "part", "h", "n")})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
