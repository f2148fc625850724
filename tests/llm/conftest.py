import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

ODD = ["", None, " ", "\n", "a", "The the", "a  b", "x \n y\n\n", "tab\tand\x0bmore \r\n", "<|endoftext|>",
       "end <|endoftext|> and \n <|endoftext|>on", "nbsp   \n here x 　", "unit\x1csep \x1f x\x85y",
       "İstanbul ΣΊΣΥΦΟΣ Kelvin K İ Å", "don't we'll I'M they'Re '' 'sx", "😀 emoji👩‍👩‍👧 text ١٢٣ 12345",
       "null\x00byte", "word, word. word! (word) -- ... ###", "ﬀ ﬁ ½ ² Å", "a" * 5000, "long word run " * 3000]


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts, repeated rows, ties, null and repeated ids, and clashing extra columns."""
    rows = [(i if i % 7 else None, t, "en", None if i % 3 else f"s{i % 4}", None) for i, t in enumerate(ODD)]
    rows += [(3, "same row twice", "en", "s1", 1)] * 2 + [(3, "same id, other text", None, "s1", 1)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("h", "fp", "ids", "size", "root", "_key", "n"):
        df = df.withColumn(c, F.lit(c))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
