import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) pairs, with the other columns filled in and two that clash with inner names."""
    from pyspark.sql import functions as F

    def make(rows, lang="en", source="s1"):
        full = [(i, t, lang, source, None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, DOCS).select("*", F.lit("x").alias("node"), F.lit(1).alias("low"), F.lit("y").alias("start"))
    return make


#: Nulls, nothing, blanks, and a text of many words.
ODD = [(None, "a b c d e f g"), (1, None), (2, ""), (3, " \n\t"), (4, "é ü ß 中文 words"), (5, "long " * 30_000)]
