from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls, empty and blank texts, repeated rows, ties, control strings, odd white space, a long text.
ODD_ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n ", "en", "a", 4),
    (4, "Hello world", "en", "b", 11),
    (5, "hello WORLD", "fr", "b", 11),
    (6, "hello WORLD", "fr", None, 11),
    (7, "Hello world", "en", "b", 11),
    (7, "Hello world", "en", "b", 11),
    (8, "don't stop<|endoftext|> it's  the \n\n end  ", "en", "é", 40),
    (9, "naïve café œuvre　日本語 m² 3² x\x1cy 'tis 'Tis ''s", "fr", "b", 40),
    (10, "lorem ipsum dolor " * 3000, None, "a", 54000),
    (11, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 2, "en", "c", 104),
    (None, "no id here at all, just ten words of text today", "en", "c", 47),
    (12, "É́ ÀÉ ß ſ ŉ İstanbul ΑΣ Σ", "de", "c", 20),
]


@pytest.fixture()
def odd_docs(spark):
    """An extra column whose name clashes with names that operators use inside."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(ODD_ROWS, SCHEMA)
    return rows.withColumns({"size": F.lit("x"), "sha": F.lit(1), "__sha": F.lit(2), "kept": F.lit(None).cast("string"), "words": F.lit(0)})


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
