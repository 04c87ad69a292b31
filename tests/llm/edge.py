"""Documents with everything that may come: nulls, empty and long texts, ties, repeats, clashing names."""

from pyspark.sql import functions as F

LONG = "wort " * 40_000
ROWS = [
    (0, "The quick brown fox, write to a.b@mail.example.com or +1 (523) 555-1055 now.", "en", "s0", 10),
    (1, None, "en", "s0", None), (2, "", None, None, 0), (3, "   \n\t ", "fr", "s1", 3), (4, LONG, "de", "s1", 5),
    (5, "same text here for all of us", "en", None, 1), (6, "same text here for all of us", "en", "s2", 1),
    (6, "same text here for all of us", "en", "s2", 1), (7, "1234 5678 !!", None, "s2", 2),
    (None, "an orphan without a number", "en", "s0", 4), (None, "an orphan without a number", None, "s0", 4),
    (8, "é" * 3000 + " 中文 text \U0001f600", None, "s0", 4),
]
CLASHES = ("size", "ids", "fp", "spans", "score", "lang_pred", "words", "_text", "raw", "_key", "row", "shard", "place", "bucket", "copy")


def documents(spark, clashes=True):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in CLASHES}) if clashes else df


def empty(spark):
    return documents(spark).limit(0)
