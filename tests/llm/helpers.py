import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Nulls in any column, empty and white texts, repeated rows, equal texts, a long text, clashing column names come on top.
ODD = [
    (1, "The cat sat on the mat.", "en", "a", 23),
    (1, "The cat sat on the mat.", "en", "a", 23),
    (2, "the CAT sat on the mat.", "en", "b", 23),
    (3, "", "en", "b", 0),
    (4, None, "en", None, None),
    (None, "a row without an id, mail me@x.org now", "en", "a", 5),
    (None, None, None, None, None),
    (5, " \t\n ", None, "c", 4),
    (6, "la maison est grande et le chat dort", "fr", "c", 36),
    (7, "word " * 20_000, "en", "a", 100_000),
    (8, "日本語の文 and Ünïcode É", None, "d", 10),
    (9, "12345 67890 !!! ???", None, "d", 19),
]


def frame(spark, rows=ODD, extra=True):
    """Rows as documents, with extra columns whose names clash with what operators make."""
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", "1 as row", "'x' as score", "2 as size", "'y' as kept", "3 as block") if extra else df


def remainder(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts
