"""What the tests of this folder share."""

from pyspark.sql import types as T

#: Extra columns whose names the operators might use themselves.
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("sha", T.StringType()),
        T.StructField("block", T.StringType()),
        T.StructField("row", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("size", T.StringType()),
        T.StructField("p", T.StringType()),
    ]
)

ODD_TEXTS = ["", None, " \t\n\x0b\x0c\r ", "one", "two words", "Ünïcödé ÀÉ ß İ", "a b c d", "日本語 テキスト 😀", "tab\tand\nline", "x" * 5000, "word " * 20000, "<b>&amp;</b> | !! %%%", "▁ mark", "\x00 nul"]


def documents(spark, rows):
    """``rows``: (doc_id, text[, source[, lang]])."""
    full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", 1, "x", "y", "z", "w", "v", "u") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd(spark):
    """Odd texts, a repeated row, a null doc_id, a null source."""
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)]
    return documents(spark, [*rows, (3, "one"), (100, "one"), (None, "no id"), (101, "no source", None, None)])


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, key="doc_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r)
    return out
