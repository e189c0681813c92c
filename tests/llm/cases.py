"""Documents that are awkward in every way the operators have to bear."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that the operators use themselves.
        T.StructField("n_words", T.StringType()),
        T.StructField("bucket", T.StringType()),
    ]
)

LONG = " ".join(f"w{k % 977} x{k % 31}y" for k in range(20_000))
TEXTS = [
    None,
    "",
    "   \n\t ",
    "word",
    "one two three four five six seven",
    "One TWO three four five six seven",
    "one two three four five six seven",
    "a b c a b c a b c\nline\nline\n\nline",
    "sign&&& *** ### $1 <|endoftext|> |x|",
    "héllo ÀÉÎ ß 漢字 🙂 \x00\x1c\x85 é",
    LONG,
    LONG,
    LONG[: len(LONG) // 2] + " changed words here",
]


def awkward(spark):
    rows = [
        (k if k != 3 else None, text, None if k % 4 == 0 else "en", None if k % 5 == 0 else f"s{k % 2}", 7, "n", None)
        for k, text in enumerate(TEXTS)
    ]
    return spark.createDataFrame([*rows, rows[5], rows[5]], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
