"""Small fixtures with the awkward cases: nulls, empty and long texts, repeats, clashing columns."""

from pyspark.sql import types as T

LONG = "lorem ipsum, dolor's 12 3456 sit\n amet  élan €uro " * 400

TEXTS = [
    (1, "The quick brown fox.\nIt's 42 o'clock!\n"),
    (2, ""),
    (3, None),
    (4, LONG),
    (5, LONG),
    (5, LONG),
    (None, "no id"),
    (6, " \t\n\v\f\r "),
    (7, "a" * 5000),
    (8, "x's'RE've   tail  \n\n  DON'T <|endoftext|> ümläut"),
    (9, "one two three one two three one two three\none\none\n \n#$%|"),
]

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("n_tokens", T.StringType()),  # clashes with outputs
        T.StructField("Measured", T.StringType()),
        T.StructField("failed", T.LongType()),
    ]
)


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "x", None, 7) for i, t in texts], DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)
