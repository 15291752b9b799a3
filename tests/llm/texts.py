"""Small documents for the tests: prose, copies, near copies, odd texts."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns an input may have besides; their names clash with those the operators make or use inside.
CLASHING = ("size", "score", "row", "slot", "shard", "doc", "hash", "kept", "node", "root", "key", "sign", "sketch", "range", "level", "TARGET")


def prose(seed, n, vocabulary=400, stem="w"):
    r = random.Random(seed)
    return " ".join(f"{stem}{r.randrange(vocabulary)}" for _ in range(n))


def odd_rows():
    """Null, empty, blank, very long, repeated rows and repeated ids, null ids, nulls in every column."""
    long = prose(1, 30_000)
    same = prose(2, 50)
    return [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \t\n\r\x0b\x0c", None, None, 6), (4, long, "en", "b", len(long)),
        (5, same, "en", "a", len(same)), (5, same, "en", "a", len(same)), (6, same, "de", "b", len(same)), (6, "other words here", "de", None, 16),
        (None, same, None, None, None), (None, None, None, None, None), (7, "one", "en", "a", 3), (8, "É ß 𝄞 naïve x", "fr", "c", 14),
    ]


def frame(spark, rows, clashing=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if clashing:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHING)])
    return df


def bag(df):
    return sorted(map(repr, df.collect()))
