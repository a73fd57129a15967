"""Small tables for the text operators, with every odd case in one place, and plain versions of what they compute."""

import random
import re

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)"""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOC)


def prose(n, seed=1, vocabulary=400):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = prose(60_000, 7, 5000)
    return [
        (1, None, None), (2, "", "a"), (3, " \t\n", "a"), (4, "same text", "b"), (5, "same  text", "b"), (5, "same  text", "b"),
        (6, long, "b"), (7, long + " end", "c"), (None, "same text", "c"), (None, "without an id", None), (8, "One two.", "d"),
        (9, "one two.", "d"), (10, prose(80, 3), "d"), (10, prose(90, 4), "d"),
    ]


def clash(df, *names):
    """The table with more columns, whose names operators use themselves."""
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit(f"own {n}").alias(n) for n in names))
