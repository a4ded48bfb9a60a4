"""Small tables with every awkward case: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def awkward_rows():
    rng = random.Random(3)
    long = " ".join(words(rng, 30000, 10**6))
    base = words(rng, 120)
    near = base[:60] + ["changed"] + base[61:]
    passage = " ".join(words(rng, 70))
    rows = [
        (1, None), (2, ""), (3, "word"), (4, " \n\t "), (5, long), (6, " ".join(base)), (7, " ".join(near)), (8, " ".join(base)), (6, " ".join(base)),
        (None, "a text without an id " * 5), (None, None), (9, "start " + passage + " end"), (10, passage), (11, "a b c " * 60), (12, "a b c " * 60),
        (13, "été À Ñ 😀 ▁ mixed"), (14, "same words"), (15, "Same WORDS"), (16, "x\ny\nx\n\nx"),
    ]
    return [(i, t, "en" if i != 13 else None, "src0", len(t or "")) for i, t in rows]


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


def clashing(df):
    """The table with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    for name in ("copy", "spans", "block", "symbol", "at", "n", "x", "k", "items", "bands", "found", "score", "ids", "rep", "component", "kept"):
        df = df.withColumn(name, F.lit("extra"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
