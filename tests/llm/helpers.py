"""Small document tables with the cases that every operator must bear."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """rows: (doc_id, text, source)"""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


def words(n, start=0):
    return " ".join(f"word{i}" for i in range(start, start + n))


def awkward(spark):
    """Null, empty and blank texts, null sources, repeated rows, a very long text and one without a key."""
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n\t ", None), (4, "one two three", "a"), (4, "one two three", "a"), (5, words(20_000), "b"),
            (6, "Ünïcode text \U0001f600 ok", None), (None, "no key here at all", "c"), (7, "x" * 50_000, "c")]
    return documents(spark, rows)


def empty(spark):
    return documents(spark, [])


def with_clashes(df, *names):
    """The table with extra columns of the given names."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("clash") for n in names})
