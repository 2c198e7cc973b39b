"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): every node that has an edge with the smallest node it can reach.

    ``edges`` has two columns of one type, in any order and number; loops and rows with nulls count as no
    edge. Each step is stored in the shared folder, so a lost executor costs one step at most. The number
    of steps grows with the logarithm of the longest chain.
    """
    a, b = edges.columns
    high, low = F.greatest(F.col(a), F.col(b)), F.least(F.col(a), F.col(b))
    pairs = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    pairs = materialize(pairs.select(high.alias("u"), low.alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old = pairs
        pairs = materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).union(least).distinct(), "edges")
        drop_stored(old)
        mark = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
