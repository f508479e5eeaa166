"""Connected components of links held in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import materialise


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(a, b) links -> (node, component): the smallest node that each can reach.

    Alternating large-star and small-star rounds until nothing changes; each round is
    written to the shared folder. Minima are aggregated before the shuffle, so a node
    with very many links costs one row a task. Only nodes that are larger than their
    component have a row. Self-links and null ends are ignored.
    """
    a, b = F.col("a"), F.col("b")
    now = materialise(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), tag)

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()

    seen = mark(now)
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("x")).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m")
        small = large.join(low, F.col("u") == F.col("x")).where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialise(small.union(low.select("x", "m")).distinct(), tag)
        found = mark(now)
        if found == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = found
