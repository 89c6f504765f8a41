"""Connected components of an edge table by alternating large and small stars; nothing is gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearbox.session import discard, written


def connected_components(edges: DataFrame) -> DataFrame:
    """node, label for each node of edges (a, b: long); label is the least node of the component.

    Every round points each node's larger neighbours at its least neighbour, then its smaller ones; rounds end when the
    edges no longer change, after about log(nodes) squared rounds at worst. Each round starts from a written table, and
    removes the one before.
    Self-loops and repeated edges are allowed, null ends are not.
    """
    e = written(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter(F.col("u") != F.col("v")).distinct(),
        "components",
    )
    before = None
    while (now := signature(e)) != before:
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e, old = written(small.filter("u != v").distinct(), "components"), e
        discard(old)
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def signature(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
