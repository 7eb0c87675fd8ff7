"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tmloom.operators.scale import materialize


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``root``) for every node of an edge: root is the smallest node reachable.

    ``edges`` has two columns of one type.  Alternating large and small stars:
    every round links the larger neighbours of a node, then the smaller ones,
    to the smallest; the number of rounds grows with the logarithm of a
    component.  Each round is one written table of at most as many edges.
    """
    a, b = (F.col(c) for c in edges.columns)
    current = materialize(
        edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(),
        "edges",
    )
    state = None
    while True:
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        state = now
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = (
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        ).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        current = materialize(
            small.select("a", F.col("m").alias("b"))
            .unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
            .distinct(),
            "edges",
        )
