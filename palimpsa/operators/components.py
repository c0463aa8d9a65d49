"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .recovery import cut


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` for every node of an undirected link table.

    The component id is the smallest node id. Rounds of large-star (each
    larger neighbour points at the smallest) and small-star (each smaller
    neighbour points at the smallest) need O(log^2 n) passes over the links. Neighbour sets
    are only ever reduced to their minimum, with partial aggregation, so a
    node with very many links never gathers in a task. Null and self links
    are ignored; repeated links count once; an empty table gives none.
    """
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    edges = cut(
        links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"), u.alias("x"), v.alias("y"))
        .filter(F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col("u") != F.col("v")))
        .select("u", "v")
        .distinct()
    )
    before = _state(edges)
    while before[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        lows = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(lows, "u")
            .filter((F.col("v") > F.col("u")) & (F.col("v") != F.col("m")))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u")
        edges = cut(
            small.filter(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(lows.select("u", F.col("m").alias("v")))
            .distinct()
        )
        after = _state(edges)
        if after == before:
            break
        before = after
    members = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.union(roots)
